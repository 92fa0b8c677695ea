"""Column helpers: white space, paths, snippets and keys. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusguard.rules import (
    ALLOWED_EXTENSIONS, COMMENT_MARKERS, IGNORED_SEGMENTS, SUPPRESSION_MARK, W,
)

SNIPPET_LENGTH = 120
SNIPPET_MARK = "... [truncated]"
LINE_BREAK = r"\r?\n"

# The members of the white-space class, for trimming without a pattern: linear in the text.
WHITE_SPACE = "\t\n\v\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_NOT_BLANK = r"[^\t-\r\p{Z}\x{FEFF}]"
# A repository host, its two spellings.
REPO_HOSTS = ("github.com", "www.github.com")


def alternatives(words) -> str:
    """Regex alternation of plain words."""
    special = set(r"\.^$|?*+()[]{}")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def full_trim(c: Column) -> Column:
    """Trim the wide white-space class; Spark's own trim only strips U+0020."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def not_blank(c: Column) -> Column:
    return c.rlike(_NOT_BLANK)


def or_null(c: Column) -> Column:
    """Empty string to null (what an unmatched group yields)."""
    return F.nullif(c, F.lit(""))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    return or_null(F.regexp_extract(c, pattern, group))


def has_word(c: Column, *words: str) -> Column:
    """ASCII whole-word test. The substring test in front skips most texts cheaply, and patterns that begin with the word are searched fast."""
    found = F.lit(False)
    for w in words:
        word = alternatives([w])
        found = found | (c.contains(w) & c.rlike(f"{word}(?<![0-9A-Za-z_]{word})(?![0-9A-Za-z_])"))
    return found


def file_type(path: Column) -> Column:
    """Lower-cased suffix from the last dot of the whole path, else ``unknown``."""
    return F.when(F.instr(path, ".") == 0, F.lit("unknown")).otherwise(
        F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1))))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def in_ignored_directory(path: Column) -> Column:
    segments = F.split(forward_slashes(F.lower(path)), "/")
    return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in IGNORED_SEGMENTS]))


def has_allowed_extension(path: Column, extensions=ALLOWED_EXTENSIONS) -> Column:
    return file_type(path).isin(*extensions)


def split_lines(content: Column) -> Column:
    return F.split(content, LINE_BREAK)


def is_suppressed(line: Column) -> Column:
    return line.contains(SUPPRESSION_MARK)


def is_comment(line: Column) -> Column:
    return line.rlike(rf"^{W}*(?:{alternatives(COMMENT_MARKERS)})")


def snippet(line: Column) -> Column:
    """Trimmed line, cut after 120 characters with a mark."""
    trimmed = full_trim(line)
    return F.when(F.length(trimmed) > SNIPPET_LENGTH,
                  F.concat(F.substring(trimmed, 1, SNIPPET_LENGTH), F.lit(SNIPPET_MARK))).otherwise(trimmed)


def context_window(lines: Column, position: Column, radius: int = 2) -> Column:
    """Lines around the 0-based ``position``, clamped at both ends."""
    first = F.greatest(position - radius, F.lit(0))
    last = F.least(position + radius + 1, F.size(lines))
    return F.array_join(F.slice(lines, first + 1, last - first), "\n")


def fold_path(path: Column) -> Column:
    """Resolve ``.``, ``..`` and empty segments; a ``..`` above the root is ignored."""
    def step(acc: Column, part: Column) -> Column:
        return (F.when(part.isin("", "."), acc)
                .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .otherwise(F.concat(acc, F.array(part))))
    parts = F.split(forward_slashes(path), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def parent_directory(path: Column) -> Column:
    """Everything before the last slash, empty at the top level."""
    return F.regexp_extract(forward_slashes(path), r"^(?s)(.*)/[^/]*\z", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def content_key(c: Column) -> Column:
    """``length:hash`` with the 31-polynomial over UTF-16 units, wrapped to 32 bits."""
    hash_code = F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), c)
    return F.concat(utf16_length(c).cast("string"), F.lit(":"), hash_code)


def digest_key(c: Column) -> Column:
    """Collision-safe alternative to ``content_key``."""
    return F.concat(utf16_length(c).cast("string"), F.lit(":"), F.sha2(c, 256))
