"""Benchmark decontamination by templates.

Words, and single characters of scripts without blanks, become template tokens: numbers, units and names turn into typed
placeholders, all else is folded to lower case. Windows of ``WINDOW`` template
tokens are hashed and joined with those of the benchmark; a second time with names as
folded words, which match in any case. Items with windows of too
few literal words are also searched word for word: windows of ``WINDOW`` words,
numbers and signs as they stand. The matched windows of a document and an item are aligned, and their slots checked. Windows whose values all
equal the item's count as copied. Windows with other values count if each value of
the item has become the value that stands for it at most of its places, as in a
question asked anew with other numbers, names and units; a value that became several
ones equally often stands for none.

Nulls and edges: null or empty texts and items have no windows. Items shorter than a
window are one window of their own length; items of fewer than ``LITERALS`` words,
numbers and signs together say too little and are not searched. Rows of equal id and text are one
document. Rows without id are told apart by their text. Empty tables give no leaks.
Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import GOLDEN, mix, multipliers, slices
from corpusguard.session import materialized

WINDOW = 8
LITERALS = 4
#: An item leaks with half of its windows, or with this many, about twenty words.
SHARE, ENOUGH = 0.5, 13
FILTER_BITS = 23
#: Words a worker keeps, about 200 bytes each with their keys, and the bytes of text that it takes up at a time.
CACHED_WORDS, TAKEN = 200_000, 1 << 18
NUMBER, UNIT, NAME = (np.uint64(k) for k in (1, 2, 3))
#: Kinds of words without a placeholder, and the bit that tells the end of a sentence.
SIGN, PLAIN, ENDS = 0, 4, 8
#: Forms of a text: by templates, by templates with names as words, and word for word.
TEMPLATE, FOLDED, VERBATIM = range(3)
ORDER = multipliers(WINDOW, 3)
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|~^_=+/\\-«»“”„‘’…–—¿¡"
DIGIT_LETTER = re.compile(r"\d(?=[^\W\d_])")
#: Thai, Lao, Burmese, Khmer, kana, and Chinese characters.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
NUMERIC = re.compile(r"[+-]?\d[\d.,:/]*")
#: Number words and units.
NUMBERS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
    seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split())
UNITS = frozenset("""mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs oz pound pounds ton tons ml l liter liters litre
    litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros
    cent cents percent degree degrees meter meters metre metres kilometer kilometers gram grams kilogram kilograms km/h mph""".split())


def apart(text: str) -> str:
    """``text`` with each character of a script that writes no blanks between words as a word of its own."""
    return text if text.isascii() or not UNSPACED.search(text) else UNSPACED.sub(r" \g<0> ", text)


class Templates(dict):
    """Numbers of known words. By number there are the value, the word as it stands (folded, numbers with their minus, signs
    that are no words too), and the kind of its template, with ENDS if a sentence ends: a few bytes a word."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.value, self.verbatim, self.kind = array("Q"), array("Q"), bytearray()

    def __missing__(self, chunk: str) -> int:
        word = chunk.strip(EDGES)
        low = word.lower()
        value = xxhash.xxh3_64_intdigest(low.encode())
        if not word:
            kind = SIGN
        elif (word[0] in "+-" or word[0].isdecimal()) and NUMERIC.fullmatch(word) or low in NUMBERS:
            kind = int(NUMBER)
        elif low in UNITS:
            kind = int(UNIT)
        elif len(word) > 1 and word[0].isupper() and word[1:].islower():
            kind = int(NAME)
        else:
            kind = PLAIN
        signed = "-" + low if word[:1].isdigit() and "-" + word in chunk else low or chunk
        self.verbatim.append((value if signed == low else xxhash.xxh3_64_intdigest(signed.encode())) | 8)
        self.value.append(value if word else 0)
        self.kind.append(kind | ENDS if chunk.rstrip("\"')]»”").endswith((".", "!", "?")) else kind)
        self[chunk] = number = len(self.kind) - 1
        return number

    def read(self, texts: list[str]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Tokens and values of each text in each form."""
        if len(self) > CACHED_WORDS:
            self.forget()
        split = [DIGIT_LETTER.sub(r"\g<0> ", apart(t)).split() if t else () for t in texts]
        starts = [0, *accumulate(map(len, split))]
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, starts[-1])
        # copies by place: the growing arrays themselves are not held
        value, verbatim = np.frombuffer(self.value, np.uint64)[at], np.frombuffer(self.verbatim, np.uint64)[at]
        kind = np.frombuffer(self.kind, np.uint8)[at]
        first = np.concatenate([[True], kind[:-1] >= ENDS])[:len(at)]
        first[[s for s in starts if s < len(at)]] = True
        kind &= ENDS - 1
        plain = value | np.uint64(8)
        start = np.where(kind >= NAME, plain, kind)
        inside = np.where((kind == PLAIN) | (kind == NAME) & first, plain, kind)
        return [[without_runs(inside[s:e], value[s:e]), without_runs(start[s:e], value[s:e]), (verbatim[s:e], value[s:e])]
                for s, e in zip(starts, starts[1:])]


def without_runs(token: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and values without signs, and with one placeholder for several equal ones in a row, whose value is that of
    them all in their order."""
    real = token != 0
    token, values = token[real], values[real]
    again = (token[1:] == token[:-1]) & (token[1:] <= NAME)
    if not again.any():
        return token, values
    starts = np.flatnonzero(np.concatenate([[True], ~again]))
    lengths = np.diff(np.append(starts, len(token)))
    place = np.arange(len(token)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        together = np.add.reduceat(mix(values + (place + 1).astype(np.uint64) * GOLDEN), starts)
    return token[starts], np.where(lengths == 1, values[starts], together)


#: Kept by a worker from task to task.
KNOWN = Templates()


def windows(tokens: np.ndarray, size: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` tokens of a form, and whether it has enough words besides placeholders."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        sums = np.full(n, np.uint64(size + (form << 8)) * GOLDEN, np.uint64)
        mixed = mix(tokens)
        for i in range(size):
            sums += mixed[i:i + n] * ORDER[i]
    words = np.concatenate([[0], np.cumsum(tokens > NAME)])
    return mix(sums), words[size:] - words[:-size] >= LITERALS


def slots(tokens: np.ndarray, values: np.ndarray, at: int, size: int) -> list[int]:
    """Values of the placeholders of a window, as signed numbers."""
    inside = slice(at, at + size)
    return values[inside][tokens[inside] <= NAME].astype(np.int64).tolist()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per alignment the places of windows with the item's values, and of those whose other values are consistent."""
    for batch in batches:
        exact, changed = [], []
        for places, values, size in zip(*(batch.column(c) for c in ("places", "values", "size"))):
            at, votes = defaultdict(list), Counter()
            for v in values.as_py():
                at[v["spot"]].append((v["item"], v["doc"]))
                votes[v["item"], v["doc"]] += 1
            became, most = {}, Counter()
            for (item, doc), n in votes.items():
                if n >= most[item]:
                    became[item] = doc if n > most[item] else None
                    most[item] = n
            equal, other = [], []
            for p in places.as_py():
                own = [v for s in range(p, p + size.as_py()) for v in at.get(s, ())]
                if all(item == doc for item, doc in own):
                    equal.append(p)
                elif all(became[item] == doc for item, doc in own):
                    other.append(p)
            exact.append(equal)
            changed.append(other)
        names = ["doc_id", "h", "item_id", "form", "n"]
        places = [pa.array(c, pa.list_(pa.int64())) for c in (exact, changed)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + places, [*names, "exact", "changed"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, form, n (windows of the item), size, key, place, slots, spots (places of the slots in the item)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusguard.llm.decontaminate import KNOWN as templates
        for batch in slices(batches, limit=TAKEN):
            rows = []
            for item, forms in zip(batch.column("item_id").to_pylist(), templates.read(batch.column("text").to_pylist())):
                whole = False
                for form, (tokens, values) in enumerate(forms):
                    size = min(WINDOW, len(tokens))
                    if whole or not size:
                        continue
                    keys, good = windows(tokens, size, form)
                    whole = form == FOLDED and bool(good.all())
                    places = np.flatnonzero(good)
                    rows += [(item, form, len(places), size, int(keys[p].astype(np.int64)), int(p), slots(tokens, values, p, size),
                              (p + np.flatnonzero(tokens[p:p + size] <= NAME)).tolist()) for p in places]
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["item_id", "form", "n", "size", "key", "place", "slots", "spots"])

    return benchmark.select("item_id", "text").mapInArrow(cut, "item_id long, form int, n long, size int, key long, place long, slots array<long>, spots array<long>")


def window_filter(items: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A bit per value of the first FILTER_BITS bits of a key, 1 MB whatever the benchmark's size, and the forms and window sizes."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bits = items.groupBy((F.shiftright(place, 6)).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).collect()
    table = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for row in bits:
        table[row["word"]] = row["bits"]
    sizes = sorted((r["form"], r["size"]) for r in items.select("form", "size").distinct().collect())
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool), sizes


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), item_id, kind (copy or new values), matched, of_windows: one row per leak.

    Documents are read once, in place; only windows that pass the filter travel. The
    join with the benchmark is exact and as wide as the shuffle.
    """
    items = materialized(benchmark_windows(benchmark), "items")
    bits, sizes = window_filter(items)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusguard.llm.decontaminate import KNOWN as templates
        known = np.unpackbits(shared.value).astype(bool)
        for batch in slices(batches, limit=TAKEN):
            rows = []
            for row, forms in enumerate(templates.read(batch.column("text").to_pylist())):
                for form, size in sizes:
                    tokens, values = forms[form]
                    keys, good = windows(tokens, size, form)
                    for p in np.flatnonzero(good & known[keys >> np.uint64(64 - FILTER_BITS)]):
                        rows.append((row, form, size, int(keys[p].astype(np.int64)), int(p), slots(tokens, values, p, size)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(columns[0], pa.int64())) for c in ("doc_id", "h")] + [pa.array(c, t) for c, t in zip(columns[1:], types)],
                ["doc_id", "h", "form", "size", "key", "doc_place", "doc_slots"])

    hits = (docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
            .mapInArrow(probe, "doc_id long, h long, form int, size int, key long, doc_place long, doc_slots array<long>"))
    pairs = hits.join(items, ["form", "size", "key"])
    values = F.transform(F.arrays_zip("spots", "slots", "doc_slots"), lambda z: F.struct(
        z["spots"].alias("spot"), z["slots"].alias("item"), z["doc_slots"].alias("doc")))
    aligned = (pairs.groupBy("doc_id", "h", "item_id", "form", "n", "size", (F.col("doc_place") - F.col("place")).alias("shift"))
               .agg(F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set(values))).alias("values")))
    found = (aligned.mapInArrow(counted, "doc_id long, h long, item_id long, form int, n long, exact array<long>, changed array<long>")
             .groupBy("doc_id", "h", "item_id", "form", "n")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.concat("exact", "changed"))))).cast("long").alias("matched"),
                  F.every(F.size("changed") == 0).alias("copy")))
    needed = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * SHARE), F.lit(ENOUGH)))
    kind = F.when(F.col("copy"), "copy").otherwise("new values").alias("kind")
    # the first form that tells a leak names it
    return (found.where(F.col("matched") >= needed).groupBy("doc_id", "h", "item_id")
            .agg(F.min(F.struct("form", kind, "matched", F.col("n").alias("of_windows"))).alias("best"))
            .select("doc_id", "h", "item_id", "best.kind", "best.matched", "best.of_windows"))
