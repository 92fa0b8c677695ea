"""Language identification by nearest centroid.

Texts become vectors of hashed n-grams of folded bytes, weighted by TF-IDF and
scaled to length one. Each language has several centroids, found by spherical
k-means, and a text takes the language of the centroid with the largest cosine.
A text farther from its centroid than nearly all texts learned from and their pieces, of
that centroid and about that length is rejected.

Nulls and edges: a null text, an empty one or one without a letter is ``und`` with
score 0 and is rejected. Rows whose language or text is null teach nothing, nor do
rows without id, whose fold is unknown. With nothing to learn from, all is ``und``.
Repeated rows are predicted each. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import slices

DIMS = 4096
GRAMS = (1, 2, 3)
ROWS = 64
#: Vectors are summed in whole numbers of this part of one, up to 2^33 of them.
ONE = float(1 << 30)
#: The rounds end when all centres keep at least this cosine.
STILL = 1 - 1e-4
#: Cosines are counted in steps of this part of one, downwards, so the counts of a band and centroid are bounded.
STEPS = 1 << 12
#: Length bands: binary logarithms of the number of n-grams, the last band without end.
BANDS = 14
#: So many cosines of a centroid in a band tell its floor; with fewer the language's do.
MEMBERS = 50
LETTER = regex.compile(r"\p{L}")
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[[i for i in range(128) if not chr(i).isalpha()]] = 32
PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass(frozen=True)
class LanguageModel:
    """Weights per n-gram, unit centroids by row, and per centroid its language and least accepted cosine per length band."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    floors: np.ndarray


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed n-grams, one row per text. N-grams of blanks alone share three places that have no weight."""
    parts = [b" " + (t or "").lower().encode() + b"  " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    data = FOLDED[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
    keys = np.zeros((len(GRAMS), len(data)), np.uint16)
    for row, n in zip(keys, GRAMS):
        row[:len(data) - n + 1] = gram_keys([data[i:len(data) - n + 1 + i] for i in range(n)])
    counts = np.empty((len(parts), DIMS), np.float32)
    for i, (lo, hi) in enumerate(zip(ends - [len(p) for p in parts], ends - 2)):
        counts[i] = np.bincount(keys[:, lo:hi].ravel(), minlength=DIMS)
    return counts


def gram_keys(parts: list[np.ndarray]) -> np.ndarray:
    """Places below DIMS of n-grams, given as one array per position."""
    key = np.full(len(parts[0]), len(parts) * 40503, np.uint32)
    for part, prime in zip(parts, PRIMES):
        key += part * prime
    key *= np.uint32(2654435769)
    return key >> np.uint32(33 - DIMS.bit_length())


BLANKS = [int(gram_keys([np.full(1, 32, np.uint32)] * n)[0]) for n in GRAMS]


def batches_of(column: pa.Array) -> Iterator[list[str | None]]:
    texts = column.to_pylist()
    for i in range(0, len(texts), ROWS):
        yield texts[i:i + ROWS]


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.sqrt(counts) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def bands(counts: np.ndarray) -> np.ndarray:
    """Length band of each text, by its n-grams that have weight."""
    held = counts.sum(axis=1) - counts[:, BLANKS].sum(axis=1)
    return np.clip(np.log2(np.maximum(held, 1)).astype(np.int64), 0, BANDS - 1)


def pieces(text: str) -> list[str]:
    """The text and a piece of it per length band, each at a place and of a length that only the text decides."""
    out, size = [text], 1
    while size < len(text) and size < 1 << BANDS:
        pick = zlib.crc32(text.encode(), size)
        length = min(size + pick % size, len(text))
        at = (pick >> 8) % (len(text) - length + 1)
        out.append(text[at:at + length])
        size *= 2
    return [t for i, t in enumerate(out) if i == 0 or LETTER.search(t)]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that have each hashed n-gram, over all rows; the answer has DIMS numbers whatever the input."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(DIMS, np.int64), 0
        for batch in slices(batches):
            for texts in batches_of(batch.column("text")):
                seen += (term_counts(texts) > 0).sum(axis=0)
                rows += len(texts)
        if rows:
            yield pa.RecordBatch.from_pydict({"gram": np.arange(-1, DIMS), "n": np.concatenate([[rows], seen])})

    sums = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(DIMS + 1, np.int64)
    for row in sums:
        seen[row["gram"] + 1] = row["n"]
    return seen[1:], int(seen[0])


def vectors_of(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[str, np.ndarray, list[int]]]:
    """lang, unit vectors of texts with weight, and numbers that tell their texts apart, some rows at a time."""
    for batch in slices(batches):
        langs, at = np.asarray(batch.column("lang").to_pylist(), object), 0
        for texts in batches_of(batch.column("text")):
            unit = weighted(term_counts(texts), idf)
            held = np.abs(unit).sum(axis=1) > 0
            named = langs[at:at + len(texts)]
            at += len(texts)
            for lang in dict.fromkeys(named):
                rows = np.flatnonzero(held & (named == lang))
                if len(rows):
                    yield lang, unit[rows], [zlib.crc32(texts[i].encode()) for i in rows]


def summed(docs: DataFrame, idf: np.ndarray, centres: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per language and centre, the sum of the vectors nearest to it, over all rows of ``docs``.

    Each task sends one row per language and centre. Components are added as whole numbers of 2^-30, so that the sums are
    the same in whatever order they are added.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for lang, unit, _ in vectors_of(batches, idf):
            own = centres.get(lang)
            near = np.zeros(len(unit), np.int64) if own is None else (unit @ own.T).argmax(axis=1)
            total = sums.setdefault(lang, np.zeros((1 if own is None else len(own), DIMS), np.int64))
            whole = np.rint(unit * np.float32(ONE)).astype(np.int64)
            for c in np.unique(near):
                total[c] += whole[near == c].sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(total), "c": list(range(len(total))), "v": [t.tobytes() for t in total]})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(DIMS, np.int64)
        for v in group["v"]:
            total += np.frombuffer(v, np.int64)
        return pd.DataFrame({"lang": [key[0]], "c": [key[1]], "v": [total.tobytes()]})

    parts = docs.select("lang", "text").mapInArrow(add, "lang string, c long, v binary")
    rows = parts.groupBy("lang", "c").applyInPandas(merge, "lang string, c long, v binary").collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        own = centres.get(r["lang"])
        total = out.setdefault(r["lang"], np.zeros((1 if own is None else len(own), DIMS)))
        total[r["c"]] = np.frombuffer(bytes(r["v"]), np.int64) / ONE
    return out


def farthest(docs: DataFrame, idf: np.ndarray, centres: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per language, the vector farthest from all its centres, over all rows; of equal ones that of the least checksum."""
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}
        for lang, unit, marks in vectors_of(batches, idf):
            near = (unit @ centres[lang].T).max(axis=1)
            for i in np.flatnonzero(near == near.min()):
                found = (round(float(near[i]), 5), marks[i], unit[i].tobytes())
                best[lang] = min(best.get(lang, found), found)
        if best:
            yield pa.RecordBatch.from_pydict({"lang": list(best), "cosine": [b[0] for b in best.values()],
                                              "mark": [b[1] for b in best.values()], "v": [b[2] for b in best.values()]})

    rows = docs.select("lang", "text").mapInArrow(least, "lang string, cosine double, mark long, v binary")
    first = rows.groupBy("lang").agg(F.min(F.struct("cosine", "mark", "v")).alias("b")).collect()
    return {r["lang"]: np.frombuffer(bytes(r["b"]["v"]), np.float32) for r in first}


def unit_rows(sums: np.ndarray) -> np.ndarray:
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def clustered(docs: DataFrame, idf: np.ndarray, clusters: int, rounds: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Centres and the lengths of their texts' sums per language, by spherical k-means over all rows of ``docs``.

    The first centre of a language is its mean, the others the texts farthest from those chosen. The rounds end when no
    centre moves further than ``STILL``. A round sends one vector per task, language and centre.
    """
    centres = {lang: unit_rows(total) for lang, total in summed(docs, idf, {}).items()}
    for _ in range(clusters - 1 if centres else 0):
        for lang, v in farthest(docs, idf, centres).items():
            if (centres[lang] @ v).max() < 1 - 1e-5:
                centres[lang] = np.vstack([centres[lang], v])
    sums: dict[str, np.ndarray] = {}
    for _ in range(rounds if centres else 0):
        sums = summed(docs, idf, centres)
        # a centre that is nearest to no text stays
        moved = {lang: np.where(np.abs(total).sum(axis=1, keepdims=True) > 0, unit_rows(total), centres[lang]) for lang, total in sums.items()}
        still = all((moved[lang] * centres[lang]).sum(axis=1).min() >= STILL for lang in moved)
        centres = moved
        if still:
            break
    return centres, {lang: np.linalg.norm(total, axis=1) for lang, total in sums.items()}


def fit_languages(docs: DataFrame, clusters: int = 3, rounds: int = 12, max_langs: int = 256, quantile: float = 0.01, slack: float = 0.8) -> LanguageModel:
    """Learn from all rows of ``docs`` (doc_id, text, lang) that have text and lang.

    Document frequencies, centroids and floors are taken over every row, each in passes that
    send sums or counts of fixed size. A centroid accepts cosines from ``slack`` times the
    ``quantile`` of those that the texts nearest to it, and pieces of them, have in each
    length band, each text compared with the centroid of the others; so short texts of a
    known language, which are far from every centroid, stay, and single odd texts decide
    nothing. More than ``max_langs`` languages raise, as the column then holds no languages.
    """
    known = docs.select("text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    seen, rows = document_frequencies(known)
    idf = (np.log((1 + rows) / (1 + seen)) + 1).astype(np.float32)
    idf[BLANKS] = 0
    if known.select("lang").distinct().limit(max_langs + 1).count() > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    centres, mass = clustered(known, idf, clusters, rounds)
    langs = tuple(lang for lang in sorted(centres) for _ in centres[lang])
    flat = np.vstack([np.zeros((0, DIMS), np.float32)] + [centres[lang] for lang in sorted(centres)])
    cosines = own_cosines(known, idf, flat, langs, np.concatenate([np.zeros(0)] + [mass[lang] for lang in sorted(centres)]))
    return LanguageModel(idf, flat, langs, slack * floors_of(cosines, langs, quantile))


def own_cosines(docs: DataFrame, idf: np.ndarray, centroids: np.ndarray, langs: tuple[str, ...], mass: np.ndarray) -> DataFrame:
    """band, lang, centroid, cosine: of each text and its pieces to the nearest centroid of its language.

    ``mass`` is the length of the sum of a centroid's texts: the text itself is taken out of its centroid.
    """
    own = {lang: np.flatnonzero([x == lang for x in langs]) for lang in langs}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in own or not LETTER.search(text):
                    continue
                counts = term_counts(pieces(text))
                unit = weighted(counts, idf)
                cosines = unit @ centroids[own[lang]].T
                c = cosines[0].argmax()
                whole = mass[own[lang][c]]
                rest = whole * whole - 2 * whole * cosines[0, c] + 1
                cosines[:, c] = (whole * cosines[:, c] - unit @ unit[0]) / np.sqrt(rest) if rest > 1e-3 else -1
                near = cosines.argmax(axis=1)
                best = cosines[np.arange(len(near)), near]
                out += [r for r in zip(bands(counts).tolist(), [lang] * len(near), own[lang][near].tolist(), best.tolist()) if r[3] > -1]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.string(), pa.int32(), pa.float64()])],
                                             ["band", "lang", "centroid", "cosine"])

    return docs.select("lang", "text").mapInArrow(compare, "band int, lang string, centroid int, cosine double")


def floors_of(cosines: DataFrame, langs: tuple[str, ...], quantile: float) -> np.ndarray:
    """Low quantile of the cosines by centroid and band: of the centroid, else of its language, else of all, else of the band below."""
    counted = (cosines.groupBy("band", "lang", "centroid", (F.floor(F.col("cosine") * STEPS) / STEPS).alias("cosine"))
               .agg(F.count(F.lit(1)).alias("rows")))
    told = {(r["band"], r["lang"], r["centroid"]): r["floor"] for r in
            counted.rollup("band", "lang", "centroid").agg(F.percentile("cosine", F.lit(quantile), F.col("rows")).alias("floor"), F.sum("rows").alias("n"))
            .where(F.col("band").isNotNull() & (F.col("lang").isNull() | (F.col("n") >= MEMBERS))).collect()}
    floors = np.zeros((len(langs), BANDS))
    for c, lang in enumerate(langs):
        for b in range(BANDS):
            below = floors[c, b - 1] if b else 0.0
            floors[c, b] = next((told[k] for k in ((b, lang, c), (b, lang, None), (b, None, None)) if k in told), below)
    return floors


def predict_languages(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (cosine), rejected, and the columns named in ``keep``."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, lang, score, out = batch.column("text").to_pylist(), [], [], []
            for part in batches_of(batch.column("text")):
                if not len(model.langs):
                    lang += ["und"] * len(part)
                    score += [0.0] * len(part)
                    out += [True] * len(part)
                    continue
                counts = term_counts(part)
                cosines = weighted(counts, model.idf) @ model.centroids.T
                best = cosines.argmax(axis=1)
                for text, b, row, floor in zip(part, best, cosines, model.floors[best, bands(counts)]):
                    known = text is not None and LETTER.search(text) is not None
                    lang.append(model.langs[b] if known else "und")
                    score.append(min(1.0, max(0.0, float(row[b]))) if known else 0.0)
                    out.append(not known or float(row[b]) < floor)
            done = pa.RecordBatch.from_pydict({
                "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(out, pa.bool_())})
            names = ["doc_id", *keep]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + done.columns, [*names, *done.schema.names])

    kept = ["doc_id", *keep]
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(predict, f"{schema}, lang_pred string, score double, rejected boolean")
