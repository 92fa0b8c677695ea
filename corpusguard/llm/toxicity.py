"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes disguises: look-alike letters of other alphabets, accents, full-width
forms and digits that stand for letters become plain letters, invisible characters go,
and what is not a letter is a blank. The lexicon is learned from labelled texts: words
and beginnings of words whose share of toxic texts is far above the mean, in each of
two halves of the sample. A match inside an exception phrase, a neighbour pair that
toxic texts do not have more often than others, does not count. The weights of the
matches are summed, taken relative to the length of the text and turned into a
probability by a logistic curve fitted on the same sample.

Nulls and edges: a null text is empty and, like any text without a match, has the
score of no match. Rows without id or label teach nothing; of several labels of an id
the highest counts. Without labels of both kinds the lexicon is empty and every score
is the share of toxic labels, 0 if there are none. Repeated rows are scored each. Other
columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import slices

#: Look-alikes and the letter each stands for; l, 1 and | are read as i throughout.
LOOKALIKES = dict(zip("аеорсхуіѕјкмтвнԁɡοανρτυικεβᴉıɪᴀʙᴄᴅᴇɢʜᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢ", "aeopcxyisjkmtbhdgoavptuikebiiiabcdeghjkimnoprtuvwyz"))
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g"}
INVISIBLE = "­​‌‍⁠﻿"
STEMS = (4, 5, 6, 7, 8)
PRIOR = 4.0


class _Folds(dict):
    """One folded character per character, of any script, worked out when it first occurs: without accents, width and
    typographic form, look-alikes and digits as the letters they stand for; marks and invisible signs go, and what is no
    letter is a blank."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        if char in INVISIBLE or unicodedata.category(char).startswith("M"):
            fold = None
        else:
            base = unicodedata.normalize("NFKD", char)[:1].lower()[:1]
            base = SUBSTITUTES.get(base, LOOKALIKES.get(base, base))
            fold = base if base.isalpha() else " "
        self[code] = fold
        return fold


FOLDS = _Folds()


def folded(text: str | None) -> str:
    """Words of folded letters with one blank on either side."""
    return f" {' '.join((text or '').translate(FOLDS).split())} "


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by entry (a blank, letters, and a blank if it is a whole word), exception phrases, and the logistic curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for entry in weights:
            self.automaton.add_word(entry, (len(entry), entry, False))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), phrase, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, str]]:
        """Start and entry of each match in folded text outside exception phrases."""
        if not len(self.automaton):
            return []
        found, spared = [], set()
        for end, (size, entry, exception) in self.automaton.iter(text):
            start = end - size + 1
            if exception:
                spared.update(i for i in range(start, end) if text[i] == " ")
            else:
                found.append((start, entry))
        return [(s, e) for s, e in found if s not in spared]

    def values(self, text: str) -> tuple[float, float]:
        """Sum of the weights, each entry's repetitions counting less and less, and the sum relative to the length."""
        counts = Counter(e for _, e in self.hits(text))
        total = sum(self.weights[e] * math.log2(1 + n) for e, n in counts.items())
        return total, total / math.sqrt(text.count(" "))


def weight(toxic: float, clean: float, share: float) -> float:
    """Log-odds of toxic texts among those with an entry, less the log-odds of all, drawn to 0 by PRIOR texts."""
    rate = (toxic + PRIOR * share) / (toxic + clean + PRIOR)
    return math.log(rate / (1 - rate)) - math.log(share / (1 - share))


def chosen(rows: list, share: float, least: float) -> dict[str, float]:
    """Entries (entry, toxic and clean texts in either half) that both halves confirm; of nested ones the strongest,
    of those equal the longest beginning."""
    good = []
    for r in rows:
        if min(weight(r["ta"], r["ca"], share), weight(r["tb"], r["cb"], share)) >= least:
            good.append((weight(r["ta"] + r["tb"], r["ca"] + r["cb"], share), not r["entry"].endswith(" "), len(r["entry"]), r["entry"]))
    weights: dict[str, float] = {}
    for w, _, _, entry in sorted(good, reverse=True):
        beginnings = [entry[:k] for k in range(2, len(entry) + 1)]
        if not any(b in weights for b in beginnings) and not any(e.startswith(entry.rstrip()) and weights[e] >= w - 0.1 for e in weights):
            weights[entry] = w
    return weights


def fit_logistic(values: np.ndarray, toxic: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Intercept and slopes by Newton's method, with a small penalty on the slopes."""
    x = np.column_stack([np.ones(len(values)), values])
    ridge = np.diag([1e-9] + [penalty] * values.shape[1])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ b)
        b = b + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, entries: int = 2_000, least: float = 2.0) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Bounds: at most ``sample`` labelled ids, those that hash lowest, and at most
    ``entries`` candidates for the lexicon and as many phrases, the strongest. Their
    texts are read whole. The driver holds two numbers per sampled text.
    """
    ids = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("half"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("toxic")).first()
    if not size["toxic"] or size["toxic"] == size["n"]:
        share = size["toxic"] / size["n"] if size["n"] else 0.0
        return ToxicityModel({}, (), (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    share = size["toxic"] / size["n"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=8 << 20):
            counts = {(t, h): Counter() for t in (True, False) for h in (True, False)}
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half"))):
                words = set(folded(text).split())
                counts[toxic, half].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k})
            names = sorted(set().union(*counts.values()))
            yield pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), **{
                c: pa.array([counts[key][e] for e in names], pa.int64()) for c, key in
                (("ta", (True, True)), ("tb", (True, False)), ("ca", (False, True)), ("cb", (False, False)))}})

    sums = rows.mapInArrow(features, "entry string, ta long, tb long, ca long, cb long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("ta", "tb", "ca", "cb")])
    rate = (F.col("ta") + F.col("tb") + PRIOR * share) / (F.col("ta") + F.col("tb") + F.col("ca") + F.col("cb") + PRIOR)
    weights = chosen(sums.where("ta >= 3 AND tb >= 3").orderBy(rate.desc(), F.length("entry").desc(), "entry").limit(entries).collect(), share, least)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for batch in slices(batches, limit=8 << 20):
            counts = {True: Counter(), False: Counter()}
            for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic"))):
                text, seen = folded(text), set()
                for start, _ in matcher.hits(text):
                    word = text.find(" ", start + 1)
                    if start > 0:
                        seen.add(text[text.rfind(" ", 0, start):word + 1])
                    if word + 1 < len(text):
                        seen.add(text[start:text.find(" ", word + 1) + 1])
                counts[toxic].update(seen)
            names = sorted(counts[True].keys() | counts[False].keys())
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(names, pa.string()), "t": pa.array([counts[True][p] for p in names], pa.int64()),
                                              "c": pa.array([counts[False][p] for p in names], pa.int64())})

    harmless = (rows.mapInArrow(phrases, "phrase string, t long, c long").groupBy("phrase").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
                .where(f"c >= 3 AND t <= {share} * (t + c)").orderBy(F.desc("c"), "phrase").limit(entries).collect())
    exceptions = tuple(r["phrase"] for r in harmless)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, exceptions)
        for batch in slices(batches):
            both = [matcher.values(folded(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"total": pa.array([b[0] for b in both], pa.float64()), "dense": pa.array([b[1] for b in both], pa.float64()),
                                              "toxic": batch.column("toxic")})

    known = rows.mapInArrow(values, "total double, dense double, toxic boolean").toPandas()  # at most ``sample`` rows
    curve = fit_logistic(known[["total", "dense"]].to_numpy(), known["toxic"].to_numpy(float))
    return ToxicityModel(weights, exceptions, tuple(float(c) for c in curve))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, n_matches: one row per row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights, model.exceptions)
        b, by_total, by_density = model.curve
        for batch in slices(batches):
            scores, matches = [], []
            for text in batch.column("text").to_pylist():
                text = folded(text)
                total, dense = matcher.values(text)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b + by_total * total + by_density * dense)))))
                matches.append(len(matcher.hits(text)) if total else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(matches, pa.int64())],
                ["doc_id", "score", "predicted", "n_matches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_matches long")
