"""Near duplicates by SetSketch registers.

A document is its set of distinct five-word shingles. Each shingle starts a Poisson
process of points that fall on random registers; a register keeps the least point,
as the exponent of a power of ``BASE`` cut to 16 bits. Registers of a union are the
maxima of the registers, and two documents agree in a register with a probability
close to their Jaccard similarity, so groups of registers serve as bands. Pairs
that share a band are estimated from all registers by joint likelihood, with the
exact set sizes, and what may be similar enough is confirmed on the full sets.

Equal sets are one class. Only classes are compared. First each class is compared
with the most central class of each of its buckets, then
with the most central class of the largest component in the bucket. What is left in
different components is compared unless it cannot be linked: signatures in a bucket
are too far apart, or the shingles that many classes hold and the rarer ones that
both classes hold are together too few (``by_rarity``). So a group of thousands of
near copies costs a few comparisons per copy, and no link between components is left
out.

Nulls and edges: a null text is empty; an empty set is linked with nothing. A row
without id cannot be named and is linked with nothing: its component is null and it
is kept. Repeated rows give one result each. Rows that share an id are one document,
so what their texts link to is connected. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import GOLDEN, joined_bytes, mix, multipliers, slices, word_hashes
from corpusguard.llm.components import components
from corpusguard.session import discard, materialized

WORDS = 5
BANDS, PER_BAND = 40, 5
REGISTERS = BANDS * PER_BAND
BASE, RATE, TOP = 1.001, 20.0, 65534
PERCENT = 75
#: A pair is dropped before the exact test only if its estimate is this many standard deviations too low.
SIGMAS = 4.0
#: Rounds of comparisons with the heads of the largest components before the pairs that are left.
ROUNDS = 1
#: A shingle that at most so many open classes hold is rare.
RARE = 64
#: A signature has the lowest PLANES bits of every register, one plane after another in WORDS_PER_PLANE numbers.
PLANES, WORDS_PER_PLANE = 3, 4
#: Share of registers whose signatures differ at the threshold, and the number that rules a pair out.
_APART = (1 - PERCENT / 100) * (1 - 0.5 ** PLANES)
DIFFERING = int(REGISTERS * _APART + SIGMAS * (REGISTERS * _APART * (1 - _APART)) ** 0.5)
SHINGLE = multipliers(WORDS, 7)
BAND = multipliers(PER_BAND, 11)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes per text; fewer words than five are one shingle."""
    data, offsets = joined_bytes(texts)
    words, first = word_hashes(data, offsets)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    with np.errstate(over="ignore"):
        sums = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for i in range(WORDS):
            sums += words[i:i + len(sums)] * SHINGLE[i]
        sums = mix(sums)
        sets = []
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= WORDS:
                sets.append(np.unique(sums[lo:hi - WORDS + 1]))
            elif hi > lo:
                short = (words[lo:hi] * SHINGLE[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo) * GOLDEN
                sets.append(mix(np.asarray([short])))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _least_points(elements: np.ndarray, owner: np.ndarray, until: np.ndarray, least: np.ndarray) -> None:
    """Lower ``least`` (rows by registers) by the points of each element's process before its row's ``until``."""
    at = np.zeros(len(elements))
    step, block = 0, 1
    while len(elements):
        with np.errstate(over="ignore"):
            draw = mix(elements[:, None] + (np.arange(step, step + block, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
        points = at[:, None] + np.cumsum(-np.log(_uniform(draw)), axis=1) / REGISTERS
        hit = points < until[owner][:, None]
        # the time uses the upper 53 bits, the register the other 11
        place = ((draw[hit] & np.uint64(2047)) * np.uint64(REGISTERS) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(least.reshape(-1), np.broadcast_to(owner[:, None], hit.shape)[hit] * REGISTERS + place, points[hit])
        going = hit[:, -1]
        elements, owner, at = elements[going], owner[going], points[going, -1]
        step, block = step + block, min(256, block * 4)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of each non-empty set, one row per set; rows of empty sets are 0.

    Points later than (ln m + c) / n cannot matter once every register has one before
    that time; sets with a register left over are done again with a larger c, so the
    result is the sketch that all points would give.
    """
    sizes = np.asarray([len(s) for s in sets])
    least = np.full((len(sets), REGISTERS), np.inf)
    todo, slack = np.flatnonzero(sizes), 4.0
    while len(todo):
        until = np.zeros(len(sets))
        until[todo] = (np.log(REGISTERS) + slack) / sizes[todo]
        _least_points(np.concatenate([sets[i] for i in todo]), np.repeat(todo, sizes[todo]), until, least)
        todo, slack = todo[np.isinf(least[todo]).any(axis=1)], slack * 2
    exponent = np.floor(1 - np.log(np.where(np.isinf(least), 1.0, least) / RATE) / np.log(BASE))
    registers = np.clip(exponent, 0, TOP).astype(np.uint16)
    registers[sizes == 0] = 0
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band, distinct between bands."""
    with np.errstate(over="ignore"):
        groups = registers.reshape(len(registers), BANDS, PER_BAND).astype(np.uint64)
        return mix((groups * BAND).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 30) -> np.ndarray:
    """Jaccard similarity with the largest joint likelihood of the counts of larger, smaller and equal registers.

    With set sizes known, registers of the first exceed those of the second with
    probability p(u - vJ), fall short with p(v - uJ) and tie otherwise, where
    p(x) = -log_base(1 - x (base - 1) / base); the likelihood has one maximum, found
    by golden sections.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        left, right = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        better = likelihood(left) > likelihood(right)
        lo, hi = np.where(better, lo, left), np.where(better, right, hi)
    return (lo + hi) / 2


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), cls (hash of the set), regs, keys, sig; one row per row of ``docs``, empty sets without sketch."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            registers = sketches(sets)
            keys = band_keys(registers).astype(np.int64)
            with np.errstate(over="ignore"):
                cls = mix(np.asarray([s.sum(dtype=np.uint64) ^ mix(s ^ GOLDEN).sum(dtype=np.uint64) * GOLDEN for s in sets], np.uint64)
                          + np.asarray([len(s) for s in sets], np.uint64)).astype(np.int64)
            full = [len(s) > 0 for s in sets]
            bits = np.zeros((len(sets), PLANES, WORDS_PER_PLANE * 64), bool)
            for plane in range(PLANES):
                bits[:, plane, :REGISTERS] = registers >> plane & 1
            signature = np.packbits(bits.reshape(len(sets), -1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "cls": pa.array([int(c) if f else None for c, f in zip(cls, full)], pa.int64()),
                "regs": pa.array([r.tobytes() if f else None for r, f in zip(registers, full)], pa.binary()),
                "keys": pa.array([k if f else None for k, f in zip(keys, full)], pa.list_(pa.int64())),
                "sig": pa.array([g if f else None for g, f in zip(signature, full)], pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n long, cls long, regs binary, keys array<long>, sig array<long>")


def plausible(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose registers do not speak against the threshold."""
    sides = [sketch.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(f"regs_{c}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("a", "b"))
            n_a, n_b = (batch.column(f"n_{c}").to_numpy().astype(float) for c in ("a", "b"))
            j = estimated_jaccard(a, b, n_a, n_b)
            spread = np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS)
            sizes = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
            yield batch.select(["a", "b"]).filter(pa.array(sizes & (j >= PERCENT / 100 - SIGMAS * spread)))

    return both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(keep, "a long, b long")


def full_sets(classes: DataFrame, docs: DataFrame, heads: DataFrame) -> DataFrame:
    """cls, members (sorted shingle hashes) of the given classes, made again from the texts of their first documents."""
    wanted = classes.join(heads.select("cls", "rep"), "cls").select("cls", F.col("rep").alias("doc_id"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "members"])

    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(wanted, "doc_id")
    return materialized(texts.select("cls", "text").mapInArrow(build, "cls long, members binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose full sets pass."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                passed.append(100 * both >= PERCENT * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    x = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long").distinct()


def shingles_of(sets: DataFrame) -> DataFrame:
    """cls, shingle: the members of each class."""
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "members"):
            parts = [np.frombuffer(m.as_buffer(), np.int64) for m in batch.column("members")]
            yield pa.RecordBatch.from_pydict({
                "cls": np.repeat(batch.column("cls").to_numpy(), [len(p) for p in parts]), "shingle": np.concatenate(parts)})

    return sets.mapInArrow(members, "cls long, shingle long")


def needed(n: Column, m: Column) -> Column:
    """The least overlap that links two sets of these sizes."""
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT))


def by_rarity(classes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``classes`` (cls, n, root): cls, common, how many of its shingles more than RARE classes hold; and the pairs
    a, b of different components whose common shingles alone are too few for a link but not with the rare ones that both hold.

    Two classes overlap in the rarer shingles that both hold and in at most as many common
    ones as the poorer of them has, which is an exact bound. Members of a family of copies
    that are not linked differ from it in shingles that few or none share, so hardly any
    pair of them passes. A rare shingle meets at most RARE others, so the rows made grow
    with the shingles and not with their square.
    """
    open_sets = sets.join(classes.select("cls"), "cls", "left_semi")
    members = materialized(shingles_of(open_sets).distinct(), "shingles")
    held = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    common = members.join(held.where(F.col("holders") > RARE), "shingle", "left_semi").groupBy("cls").agg(F.count(F.lit(1)).alias("common"))
    known = materialized(classes.select("cls", "n", "root").join(common, "cls", "left").withColumn("common", F.coalesce("common", F.lit(0))), "common")
    rare = materialized(members.join(held.where(F.col("holders") <= RARE), "shingle", "left_semi").join(known, "cls"), "rare")
    x, y = rare.alias("x"), rare.alias("y")
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
    sizes = 100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")
    least, need = F.least("x.common", "y.common"), needed(F.col("x.n"), F.col("y.n"))
    pairs = (x.join(y, meet & sizes & (least < need)).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), (need - least).alias("missing"))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"), F.first("missing").alias("missing")).where("both >= missing"))
    return known.select("cls", "common"), pairs.select("a", "b")


def opened(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """``buckets`` (key, cls, n, sig, meets) that hold several components, with root, main (the root of the largest part)
    and head (the most central class of that part)."""
    placed = buckets.join(roots.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("meets", "cls", "n", "sig")).alias("top"))
    split = (parts.groupBy("key").agg(F.max(F.struct("size", "top", "root")).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").select("key", F.col("m.root").alias("main"), F.col("m.top").alias("head")))
    return materialized(placed.join(split, "key"), "open")


def near(x: str, y: str) -> Column:
    """Whether the sizes and signatures of two classes allow a link."""
    differing = F.lit(0)
    for i in range(WORDS_PER_PLANE):
        planes = [F.col(f"{x}.sig")[i + p * WORDS_PER_PLANE].bitwiseXOR(F.col(f"{y}.sig")[i + p * WORDS_PER_PLANE]) for p in range(PLANES)]
        differing = differing + F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), planes))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (differing <= DIFFERING) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def apart() -> Column:
    return (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near("x", "y")


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def stars(open_: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """a, b: each class outside its bucket's main part with that head of such a part with which it shares most buckets,
    of those not ``tested``; one pair per class."""
    met = (open_.alias("x").where((F.col("root") != F.col("main")) & near("x", "head"))
           .groupBy("x.cls", F.col("head.cls").alias("other")).agg(F.count(F.lit(1)).alias("shared")).select(*ordered("cls", "other"), "cls", "other", "shared"))
    fresh = met if tested is None else met.join(tested, ["a", "b"], "left_anti")
    best = fresh.groupBy("cls").agg(F.max(F.struct("shared", "other")).alias("m"))
    return best.select(*ordered("cls", "m.other")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def rest_of_links(buckets: DataFrame, links: DataFrame, given: DataFrame, docs: DataFrame, heads: DataFrame) -> DataFrame:
    """``links`` and those that connect further components: stars around other heads first, then whatever pairs are left.
    ``given`` are the pairs compared so far."""
    open_ = opened(buckets, components(links))
    left, right = open_.where("root <> main").alias("x"), open_.alias("y")
    classes = materialized(left.join(right, apart(), "left_semi").select("cls").unionByName(
        right.join(left, apart(), "left_semi").select("cls")).distinct(), "classes")
    sets = full_sets(classes, docs, heads)
    buckets = buckets.join(classes, "cls")
    open_, tested = open_.join(classes, "cls"), given
    for _ in range(ROUNDS):
        asked = materialized(stars(open_, tested), "asked")
        pairs = materialized(plausible(asked, heads), "pairs")
        found = materialized(confirmed(pairs, sets), "found")
        tested = tested.unionByName(asked)
        if found.isEmpty():
            break
        links = materialized(links.unionByName(found), "links")
        superseded, open_ = open_, opened(buckets, components(links))
        discard(superseded)
    rooted = open_.groupBy("cls").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    common, by_rare = by_rarity(rooted, sets)
    rest = materialized(open_.join(common, "cls").join(heads.select("cls", "keys"), "cls"), "open")
    left, right = rest.where("root <> main").alias("x"), rest.alias("y")
    enough = F.least("x.common", "y.common") >= needed(F.col("x.n"), F.col("y.n"))
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls"))
    here = F.col("x.key") == F.array_min(F.array_intersect("x.keys", "y.keys"))  # a pair counts in one of its buckets
    by_common = left.join(right, apart() & enough & once & here).select(*ordered("x.cls", "y.cls"))
    pairs = by_common.unionByName(by_rare).join(tested, ["a", "b"], "left_anti")
    return links.unionByName(confirmed(materialized(plausible(pairs, heads), "pairs"), sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Bands of five registers, forty of them, miss a pair at the threshold with a
    probability of 2e-5 and a more similar one far less often.
    """
    sketches = materialized(sketched(docs), "sketches")
    heads = materialized(sketches.where("doc_id IS NOT NULL AND cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n", "regs", "keys", "sig")]), "classes")
    rows = materialized(sketches.select("doc_id", "n", "cls"), "rows")
    discard(sketches)
    named = rows.where("doc_id IS NOT NULL AND cls IS NOT NULL")
    bands = heads.select("cls", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialized(bands.join(shared, "key"), "members")
    # the most central class of a bucket is the one that meets most others in all its buckets
    central = members.groupBy("cls").agg(F.sum("size").alias("meets"))
    buckets = materialized(members.select("key", "cls").join(central, "cls").join(heads.select("cls", "n", "sig"), "cls"), "buckets")
    discard(members)

    same_id = named.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("doc_id", "a")
    given = named.select("doc_id", F.col("cls").alias("b")).join(same_id, "doc_id").where("a <> b").select("a", "b").distinct()
    alone = heads.select(F.col("cls").alias("v"), F.col("cls").alias("root")).limit(0)
    asked = materialized(stars(opened(buckets, alone)), "asked")
    pairs = materialized(plausible(asked, heads), "pairs")
    sets = full_sets(ends(pairs), docs, heads)
    first = materialized(confirmed(pairs, sets).unionByName(given).distinct(), "links")
    discard(sets, pairs)
    links = materialized(rest_of_links(buckets, first, asked, docs, heads), "links")
    discard(buckets)

    final = components(links).withColumnRenamed("v", "cls")
    least = heads.select("cls", "rep").join(final, "cls").groupBy("root").agg(F.min("rep").alias("least"))
    names = final.join(least, "root").select("cls", "least")
    out = rows.select("doc_id", "n", "cls").join(
        heads.select("cls", "rep").join(names, "cls", "left").select("cls", F.coalesce("least", "rep").alias("component")), "cls", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
