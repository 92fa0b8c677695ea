"""Removal of byte strings that already occur in a document with a smaller id.

Every string of ``LENGTH`` bytes holds a place, its anchor, that only its own bytes
decide: the start of the 16-byte gram with the least hash in it. So equal strings
have equal anchors, and only anchors with equal grams need to be compared.

1. Each task cuts its texts to anchors, with a hash of the gram and one of its
   surroundings, the bytes of the strings that it is the anchor of. Where a task has the
   same gram and surroundings several times, only the least document's goes on; the others
   are settled. The rest is dealt by gram as packed arrays.
2. Per gram: an anchor whose surroundings an earlier document has is settled, all of
   them are removed. Grams with several surroundings that agree on one side go on.
3. For those the bytes are fetched, and the suffixes that start where a string of this
   anchor may start are sorted: a mergesort whose comparisons find the common
   extension by binary search over prefix polynomial hashes. Strings that are
   neighbours and agree over the whole length are compared byte by byte, should two
   hashes have collided. The least id of each run stays. Grams with more than ``HOT``
   surroundings are not held whole: their surroundings are cut to pieces of strings that
   have the anchor at nearby places, and the pieces are dealt by the bytes that all these
   strings have in common. Where more than ``HOT`` still meet, equal pieces are brought
   together, all but one of them settled, and that one is cut again, down to single strings.
4. The removed places of a document are joined with its text.

Disk holds the shuffle of one step at a time, and tables only as long as a later step reads
them. A context that meets many others costs two pieces, not one row per string; more only
where over ``HOT`` of them agree on 33 bytes, and again on 45.

Nulls and edges: a null text is empty. Texts shorter than ``LENGTH`` lose nothing. A
row without id has no place in the order: it loses nothing and removes nothing. Rows
that share an id are one document; if their texts differ, the least text is it.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.common import GOLDEN, SLICE_BYTES, mix, slices, tasks
from corpusguard.session import discard, materialized

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1
#: Any string has as many bytes on one side of its anchor's gram at least.
HALF = (SPAN - 1) // 2
CHUNK = 16 << 20
#: Bytes of surroundings that are sorted at once; each byte is the start of about one string.
SORTED = 1 << 20
#: More contexts of a gram than this, or pieces of a key, are cut and dealt anew.
HOT = 1000
#: Places of the anchor that the strings of a piece have, by round; each divides the one before. The last round only
#: brings equal strings together, after which none is left to compare.
WIDTHS = (18, 6, 1, 1)
BASE = np.uint64(0x9E3779B97F4A7C55)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOW40 = np.uint64((1 << 40) - 1)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2**64."""
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Prefixes:
    """Polynomial hashes of any part of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(1 << max(16, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=self.sums[1:])

    def part(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash per place of the GRAM bytes from there."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    return mix(mix(words[:n] * GOLDEN) + words[8:8 + n])


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[:len(values) - rest], values[rest:]) if rest else values


def least_grams(grams: np.ndarray) -> np.ndarray:
    """Per start of a string of LENGTH bytes, the least gram hash in it."""
    return sliding(grams, SPAN, np.minimum)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the anchors in ``data``, texts one after another that stop at ``ends``; their grams; the text of each;
    where the strings that it is the anchor of begin and end."""
    grams = gram_hashes(data)
    if len(grams) < SPAN:
        none = np.zeros(0, np.int64)
        return none, grams[:0], none, none, none
    least = least_grams(grams)
    stops = np.repeat(ends, np.diff(ends, prepend=0))[:len(least)]
    least[np.arange(len(least)) + LENGTH > stops] = 0
    edge = np.zeros(SPAN - 1, np.uint64)
    chosen = sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum)
    at = np.flatnonzero((chosen == grams) & (grams > 0))
    found, text = grams[at], np.searchsorted(ends, at, side="right")
    # starts with the same least gram are one run, and the runs of a text follow each other as their anchors do
    first = np.flatnonzero(np.diff(least, prepend=least[0] ^ np.uint64(1)) != 0)
    last = np.append(first[1:], len(least)) - 1
    real = least[first] > 0
    run = np.cumsum((np.diff(found, prepend=np.uint64(0)) != 0) | (np.diff(text, prepend=-1) != 0)) - 1
    return at, found, text, np.maximum(at - SPAN + 1, first[real][run]), np.minimum(at, last[real][run]) + LENGTH


def described(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: text, place in it, gram, hash of its surroundings, hash of HALF bytes on its left and right,
    bytes of the surroundings on either side of the gram."""
    at, grams, text, lo, hi = anchors(data, ends)
    prefix = Prefixes(data)
    around = mix(prefix.part(lo, hi) + (hi - lo).astype(np.uint64) * GOLDEN) >> np.uint64(16)
    left = mix(prefix.part(np.maximum(at - HALF, 0), at)) >> np.uint64(48)
    right = mix(prefix.part(at + GRAM, np.minimum(at + GRAM + HALF, len(data)))) >> np.uint64(48)
    return (text, at - np.concatenate([[0], ends])[text], grams, around, left.astype(np.uint16), right.astype(np.uint16),
            (at - lo).astype(np.uint8), (hi - at - GRAM).astype(np.uint8))


#: What pack keeps: numbers by their first, second, ... bytes, as the upper ones are mostly the same; hashes as they are.
STEPS, HASHES = (np.int64, np.uint32, np.int32), (np.uint32, np.uint8, np.uint32, np.uint16, np.uint16, np.uint16, np.uint8, np.uint8)


def pack(ids: np.ndarray, places: np.ndarray, grams: np.ndarray, around: np.ndarray, *sides: np.ndarray) -> bytes:
    """Anchors in order of document and place, in few bytes each: ids once per document, places as steps."""
    new = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    numbers = (np.diff(ids[new], prepend=0), np.diff(np.append(new, len(ids))), np.diff(places, prepend=0))
    hashes = (grams, grams >> np.uint64(32), around, around >> np.uint64(32), *sides)
    return b"".join((np.asarray([len(ids), len(new)], np.uint32).tobytes(),
                     *(x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes() for x, kind in zip(numbers, STEPS)),
                     *(x.astype(kind).tobytes() for x, kind in zip(hashes, HASHES))))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, docs = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    at, out = 8, []
    for kind, size, by_byte in (*zip(STEPS, (docs, docs, n), (True,) * 3), *((kind, n, False) for kind in HASHES)):
        wide = np.dtype(kind).itemsize
        part = np.frombuffer(blob, np.uint8, size * wide, at)
        out.append((np.ascontiguousarray(part.reshape(wide, size).T) if by_byte else part).view(kind).ravel())
        at += size * wide
    ids, counts, steps, g, g_high, a, a_high, *sides = out
    return (np.repeat(np.cumsum(ids), counts), np.cumsum(steps, dtype=np.int64), g.astype(np.uint64) | g_high.astype(np.uint64) << np.uint64(32),
            a.astype(np.uint64) | a_high.astype(np.uint64) << np.uint64(32), *sides)


def coded(places: np.ndarray, before: np.ndarray, after: np.ndarray, settled: np.ndarray | int) -> np.ndarray:
    """A number of place, bytes of the surroundings on either side of the gram, and state: 1 if the surroundings are in
    an earlier document, 0 if they must be compared."""
    return ((places * 64 + before) * 64 + after) * 2 + settled


def settle(ids, places, grams, around, left, right, before, after) -> tuple[np.ndarray, np.ndarray]:
    """Documents and coded places of the anchors that are settled or must be compared."""
    order = np.lexsort((ids, around, grams))
    ids, places, grams, around, left, right, before, after = (x[order] for x in (ids, places, grams, around, left, right, before, after))
    new_gram = np.diff(grams, prepend=grams[0] ^ np.uint64(1)) != 0
    new = new_gram | (np.diff(around, prepend=around[0] ^ np.uint64(1)) != 0)
    heads = np.flatnonzero(new)
    part = np.cumsum(new) - 1
    first = ids[heads][part]
    settled = ids > first
    # surroundings of the same gram that agree with others on a side, one of which any string has in full
    gram = (np.cumsum(new_gram) - 1)[heads]
    agrees = np.zeros(len(heads), bool)
    for side, reach in ((left, before), (right, after)):
        full = np.flatnonzero(reach[heads] >= HALF)
        _, back, count = np.unique(gram[full] * 65536 + side[heads[full]], return_inverse=True, return_counts=True)
        agrees[full] |= count[back] > 1
    compare = ~settled & agrees[part]
    keep = settled | compare
    return ids[keep], coded(places[keep], before[keep], after[keep], settled[keep])


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, at (see ``coded``) of the anchors that are settled or must be compared."""
    parts = 4 * tasks(docs.sparkSession)
    names, types = ["part", "blob", "doc_id", "at"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def rows(part, blob, doc_id, at):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((part, blob, doc_id, at), types)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            ids, places, grams, around, *sides = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((places, ids))
            ids, places, grams, around, *sides = (c[order] for c in (ids, places, grams, around, *sides))
            key = mix(grams + mix(around))
            by = np.argsort(key, kind="stable")
            new = np.diff(key[by], prepend=key[by[0]] ^ np.uint64(1)) != 0
            first = ids[by][np.flatnonzero(new)][np.cumsum(new) - 1]
            done = np.zeros(len(ids), bool)
            done[by] = ids[by] > first
            if done.any():
                spread = -1 - ids[done] % parts
                yield rows(spread, [None] * len(spread), ids[done], coded(places[done], sides[2][done], sides[3][done], 1))
            part = ((grams >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            left_over = np.flatnonzero(~done)
            left_over = left_over[np.argsort(part[left_over], kind="stable")]
            packed, held_bytes = [], 0
            for w in np.split(left_over, np.flatnonzero(np.diff(part[left_over])) + 1):
                packed.append((part[w[0]], pack(ids[w], places[w], grams[w] & LOW40, around[w], *(c[w] for c in sides))))
                held_bytes += len(packed[-1][1])
                if held_bytes >= SLICE_BYTES:
                    yield rows(*zip(*packed), *([None] * len(packed),) * 2)
                    packed, held_bytes = [], 0
            if packed:
                yield rows(*zip(*packed), *([None] * len(packed),) * 2)

        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            text, *found = described(data, ends)
            if len(text):
                held.append((batch.column("doc_id").to_numpy()[text], *found))
            size += len(data)
            if size >= CHUNK and held:
                yield from dealt()
                held, size = [], 0
        if held:
            yield from dealt()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []

        def answer():
            ids, at = settle(*(np.concatenate(c) for c in zip(*map(unpack, blobs))))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64())], ["doc_id", "at"])

        for batch in batches:
            part = batch.column("part").to_numpy()
            passing = part < 0
            if passing.any():
                yield batch.filter(pa.array(passing)).select(["doc_id", "at"])
            for row in np.flatnonzero(~passing):
                if part[row] != current and blobs:
                    yield answer()
                    blobs = []
                current = part[row]
                blobs.append(batch.column("blob")[row].as_py())
        if blobs:
            yield answer()

    dealt = (docs.select("doc_id", "text").mapInArrow(cut, "part long, blob binary, doc_id long, at long")
             .repartition(tasks(docs.sparkSession), "part").sortWithinPartitions("part"))
    return dealt.mapInArrow(judge, "doc_id long, at long")


#: A context: its gram or key, how many bytes are before the gram, the bytes of the strings, and where a document has them, as int64.
CONTEXT = "gram long, doc_id long, before long, bytes binary, starts binary"


def context_rows(rows: list[tuple], *stretches: np.ndarray) -> pa.RecordBatch:
    """Contexts, and the stretches to remove, if any, as rows without them."""
    names = ["gram", "doc_id", "before", "bytes", "starts"]
    contexts = pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, [pa.int64()] * 3 + [pa.binary()] * 2)], names)
    if stretches:
        contexts = pa.concat_tables([contexts, pa.table(list(stretches), ["doc_id", "lo", "hi"])], promote_options="default")
    return contexts.combine_chunks().to_batches()[0] if len(contexts) else pa.RecordBatch.from_pylist([], contexts.schema)


def merged(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of documents, those that touch as one."""
    order = np.lexsort((lo, ids))
    ids, lo, hi = ids[order], lo[order], hi[order]
    if not len(ids):
        return ids, lo, hi
    shift = np.cumsum(np.diff(ids, prepend=ids[0]) != 0) * (hi.max() + 1 - lo.min())
    reach = np.maximum.accumulate(hi + shift)
    first = np.flatnonzero(np.concatenate([[True], lo[1:] + shift[1:] > reach[:-1]]) | (np.diff(shift, prepend=-1) != 0))
    return ids[first], lo[first], np.maximum.reduceat(hi, first)


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each anchor to compare, the bytes of the strings it is the anchor of; once where a document has the same again."""
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, codes in zip(*(batch.column(c) for c in ("doc_id", "text", "codes"))):
                body, doc_id = text.as_py().encode(), doc_id.as_py()
                code = np.unique(codes.values.to_numpy())
                at, before = code >> 12, code >> 6 & 63
                words = np.frombuffer(body, np.uint8)[at[:, None] + np.arange(GRAM)].view(np.uint64)
                grams = mix(mix(words[:, 0] * GOLDEN) + words[:, 1])
                lo, hi = at - before, at + GRAM + (code & 63)
                found: dict[tuple, list[int]] = {}
                for gram, b, start, end in zip(grams.astype(np.int64).tolist(), before.tolist(), lo.tolist(), hi.tolist()):
                    found.setdefault((gram, b, body[start:end]), []).append(start)
                out += ((gram, doc_id, b, part, np.asarray(starts).tobytes()) for (gram, b, part), starts in found.items())
            yield context_rows(out)

    lists = wanted.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    return docs.select("doc_id", "text").join(lists, "doc_id").select("doc_id", "text", "codes").mapInArrow(fetch, CONTEXT)


def extension(prefix: Prefixes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of the strings of LENGTH bytes at ``a`` and ``b``, by binary search over hashes."""
    out = np.full(len(a), LENGTH, np.int64)
    differ = np.flatnonzero(prefix.part(a, a + LENGTH) != prefix.part(b, b + LENGTH))
    a, b = a[differ], b[differ]
    low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH - 1, np.int64)
    for _ in range(LENGTH.bit_length()):
        middle = (low + high + 1) // 2
        same = prefix.part(a, a + middle) == prefix.part(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    out[differ] = low
    return out


def suffix_order(data: np.ndarray, prefix: Prefixes, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of ``starts`` by the LENGTH bytes from there within each group; ``group`` rises.

    A mergesort from the bottom up, all merges of a level at once: the place of an
    element is its place in its own run plus that in the neighbouring run, found by
    binary search. A comparison looks at the byte after the common extension.
    """
    begin = np.searchsorted(group, group, side="left")
    end = np.searchsorted(group, group, side="right")
    place = np.arange(len(starts)) - begin
    longest = int((end - begin).max()) if len(starts) else 0
    order = np.arange(len(starts))

    def below(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the string at ``a`` comes before that at ``b``; equal ones as ``ties`` says."""
        same = extension(prefix, a, b)
        inside = np.minimum(same, LENGTH - 1)
        return np.where(same == LENGTH, ties, data[a + inside] < data[b + inside])

    width = 1
    while width < longest:
        active = np.flatnonzero(end - begin > width)
        run = place[active] // width
        other = begin[active] + (run ^ 1) * width
        lo = np.minimum(other, end[active])
        hi = np.minimum(other + width, end[active])
        first, right = lo.copy(), run % 2 == 1
        own = starts[order[active]]
        # how many of the other run go before; equal strings of the left run do
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) // 2
            before = below(starts[order[middle]], own[open_], right[open_])
            lo[open_] = np.where(before, middle + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], middle)
        target = begin[active] + run // 2 * 2 * width + place[active] % width + (lo - first)
        moved = order.copy()
        moved[target] = order[active]
        order = moved
        width *= 2
    return order


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes from each start also start in a member of its group with a smaller id.

    A string whose hash no other in the group has is not sorted.
    """
    prefix = Prefixes(data)
    name = mix(prefix.part(starts, starts + LENGTH) + mix(group.astype(np.uint64)))
    order = np.argsort(name, kind="stable")
    again = np.zeros(len(name), bool)
    again[1:] = name[order][1:] == name[order][:-1]
    again[:-1] |= again[1:]
    shared = np.sort(order[again])
    out = np.zeros(len(starts), bool)
    if len(shared):
        out[shared] = _repeated(data, prefix, starts[shared], group[shared], ids[shared])
    return out


def _repeated(data: np.ndarray, prefix: Prefixes, starts: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    order = suffix_order(data, prefix, starts, group)
    at, of = starts[order], group
    same = np.zeros(len(at), bool)
    near = np.flatnonzero(of[1:] == of[:-1]) + 1
    equal = near[extension(prefix, at[near - 1], at[near]) == LENGTH]
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    agree = (strings[at[equal - 1]] == strings[at[equal]]).all(axis=1)
    if not agree.all():  # two hashes collided: sort by the bytes themselves
        text = np.ascontiguousarray(strings[starts]).view(f"V{LENGTH}").ravel()
        _, name = np.unique(text, return_inverse=True)
        order = np.lexsort((name, group))
        at = starts[order]
        same[1:] = (group[order][1:] == group[order][:-1]) & (name[order][1:] == name[order][:-1])
    else:
        same[equal] = True
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(~same))
    out = np.zeros(len(starts), bool)
    out[order] = ids[order] > least[run]
    return out


def compared(found: DataFrame) -> DataFrame:
    """doc_id, lo, hi: bytes that strings of earlier documents cover, told from the suffixes of each gram."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def answer(batch: pa.Table) -> pa.RecordBatch:
            parts = batch.column("bytes").to_pylist()
            gram, doc, before = (batch.column(c).to_numpy() for c in ("gram", "doc_id", "before"))
            places = batch.column("starts").to_pylist()
            lengths = np.asarray([len(p) for p in parts])
            each = lengths - LENGTH + 1
            owner = np.repeat(np.arange(len(parts)), each)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            starts = (np.cumsum(lengths) - lengths)[owner] + step
            offset = before[owner] - step
            _, name = np.unique(gram, return_inverse=True)
            key = name[owner] * np.int64(64) + offset
            order = np.argsort(key, kind="stable")
            hit = np.zeros(len(owner), bool)
            hit[order] = repeated(np.frombuffer(b"".join(parts), np.uint8), starts[order], key[order], doc[owner][order])
            # runs of neighbouring strings are one stretch
            edge = np.diff(np.concatenate([[0], (hit * (owner + 1))]))
            change = np.flatnonzero(edge)
            lo = change[hit[change]]
            hi = np.flatnonzero(hit & np.concatenate([~hit[1:] | (owner[1:] != owner[:-1]), [True]])) if len(hit) else lo
            # each wherever the document has its context
            count = np.asarray([len(p) // 8 for p in places])[owner[lo]]
            place = np.frombuffer(b"".join(places[k] for k in owner[lo].tolist()), np.int64)
            ids, lo, hi = merged(np.repeat(doc[owner[lo]], count), place + np.repeat(step[lo], count), place + np.repeat(step[hi] + LENGTH, count))
            return pa.RecordBatch.from_pydict({"doc_id": ids, "lo": lo, "hi": hi})

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SORTED:
                whole = pa.Table.from_batches(held).combine_chunks()
                gram = whole.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1], side="left"))
                if cut:
                    yield answer(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield answer(pa.Table.from_batches(held))

    dealt = found.repartition(tasks(found.sparkSession), "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(sort, "doc_id long, lo long, hi long")


def pieces(found: DataFrame, width: int) -> DataFrame:
    """Contexts cut so that the strings of each have their anchor at ``width`` places at most, with a key in place of the gram.

    Strings that are equal have their anchor at the same place, so they are in pieces of the same range of places; the
    key is a hash of the bytes that all strings of this range have in common. Neighbours that are equal, and pieces that
    a slice has several times, are settled but for the least document's: rows without a gram have the stretch to remove.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, 0
        for batch in slices(batches, "bytes"):
            same: dict[tuple, dict[int, list[np.ndarray]]] = {}
            settled: list[tuple[int, np.ndarray, int]] = []
            for gram, doc, before, body, starts in zip(*(c.to_pylist() for c in batch.columns)):
                places = np.frombuffer(starts, np.int64)
                if (gram, before, body) == last and doc > of:
                    settled.append((doc, places, len(body)))
                    continue
                last, of = (gram, before, body), doc
                least = before - len(body) + LENGTH
                for low in range(least // width * width, before + 1, width):
                    high = min(low + width, SPAN) - 1
                    a, b = max(least, low), min(before, high)
                    key = hashlib.blake2b(body[before - low:before + LENGTH - high], digest_size=8, salt=bytes([low])).digest()
                    same.setdefault((key, b, body[before - b:before + LENGTH - a]), {}).setdefault(doc, []).append(places + (before - b))
            rows = []
            for (key, b, body), docs in same.items():
                first = min(docs)
                rows.append((int.from_bytes(key, "little", signed=True), first, b, body, b"".join(p.tobytes() for p in docs.pop(first))))
                settled += ((doc, p, len(body)) for doc, parts in docs.items() for p in parts)
            count = [len(p) for _, p, _ in settled]
            lo = np.concatenate([np.zeros(0, np.int64), *(p for _, p, _ in settled)])
            hi = lo + np.repeat(np.asarray([n for _, _, n in settled], np.int64), count)
            yield context_rows(rows, *merged(np.repeat(np.asarray([d for d, _, _ in settled], np.int64), count), lo, hi))

    return found.select("gram", "doc_id", "before", "bytes", "starts").mapInArrow(cut, f"{CONTEXT}, lo long, hi long")


def stretches_of(found: DataFrame) -> DataFrame:
    """doc_id, lo, hi of all contexts: by gram; by key where more than HOT have one, in smaller pieces as long as there are."""
    few, done, written = [], [], []
    for width in WIDTHS:
        hot = materialized(found.groupBy("gram").count().where(F.col("count") > HOT).select("gram"), "hot", freed=True)
        written.append(hot)
        if hot.isEmpty():
            few.append(found)
            break
        few.append(found.join(F.broadcast(hot), "gram", "left_anti"))  # a HOT-th of the contexts at most, 8 bytes each
        many = found.join(F.broadcast(hot), "gram", "left_semi")
        if done:  # the first ones have no equals: those are settled by their hash
            many = (many.repartition(tasks(found.sparkSession), "gram", "bytes")
                    .sortWithinPartitions("gram", "bytes", "before", "doc_id"))
        cut = materialized(pieces(many, width), "pieces", freed=True)
        written.append(cut)
        done.append(cut.where("gram IS NULL").select("doc_id", "lo", "hi"))
        found = cut.where("gram IS NOT NULL").drop("lo", "hi")
    together = compared(reduce(DataFrame.unionByName, few))
    stretches = materialized(reduce(DataFrame.unionByName, [together, *done]), "stretches", freed=True)
    discard(*written)
    return stretches


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of lo, hi): one row per document."""
    whole = docs.select("doc_id", "text")
    named = whole.where("doc_id IS NOT NULL")
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        named = materialized(named.groupBy("doc_id").agg(F.min("text").alias("text")), "documents", freed=True)
        whole = named.unionByName(whole.where("doc_id IS NULL"))
    flags = materialized(flagged(named), "anchors", freed=True)
    code = F.shiftright("at", 1)
    unclear = materialized(contexts(named, flags.where("at % 2 = 0").select("doc_id", code.alias("code"))), "contexts", freed=True)
    stretches = stretches_of(unclear)
    discard(unclear)
    place, before, after = F.shiftright(code, 12), F.shiftright(code, 6).bitwiseAND(63), code.bitwiseAND(63)
    settled = flags.where("at % 2 = 1").select("doc_id", (place - before).alias("lo"), (place + GRAM + after).alias("hi"))
    # a stretch is one number of place and length; pairs took 1.6 times the bytes in the shuffle
    covers = (settled.unionByName(stretches).select("doc_id", F.shiftleft("lo", 32).bitwiseOR(F.col("hi") - F.col("lo")).alias("cover"))
              .groupBy("doc_id").agg(F.collect_list("cover").alias("cover")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, cover in zip(*(batch.column(c) for c in ("doc_id", "text", "cover"))):
                body = (text.as_py() or "").encode()
                steps = np.zeros(len(body) + 1, np.int32)
                if cover.is_valid:
                    code = cover.values.to_numpy()
                    np.add.at(steps, code >> 32, 1)
                    np.add.at(steps, (code >> 32) + (code & 0xFFFFFFFF), -1)
                gone = np.cumsum(steps[:-1]) > 0
                edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                spans = [{"lo": int(a), "hi": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                out.append((doc_id.as_py(), len(body), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return (whole.join(covers, "doc_id", "left").select("doc_id", "text", "cover")
            .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: long, hi: long>>"))
