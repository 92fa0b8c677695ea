"""Conversation structure repair: the cheapest edits that make a conversation alternate, by scalar big-integer weights.

The turns of a conversation are edited until the initials of their roles read
``(s?(ua)+)?``: a turn is kept, given the role user or assistant, or deleted, and empty
turns may be inserted anywhere. Blank and repeated turns must go, and truncated ones that
stay cost extra. One integer weighs a path: its high digits are the cost, and every turn
owns three low base-8 digits at a fixed place, which spell the letters of its edits, filled
with zeros at the end. The least integer over the paths of the graph (turn, role state) is
therefore the cheapest repair and, among those, the ASCII-least audit, and its digits are
read off as the audit. A turn is preceded by two inserted ones at most; a third leads back
to a state that two reach for less. Turns are weighed in chunks, whose 4 x 4 tables of
least weights are composed in pairs, so long conversations cost n log n digits.

Turns are sorted by range of (conv_id, turn, role, text), so a conversation of any length is
spread over tasks. One that lies inside a task is repaired there; of those that reach a
task's edge or exceed a piece, each piece sends one letter per turn, the letters are
solved together, and each piece gets its part of the audit back.

Nulls and edges: a null role or text is one blank, rows with null conv_id are one
conversation, and null turns come first. Rows of one turn are ordered by role and text;
equal rows of a turn stand side by side and all but the first are duplicates. A
conversation without rows has no edits. An empty table gives none. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.session import materialized

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Digits of the letters, in ASCII order; 0 fills a turn's place.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
SPELL = str.maketrans({str(v): k for k, v in LETTERS.items()} | {"0": ""})
SLOT_BITS = 9
#: Turns weighed by plain steps before their table is composed with the next.
CHUNK = 64
#: A piece of a conversation ends at so many rows or characters.
PIECE_ROWS, PIECE_CHARS = 4096, 8 << 20


@dataclass(frozen=True)
class Costs:
    """What each edit costs. An insertion must cost something, or a repair could grow without end."""
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _inserted(state: int, count: int) -> int:
    for _ in range(count):
        state = ASSISTANT if state == USER else USER
    return state


def _slot(letters: str) -> int:
    value = 0
    for letter in letters:
        value = value << 3 | LETTERS[letter]
    return value << 3 * (3 - len(letters))


def _edits(symbol: str, costs: Costs) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letter) of one turn. ``symbol``: x must go; else s, u, a, o by role, upper case if truncated."""
    edits = [(s, s, costs.delete, "D") for s in range(4)]
    if symbol != "x":
        extra = costs.truncated if symbol.isupper() else 0
        kept = {"s": ((EMPTY, SYSTEM),), "u": ((EMPTY, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
        edits += [(i, o, costs.keep + extra, "K") for i, o in kept.get(symbol.lower(), ())]
        edits += [(i, o, costs.rerole + extra, "R") for i, o in (*kept["u"], *kept["a"])]
    return edits


@lru_cache(maxsize=64)
def _steps(symbol: str, costs: Costs) -> tuple[tuple[int, int, int, int], ...]:
    """(state before, state after, cost, digits): the least of each pair of states, insertions before the turn included. ``$`` is the end."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for start in range(4):
        for count in range(3):
            at, paid, said = _inserted(start, count), costs.insert * count, "I" * count
            ends = [(at, at, 0, "")] if symbol == "$" else [e for e in _edits(symbol, costs) if e[0] == at]
            for _, stop, cost, letter in ends:
                weight = (paid + cost, _slot(said + letter))
                if weight < best.get((start, stop), (weight[0] + 1, 0)):
                    best[start, stop] = weight
    return tuple((i, o, cost, digits) for (i, o), (cost, digits) in best.items())


Table = tuple[int, tuple]  # turns, and per pair of states the least weight or None


@lru_cache(maxsize=1 << 15)
def _chunk(symbols: str, costs: Costs) -> Table:
    """The least weights from each state to each over a few turns."""
    top = SLOT_BITS * len(symbols)
    rows = []
    for start in range(4):
        least: list = [None] * 4
        least[start] = 0
        for k, symbol in enumerate(symbols, 1):
            shift = top - SLOT_BITS * k
            after: list = [None] * 4
            for i, o, cost, digits in _steps(symbol, costs):
                if least[i] is not None:
                    weight = least[i] + (cost << top) + (digits << shift)
                    if after[o] is None or weight < after[o]:
                        after[o] = weight
            least = after
        rows.append(tuple(least))
    return len(symbols), tuple(rows)


def _composed(first: Table, second: Table) -> Table:
    (n, a), (m, b) = first, second
    low, top = SLOT_BITS * m, SLOT_BITS * (n + m)
    digits = (1 << low) - 1

    def least(i: int, o: int):
        sums = [(a[i][k] << low) + ((b[k][o] >> low) << top) + (b[k][o] & digits)
                for k in range(4) if a[i][k] is not None and b[k][o] is not None]
        return min(sums, default=None)
    return n + m, tuple(tuple(least(i, o) for o in range(4)) for i in range(4))


@lru_cache(maxsize=1 << 13)
def _solved_short(symbols: str, costs: Costs) -> tuple[int, str]:
    tables = [_chunk((symbols + "$")[i:i + CHUNK], costs) for i in range(0, len(symbols) + 1, CHUNK)]
    while len(tables) > 1:
        tables = [_composed(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    n, least = tables[0]
    weight = min(w for w in (least[EMPTY][EMPTY], least[EMPTY][ASSISTANT]) if w is not None)
    low = SLOT_BITS * n
    return weight >> low, format(weight & ((1 << low) - 1), "o").translate(SPELL)


def solve(symbols: str, costs: Costs = Costs()) -> tuple[int, str]:
    """The least cost and the audit of the turns that ``symbols`` stand for; see ``_edits``."""
    return (_solved_short if len(symbols) <= 512 else _solved_short.__wrapped__)(symbols, costs)


def apply_edits(audit: str, turns: list[tuple[str, str]], state: int = EMPTY) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of the turns that stay or come in, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            role, text = ("assistant" if state == USER else "user"), ""
        else:
            role, text = turns[at]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if state == USER else "user"
        out.append((letter, role, text))
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
    return out, state


PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()), ("symbols", pa.string()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns_seen", pa.int64()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
    ("cost", pa.int64()), ("audit", pa.string()), ("gaps", pa.int64()),
    ("turns", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))),
])
LEGAL = {"su", "ua", "au"}
COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Piece:
    """Sorted rows of one conversation, or of a part of it, judged as they come."""

    def __init__(self, conv_id, number):
        self.row = {"conv_id": conv_id, "piece": number, "whole": False, "turns_seen": 0, "first_turn": None, "last_turn": None,
                    "first_initial": None, "last_initial": None, "cost": None, "audit": None, "gaps": None, **dict.fromkeys(COUNTS, 0)}
        self.symbols: list[str] = []
        self.turns: list[tuple[str, str]] = []
        self.chars = 0
        self.before = None

    def add(self, turn, role: str, text: str, again: bool) -> None:
        row = self.row
        initial = role[:1]
        bare = text.rstrip(BLANK)
        if not bare:
            fault = "blank"
        elif again or self.before == (turn, role, text):
            fault = "duplicate"
        else:
            fault = "" if bare[-1] in ENDS else "truncated"
        if fault:
            row[fault] += 1
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append("x" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
        if row["last_initial"] is None:
            row["first_initial"] = initial
        else:
            row["illegal"] += row["last_initial"] + initial not in LEGAL
        row["last_initial"] = initial
        if turn is not None and turn != row["last_turn"]:
            row["turns_seen"] += 1
            row["last_turn"] = turn
            if row["first_turn"] is None:
                row["first_turn"] = turn
        self.turns.append((role, text))
        self.chars += len(text)
        self.before = (turn, role, text)

    def done(self, part: int, whole: bool, costs: Costs) -> dict:
        symbols = "".join(self.symbols)
        turns = [("", *t) for t in self.turns]
        row = self.row | {"part": part, "whole": whole, "symbols": symbols}
        if whole:
            row["cost"], row["audit"] = solve(symbols, costs)
            turns = apply_edits(row["audit"], self.turns)[0]
            row["gaps"] = 0 if row["first_turn"] is None else row["last_turn"] - row["first_turn"] + 1 - row["turns_seen"]
            row["symbols"] = None
        row["turns"] = [dict(zip(("edit", "role", "text"), t)) for t in turns]
        return row


def _pieces(batches: Iterator[pa.RecordBatch], costs: Costs, piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a sorted partition. The first and the last conversation may go on in another task, so they are never whole."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    current, out, chars = None, [], 0
    first = True

    def flush():
        nonlocal out, chars
        ready, out, chars = out, [], 0
        return pa.RecordBatch.from_pylist(ready, schema=PIECE)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again")]
        for conv_id, turn, role, text, copies, again in zip(*columns):
            if current is None or conv_id != current.row["conv_id"]:
                if current is not None:
                    out.append(current.done(part, not first and current.row["piece"] == 0, costs))
                    chars += current.chars
                    first = False
                current = Piece(conv_id, 0)
            for _ in range(copies):
                if len(current.symbols) >= piece_rows or current.chars >= PIECE_CHARS:
                    out.append(current.done(part, False, costs))
                    chars += current.chars
                    before = current.before
                    current = Piece(conv_id, current.row["piece"] + 1)
                    current.before = before
                current.add(turn, role, text, again)
            if len(out) >= 2048 or chars >= PIECE_CHARS:
                yield flush()
    if current is not None:
        out.append(current.done(part, False, costs))
    if out:
        yield flush()


SOLVED = pa.schema([PIECE.field(n) for n in ("conv_id", *COUNTS, "gaps", "cost")] + [
    pa.field("parts", pa.list_(pa.struct([("part", pa.int32()), ("piece", pa.int32()), ("audit", pa.string()), ("state", pa.int32())])))])


def _together(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """Solve conversations that lie in several pieces, given per piece one letter per turn and a few counts."""
    for batch in batches:
        out = []
        for conv_id, pieces in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist()):
            cost, audit = solve("".join(p["symbols"] for p in pieces), costs)
            row = {"conv_id": conv_id, "cost": cost, **{c: sum(p[c] for p in pieces) for c in COUNTS}, "parts": []}
            seen, initial, last = 0, None, None
            first = next((p["first_turn"] for p in pieces if p["first_turn"] is not None), None)
            state, at = EMPTY, 0
            for k, p in enumerate(pieces):
                if p["first_initial"] is not None:
                    row["illegal"] += initial is not None and initial + p["first_initial"] not in LEGAL
                    initial = p["last_initial"]
                if p["first_turn"] is not None:
                    seen += p["turns_seen"] - (p["first_turn"] == last)
                    last = p["last_turn"]
                stop, left = at, len(p["symbols"])
                while left or (k == len(pieces) - 1 and stop < len(audit)):
                    left -= audit[stop] != "I"
                    stop += 1
                row["parts"].append({"part": p["part"], "piece": p["piece"], "audit": audit[at:stop], "state": state})
                roles = [({"o": "x"}.get(s.lower(), s.lower()), "") for s in p["symbols"]]
                state = apply_edits(audit[at:stop], roles, state)[1]
                at = stop
            row["gaps"] = 0 if first is None else last - first + 1 - seen
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=SOLVED)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = PIECE.field("turns").type
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            audit, state = one.column("audit")[0].as_py(), one.column("state")[0].as_py()
            turns = [(t["role"], t["text"]) for t in one.column("turns")[0].as_py()]
            edited = [dict(zip(("edit", "role", "text"), t)) for t in apply_edits(audit, turns, state)[0]]
            yield pa.RecordBatch.from_arrays([*[one.column(n) for n in ("conv_id", "part", "piece", "audit")], pa.array([edited], kind)],
                                             names=["conv_id", "part", "piece", "audit", "turns"])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one with their number, so a row repeated without end is not sent as often."""
    for batch in batches:
        if batch.num_rows:
            grouped = pa.Table.from_batches([batch]).group_by(["conv_id", "turn", "role", "text"]).aggregate([("copies", "sum")])
            yield from grouped.rename_columns([*grouped.column_names[:-1], "copies"]).select(
                ["conv_id", "turn", "role", "text", "copies"]).to_batches()


@dataclass
class Repair:
    """``conversations``: one row each with counts, gaps and cost. ``pieces``: their turns after repair, in order of (part, piece), with
    the audit of each piece; ``whole`` if that piece is all of its conversation."""
    conversations: DataFrame
    pieces: DataFrame


def repair(turns: DataFrame, costs: Costs = Costs(), piece_rows: int = PIECE_ROWS) -> Repair:
    """The cheapest repair of every conversation in ``turns`` (conv_id, turn, role, text).

    An optional column ``copies`` says how often a row stands there, 0 for a row that only makes its conversation known.
    """
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    blank = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"),
                        F.coalesce("text", blank).alias("text"), copies.alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # turns at which the same words were first said, only of those said at several
    firsts = (rows.where("copies > 0").groupBy(F.col("conv_id").alias("c"), said.alias("s"))
              .agg(F.min(order).alias("first"), F.max(order).alias("last")).where("NOT (first <=> last)").drop("last"))
    collapsed = rows.mapInArrow(_collapsed, rows.schema)
    flagged = collapsed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (said == F.col("s")), "left").select(
        "conv_id", "turn", "role", "text", "copies", (F.col("first").isNotNull() & ~order.eqNullSafe(F.col("first"))).alias("again"))
    keys = ["conv_id", "turn", "role", "text", "copies"]
    pieces = (flagged.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .mapInArrow(lambda batches: _pieces(batches, costs, piece_rows), _spark_schema(PIECE)))
    pieces = materialized(pieces, "conversations")
    whole, open_ = pieces.where("whole"), pieces.where("NOT whole")
    state = F.struct("part", "piece", "symbols", *COUNTS, "turns_seen", "first_turn", "last_turn", "first_initial", "last_initial")
    solved = (open_.groupBy("conv_id").agg(F.array_sort(F.collect_list(state)).alias("pieces"))
              .mapInArrow(lambda batches: _together(batches, costs), _spark_schema(SOLVED)))
    solved = materialized(solved, "solved")
    parts = solved.select(F.col("conv_id").alias("c"), F.explode("parts").alias("p")).select("c", "p.*")
    back = open_.select("conv_id", F.col("part").alias("at"), F.col("piece").alias("no"), "turns").join(
        parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("part")) & (F.col("no") == F.col("piece")))
    back = back.select("conv_id", "part", "piece", "audit", "state", "turns").mapInArrow(
        _applied, pieces.select("conv_id", "part", "piece", "audit", "turns").schema)
    facts = ["conv_id", "gaps", *COUNTS, "cost"]
    return Repair(whole.select(*facts).unionByName(solved.select(*facts)),
                  whole.select("conv_id", "part", "piece", "audit", "turns", "whole").unionByName(back.withColumn("whole", F.lit(False))))


def _spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema
    return from_arrow_schema(schema)


def transcripts(repaired: Repair) -> DataFrame:
    """conv_id, audit, repaired_sha256: the digest of ``role:text`` lines, read piece after piece.

    A digest can only be taken in order, so the pieces of a conversation in several pass through one task, which holds one of them at a time.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = repaired.pieces.where("whole").select("conv_id", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    text = repaired.pieces.where("NOT whole").select("conv_id", "part", "piece", "audit", (F.size("turns") > 0).alias("any"), lines.alias("lines"))
    ordered = text.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.unionByName(ordered.mapInArrow(_digests, whole.schema))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    current, digest, audits, started, out = (), None, [], False, []

    def close():
        if current:
            out.append({"conv_id": current[0], "audit": "".join(audits), "repaired_sha256": digest.hexdigest()})

    for batch in batches:
        for conv_id, audit, some, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "any", "lines"))):
            if current != (conv_id,):
                close()
                current, digest, audits, started = (conv_id,), hashlib.sha256(), [], False
            audits.append(audit)
            if some:
                digest.update((("\n" if started else "") + lines).encode())
                started = True
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)
