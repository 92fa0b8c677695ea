import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from corpusguard.llm import conversations as C
from corpusguard.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(symbols, longest_insertion=2):
    """Every edit sequence, its result tested against the pattern."""
    best = None

    def walk(at, cost, audit, initials, run):
        nonlocal best
        if at == len(symbols) and GOOD.fullmatch(initials) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if run < longest_insertion:
            for i in "ua":
                walk(at, cost + 5, audit + "I", initials + i, run + 1)
        if at < len(symbols):
            x = symbols[at]
            walk(at + 1, cost + 2, audit + "D", initials, 0)
            if x != "x":
                late = 5 if x.isupper() else 0
                walk(at + 1, cost + late, audit + "K", initials + x.lower(), 0)
                for i in "ua":
                    walk(at + 1, cost + 1 + late, audit + "R", initials + i, 0)
    walk(0, 0, "", "", 0)
    return best


def test_cheapest_edits_by_trying_all():
    for n in range(4):
        for symbols in itertools.product("sSuUaAox", repeat=n):
            assert C.solve("".join(symbols)) == cheapest("".join(symbols), 1), symbols
    r = random.Random(1)
    for _ in range(6):
        symbols = "".join(r.choice("suUaAoOx") for _ in range(4))
        assert C.solve(symbols) == cheapest(symbols, 1), symbols


def test_insertions_where_they_are_cheap():
    costs = C.Costs(keep=0, rerole=9, delete=9, insert=1, truncated=3)
    assert C.solve("uu", costs) == (2, "KIKI")
    assert C.solve("sa", costs) == (1, "KIK")
    assert C.solve("a", costs) == (1, "IK")
    assert C.solve("s", costs) == (2, "KII")
    assert C.apply_edits("KIKI", [("user", "x."), ("user", "y.")])[0] == [
        ("K", "user", "x."), ("I", "assistant", ""), ("K", "user", "y."), ("I", "assistant", "")]


def plain_steps(symbols):
    """(cost, audit) by state, turn after turn, as pairs."""
    states = {C.EMPTY: (0, "")}
    for x in symbols:
        after = {}
        for s, (cost, audit) in states.items():
            for i, o, c, letter in C._edits(x, C.Costs()):
                if i == s:
                    after[o] = min(after.get(o, (1 << 60, "")), (cost + c, audit + letter))
        states = after
    return min(states[s] for s in (C.EMPTY, C.ASSISTANT) if s in states)


def test_long_conversations_compose():
    r = random.Random(2)
    for n in (63, 64, 65, 200, 1500):
        symbols = "".join(r.choice("suUaAox") for _ in range(n))
        assert C.solve(symbols) == plain_steps(symbols)


def plain(rows):
    """The contract, row by row, for one conversation's rows after damage in order."""
    seen, symbols, counts, previous = set(), "", dict.fromkeys(C.COUNTS, 0), None
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        if previous is not None and previous[:1] + role[:1] not in ("su", "ua", "au"):
            counts["illegal"] += 1
        previous = role
        x = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else x.upper() if fault else x
    cost, audit = C.solve(symbols)
    lines = [f"{role}:{text}" for _, role, text in C.apply_edits(audit, [r[1:] for r in rows])[0]]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    """The damage of the registered query, in plain Python."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if fault == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    return out


ODD = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "user", "b!"), (1, None, "user", "b!"), (1, 5, "assistant", "c"),
       (2, 0, "system", "s."), (2, 9, "tool", "t?"), (2, 3, "", " \n"), (2, 3, "assistant", "x. "), (2, 4, "assistant", "x. "),
       (3, 7, "user", "long " * 30000 + "."), (3, 8, "assistant", "ok."), (4, 0, None, None)]


def compare(spark, rows, **kw):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    repaired = C.repair(queries.damaged(table), **kw)
    facts = {r.conv_id: tuple(r)[1:] for r in repaired.conversations.collect()}
    told = {r.conv_id: (r.audit, r.repaired_sha256) for r in C.transcripts(repaired).collect()}
    want = {conv: plain(kept) for conv, kept in hurt(rows).items()}
    assert {c: (*facts[c], *told[c]) for c in facts} == want
    assert repaired.conversations.count() == len(want)


def test_against_plain_python(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 40), r.randint(0, 9), r.choice(["user", "assistant", "system", "bot"]), r.choice(["hi.", "ok", "no!", "", "yes.", "well?"]))
            for _ in range(400)]
    compare(spark, rows + ODD)


def test_one_conversation_holds_most_rows(spark):
    r = random.Random(5)
    rows = [(7, t, "user" if t % 2 else "assistant", f"turn {t % 300}{r.choice('.!x')}") for t in range(3000)]
    rows += [(7, 50, "user", "the same.")] * 500 + [(c, 0, "user", "hello.") for c in range(8, 60)]
    compare(spark, rows, piece_rows=128)


def test_extra_columns_and_empty_tables(spark):
    table = spark.createDataFrame([(1, 2, "user", "a.", 5, "p")], "conv_id long, turn long, role string, text string, again long, part string")
    assert [(x.cost, x.truncated) for x in C.repair(table).conversations.collect()] == [(2, 0)]
    empty = C.repair(table.limit(0))
    assert empty.conversations.collect() == [] and C.transcripts(empty).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    import duckdb
    got = queries.QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    cursor = con.execute(queries.ORACLE["op12_conversation_repair"])
    assert got.columns == [c[0] for c in cursor.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(cursor.fetchall())
