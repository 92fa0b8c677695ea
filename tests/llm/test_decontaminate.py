import random

from corpusguard.llm import decontaminate as D

ITEM = "A train with Anna leaves the station at 10 km per hour and travels for 3 hours before it stops near the old bridge by the river"
ITEMS = "item_id long, text string"


def leaks(spark, rows, items):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int").repartition(3)
    found = D.find_leaks(docs, spark.createDataFrame(items, ITEMS)).collect()
    return {(x.doc_id, x.item_id): x.kind for x in found}


def test_copies_and_new_values_are_caught_and_others_left(spark):
    changed = ITEM.replace("Anna", "Bob").replace("10 km", "25 miles").replace("3 hours", "seven minutes")
    mixed = "Tom has 5 apples and gives 5 apples to his friend on the way to the market"
    unsteady = "Tom has 7 apples and gives 9 apples to his friend on the way to the market"
    steady = "Tim has 8 apples and gives 8 apples to his friend on the way to the market"
    rows = [(1, f"Before it. {ITEM} And after."), (2, f"So: {changed}."), (3, "a train of thought leaves the station of reason"), (4, None), (5, ""),
            (6, ITEM[:40]), (7, steady), (8, unsteady), (9, ITEM.upper()), (10, "(" + ITEM.replace(" ", "\n\n") + ")"), (11, "word " * 60_000 + ITEM)]
    got = leaks(spark, rows, [(100, ITEM), (101, mixed), (102, None), (103, "too short"), (104, "1 2 3 4 5 6 7 8 9 10 11 12")])
    assert got == {(1, 100): "copy", (2, 100): "new values", (7, 101): "new values", (9, 100): "copy", (10, 100): "copy", (11, 100): "copy"}


def test_equals_brute_force_on_windows(spark):
    r = random.Random(5)
    words = [f"v{c}x" for c in "abcdefghijklmnopqrstuvw"]
    items = [(i, " ".join(r.choices(words, k=r.randint(4, 30)))) for i in range(15)]
    rows = []
    for i in range(80):
        parts = r.choices(words, k=20)
        own = r.choice(items)[1].split()
        a = r.randint(0, len(own) // 2)
        parts[10:10] = own[a:r.randint(a, len(own))]
        rows.append((i, " ".join(parts)))

    def cuts(text, size):
        w = text.split()
        return [tuple(w[k:k + size]) for k in range(len(w) - size + 1)]
    want = set()
    for i, text in rows:
        for j, item in items:
            size = min(D.WINDOW, len(item.split()))
            own, there = cuts(item, size), set(cuts(text, size))
            hit = sum(c in there for c in own)
            if hit >= max(1, min(-(-len(own) // 2), D.ENOUGH)):
                want.add((i, j))
    got = leaks(spark, rows, items)
    assert set(got) == want and set(got.values()) <= {"copy"} and want


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, ITEM), (None, "nothing here"), (3, ITEM), (3, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM)], ITEMS)
    found = D.find_leaks(docs, items)
    assert sorted((x.doc_id or -1, x.item_id) for x in found.collect()) == [(-1, 1), (3, 1)]
    assert D.find_leaks(docs.limit(0), items).collect() == [] and D.find_leaks(docs, items.limit(0)).collect() == []


def test_one_changed_occurrence_leaves_the_other_windows(spark):
    item = ITEM.replace("10 km", "5 km").replace("3 hours", "5 hours") + " while the other people of the town wait for the boat that never comes to them"
    got = leaks(spark, [(1, item.replace("5 hours", "9 hours")), (2, item.replace("5 km", "9 km"))], [(100, item)])
    assert got == {(1, 100): "copy", (2, 100): "copy"}


def test_short_and_number_heavy_items_are_found_word_for_word(spark):
    items = [(1, "Calculate 17 * 23 + 5 - 2"), (2, "What is 15% of 80?"), (3, "3 5 8 13 21 34 55 89 144 233")]
    rows = [(i, f"Before. {t} And after.") for i, t in items]
    rows += [(11, "Calculate 17 + 23 + 5 - 2"), (12, "What is 16% of 80?"), (13, "3 5 9 13 21 35 55 89 144 234"), (14, "Calculate 17 and go")]
    assert leaks(spark, rows, items) == {(i, i): "copy" for i, _ in items}


def test_items_full_of_names_are_found_in_any_case(spark):
    item = ("Yesterday Anna met Bert near the Danube while Clara and Doris rode with Emil to Graz where Frida lost the Hammer of Ida "
            "and Jonas told Karl about Linz before Maria saw Nora leave the Opera with Paul for Rome")
    rows = [(1, item.lower()), (2, f"so it was. {item.upper()}"), (3, item.title()), (4, f"So: {item}"), (5, item.lower().replace("met", "saw").replace("lost", "found"))]
    got = leaks(spark, rows, [(100, item), (101, item.lower().replace("yesterday", "today"))])
    assert set(got) >= {(i, j) for i in (1, 2, 3, 4, 5) for j in (100, 101)} and {got[i, 100] for i in (1, 2)} == {"copy"}


def test_runs_of_slots_count_with_all_their_values(spark):
    items = [(1, "Put the numbers 3 4 9 in rising order and then tell us which one is the middle of them"),
             (2, "Yesterday the letter of Alice Smith came to the house of Alice Smith near the old mill by the river")]
    rows = [(1, items[0][1].replace("3 4 9", "3 7 1")), (2, items[0][1]), (3, items[1][1].replace("Smith", "Jones")), (4, items[1][1]),
            (5, items[1][1].replace("Alice Smith came", "Alice Jones came"))]
    assert leaks(spark, rows, items) == {(1, 1): "new values", (2, 1): "copy", (3, 2): "new values", (4, 2): "copy", (5, 2): "copy"}


def test_slots_are_consistent_by_brute_force(spark):
    """Numbers, units and names at random, in items of one window per slot place; a plain reading of the rule tells what leaks."""
    r = random.Random(9)
    kinds = {"N": ["3", "17", "250"], "U": ["km", "hours", "kg"], "P": ["Anna", "Bert", "Clara"]}
    words = [f"v{c}x" for c in "abcdefghijklmnopqrst"]
    shapes = []
    for _ in range(6):
        shape = r.sample(words, 14)
        for k in sorted(r.sample(range(1, 14), 4), reverse=True):
            shape.insert(k, r.choice("NUP"))
        shapes.append([x for k, x in enumerate(shape) if not (x in kinds and k and shape[k - 1] in kinds)])

    def fill(shape):
        return [r.choice(kinds[x]) if x in kinds else x for x in shape]

    def leaking(shape, item, doc):
        pairs = [(a, b) for x, a, b in zip(shape, item, doc) if x in kinds]
        became = {}
        for a in {a for a, _ in pairs}:
            counts = sorted(((sum(p == (a, b) for p in pairs), b) for b in {b for q, b in pairs if q == a}), reverse=True)
            became[a] = counts[0][1] if len(counts) == 1 or counts[0][0] > counts[1][0] else None
        n = len(shape) - D.WINDOW + 1
        good = exact = 0
        for p in range(n):
            own = [(a, b) for x, a, b in list(zip(shape, item, doc))[p:p + D.WINDOW] if x in kinds]
            same = all(a == b for a, b in own)
            exact += same
            good += same or all(became[a] == b for a, b in own)
        return ("copy" if good == exact else "new values") if good >= max(1, min(-(-n // 2), D.ENOUGH)) else None
    items, rows, want = [], [], {}
    for j, shape in enumerate(shapes):
        item = fill(shape)
        items.append((j, " ".join(item)))
        for _ in range(8):
            doc = fill(shape)
            rows.append((len(rows), "zz " + " ".join(doc)))
            kind = leaking(shape, item, doc)
            if kind:
                want[len(rows) - 1, j] = kind
    assert leaks(spark, rows, items) == want and len(want) > 5


def test_items_in_scripts_without_blanks(spark):
    item = "请计算一列火车以每小时十公里的速度行驶三个小时之后离开城市的距离是多少并说明理由吧"
    thai = "รถไฟออกจากสถานีด้วยความเร็วคงที่และถึงเมืองถัดไปหลังจากนั้น"
    rows = [(1, item), (2, f"前言。{item}结束"), (3, "请计算一列火车"), (4, f"a {thai} b"), (5, "今天天气很好我们去公园散步吧")]
    assert leaks(spark, rows, [(1, item), (2, thai)]) == {(1, 1): "copy", (2, 1): "copy", (4, 2): "copy"}


def test_known_words_take_few_bytes():
    import tracemalloc
    templates = D.Templates()
    pieces = [[" ".join(f"word{i}x" for i in range(a, a + 10_000))] for a in range(0, 400_000, 10_000)]
    tracemalloc.start()
    for piece in pieces:
        templates.read(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
