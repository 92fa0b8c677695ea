import zlib

import numpy as np
import pytest

from corpusguard.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    from corpusguard.llm.queries import vocabulary
    return vocabulary()


TEXTS = [None, "", " ", "Hello, World! It's 3.5 km; isn't it?", "a\n\nb\tc\r\nd e f", "ÀÉÎ straße İstanbul ΣΟΦΟΣ ẞ", "é H̱ x",
         "<|endoftext|> a<|startoftext|>b", "a <|ENDOFTEXT|> b", "A<|StartOfText|>B <|endoftext|>", "İstanbul I ı ﬁne ǅ K", "word!!? (x). \"q\".", "日本語 текст 123٣", "''s 's't", "end.", "long " * 9000, "x" * 3000 + ". " + "y. " * 5000,
         "\x1c\x85​ a", "№5 ½ ² ..,.. !"]


def test_pieces_hold_every_id_once(spark, vocabulary):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(vocabulary)
    rows = [(i, TEXTS[i % len(TEXTS)], 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = P.pack_documents(docs, vocabulary).collect()
    ids = {i: np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [P.END_ID], "<u4") for i, t, _ in rows}
    at = {}
    for x in sorted(got, key=lambda x: (x.doc_id, x.start)):
        own = ids[x.doc_id]
        assert x.start == at.get(x.doc_id, 0) and x.length > 0 and x.doc_tokens == len(own)
        assert x.ids_crc32 == zlib.crc32(own[x.start:x.start + x.length].tobytes()), TEXTS[x.doc_id % len(TEXTS)]
        at[x.doc_id] = x.start + x.length
    assert at == {i: len(v) for i, v in ids.items()}
    fill = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == fill.get(x.sequence_id, 0)
        fill[x.sequence_id] = x.offset + x.length
    padding = sum(0 if n & (n - 1) == 0 else P.WINDOW - n for n in fill.values())
    assert max(fill.values()) <= P.WINDOW and padding < 0.02 * sum(fill.values())


def cost(places, costs, cuts, window):
    price, last = dict(zip(places, costs)), 0
    total = 0
    for c in cuts:
        total += window - (c - last) + price[c]
        last = c
    return total


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(3)
    for _ in range(60):
        places = np.cumsum(r.integers(1, 12, r.integers(1, 14))).tolist()
        costs = r.integers(0, 9, len(places)).astype(float).tolist()
        window = 16
        cuts = P.best_cuts(places, costs, window)
        assert all(b - a <= window for a, b in zip([0, *cuts], cuts)) and places[-1] - (cuts[-1] if cuts else 0) < window
        best = {0: 0.0}
        for p, c in zip(places, costs):
            best[p] = min(v + window - (p - q) + c for q, v in best.items() if 0 < p - q <= window)
        want = min(v - q for q, v in best.items() if places[-1] - q < window)
        assert cost(places, costs, cuts, window) - (cuts[-1] if cuts else 0) == pytest.approx(want)


def test_cut_places_leave_no_gap_and_empty_table(spark, vocabulary):
    places, costs = P.cut_places(np.asarray([5, 5, 900, 2000]), 1500)
    assert places[-1] == 1500 and costs[-1] == 0 and (np.diff(np.concatenate([[0], places])) <= P.STRIDE).all() and (np.diff(places) > 0).all()
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert P.pack_documents(docs.limit(0), vocabulary).collect() == []
    assert sorted((x.doc_id or -1, x.length) for x in P.pack_documents(docs.coalesce(1), vocabulary).collect()) == [(-1, 2), (1, 2), (1, 2)]


def test_words_at_random_have_the_tokenizers_ids(vocabulary):
    import random
    words, r = P.WordIds(vocabulary), random.Random(6)
    letters = "aAbzZ éÉßİıΣςЖж日本ǅﬁ٣9'’s.,!?-_<|>\n\t\u0301\u00a0$%"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += [t + r.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>"]) + t for t in texts[:200]]
    parts = [words.words(t) for t in texts]
    words.learn(parts)
    for t, p in zip(texts, parts):
        assert words.document(p)[0][:-1].tolist() == words.ids(t), t


def test_tokenizers_across_white_space_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        P.WordIds(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
