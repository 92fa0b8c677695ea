"""Order-preserving packing of documents into token windows by dynamic programming.

Documents are read in the order of their input partition and become ids, each with
an end id. Windows of at most ``window`` ids are cut from that stream. A cut costs
the padding of its window plus a penalty by its place: nothing at the end of a
document, little at the end of a sentence, more inside one. The least total over
all cuts is found with a queue of candidates in rising cost (each start of a window
enters and leaves it once), in blocks: of each block the last windows are planned
again with what follows. What is left at the end of a partition is cut into
lengths that are powers of two, which need no padding.

Nothing is shuffled, so the plan is as wide as the input has partitions, and a lost
task is repeated from its own partition. A sequence id holds its partition's number.

Nulls and edges: a null or empty text is the end id alone; null ids stay null and
repeated rows are packed each, with places counted from the start of their own row.
An empty table gives no pieces. Other columns are ignored. A text longer than a
window is spread over as many windows as it needs.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusguard.llm.common import slices

WINDOW = 4096
END_ID = 2
SENTENCE_COST, INSIDE_COST = 8.0, 24.0
#: Only inside sentences longer than this, a cut is offered every so many ids.
STRIDE = 64
BLOCK = 1 << 17
CACHED_WORDS = 800_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
STOPS = re.compile(r"[.,;:!?](?<=[^\W_].)[.,;:!?]*(?= |$)")
PERIOD = re.compile(r"[.!?](</w>)?$")


class WordIds(dict):
    """Ids of words as little-endian bytes. White space must end a token, so that a text's ids are those of its words."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        # the same model for words of letters in lower case, which need no folding and no other cuts than at blanks
        self.plain = Tokenizer.from_str(vocabulary)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        sample = "the quick brown fuchs überquert añadir l été straße один 日本 abcdefghijklmnopqrstuvwxyz"
        if self.ids(sample) != self.plain.encode(sample, add_special_tokens=False).ids:
            self.plain = self.tokenizer
        for apart, together in ((["a", "b"], "a b"), (["a.", "'s", "7"], "a. \n 's  7")):
            if sum((self.ids(w) for w in apart), []) != self.ids(together):
                raise ValueError("a tokenizer is needed whose tokens end at white space")
        # upper case is folded here too if the tokenizer does so itself
        self.folds = self.ids("A B. É") == self.ids("a b. é")
        self.special = [t["content"].lower() for t in json.loads(vocabulary).get("added_tokens", [])]
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values(), default=0) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.ends_sentence = np.zeros(max(names.values(), default=0) + 1, bool)
        self.ends_sentence[[i for name, i in names.items() if PERIOD.search(name)]] = True

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, text: str) -> list[str]:
        """Pieces between blanks. Texts of Latin letters are folded first, and stops set apart from the word before
        them, both of which the tokenizer does itself; fewer words are then distinct. The tokenizer looks for its
        special tokens before it folds, so texts that have one in any case are left as they are."""
        text = text.replace("\n", " ")
        if self.folds and (text.isascii() or not BEYOND_LATIN.search(text)):
            folded = text.lower()
            if not any(t in folded for t in self.special):
                return STOPS.sub(r" \g<0>", folded).split(" ")
        return text.split(" ")

    def learn(self, texts: list[list[str]]) -> None:
        """Tokenize the words not known yet, many in one call; a full store is emptied first."""
        if len(self) > CACHED_WORDS:
            self.clear()
        new = [w for w in set().union(*texts) if w not in self]
        # of small letters alone each word is one piece, so the tokens that end a word part them
        letters = [w for w in new if w.isalpha() and w == w.lower()]
        for i in range(0, len(letters), 4096):
            self._learn_letters(letters[i:i + 4096])
        others = [w for w in new if w not in self]
        for i in range(0, len(others), 4096):
            part = others[i:i + 4096]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            places = np.searchsorted(ends, [o[0] for o in found.offsets], side="right")
            self._keep(part, np.asarray(found.ids, "<u4"), np.searchsorted(places, np.arange(len(part) + 1)))

    def _learn_letters(self, part: list[str]) -> None:
        text = " ".join(part)
        tokenizer = self.plain if unicodedata.is_normalized("NFC", text) else self.tokenizer
        ids = np.asarray(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        bounds = np.concatenate([[0], np.flatnonzero(self.ends_word[ids]) + 1])
        if len(bounds) == len(part) + 1 and bounds[-1] == len(ids):
            self._keep(part, ids, bounds)

    def _keep(self, part: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        data, at = ids.tobytes(), (4 * bounds).tolist()
        self.update(zip(part, [data[a:b] for a, b in zip(at, at[1:])]))

    def document(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id, and the places after each sentence."""
        ids = np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")
        return np.append(ids, np.uint32(END_ID)).astype("<u4"), np.flatnonzero(self.ends_sentence[ids]) + 1


#: Kept by a worker from task to task, by vocabulary.
KNOWN: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    if vocabulary not in KNOWN:
        KNOWN.clear()
        KNOWN[vocabulary] = WordIds(vocabulary)
    return KNOWN[vocabulary]


def cut_places(sentences: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising places in one document where a window may end, the last being its end, and the cost of each."""
    sentences = np.unique(sentences[(sentences > 0) & (sentences < total)])
    marks = np.concatenate([[0], sentences, [total]])
    inside = [np.arange(lo + STRIDE, hi, STRIDE) for lo, hi in zip(marks[:-1], marks[1:]) if hi - lo > STRIDE]
    places = np.concatenate([sentences, [total], *inside]).astype(np.int64)
    costs = np.concatenate([np.full(len(sentences), SENTENCE_COST), [0.0], np.full(len(places) - len(sentences) - 1, INSIDE_COST)])
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def best_cuts(places: list[int], costs: list[float], window: int) -> list[int]:
    """Places to cut a stream that starts at 0; the last cut lies less than a window before the end.

    ``places`` rise and are nowhere more than ``window`` apart.
    """
    starts, totals, back = [0, *places], [0.0], [0]
    queue: deque[int] = deque([0])
    for j in range(1, len(starts)):
        at = starts[j]
        while at - starts[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        total = totals[i] + window - (at - starts[i]) + costs[j - 1]
        totals.append(total)
        back.append(i)
        key = total + at
        while queue and totals[queue[-1]] + starts[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    end = starts[-1]
    j = min((k for k in range(len(starts)) if end - starts[k] < window), key=lambda k: totals[k] - starts[k])
    cuts = []
    while j:
        cuts.append(starts[j])
        j = back[j]
    return cuts[::-1]


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Pieces of the rows of ``docs`` (doc_id, text); ``vocabulary`` is the tokenizer's file content, of fixed size.

    A piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its
    ids as little-endian 32-bit numbers), doc_tokens, sequence_id, offset in the sequence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(shared.value)
        number = TaskContext.get().partitionId() << 40
        waiting: deque[list] = deque()  # doc_id, ids, cut places, costs, done: the ids of it that are packed
        held = 0

        def emit(cuts: list[int]) -> pa.RecordBatch:
            """Take windows that end at ``cuts`` off the front of what waits."""
            nonlocal number, held
            rows, last = [], 0
            for cut in cuts:
                room, offset = cut - last, 0
                while room:
                    doc = waiting[0]
                    take = min(room, len(doc[1]) - doc[4])
                    rows.append((doc[0], doc[4], take, zlib.crc32(doc[1][doc[4]:doc[4] + take]), len(doc[1]), number, offset))
                    doc[4] += take
                    room, offset = room - take, offset + take
                    if doc[4] == len(doc[1]):
                        waiting.popleft()
                number, last = number + 1, cut
            held -= last
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in SCHEMA.split(", ")])

        def planned() -> list[int]:
            places, costs, at = [], [], 0
            for _, ids, marks, prices, done in waiting:
                ahead = marks > done
                places.append(marks[ahead] + (at - done))
                costs.append(prices[ahead])
                at += len(ids) - done
            return best_cuts(np.concatenate(places).tolist(), np.concatenate(costs).tolist(), window) if places else []

        for batch in slices(batches):
            texts = [words.words(t or "") for t in batch.column("text").to_pylist()]
            words.learn(texts)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids, sentences = words.document(text)
                waiting.append([doc_id, ids, *cut_places(sentences, len(ids)), 0])
                held += len(ids)
                if held >= max(BLOCK, 8 * window):
                    yield emit(planned()[:-2])
        yield emit(planned())
        rest, cuts = held, []
        while rest:
            cuts.append((cuts[-1] if cuts else 0) + (1 << rest.bit_length() - 1))
            rest -= 1 << rest.bit_length() - 1
        yield emit(cuts)

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)
