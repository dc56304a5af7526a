"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND with every training passage.

Every text is cut into overlapping passages of twice the longest item's words, so each item that stands in a text stands whole in
some passage. A passage's score for an item is the BM25 weight of the item's terms that it holds, over
the weight of all its terms; all items that reach MIN_SCORE are retrieved. Items stand in blocks; a block is searched, with a pivot, only if the
terms' largest weights in it can reach that score. A retrieved item counts as leaked if the passage
holds at least MIN_OVERLAP of the five-word shingles of the whole item and of its question, and half of its answer's. The
question ends at the last question mark or before "answer:", or else before the last sentence.

The items are shared with every task in parts of at most PART_BYTES of text, one pass over the documents for each part; document
frequencies are those of all items.

Defined results: null or empty texts match nothing; null and repeated ids are ordinary rows; repeated
items each match; items without words are ignored; empty tables give no rows; other columns are ignored or, when
filtering, kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import body, tune

K1, B = 1.2, 0.75
MIN_SCORE, MIN_OVERLAP, MIN_ANSWER, SHINGLE = 0.6, 0.8, 0.5, 5
BLOCKS, PART_BYTES, SLACK = 64, 2 << 20, 1e-5
CLASS, STEP = 64, 4
#: Letters and digits stay; all else parts words. The table is for texts in ASCII.
TABLE = bytes(b if chr(b).isalnum() else 32 for b in range(128)) + bytes([32]) * 128
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[bytes]:
    """Words, case folded."""
    if text.isascii():
        return text.encode().lower().translate(TABLE).split()
    return " ".join(WORD.findall(unicodedata.normalize("NFC", text).casefold())).encode().split()


def parts_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    m = re.search(r"(?is)^(.*)\banswer\s*:(.*)$", text) or re.search(r"(?s)^(.*\?)(.*\w.*)$", text) or re.search(r"(?s)^(.*\w.*[.!])(.*\w.*)$", text.rstrip(" \t\r\n.!")) or None
    question, answer = (words_of(m[1]), words_of(m[2])) if m else (words_of(text), [])
    return question, answer


def shingles(words: list[bytes], k: int = SHINGLE) -> set[bytes]:
    k = min(k, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


class Index:
    """Postings of normalised BM25 weights, with the largest weight of each term in every one of BLOCKS ranges of items."""

    def __init__(self, items: list[tuple[object, str]], df: dict[bytes, int] | None = None, n_items: int | None = None, mean_words: float | None = None):
        rows = sorted(((i, t, words_of(t)) for i, t in items if t and words_of(t)), key=lambda r: (str(type(r[0])), r[0] if r[0] is not None else 0, r[1]))
        self.items = [r[0] for r in rows]
        df = df or Counter(w for r in rows for w in set(r[2]))
        n, mean = n_items or len(rows), mean_words or sum(len(r[2]) for r in rows) / max(1, len(rows))
        self.longest = max((len(r[2]) for r in rows), default=0)
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for d, (_, _, words) in enumerate(rows):
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in Counter(words).items()}
            total = sum(weight.values())
            for w, x in weight.items():
                postings[w].append((d, x / total))
        self.ids = {w: i for i, w in enumerate(sorted(postings))}
        lists = [postings[w] for w in sorted(postings)]
        self.docs = [[d for d, _ in p] for p in lists]
        self.weights = [[x for _, x in p] for p in lists]
        self.width = max(1, -(-len(rows) // BLOCKS))
        self.block_max = np.zeros((len(lists), max(1, -(-len(rows) // self.width))), np.float32)
        for t, p in enumerate(lists):
            for d, x in p:
                self.block_max[t, d // self.width] = max(self.block_max[t, d // self.width], x)
        self.term_max = np.array([max(w) for w in self.weights] or [0.0])
        self.whole = [shingles(r[2]) for r in rows]
        self.sides = [tuple(shingles(p) for p in parts_of(r[1])) for r in rows]

    def search(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """All items with a score of at least `least` for these distinct terms: block by block, with a pivot in each that may hold one."""
        out = []
        bounds = self.block_max[terms].sum(0)
        for k in np.flatnonzero(bounds >= least - SLACK).tolist():
            first, end = k * self.width, (k + 1) * self.width
            cursors = []
            for t in terms[self.block_max[terms, k] > 0].tolist():
                at = bisect_left(self.docs[t], first)
                cursors.append([self.docs[t][at], at, t, float(self.block_max[t, k])])
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, -1
                for i, c in enumerate(cursors):
                    bound += c[3]
                    if bound >= least - SLACK:
                        pivot = i
                        break
                if pivot < 0:
                    break
                d = cursors[pivot][0]
                if cursors[0][0] == d:
                    score = sum(self.weights[c[2]][c[1]] for c in cursors if c[0] == d)
                    if score >= least:
                        out.append((d, score))
                    d += 1
                for c in cursors:
                    if c[0] < d:
                        docs = self.docs[c[2]]
                        c[1] = bisect_left(docs, d, c[1])
                        c[0] = docs[c[1]] if c[1] < len(docs) else end
                cursors = [c for c in cursors if c[0] < end]
        return out

    def passages(self, n: int) -> Iterator[tuple[int, int]]:
        size = max(2 * self.longest, 2)
        at = 0
        while True:
            yield at, min(n, at + size)
            if at + size >= n:
                return
            at += size // 2

    def leaks(self, text: str, least: float = MIN_SCORE) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage) of leaked items, each at its best passage."""
        return self.leaks_in(words_of(text), least)

    def leaks_in(self, words: list[bytes], least: float = MIN_SCORE) -> list[tuple[int, float, float, float, int]]:
        if not words or not self.items:
            return []
        get = self.ids.get
        terms = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        reach = np.concatenate([[0.0], np.cumsum(np.where(terms >= 0, self.term_max[terms], 0))])
        order = np.argsort(terms, kind="stable")
        before = np.full(len(terms), -1)  # where the word stood last
        same = terms[order[1:]] == terms[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        best: dict[int, tuple] = {}
        for a, b in self.passages(len(words)):
            if reach[b] - reach[a] < least - SLACK:
                continue
            part = terms[a:b]
            own = part[(before[a:b] < a) & (part >= 0)]
            held = None
            for d, score in self.search(own, least):
                held = shingles(words[a:b]) if held is None else held
                if len(words) < SHINGLE or any(len(s) and len(next(iter(s)).split()) < SHINGLE for s in self.sides[d]):
                    inside = lambda s: sum(_within(x, words[a:b]) for x in s)  # noqa: B023, E731
                else:
                    inside = lambda s: len(s & held)  # noqa: B023, E731
                share = lambda s: inside(s) / len(s) if s else 1.0  # noqa: B023, E731
                whole, question, answer = share(self.whole[d]), *map(share, self.sides[d])
                if whole >= MIN_OVERLAP and question >= MIN_OVERLAP and answer >= MIN_ANSWER:
                    best[d] = max(best.get(d, (0, 0, 0, 0)), (score, question, answer, -a))
        return [(d, s, q, x, -a) for d, (s, q, x, a) in sorted(best.items())]


class Indexes:
    """An index for each class of lengths, so that a long item doesn't widen the passages that short ones are sought in: up to CLASS words, up to CLASS * STEP words, and so on."""

    def __init__(self, items: list[tuple[object, str]], df: dict[bytes, int] | None = None, n_items: int | None = None, mean_words: float | None = None):
        sized = [(i, t, words_of(t)) for i, t in items if t]
        sized = [r for r in sized if r[2]]
        df = df or Counter(w for r in sized for w in set(r[2]))
        n_items, mean_words = n_items or len(sized), mean_words or sum(len(r[2]) for r in sized) / max(1, len(sized))
        classes: dict[int, list[tuple[object, str]]] = defaultdict(list)
        for i, t, words in sized:
            k, most = 0, CLASS
            while len(words) > most:
                k, most = k + 1, most * STEP
            classes[k].append((i, t))
        self.parts = [Index(classes[k], df, n_items, mean_words) for k in sorted(classes)]

    def leaks(self, text: str, least: float = MIN_SCORE) -> list[tuple[object, float, float, float, int]]:
        """As of an index, with the items' own ids."""
        words = words_of(text)
        return [(p.items[d], *rest) for p in self.parts for d, *rest in p.leaks_in(words, least)]


def _within(shingle: bytes, words: list[bytes]) -> bool:
    return b" " + shingle + b" " in b" " + b" ".join(words) + b" "


def indexes(spark: SparkSession, items: DataFrame, item_id: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES) -> Iterator[Indexes]:
    """An index for every part of the items."""
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    total, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = -(-(total or 0) // part_bytes)
    if parts <= 1:
        yield Indexes([tuple(r) for r in rows.collect()])  # at most part_bytes
        return
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                words = words_of(t.as_py())
                if words:
                    own = sorted(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([len(words)] + [0] * (len(own) - 1), pa.int64()), pa.array([1] + [0] * (len(own) - 1), pa.int64())], names=["w", "n_words", "n"])

    words = rows.mapInArrow(run, "w binary, n_words long, n long")
    n_words, n_items = words.agg(F.sum("n_words"), F.sum("n")).first()
    for p in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p)
        used = own.mapInArrow(run, "w binary, n_words long, n long").select("w").distinct()
        df = {bytes(r["w"]): r["df"] for r in words.join(used, "w").groupBy("w").agg(F.count("*").alias("df")).collect()}
        yield Indexes([tuple(r) for r in own.collect()], df, n_items, n_words / max(1, n_items))


def leaked(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word: a row for every item leaked into every document."""
    tune(spark)
    kinds = [docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = "doc_id {}, item_id {}, score double, question_overlap double, answer_overlap double, first_word long".format(*kinds)
    out = None
    for index in indexes(spark, items, item_id, text, part_bytes):
        shared = spark.sparkContext.broadcast(index)  # made of at most part_bytes of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(1)):
                    for x in index.leaks(t.as_py()):
                        at.append(i)
                        found.append(x)
                if found:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *map(pa.array, zip(*found, strict=True))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).mapInArrow(run, schema)
        out = rows if out is None else out.union(rows)
    return out


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without the rows into which an item has leaked."""
    tune(spark)
    for index in indexes(spark, items, item_id, text, part_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.leaks(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
