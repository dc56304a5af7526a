"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A text becomes three blocks of weighted term counts: trigrams of its sequence of character classes with runs folded,
how often words repeat, and hashed words. A singular value decomposition of a bounded sample of labelled rows
(`per_label` rows of each label, chosen by a hash of the id) gives DIMS latent dimensions. The sample's vectors, at most
2 * per_label * DIMS numbers, go to every task; each task computes its documents' exact cosines with all of them in blocks,
and the NEIGHBOURS nearest vote with weights that grow with similarity. The sample is balanced, so a score is a likelihood
for label 1 under equal priors.

Defined results: a null text is the empty text; an empty text has no direction, so it is equally near to all labelled vectors and scores their mean label; null and
repeated ids are ordinary rows; of repeated labels the lowest counts, null ones don't; with labels of one kind only every
score is that label, with none UNKNOWN; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import body, fold, tune

PER_LABEL, DIMS, NEIGHBOURS, SHARPNESS = 1500, 64, 25, 20.0
THRESHOLD, UNKNOWN = 0.3, 0.5
CLASSES, WORD_BUCKETS, REPEATS = 40, 4096, 4
SHAPE_WEIGHT, REPEAT_WEIGHT, WORD_WEIGHT = 0.7, 0.6, 0.38
AT_ONCE = 1024


def _class_table() -> bytes:
    """Capital, small or other letter, digit, blank, line end, and each punctuation mark by itself."""
    table, mark = bytearray(256), 6
    for b in range(256):
        c = chr(b)
        if "A" <= c <= "Z":
            table[b] = 1
        elif "a" <= c <= "z" or b >= 128:
            table[b] = 2
        elif "0" <= c <= "9":
            table[b] = 3
        elif c in "\n\r":
            table[b] = 5
        elif b <= 32 or b == 127:
            table[b] = 4
        else:
            table[b] = mark
            mark += 1
    return bytes(table)


TABLE = _class_table()
N_TERMS = CLASSES**3 + REPEATS + WORD_BUCKETS


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term ids, ascending, and their counts."""
    data = text.encode("utf-8", "surrogatepass")
    c = np.frombuffer(data.translate(TABLE), np.uint8)
    c = c[np.r_[True, c[1:] != c[:-1]]].astype(np.int64) if len(c) else c
    ids, counts = np.unique((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], return_counts=True) if len(c) > 2 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    words = data.lower().split()
    if not words:
        return ids, counts
    seen = Counter(words)
    same = sum(map(eq, words, words[1:]))
    repeats = np.array([same, len(words) - len(seen), len(seen), max(seen.values()) - 1])
    at = np.flatnonzero(repeats)
    buckets, sums = np.unique(np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in seen), np.int64, len(seen)), return_counts=True)
    base = CLASSES**3
    return np.concatenate([ids, base + at, base + REPEATS + buckets]), np.concatenate([counts, repeats[at], sums])


def weigh(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each block as a vector of its own length: damped counts times inverse document frequency."""
    base = CLASSES**3
    out = (1 + np.log(counts)) * idf[ids]
    repeat = (ids >= base) & (ids < base + REPEATS)
    n = counts[ids == base + 2].sum() + counts[ids == base + 1].sum()
    out[repeat] = counts[repeat] / max(1, n)  # shares, as lengths differ
    for part, weight in ((ids < base, SHAPE_WEIGHT), (repeat, REPEAT_WEIGHT), (ids >= base + REPEATS, WORD_WEIGHT)):
        norm = np.sqrt(np.square(out[part]).sum())
        if norm > 0:
            out[part] *= weight / norm
    return out


class Model:
    """idf, the projection to the latent dimensions, the labelled unit vectors and their labels."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray, int]], dims: int = DIMS, seed: int = 0):
        self.labels = np.array([y for _, _, y in sample], np.float64)
        df = np.zeros(N_TERMS)
        for ids, _, _ in sample:
            df[ids] += 1
        self.idf = (np.log((1 + len(sample)) / (1 + df)) + 1).astype(np.float32)
        self.known = np.flatnonzero(df >= min(3, max(1, len(sample) // 10)))
        if not len(sample) or not len(self.known):
            self.project, self.vectors = np.zeros((N_TERMS, 1), np.float32), np.zeros((len(sample), 1), np.float32)
            return
        column = np.full(N_TERMS, -1)
        column[self.known] = np.arange(len(self.known))
        matrix = np.zeros((len(sample), len(self.known)), np.float32)
        for i, (ids, counts, _) in enumerate(sample):
            to = column[ids]
            matrix[i, to[to >= 0]] = weigh(ids, counts, self.idf)[to >= 0]
        rank = min(dims, *matrix.shape)
        # randomized range finder with power iterations
        start = np.random.default_rng(seed).standard_normal((matrix.shape[1], min(rank + 16, *matrix.shape))).astype(np.float32)
        basis = np.linalg.qr(matrix @ start)[0]
        for _ in range(4):
            basis = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ basis)[0])[0]
        right = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:rank]
        self.project = np.zeros((N_TERMS, rank), np.float32)
        self.project[self.known] = right.T
        self.vectors = _unit(matrix @ right.T)

    def slim(self) -> dict:
        return {"idf": self.idf, "known": self.known, "project": self.project[self.known], "vectors": self.vectors, "labels": self.labels}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.square(x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


def vote(model: dict, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted mean label of the nearest labelled vectors, by exact cosines."""
    labels = model["labels"]
    if not len(labels):
        return np.full(len(vectors), UNKNOWN)
    out = np.empty(len(vectors))
    k = min(neighbours, len(labels))
    for at in range(0, len(vectors), AT_ONCE):
        cosine = vectors[at : at + AT_ONCE] @ model["vectors"].T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(cosine, near, 1).astype(np.float64)
        weight = np.exp(SHARPNESS * (sims - sims.max(1, keepdims=True)))
        out[at : at + AT_ONCE] = np.clip((weight * labels[near]).sum(1) / weight.sum(1), 0, 1)
    out[~vectors.any(1)] = labels.mean()  # equally near to all, so all vote
    return out


def embed(model: dict, texts: list[str]) -> np.ndarray:
    column = np.full(N_TERMS, -1)
    column[model["known"]] = np.arange(len(model["known"]))
    out = np.zeros((len(texts), model["project"].shape[1] if len(model["known"]) else 1), np.float32)
    for i, text in enumerate(texts):
        ids, counts = terms(text)
        if len(ids) and len(model["known"]):
            w = weigh(ids, counts, model["idf"])
            to = column[ids]
            out[i] = w[to >= 0].astype(np.float32) @ model["project"][to[to >= 0]]
    return _unit(out)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, label: str = "quality", doc_id: str = "doc_id", text: str = "text", held_out: int = 0) -> dict:
    """The model of at most per_label rows of each label whose fold isn't held_out."""
    tune(spark)
    marked = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    marked = marked.filter(fold("_id") != held_out).groupBy("_id").agg(F.min("_label").alias("_label"))
    pick = lambda y: marked.filter(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
    chosen = F.broadcast(pick(0).union(pick(1)))  # at most 2 * per_label rows
    found = docs.select(F.col(doc_id).alias("_id"), body(text).alias("_text")).join(chosen, "_id").select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [terms(x.as_py()) for x in b.column(2)]
            if pairs:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p[0].astype("<i4").tobytes() for p in pairs]), pa.array([p[1].astype("<i4").tobytes() for p in pairs])], names=["id", "y", "ids", "counts"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = found.mapInArrow(run, f"id {kind}, y int, ids binary, counts binary").groupBy("id").agg(F.min_by(F.struct("y", "ids", "counts"), F.sha2("ids", 256)).alias("x")).select("id", "x.*").toArrow()
    rows = rows.sort_by("id")
    unpack = lambda x: np.frombuffer(x.as_py(), "<i4").astype(np.int64)
    return Model([(unpack(i), unpack(c), y.as_py()) for i, c, y in zip(rows["ids"], rows["counts"], rows["y"], strict=True)]).slim()


def scores(spark: SparkSession, docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id and score of every row; keep: all columns of docs whose row reaches THRESHOLD, instead."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 * per_label vectors and the projection of known terms

    def rate(texts: pa.Array) -> np.ndarray:
        return vote(shared.value, embed(shared.value, [x or "" for x in texts.to_pylist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rate(b.column(1)))], names=["doc_id", "score"])

    def keep_good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(rate(b.column(b.schema.get_field_index(text))) >= THRESHOLD))

    if keep:
        return docs.mapInArrow(keep_good, docs.schema)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
