"""SimHash near-duplicate detection with pigeonring filtering.

A document's fingerprint has bit b set if over half of the hashes of its word shingles have. Fingerprints
at most `distance` bits apart are linked. With distance + 1 segments on a ring, every such pair has a segment from which each
chain of consecutive segments differs in at most its proportional share of the distance: none in the first
segment, at most one in the first two, and so on. Pairs are sought from every segment: the index key is the
exact first segment, the second segment is probed with at most one bit changed, and longer chains prune what is
left before the full Hamming check.

Only distinct fingerprints, one row each, are compared. A key with more than SPLIT fingerprints is split by the
remaining bits: a linked pair must also agree on one of their five parts. Each task gives a spanning forest of the links it
finds, never all pairs, and components are contracted in tables.

Defined results: ids are integers, others are refused with a TypeError; a null text is the empty text, with fingerprint zero; repeated rows share a
component; rows without an id have a fingerprint and the component of equal fingerprints, but link no others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, body, integer_ids, tune
from quillmesh.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
SPLIT, DEPTH = 1 << 15, 3
HASHES_AT_ONCE, PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 17, 1 << 21, 1 << 17


def shingle_hashes(text: str, k: int = SHINGLE) -> list[int]:
    """Hashes of all runs of k words, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(texts: list[str], k: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    return fingerprints_of([np.array(shingle_hashes(t, k), np.uint64) for t in texts])


def fingerprints_of(hashed: list[np.ndarray]) -> np.ndarray:
    """The 64-bit fingerprint of each text, from the hashes of its shingles."""
    counts, sizes = np.zeros((len(hashed), 64), np.int64), np.zeros(len(hashed), np.int64)
    held, owners, n = [], [], 0

    def flush() -> None:
        nonlocal held, owners, n
        if held:
            starts = np.cumsum([0] + [len(h) for h in held[:-1]])
            np.add.at(counts, owners, _bit_counts(np.concatenate(held), starts))
            held, owners, n = [], [], 0

    for i, hashes in enumerate(hashed):
        sizes[i] = len(hashes)
        for at in range(0, len(hashes), HASHES_AT_ONCE):
            part = hashes[at : at + HASHES_AT_ONCE]
            held.append(part)
            owners.append(i)
            n += len(part)
            if n >= HASHES_AT_ONCE:
                flush()
    flush()
    over = (counts * 2 > sizes[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_table(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _parts(bits: list[int], n: int) -> list[list[int]]:
    """n runs of nearly equal length."""
    edges = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(path: tuple[int, ...], distance: int) -> int:
    """The bits that a key fixes: a segment, then a part of what is left, and so on."""
    left, fixed = list(range(64)), 0
    for k in path:
        part = _parts(left, distance + 1)[k]
        fixed |= _mask(part)
        left = [b for b in left if b not in set(part)]
    return fixed


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the classes of a[i] and b[i] joined; each class is labelled by its least member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            far = label[label]
            if (far == label).all():
                break
            label = far


def links(group: np.ndarray, segment: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each row, the least row of its class among the rows of its group, linked by the rule of the ring.

    group: equal where keys are equal, ascending; segment: at which segment the chains of a row's key start.
    """
    n = distance + 1
    segments = [_mask(p) for p in _parts(list(range(64)), n)]
    low = np.array([(m & -m).bit_length() - 1 for m in segments], np.uint64)
    width = max(bin(m).count("1") for m in segments)
    chains = [np.array([sum(segments[(s + j) % n] for j in range(size)) for s in range(n)], np.uint64) for size in range(2, n)]
    second = (segment + 1) % n
    own = np.array(segments, np.uint64)[second]
    value = ((fp & own) >> low[second]).astype(np.int64)
    own_width = np.array([bin(m).count("1") for m in segments])[second]
    key = (group.astype(np.int64) << width) | value
    order = np.argsort(key, kind="stable")
    key, fp, segment, value, own_width = key[order], fp[order], segment[order], value[order], own_width[order]
    label, here = np.arange(len(key)), np.arange(len(key))

    def compare(at: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        nonlocal label
        ends = np.cumsum(count)
        begin = 0
        while begin < len(at):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
            size = count[begin:end]
            a = np.repeat(at[begin:end], size)
            b = np.repeat(first[begin:end], size) + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
            for length, chain in enumerate(chains, 2):
                x = (fp[a] ^ fp[b]) & chain[segment[a]]
                ok = np.bitwise_count(x) <= length * distance // n
                a, b = a[ok], b[ok]
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            label = _union(label, a[ok], b[ok])
            begin = end

    same = np.searchsorted(key, key, side="right")
    some = np.flatnonzero(same > here + 1)
    compare(some, some + 1, same[some] - some - 1)
    for b in range(width):
        up = np.flatnonzero(((value >> b) & 1 == 0) & (b < own_width))
        probe = key[up] | (1 << b)
        first, last = np.searchsorted(key, probe, side="left"), np.searchsorted(key, probe, side="right")
        some = last > first
        compare(up[some], first[some], (last - first)[some])
    out = np.empty(len(key), np.int64)
    out[order] = order[label]
    return out


def _link_tasks(distance: int):
    """Spanning forests of the links of rows (path, val, fp, rep) sorted by (path, val)."""

    def forest(path: np.ndarray, val: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (path[1:] != path[:-1]) | (val[1:] != val[:-1])]
        root = links(np.cumsum(new), path % 10, fp.view(np.uint64), distance)
        some = rep != rep[root]
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root][some])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            n += b.num_rows
            if n < ROWS_AT_ONCE:
                continue
            path, val, fp, rep = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.flatnonzero((path != path[-1]) | (val != val[-1]))[-1]) + 1 if (path[0], val[0]) != (path[-1], val[-1]) else 0
            if last:  # the last group may go on
                yield forest(path[:last], val[:last], fp[:last], rep[:last])
            held, n = [[c[last:] for c in (path, val, fp, rep)]], len(path) - last
        if n:
            yield forest(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _keyed(rows: DataFrame, paths: list[tuple[int, ...]], distance: int) -> DataFrame:
    """A row for each path; a path is written as decimal digits, the first segment last."""
    code = lambda p: sum(d * 10**i for i, d in enumerate(p)) + 10 ** len(p) * 9
    keys = F.array(*[F.struct(F.lit(code(p)).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(_masks(p, distance))).cast("long")).alias("val")) for p in paths])
    return rows.select(F.explode(keys).alias("k"), "fp", "rep").select("k.path", "k.val", "fp", "rep")


def linked(spark: SparkSession, rows: DataFrame, scratch: Scratch, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """u, v: a spanning forest of the links between the rep of rows (fp: distinct, rep: long) whose fingerprints differ in at most `distance` bits."""
    paths: list[tuple[int, ...]] = [(i,) for i in range(distance + 1)]
    edges: list[DataFrame] = []
    ready = _keyed(rows, paths, distance)
    for depth in range(1, DEPTH + 2):
        # at most one row for every `split` keyed fingerprints
        hot = None
        if depth <= DEPTH:
            hot = scratch.write(ready.groupBy("path", "val").count().filter(F.col("count") > split).select("path", "val"), f"hot-{depth}")
            if not hot.count():
                hot = None
        cold = ready if hot is None else ready.join(hot, ["path", "val"], "left_anti")
        ordered = cold.select("path", "val", "fp", "rep").repartition("path", "val").sortWithinPartitions("path", "val")
        edges.append(scratch.write(ordered.mapInArrow(_link_tasks(distance), "u long, v long"), f"links-{depth}"))
        if hot is None:
            break
        warm = ready.join(hot, ["path", "val"], "left_semi")
        longer = {p: [(*p, j) for j in range(distance + 1)] for p in paths}
        code = {p: sum(d * 10**i for i, d in enumerate(p)) + 10 ** len(p) * 9 for p in paths}
        parts = [_keyed(warm.filter(F.col("path") == code[p]).select("fp", "rep"), longer[p], distance) for p in paths]
        ready = parts[0]
        for x in parts[1:]:
            ready = ready.union(x)
        ready = scratch.write(ready, f"split-{depth}")
        paths = [q for p in paths for q in longer[p]]
    found = edges[0]
    for e in edges[1:]:
        found = found.union(e)
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE, k: int = SHINGLE, split: int = SPLIT, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row; component_id is the smallest doc_id that links reach."""
    integer_ids(docs, doc_id)
    scratch = scratch or Scratch(spark, "simhash")
    table = scratch.write(fingerprint_table(spark, docs, k, doc_id, text), "fingerprints")
    nodes = scratch.write(table.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    rows = nodes.filter("rep is not null").select("fp", F.col("rep").cast("long").alias("rep"))
    roots = connected_components(spark, linked(spark, rows, scratch, distance, split), scratch)
    named = nodes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return table.join(named, "fp").select("doc_id", "fp", "component_id")
