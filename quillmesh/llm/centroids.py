"""Centroid clustering of integer vectors with Drake's adaptive bounds.

Every vector carries its centroid, the next nearest ones in order with a lower bound of the distance to each, and one bound for all
the rest. When centroids move, bounds shrink by the moves; the first bound that lies beyond the exact distance to the own centroid
certifies that nothing from there on can be nearer, so only what stands before it is measured anew. Where no bound certifies, all
centroids are rescanned exactly. The number of bounds adapts: as many as the round before had use for, from a quarter of the
centroids down to an eighth. Bounds are rounded outwards and decide strictly, so the result is that of exact assignment, ties included.

State lives in tables of the shared folder, rewritten once for each round; the driver holds centroids and their sums only.

Nulls: a vector that is null, has another length or a component that is null or not finite is left out; a null id counts as the empty
text where seeds are chosen. Components beyond 2^27 after scaling count as 2^27, so that a squared distance fits in a long. Repeated
rows are clustered each; of seeds with one hash, that of the smaller components comes first. Fewer vectors than centroids make fewer
centroids; no vectors, no rows. A sum of distances beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, tune

#: Largest size of a scaled component: 64 squares of twice this sum to 2^62.
LARGEST = 1 << 27
BATCH = 4096
#: Part of a bound by which it is rounded outwards; doubles err by less.
SLACK = 1e-12


def integer_vectors(vectors: DataFrame, dim: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v, the floors of the scaled components, of the rows that can be clustered."""
    wide = F.col(vector).cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return vectors.filter((F.size(wide) == dim) & finite).select(F.col(vec_id).alias("vec_id"), F.transform(wide, whole).alias("v"))


def seeds(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id, in their order."""
    tag = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in kept.orderBy(tag, "v").select("v").limit(k).collect()], np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to its own row of centroids, or to each centroid where these have one axis more."""
    gap = v[:, None, :] - centroids if centroids.ndim == 3 else v - centroids
    return np.einsum("...d,...d->...", gap, gap)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(float)) * (1 - SLACK)


def scan(v: np.ndarray, centroids: np.ndarray, bounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own centroid, its squared distance, the next ones in order and the bounds, from all exact distances."""
    every = np.stack([squared(v, np.broadcast_to(c, v.shape)) for c in centroids], axis=1)
    order = np.argsort(every, axis=1, kind="stable")  # ties: smaller number first
    ranked = np.take_along_axis(every, order, axis=1)
    rest = _below(ranked[:, bounds + 1]) if len(centroids) > bounds + 1 else np.full(len(v), np.inf)
    return order[:, 0], ranked[:, 0], order[:, 1 : bounds + 1], np.column_stack([_below(ranked[:, 1 : bounds + 1]), rest])


def reassign(v: np.ndarray, own: np.ndarray, near: np.ndarray, low: np.ndarray, moves: np.ndarray, centroids: np.ndarray, bounds: int) -> tuple[np.ndarray, ...]:
    """The same after centroids moved, and how many bounds each row had use for: all and one more where it was rescanned."""
    shift = np.column_stack([moves[near], np.full(len(v), moves.max())])
    low = low - shift - SLACK * (np.where(np.isinf(low), 0, np.abs(low)) + shift)
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1][:, : bounds + 1].copy()  # what bounds j bounds all after j
    near, own, d2 = near[:, :bounds].copy(), own.copy(), squared(v, centroids[own])
    sure = np.sqrt(d2.astype(float))[:, None] * (1 + SLACK) < low
    used = np.where(sure.any(axis=1), sure.argmax(axis=1), bounds + 1)
    for j in range(1, bounds + 1):
        at = np.flatnonzero(used == j)
        if len(at):
            mine = np.sort(np.column_stack([own[at], near[at, :j]]), axis=1)  # by number, so that a stable sort keeps ties in order
            found = squared(v[at], centroids[mine])
            order = np.argsort(found, axis=1, kind="stable")
            mine, found = np.take_along_axis(mine, order, axis=1), np.take_along_axis(found, order, axis=1)
            own[at], d2[at], near[at, :j], low[at, :j] = mine[:, 0], found[:, 0], mine[:, 1:], _below(found[:, 1:])
    at = np.flatnonzero(used == bounds + 1)
    if len(at):
        own[at], d2[at], near[at], low[at] = scan(v[at], centroids, bounds)
    return own, d2, near, low, used


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1), kind))


STATE = "v array<int>, cluster int, distance long, near array<int>, low array<double>, used int"


def _round(held: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, bounds: int) -> DataFrame:
    """held with its state after one assignment; moves: how far each centroid went since the last, none at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda name, kind: _matrix(b.column(b.schema.get_field_index(name)), b.num_rows, kind)  # noqa: B023, E731
            v = column("v", np.int64)
            if moves is None:
                own, d2, near, low = scan(v, centroids, bounds)
                used = np.full(len(v), bounds + 1)
            else:
                own = b.column(b.schema.get_field_index("cluster")).to_numpy().astype(np.int64)
                own, d2, near, low, used = reassign(v, own, column("near", np.int64), column("low", float), moves, centroids, bounds)
            yield pa.RecordBatch.from_arrays([
                b.column(b.schema.get_field_index("vec_id")), _lists(v, pa.int32()), pa.array(own, pa.int32()), pa.array(d2), _lists(near, pa.int32()), _lists(low, pa.float64()), pa.array(used, pa.int32()),
            ], names=["vec_id", "v", "cluster", "distance", "near", "low", "used"])

    return held.mapInArrow(run, f"vec_id {held.schema['vec_id'].dataType.simpleString()}, {STATE}")


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v, cluster, distance, cluster_inertia, inertia and centroid of each vector that can be clustered.

    rounds assignments, each followed by the move of every non-empty centroid to the floor of its mean; then one more assignment.
    """
    tune(spark, BATCH)
    scratch = Scratch(spark, "centroids")
    kept = integer_vectors(vectors, dim, scale, vec_id, vector)
    centroids = seeds(kept, k, seed)
    n = len(centroids)
    bounds = min(max(n - 1, 0), max(1, n // 4))
    moves: np.ndarray | None = None
    held = kept
    for at in range(rounds + 1 if n else 0):
        held = scratch.write(_round(held, centroids, moves, bounds), f"state-{at}")
        if at:
            scratch.drop(f"state-{at - 1}")
        if at < rounds:
            sums = held.groupBy("cluster").agg(F.count("*").alias("n"), F.max("used").alias("used"), F.array(*(F.sum(F.col("v")[i]) for i in range(dim))).alias("s")).collect()  # one row for each centroid
            moved = centroids.copy()
            for r in sums:
                moved[r["cluster"]] = [x // r["n"] for x in r["s"]]
            moves = np.sqrt(squared(moved, centroids).astype(float)) * (1 + SLACK)
            centroids = moved
            if at:
                bounds = min(bounds, max(1, n // 8, max(r["used"] for r in sums)))
    if not n:
        held = kept.limit(0).select("*", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    totals = {r["cluster"]: r["d"] for r in held.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}  # one row for each centroid
    whole = sum(totals.values()) if None not in totals.values() else None
    facts = [(c, d, whole if whole is not None and whole < 1 << 63 else None, centroids[c].tolist()) for c, d in totals.items()]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return held.select("vec_id", "v", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: str = "centroid") -> Column:
    """Lower-case hexadecimal SHA-256 of the components as decimals, joined by commas."""
    return F.sha2(F.concat_ws(",", F.transform(centroid, lambda x: x.cast("string"))), 256)
