"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of the first 64 bits of the text's MD5. The smallest capacity that
lets a greedy scan cut the order into `n_shards` runs is found by binary search, and the cuts are those of the scan at
that capacity. The scan runs on the driver over sums of ranges of the hash, at most a few hundred thousand of them; ranges in
which a cut may still fall are split finer, and the search repeats, until the capacity and every cut are
exact. No group, hot or not, meets in one task: only sums of sizes by range are gathered.

A group larger than the mean of the shards that are left is a shard of its own, at its place in the order, so that one hot
text doesn't set the capacity of all shards; no other shard goes across it.

Defined results: a null text is the empty text; null and repeated ids are ordinary rows; an
empty table gives no rows; other columns are ignored. Two texts with the same hash count as one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.common import Scratch, body, rank_in

OVERHEAD = 16
FIRST_BITS, MORE_BITS = 14, 6
#: Order of unsigned hashes as order of signed longs.
FLIP = -(1 << 63)


class Ranges:
    """Sums of sizes over consecutive ranges of the hash: bits leading bits equal to prefix."""

    def __init__(self) -> None:
        self.at: dict[int, tuple[int, int, bool, int]] = {}  # first hash -> bits, bytes, one hash only, that hash

    def put(self, bits: int, rows: list) -> None:
        for r in rows:
            low, high = r["low"], r["high"]
            self.at[(r["prefix"] & ((1 << bits) - 1)) << (64 - bits)] = (bits, int(r["bytes"]), low == high, low)

    def drop(self, first: int) -> None:
        del self.at[first]


def _chains(edges: np.ndarray, single: np.ndarray, barriers: np.ndarray, capacity: int, n: int) -> tuple[list[int], list[int]]:
    """Where 1, 2, ... n shards of this capacity end at least and at most, greedily, in bytes. No shard goes across a barrier."""
    low, high, lows, highs = 0, 0, [], []
    total = int(edges[-1])
    walls = np.append(edges[barriers], total)
    for _ in range(n):
        wall = int(walls[np.searchsorted(walls[:-1], low, side="right")])
        i = int(np.searchsorted(edges, low + capacity, side="right")) - 1
        low = min(int(edges[i]), wall)
        wall = int(walls[np.searchsorted(walls[:-1], high, side="right")])
        reach = high + capacity
        i = int(np.searchsorted(edges, reach, side="right")) - 1
        high = min(wall, total if reach >= total else int(edges[i]) if single[i] else min(reach, int(edges[i + 1]) - 1))
        lows.append(low)
        highs.append(high)
    return lows, highs


def _least(holds, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


def plan_cuts(sums, n_shards: int) -> list[int]:
    """The first hashes of all shards but the first, ascending.

    sums(bits, prefixes, parent_bits) gives rows prefix, bytes, low, high for the ranges of that many bits
    whose leading parent_bits are among prefixes (None: all).
    """
    ranges, bits = Ranges(), FIRST_BITS
    ranges.put(bits, sums(bits, None, 0))
    while True:
        firsts = sorted(ranges.at)
        info = [ranges.at[f] for f in firsts]
        rest, left, heavy = sum(i[1] for i in info), n_shards, set()
        for k in sorted(range(len(info)), key=lambda k: -info[k][1]):
            # each heavy group may part the run that it stands in, so it takes two shards
            if left > 2 and info[k][2] and info[k][1] * left > rest and len(info) - len(heavy) > 1:
                heavy.add(k)
                rest, left = rest - info[k][1], left - 1
            else:
                break
        kept = [k for k in range(len(info)) if k not in heavy]
        while heavy and _runs(kept) > left:  # more runs between heavy groups than shards: the least of these isn't taken out
            heavy.remove(min(heavy, key=lambda k: info[k][1]))
            kept, left = [k for k in range(len(info)) if k not in heavy], left + 1
        rest = sum(info[k][1] for k in kept)
        unsure = {k for k in kept if not info[k][2] and info[k][1] * n_shards > rest // 4}
        edges = np.concatenate([[0], np.cumsum([info[k][1] for k in kept], dtype=np.int64)]).astype(np.int64)
        single = np.array([info[k][2] for k in kept] + [True])
        barriers = np.unique(np.searchsorted(np.array(kept, np.int64), np.array(sorted(heavy), np.int64)))
        barriers = barriers[(barriers > 0) & (barriers < len(kept))]
        total, ends = int(edges[-1]), []
        if total:
            least = _least(lambda c: _chains(edges, single, barriers, c, left)[1][-1] >= total, 1, total)
            most = _least(lambda c: _chains(edges, single, barriers, c, left)[0][-1] >= total, least, total)
            ends, highs = _chains(edges, single, barriers, least, left)[0], _chains(edges, single, barriers, most, left)[1]
            open_ends = len(ends) if least != most else len(ends) - 1
            for low, high in zip(ends[:open_ends], highs[:open_ends], strict=True):
                i, j = (int(np.searchsorted(edges, x, side="right")) - 1 for x in (low, high))
                unsure |= {kept[k] for k in range(i, min(j, len(kept) - 1) + 1) if not single[k]}
        if not unsure:
            starts = {kept[i] for i in np.searchsorted(edges, [x for x in ends if x < total]).tolist()} | heavy | {k + 1 for k in heavy}
            return [firsts[k] for k in sorted(starts) if 0 < k < len(firsts)]
        bits = min(64, bits + MORE_BITS)
        for width in {info[k][0] for k in unsure}:  # ranges of several widths may be left
            parents = {firsts[k] >> (64 - width) for k in unsure if info[k][0] == width}
            ranges.put(bits, sums(bits, parents, width))
        for k in unsure:
            if firsts[k] in ranges.at and ranges.at[firsts[k]][0] != bits:
                ranges.drop(firsts[k])


def _runs(kept: list[int]) -> int:
    """Into how many runs the heavy ranges part the others."""
    return sum(not i or kept[i - 1] != k - 1 for i, k in enumerate(kept))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_of(key: Column, cuts: list[int]) -> Column:
    ordered = key.bitwiseXOR(F.lit(FLIP))
    out = F.lit(0)
    for first in cuts:
        out = out + (ordered >= F.lit(_signed(first) ^ FLIP)).cast("int")
    return out.cast("int")


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_hash, shard, slot (the rank of the id in the shard) for every row of docs."""
    scratch = Scratch(spark, "sharding")
    binary = body(text).cast("binary")
    rows = scratch.write(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body(text)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"), F.conv(F.substring(F.md5(binary), 1, 16), 16, -10).cast("long").alias("text_hash"),
    ), "rows")

    def sums(bits: int, parents: set[int] | None, parent_bits: int) -> list:
        top = lambda b: F.shiftrightunsigned("text_hash", 64 - b) if b < 64 else F.col("text_hash")
        some = rows if parents is None else rows.filter(top(parent_bits).isin([_signed(p) for p in parents]))
        return some.groupBy(top(bits).alias("prefix")).agg(
            F.sum("size").alias("bytes"), F.min("text_hash").alias("low"), F.max("text_hash").alias("high")
        ).collect()  # fmt: skip  # at most 2^14 ranges, then 2^6 for each range that a cut may fall in

    dealt = rows.withColumn("shard", shard_of(F.col("text_hash"), plan_cuts(sums, n_shards)))
    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(n_shards, np.int64)
        for b in batches:
            yield b.assign(part=part, local=rank_in(b["shard"].to_numpy(), seen))

    # ranges of shard and id, so that a slot is the rank of the id in its shard, and a hot shard is spread; doc_id keeps its nulls as it travels as a string or none
    order_in = ["shard", "doc_id", "text_hash"]
    ranges = dealt.repartitionByRange(*order_in).sortWithinPartitions(*order_in)
    plain = ranges.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema["doc_id"].dataType = T.StringType()
    numbered = scratch.write(plain.mapInPandas(number, schema), "numbered")
    from pyspark.sql import Window

    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    kind = docs.schema[doc_id].dataType
    return numbered.join(starts, ["shard", "part"]).select(
        F.col("doc_id").cast(kind).alias("doc_id"), "size", "text_crc32", "text_hash", "shard", (F.col("start") + F.col("local")).alias("slot")
    )
