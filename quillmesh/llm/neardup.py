"""Near-duplicate removal by SimHash of five-word shingles: texts whose shingle sets have a Jaccard similarity of SIMILAR or more are linked.

Candidates come first from the SimHash operator: fingerprints of five-word shingles at most simhash.DISTANCE bits apart, found by its
pigeonring filter. A 64-bit SimHash holds a similarity of 0.8 within about 10 bits (20 for nearly all pairs); so many differing bits leave no segment of
a ring that tells pairs apart. Pairs farther apart are therefore sought among texts that share one of BANDS bands of ROWS min-hashes: at similarity 0.8 a
pair is missed with probability 7e-5, above it less. Every link is decided by the exact similarity of the shingle sets.

Texts with equal shingle sets are one node. Buckets are linked by stars first, from STARS centers in turn; buckets that
lie in one component then need no more. Of the others every two texts of a cluster are compared in tasks over two bounded blocks,
which give the links they find as a forest. Nothing is capped.

Defined results: a null text is the empty text; empty texts are equal; repeated ids keep one row each; of a component without ids
one row stays, of others no row without an id does; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, body, tune
from quillmesh.llm.components import connected_components
from quillmesh.llm.simhash import _union, fingerprints_of, linked, shingle_hashes

SHINGLE, SIMILAR = 5, (4, 5)  # 4 / 5
BANDS, ROWS, STARS, AT_ONCE = 24, 5, 2, 1024
BLOCK, BLOCK_SHINGLES = 256, 500_000
_RANDOM = np.random.default_rng(8)
FLIP, TIMES = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] for _ in range(2))
TIMES |= np.uint64(1)
MIX, BAND = (_RANDOM.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (ROWS, BANDS))


def hashes_of(text: str) -> np.ndarray:
    return np.array(shingle_hashes(text, SHINGLE), np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    return np.unique(hashes_of(text))


def set_hash(held: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(held.tobytes())).view(np.int64)) if len(held) else 0


def band_keys(held: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes; none for the empty set."""
    if not len(held):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(held), AT_ONCE):
        least = np.minimum(least, ((held[at : at + AT_ONCE] ^ FLIP) * TIMES).min(1))
    least ^= least >> np.uint64(29)
    mixed = (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64) * BAND
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashed = [hashes_of(t.as_py()) for t in b.column(1)]
        sets = [np.unique(h) for h in hashed]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array(fingerprints_of(hashed).view(np.int64)), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "set", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set", "h"])


def _block_links(table: pa.Table) -> pa.Table:
    """Spanning forest of the links of SIMILAR or more between different c, by counting the shingles in common."""
    sets, c, block = (table[x].to_numpy() for x in ("set", "c", "b"))
    apart = table["i"][0].as_py() != table["j"][0].as_py()  # then each block has a task of its own
    sizes = np.array([len(x) for x in table["h"]], np.int64)
    flat = np.concatenate([x.values.to_numpy() for x in table["h"]])
    ids = np.unique(flat, return_inverse=True)[1]
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    count = np.bincount(ids)
    first = np.cumsum(count) - count
    ends = np.cumsum(sizes)
    label = np.arange(len(sets))
    for x in range(len(sets)):
        own = ids[ends[x] - sizes[x] : ends[x]]
        n = count[own]
        at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(holder[at], minlength=len(sets))
        y = np.flatnonzero((both * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (sizes + sizes[x])) & (c != c[x]) & ((block != block[x]) | (not apart)))
        if len(y):
            label = _union(label, np.full(len(y), x), y)
    some = label != np.arange(len(sets))
    return pa.table({"u": pa.array(sets[some], pa.int64()), "v": pa.array(sets[label[some]], pa.int64())})


def _within_clusters(spark: SparkSession, live: DataFrame, centers: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links u, v between components of the clusters that open buckets join; every two blocks of a cluster meet in one task."""
    rest = live.join(centers, "key").select("set", "c", "center")
    clusters = connected_components(spark, rest.select(F.col("set").alias("u"), F.col("center").alias("v")), Scratch(spark, "neardup-clusters"))
    nodes = rest.select("set", "c").distinct().join(clusters, F.col("set") == F.col("node")).select("root", "set", "c")
    nodes = scratch.write(nodes.join(sets, "set").select("root", "set", "c", "h"), "open")
    blocks = nodes.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("h")) / BLOCK_SHINGLES)).cast("int").alias("n"))
    dealt = nodes.join(blocks, "root").withColumn("b", F.pmod(F.xxhash64("set"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    units = dealt.select("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "set", "c", "h")
    return units.groupBy("root", "i", "j").applyInArrow(_block_links, "u long, v long")


def components(spark: SparkSession, docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, set, root (equal in a component), component_id (its least doc_id) of every row."""
    tune(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text"))
    table = scratch.write(own.mapInArrow(_signed, f"doc_id {kind}, set long, fp long, keys array<long>"), "signed")
    nodes = scratch.write(table.groupBy("set").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    pair = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    prints = scratch.write(nodes.groupBy("fp").agg(F.min("set").alias("rep")), "prints")
    near = linked(spark, prints, scratch).select(*pair("u", "v"))
    same = nodes.select("fp", "set").join(prints, "fp").filter("set <> rep").select(*pair("set", "rep"))
    pairs = scratch.write(near.union(same).distinct(), "pairs")
    keyed = nodes.select("set", "rep", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = scratch.write(keyed.join(shared, "key").select("key", "set", "rep"), "members")
    in_pairs = nodes.join(pairs.select(F.col("u").alias("set")).union(pairs.select("v")), "set", "left_semi").select("rep")
    ids = members.select("rep").union(in_pairs).filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    chosen = own.join(ids, "doc_id", "left_semi").select("text").union(own.filter("doc_id is null").select("text"))
    sets = scratch.write(chosen.mapInArrow(_sets, "set long, h array<long>").groupBy("set").agg(F.first("h").alias("h")), "sets")

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs u, v of SIMILAR or more."""
        a, b = (sets.select(F.col("set").alias(x), F.col("h").alias(f"h{x}")) for x in ("u", "v"))
        sizes = F.size("hu") + F.size("hv")
        some = pairs.join(a, "u").join(b, "v").filter(F.least(F.size("hu"), F.size("hv")) * SIMILAR[1] >= F.greatest(F.size("hu"), F.size("hv")) * SIMILAR[0])
        return some.filter(F.size(F.array_intersect("hu", "hv")) * (SIMILAR[0] + SIMILAR[1]) >= sizes * SIMILAR[0]).select("u", "v")

    tested, links = pairs, scratch.write(similar(pairs), "links")
    roots = connected_components(spark, links, scratch)
    for r in range(STARS + 1):
        live = members.select("key", "set").join(roots, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("root", "set").alias("c"))
        centers = live.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.struct(F.xxhash64("set", F.lit(r)), "set", "c")).alias("x"))
        centers = centers.filter("low < high").select("key", F.col("x.set").alias("center"), F.col("x.c").alias("of"))
        if r < STARS:
            new = live.join(centers, "key").filter("c <> of").select(*pair("set", "center")).distinct()
            new = scratch.write(new.join(tested, ["u", "v"], "left_anti"), f"pairs-{r}")
            found = scratch.write(similar(new), f"found-{r}")
            tested = tested.union(new)
        else:  # all that is left
            found = scratch.write(_within_clusters(spark, live, centers, sets, scratch), f"found-{r}")
        if found.limit(1).count():
            links = links.union(found)
            roots = connected_components(spark, links, scratch)
    named = nodes.select("set", "rep").join(roots, F.col("set") == F.col("node"), "left").select("set", "rep", F.coalesce("root", "set").alias("root"))
    named = scratch.write(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return table.select("doc_id", "set").join(named.join(least, "root").select("set", "root", "component_id"), "set").select("doc_id", "set", "root", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id, or any if none has an id."""
    scratch = Scratch(spark, "neardup")
    names = docs.columns
    kept_id, kept_n, kept_set = (_fresh(names, x) for x in ("kept_id", "kept_n", "kept_set"))
    found = components(spark, docs, scratch, doc_id, text)
    first = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    first = scratch.write(first.select(F.col("doc_id").alias(kept_id), F.col("n").alias(kept_n)), "first")
    kept = docs.join(first.hint("shuffle_hash"), docs[doc_id] == first[kept_id])
    out = kept.filter(F.col(kept_n) == 1).select(*names)
    if first.filter(F.col(kept_n) > 1).limit(1).count():  # repeated ids: one row each
        out = out.unionByName(kept.filter(F.col(kept_n) > 1).dropDuplicates([doc_id]).select(*names))
    if docs.schema[doc_id].nullable:
        lonely = found.filter("component_id is null").groupBy("root").agg(F.min("set").alias(kept_set)).select(kept_set)
        if lonely.limit(1).count():
            set_of = F.pandas_udf(lambda s: s.map(lambda t: set_hash(shingle_set(t))), "long")
            bare = docs.filter(F.col(doc_id).isNull()).withColumn(kept_set, set_of(body(text)))
            out = out.unionByName(bare.join(lonely, kept_set, "left_semi").dropDuplicates([kept_set]).select(*names))
    return out


def _fresh(names: list[str], like: str) -> str:
    """A column name that no name equals, however it is written."""
    while like in {n.lower() for n in names}:
        like += "_"
    return like
