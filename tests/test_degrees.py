"""Degrees and import clusters that are counted without a table of pairs, against the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import factored, markov
from quillmesh.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _degrees(pairs):
    return sorted((str(r["from_id"]), r["count"]) for r in pairs.groupBy("from_id").count().collect())


def _got(df):
    return sorted((str(r["from_id"]), r["d"]) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("everywhere", [(), ("a",), ("a", "b")])
def test_degrees_equal_pairs(spark, monkeypatch, block, everywhere):
    """With repeated rows, keys that are hot, and symbols of every file (no weight, nor have states that meet only these)."""
    monkeypatch.setattr(markov.shared_degrees, "__defaults__", (block,))
    r = random.Random(block)
    rows = [(k, f"s{r.randrange(25)}") for k in range(12) for _ in range(r.randrange(0, 9))] * 2 + [(k, s) for k in [*range(12), 90, 91] for s in everywhere] + [(90, "alone"), (91, None), (None, "s1"), (None, "s2")]
    links = spark.createDataFrame(rows, "key int, item string").cache()
    once = links.filter("key is not null and item is not null").distinct()
    pairs = markov.normalise(markov.call_flow_weights(once.select(F.col("key").alias("caller"), F.col("item").alias("callee"), F.lit(1).alias("call_count"), F.lit(True).alias("is_async"), F.lit(False).alias("is_conditional"))))
    assert _got(markov.call_flow_degrees(links.toDF("caller", "callee"))) == _degrees(pairs)
    near = markov.normalise(markov.cooccurrence_weights(once.select(F.col("key").alias("file"), F.col("item").alias("symbol"), F.lit("x").alias("parent"))))
    assert _got(markov.cooccurrence_degrees(links.toDF("file", "symbol"))) == _degrees(near)
    links.unpersist()


def test_import_clusters_by_classes_equal_pairs(spark):
    r = random.Random(5)
    sets = [[f"m{r.randrange(6)}" for _ in range(r.randrange(1, 5))] for _ in range(9)] + [["x"], ["y", "z"]]
    imports = [(f, s) for f in range(40) for s in sets[f % len(sets)]] + [(99, "y"), (99, "z"), (98, None)]
    own = {f: {s for g, s in imports if g == f and s} for f, _ in imports}
    raw = {(f, g): len(own[f] & own[g]) * 0.5 for f in own for g in own if f != g and len(own[f] & own[g]) >= 2}
    df = spark.createDataFrame(imports, "file int, source string")
    found = {(x["from_id"], x["to_id"]): (x["raw"], x["prob"]) for x in markov.import_cluster(df).collect()}
    assert {k: v[0] for k, v in found.items()} == raw
    assert all(abs(p - w / sum(x for k, x in raw.items() if k[0] == f)) < 1e-12 for (f, _), (w, p) in found.items())
    assert {x["from_id"]: x["d"] for x in markov.import_cluster_degrees(df).collect()} == {f: sum(k[0] == f for k in raw) for f in own if any(k[0] == f for k in raw)}


@pytest.mark.parametrize("length", [1, 3, 256])
@pytest.mark.parametrize("small", [0, 20, 500_000])
def test_import_clusters_by_lists_equal_pairs(spark, monkeypatch, length, small):
    """By lists of several lengths, where links or members, both or neither are too many to be sent."""
    monkeypatch.setattr(markov, "LIST", length)
    monkeypatch.setattr(markov, "SMALL", small)
    sets = [["a", "b"], ["a", "b", "c"], ["c", "d"], ["x"], ["a", "b", "c", "d"]]
    own = {f: set(sets[f % 5]) for f in range(31)}
    df = spark.createDataFrame([(f, s) for f in own for s in own[f]] * 2, "file int, source string")
    raw = {(f, g): len(own[f] & own[g]) * 0.5 for f in own for g in own if f != g and len(own[f] & own[g]) >= 2}
    total = {f: sum(w for (x, _), w in raw.items() if x == f) for f in own}
    found = sorted(tuple(x) for x in markov.import_cluster(df, digits=6).collect())
    assert [(f, g, w) for f, g, w, _ in found] == sorted((*k, w) for k, w in raw.items())
    assert all(abs(p - w / total[f]) < 1e-6 for f, _, w, p in found)
    only = markov.import_cluster_weights(df).filter("from_id in (1, 7)").collect()
    assert sorted(tuple(x) for x in only) == sorted((*k, w) for k, w in raw.items() if k[0] in (1, 7))


def test_import_clusters_come_list_by_list(spark, tmp_path):
    """Millions of pairs of a few files are runs and short repeats, so a column file of them is small."""
    imports = spark.range(4000).select((F.xxhash64("id") % 10**12).alias("file"), F.explode(F.array(F.concat(F.lit("m"), F.col("id") % 4), F.concat(F.lit("n"), F.col("id") % 4))).alias("source"))
    markov.import_cluster(imports).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 4 * 1000 * 999
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4 * 1000 * 999


def test_a_filter_of_states_comes_before_pairs(spark):
    """Only the files that are asked for meet lists."""
    imports = spark.createDataFrame([(f, s) for f in range(9) for s in ("a", "b")], "file int, source string")
    plan = markov.import_cluster_weights(imports).filter("from_id = 3")._jdf.queryExecution().optimizedPlan().toString()
    assert "= 3)" in plan.split("Generate explode(files")[1]


@pytest.mark.parametrize("name", ["a2_chain_stats", "m9_chain_registry"])
def test_counts_of_chains_weigh_no_pairs(spark, monkeypatch, name):
    def unwanted(*args, **more):
        raise AssertionError("a table of pairs")

    for w in ("call_flow_weights", "cooccurrence_weights", "import_cluster_weights", "normalise"):
        monkeypatch.setattr(markov, w, unwanted if w != "normalise" else markov.normalise)
    assert QUERIES[name](spark, SF).count() == 4


def test_named_transitions_pair_only_what_is_asked(spark, monkeypatch):
    from quillmesh.operators import lineage

    written = []
    real = lineage.stored
    for how in ("stored", "cut"):
        monkeypatch.setattr(lineage, how, lambda df: (written.append(real(df)), written[-1])[1])
    QUERIES["m9_named_transitions"](spark, SF).collect()
    assert written and all(df.filter("cast(from_id as long) % 50 <> 1").isEmpty() for df in written)


def test_hot_keys_by_hashes(spark, monkeypatch):
    """Keys of one hash are told apart."""
    monkeypatch.setattr(markov, "HASHES", 1)
    rows = spark.createDataFrame([(k, v) for k in range(5) for v in range(10 if k == 3 else 2)], "k int, v int")
    assert [tuple(x) for x in markov.hot_keys(rows, "k", 4).collect()] == [(3, 10)]
    assert markov.hot_keys(rows, "k", 10) is None


@pytest.mark.parametrize("wide", [65_536, 2])
@pytest.mark.parametrize("strange", [False, True])
def test_support_on_odd_rows_equals_sql(spark, monkeypatch, tmp_path, wide, strange):
    """Without incidence and totals: repeated lines, missing keys, parts told twice, callees that are no parts, parts of every file, wide keys."""
    duckdb = pytest.importorskip("duckdb")

    def unwanted(*args, **more):
        raise AssertionError("an incidence of all rows")

    for name in ("call_flow_factors", "cooccurrence_factors", "totals"):
        monkeypatch.setattr(factored, name, unwanted)
    monkeypatch.setattr(markov.most_shared, "__defaults__", (wide,))
    r = random.Random(wide)
    pairs = [(o, r.randrange(12)) for o in range(9) for _ in range(r.randrange(4))] * 2 + [(o, 50) for o in range(-5, 9)] + [(-5, 51), (-4, None), (-3, -3), (None, 52), (None, 53), (20, 50), (20, 54), (21, 50)]
    pairs += [(-2, 900), (30, 901), (30, 55)] if strange else []  # 900 and 901 are no parts
    lines = [(o, p, 1, i, 1.0, "R", "O", None) for i, (o, p) in enumerate(pairs) if not (o is None and p is None)]
    # without strange rows every file holds part 50
    lines = lines if strange else [x for x in lines if x[0] is not None]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [*range(12), 50, 51, 52, 53, 54, 55, 56, -3, 3, None]
    spark.createDataFrame([(p, "b") for p in parts], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(SQL["l13_factored_support"]).fetchall()
    found = QUERIES["l13_factored_support"](spark, str(tmp_path)).select("state", "by_calls", "by_files").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in found)
    assert len({x[1:] for x in want}) >= 3


def test_support_where_nothing_is_linked(spark, tmp_path):
    """A part without a key is in no empty list."""
    spark.createDataFrame([(1, 1), (2, 2)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (None,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["l13_factored_support"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, found))) == ["('1', False, False)", "(None, False, False)"]
