"""Walks through factors against walks over tables of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import factored, lineage, markov

CALLS = "caller string, callee string, call_count long, is_async boolean, is_conditional boolean"


def _calls(spark, r, callers, callees):
    rows = {(f"c{r.randrange(callers)}", f"s{min(int(r.expovariate(0.2)), callees - 1)}"): (r.randint(1, 9), r.random() < 0.3, r.random() < 0.3) for _ in range(callers * 5)}
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], CALLS)


def _got(df):
    return sorted((x["state"], round(x["score"], 9), x["hops"]) for x in df.collect())


@pytest.mark.parametrize(("least", "depth", "fan_out"), [(0.05, 2, 50), (0.001, 3, 4)])
def test_walk_equals_pairs(spark, least, depth, fan_out):
    calls = _calls(spark, random.Random(depth), 40, 30)
    pairs = markov.normalise(markov.call_flow_weights(calls)).cache()
    rows = factored.call_flow_factors(calls).cache()
    found = factored.totals(rows).cache()
    for start in ("s0", "s7", "alone"):
        want = markov.walk(pairs, start, depth, least=least, fan_out=fan_out)
        assert _got(factored.walk(spark, start, factored.through(rows, rows, found, fan_out), depth, least=least)) == _got(want)
    raw = {x["from_id"]: x["t"] for x in pairs.groupBy("from_id").agg(F.sum("raw").alias("t")).collect()}
    mine = {x["state"]: x["total"] for x in found.collect()}
    assert mine.keys() == raw.keys() and all(abs(mine[k] - raw[k]) < 1e-9 * raw[k] for k in raw)
    for df in (pairs, rows, found):
        df.unpersist()


def test_files_and_imports_equal_pairs(spark):
    """Classes count twice, none is no class; symbols of every file weigh nothing; pairs of importers need two common sources."""
    r = random.Random(9)
    seen = {(f"f{r.randrange(12)}", f"s{r.randrange(25)}"): r.choice([None, "A", "B"]) for _ in range(130)} | {(f"f{i}", "every"): None for i in range(12)}
    occurrences = spark.createDataFrame([(*k, p) for k, p in seen.items()], "file string, symbol string, parent string")
    pairs = markov.normalise(markov.cooccurrence_weights(occurrences)).cache()
    rows = factored.cooccurrence_factors(occurrences).cache()
    found = factored.totals(rows).cache()
    for start in ("s1", "every"):
        assert _got(factored.walk(spark, start, factored.through(rows, rows, found), least=0.002)) == _got(markov.walk(pairs, start, least=0.002))
    states = spark.createDataFrame([("s1",), ("every",), ("none",)], "state string")
    assert {x["state"]: x["supported"] for x in factored.support(found, states).collect()} == {"s1": True, "every": False, "none": False}
    imports = spark.createDataFrame([(f"f{r.randrange(15)}", f"m{r.randrange(8)}") for _ in range(70)], "file string, source string")
    pairs = markov.normalise(markov.import_cluster_weights(imports)).cache()
    rows = factored.import_cluster_factors(imports)
    assert _got(factored.walk(spark, "f1", factored.through_clusters(rows, rows), least=0.001)) == _got(markov.walk(pairs, "f1", least=0.001))


def test_a_hot_key_costs_its_rows(spark):
    """A caller of 100,000 parts, twenty of them called often: none of its 10^10 pairs is made, and few members become candidates."""
    hot = spark.range(100_000).select(F.lit("hot").alias("caller"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("callee"), F.when(F.col("id") < 20, F.lit(10**15)).otherwise(F.lit(1)).cast("long").alias("call_count"), F.lit(False).alias("is_async"), F.lit(False).alias("is_conditional"))
    small = spark.createDataFrame([("a", "s0", 5, False, False), ("a", "s99999", 5, False, False), ("a", "x", 7, True, False)], CALLS)
    rows = factored.call_flow_factors(hot.union(small)).cache()
    found = factored.totals(rows).cache()
    assert rows.count() == 100_003 and found.count() == 100_001
    front = spark.createDataFrame([("s99999", 1.0)], "state string, score double")
    best = {x["state"]: x["prob"] for x in factored.steps(front, rows, rows, found, 0.001).collect()}
    u = dict(rows.filter("state = 's99999'").select("key", "u").collect())
    v = lambda key: {x["state"]: x["v"] for x in rows.filter(F.col("key") == key).filter("state in ('s0', 's1', 's5', 'x')").collect()}
    one = found.filter("state = 's99999'").first()
    raw = {}
    for key in u:
        for state, value in v(key).items():
            raw[state] = raw.get(state, 0.0) + u[key] * value
    assert best == pytest.approx({s: w / one["total"] for s, w in raw.items() if w / one["total"] >= 0.001})
    rows.unpersist()
    found.unpersist()


def test_a_hop_reads_each_table_once(spark, tmp_path, monkeypatch):
    """Totals, states and members are scanned once each by all that a hop plans; rows that repeat and rows without key, state or weight count as they did."""
    odd = [(None, "s0", 1.0, 1.0), ("7:k", None, 1.0, 1.0), ("7:k", "s1", None, 1.0), ("7:k", "s2", 1.0, None)]
    rows = factored.call_flow_factors(_calls(spark, random.Random(4), 30, 20))
    rows = rows.union(rows.limit(9)).union(spark.createDataFrame(odd, factored.INCIDENCE))
    for name, df in {"rows": rows, "found": factored.totals(rows)}.items():
        df.write.parquet(str(tmp_path / name))
    rows, found = (spark.read.parquet(str(tmp_path / name)) for name in ("rows", "found"))
    states, members = (rows.select(*c).write.parquet(str(tmp_path / n)) or spark.read.parquet(str(tmp_path / n)) for n, c in {"states": ("state", "key", "u"), "members": ("key", "state", "v")}.items())
    plans, stored = [], lineage.stored
    monkeypatch.setattr(lineage, "stored", lambda df: plans.append(df) or stored(df))
    front = spark.createDataFrame([("s0", 1.0), ("s1", 0.5), ("s2", 1.0), ("alone", 1.0)], "state string, score double")
    got = factored.steps(front, states, members, found, 0.01)
    read = [leaf.relation().location().rootPaths().head().getName() for df in [*plans, got] for leaf in _scans(df)]
    assert [read.count(name) for name in ("found", "states", "members")] == [1, 1, 1]
    a, b = rows.select(F.col("state").alias("at"), "key", "u"), rows.select("key", "state", "v")
    weighed = a.join(b, "key").filter("state <> at").groupBy("at", "state").agg(F.sum(F.col("u") * F.col("v")).alias("raw"))
    want = weighed.join(front.withColumnRenamed("state", "at"), "at").join(found.withColumnRenamed("state", "at"), "at").filter("score * raw / total >= 0.01")
    plain = lambda df: {(x["at"], x["state"]): round(x["prob"], 9) for x in df.collect()}
    assert (mine := plain(got)) and all(mine.get(k) == p for k, p in plain(want.withColumn("prob", F.col("raw") / F.col("total"))).items())


def _scans(df):
    """The scans of files in a plan."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return [leaf for i in range(leaves.size()) if (leaf := leaves.apply(i)).getClass().getSimpleName() == "FileSourceScanExec"]
