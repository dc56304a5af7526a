"""Factors of chains that follow changed files, against factors made anew."""

import random

from pyspark.sql import functions as F

from quillmesh.operators import factored, maintained
from quillmesh.sources.model import RELATIONS
from quillmesh.sources.store import Store, migrated

NAMES = "get set load parse draw".split()


def _rows(r, f):
    """A file: symbols (some shared by id with other files, some named alike), calls, related types, imports."""
    own = [(n if r.random() < 0.4 else f"{f}:{n}", f, n, r.choice([None, "A", "B"])) for n in r.sample(NAMES, r.randint(0, 4))]
    calls = [(f, f"{f}:c{r.randrange(3)}", n, r.randint(1, 5), r.random() < 0.3, r.random() < 0.3) for n in r.sample([*NAMES, "out"], r.randint(0, 5))]
    types = [(f, f"{f}:T", r.choice(["Base", "I"]), r.choice(["extends", "implements"])) for _ in range(r.randint(0, 2))]
    return {"symbols": own, "calls": list({c[:3]: c for c in calls}.values()), "type_rels": types, "imports": [(f, f"m{r.randrange(4)}") for _ in range(r.randint(0, 3))]}


COLUMNS = {
    "symbols": "id string, file_path string, local_name string, parent_class string", "calls": "file_path string, caller_symbol_id string, callee_name string, call_count long, is_async boolean, is_conditional boolean",
    "type_rels": "file_path string, source_symbol_id string, target_name string, relationship_kind string", "imports": "file_path string, import_source string", "files": "file_path string",
}


def _save(store, r, files):
    made = [_rows(r, f) for f in files]
    rows = {n: [x for m in made for x in m[n]] for n in made[0]} | {"files": [(f,) for f in files]}
    tables = {n: migrated(store.spark.createDataFrame(rows[n], c), store.spark.createDataFrame([], RELATIONS[n]).schema) for n, c in COLUMNS.items()}
    store.save(tables, store.spark.createDataFrame([(f,) for f in files], "file_path string"))


def _held(store):
    plain = lambda df: sorted(tuple(f"{v:.9f}" if isinstance(v, float) else v for v in x) for x in df.collect())
    out = {f"{c} {i}": plain(df) for c, tables in store.chain_factors().items() for i, df in enumerate(tables)}
    out["links"] = plain(maintained.linked(store.read("chain_links")))
    return out | {"clusters": plain(store.read("chain_members").filter("chain = 'import_cluster'").select("key", "state", "v")), "files": store.read("chain_counts").first()[0]}


def test_random_edits_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Files that change, come and go, names that come to mean another file's symbol; compaction on the way."""
    monkeypatch.setattr(Store, "MOST_SEGMENTS", 4)
    r, store = random.Random(11), Store(spark, str(tmp_path / "s"))
    _save(store, r, [f"f{i}" for i in range(8)])
    store.build_factors()
    assert store.update_factors() == 0
    for step in range(3):
        _save(store, r, [f"f{r.randrange(9 + step)}"])
        if step % 2:
            store.delete([f"f{r.randrange(8)}", "none"])
            _save(store, r, ["f3", f"g{step}"])
        assert store.update_factors() > 0
        mine, before = _held(store), store.manifest()
        store.build_factors()
        assert mine == _held(store), step
        store._put(store.manifest(), before["tables"], before["deletions"])  # go on with the rows that followed


def test_totals_equal_factored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    _save(store, random.Random(5), [f"f{i}" for i in range(7)])
    calls, symbols, _, _ = store._relations()
    plain = lambda df: sorted((x["state"], x["keys"], round(x["total"], 9)) for x in df.collect())
    found = store.chain_factors()
    assert plain(found["call_flow"][2]) == plain(factored.totals(factored.call_flow_factors(calls)))
    assert plain(found["cooccurrence"][2]) == plain(factored.totals(factored.cooccurrence_factors(symbols)))
    plan = found["cooccurrence"][2].filter("state in ('get')")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(state,get)" in plan  # a walk's front reaches the scan


def test_rows_written_follow_the_change(spark, tmp_path):
    store, r = Store(spark, str(tmp_path / "s")), random.Random(2)
    _save(store, r, [f"f{i}" for i in range(200)])
    store.build_factors()
    whole = {n: store.read(n).count() for n in ("chain_states", "chain_names")}
    tables = migrated(spark.createDataFrame([("new", "f7", "only_here", None)], COLUMNS["symbols"]), spark.createDataFrame([], RELATIONS["symbols"]).schema)
    store.save({"symbols": tables}, spark.createDataFrame([("f7",)], "file_path string"))
    n = store.update_factors()
    written = {name: spark.read.parquet(f"{store.root}/{store.manifest()['tables'][name][-1][0]}").count() for name in whole}
    assert 1 <= n < 120 and all(len(store.manifest()["tables"][name]) == 2 and written[name] < whole[name] for name in whole)


def test_only_changed_keys_without_shared_names(spark, tmp_path):
    """Where no name of the changed file is called elsewhere, its rows alone are written."""
    store = Store(spark, str(tmp_path / "s"))
    whole = lambda rows: migrated(spark.createDataFrame(rows, COLUMNS["symbols"]), spark.createDataFrame([], RELATIONS["symbols"]).schema)
    store.save({"symbols": whole([(f"{i}:{j}", f"f{i}", f"n{i}_{j}", None) for i in range(50) for j in range(4)])}, spark.createDataFrame([], "file_path string"))
    store.build_factors()
    store.save({"symbols": whole([("3:0", "f3", "n3_0", None), ("3:x", "f3", "n3_x", None)])}, spark.createDataFrame([("f3",)], "file_path string"))
    assert store.update_factors() == 1
    assert spark.read.parquet(f"{store.root}/{store.manifest()['tables']['chain_states'][-1][0]}").count() == 2 and store.read("chain_counts").first()[0] == 50
    store.delete(["f4"])
    assert store.update_factors() == 1 and store.read("chain_counts").first()[0] == 49 and store.read("chain_states").count() == 48 * 4 + 2


def test_an_update_reads_calls_once(spark, tmp_path):
    """Calls of the files to be made anew are kept apart, and a manifest is read without a job; rows that repeat or lack a caller, a name, a count or flags give what a rebuild gives."""
    store, r = Store(spark, str(tmp_path / "s")), random.Random(3)
    _save(store, r, [f"f{i}" for i in range(6)])
    store.build_factors()
    odd = [("f2", "f2:c0", "get", 2, True, False)] * 2 + [("f2", None, "get", 1, False, False), ("f2", "f2:c0", None, 1, None, None), ("f2", "f2:c0", "out", None, True, True), ("f2", "f2:c1", "load", 3, None, True), ("f2", "f2:c0", "set", 1, False, False)]
    rows = migrated(spark.createDataFrame(odd, COLUMNS["calls"]), spark.createDataFrame([], RELATIONS["calls"]).schema)
    store.save({"calls": rows}, spark.createDataFrame([("f2",)], "file_path string"))
    calls = store._relations(spark.createDataFrame([("f2",), (None,)], "file_path string"))[0]
    assert calls.count() == len(odd) and not any("/calls/" in f for f in calls.inputFiles())
    spark.sparkContext.setJobGroup("manifests", "")
    try:
        held = store.manifest()
        assert held["tables"]["calls"] and not spark.sparkContext.statusTracker().getJobIdsForGroup("manifests")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert store.update_factors() > 0
    plain = lambda: {c: [sorted(map(str, df.withColumns({n: F.round(n, 9) for n, t in df.dtypes if t == "double"}).collect())) for df in tables] for c, tables in store.chain_factors().items()}
    mine = plain()
    store.build_factors()
    assert mine == plain()
    apart = tmp_path / "s" / "stale_calls"
    assert len(list(apart.iterdir())) == 2 and store.vacuum(keep_s=0) >= 2 and not list(apart.iterdir())
    assert mine == plain()
