"""Tables merged as they are read, their compaction and versions, and the inverted index."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import postings, search
from quillmesh.sources.model import RELATIONS
from quillmesh.sources.store import Conflict, Store, migrated

WORDS = "get set load user User_name parseFile red blue widget gadget reds x1 été".split()


def _symbols(spark, rows):
    """rows: id, file, name, signature."""
    df = spark.createDataFrame(rows, "id string, file_path string, name string, signature string")
    return migrated(df, spark.createDataFrame([], RELATIONS["symbols"]).schema)


def _random(r, n, files=6):
    return [(f"s{i}", f"f{i % files}", " ".join(r.choices(WORDS, k=r.randint(0, 4))) or None, " ".join(r.choices(WORDS, k=r.randint(0, 9)))) for i in range(n)]


def _files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def _rounded(df):
    return sorted((x["id"], round(x["score"], 9)) for x in df.collect())


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    """After an update and a deletion, before and after compaction."""
    r = random.Random(1)
    rows = _random(r, 150)
    store = Store(spark, str(tmp_path / "s"))
    store.save({"symbols": _symbols(spark, rows)}, _files(spark))
    new = [(f"n{i}", "f2", name, sig) for i, (_, _, name, sig) in enumerate(_random(r, 20))]
    store.save({"symbols": _symbols(spark, new)}, _files(spark, "f2"))
    store.delete(["f4"])
    live = _symbols(spark, [x for x in rows if x[1] not in ("f2", "f4")] + new).cache()
    queries = ["red", "red wid", '"red" OR "blue"', '"get set" OR gad*', 'load "red widget"', "nothing", "", '"x1 été re"* OR "blue blue"']
    want = {q: search.match(live, "id", {"name": 2.0, "signature": 1.0}, q).collect() for q in queries}
    scoped = _rounded(search.match(live, "id", {"signature": 1.0}, queries[1]))
    plain = lambda rows: sorted((x["id"], round(x["score"], 9)) for x in rows)
    for step in range(2):
        for q in queries if not step else queries[2:5]:
            assert _rounded(store.search("symbols", q, (2.0, 1.0, 1.0))) == plain(want[q]), q
        assert _rounded(store.search("symbols", queries[1], (None, None, 1.0))) == scoped
        for q in queries[1:3]:
            top = sorted(want[q], key=lambda x: (-round(x["score"], 9), x["id"]))[:7]
            assert _rounded(store.search("symbols", q, (2.0, 1.0, 1.0), 7)) == plain(top)
        if not step:
            store.compact(full=True)
    live.unpersist()


def test_levels_that_cannot_reach_are_skipped(spark):
    """The best of many rows that hold a word, where a few hold it much more."""
    rows = [(f"s{i:04d}", "f", "red " * ((i % 3 == 0) + 30 * (i < 5)) + "blue " * (i % 7 if i % 4 == 0 else 0) + "pad " * (i % 11), "blue" if i % 8 == 1 else "") for i in range(800)]
    built = postings.build(_symbols(spark, rows), "id", ["name", "signature"]).cache()
    terms, totals, weights = postings.dictionary(built, 2).cache(), postings.lengths(_symbols(spark, rows), ["name", "signature"]).cache(), [1.0, 0.5]
    for words in (["red"], ["red", "blue"]):
        query = " OR ".join(f'"{w}"' for w in words)
        want = postings.search(built, totals, weights, query).orderBy(F.desc(F.round("score", 9)), "id").limit(4).collect()
        found = postings.best(built, terms, totals, weights, query, 4).collect()
        assert [(x["id"], round(x["score"], 9)) for x in found] == [(x["id"], round(x["score"], 9)) for x in want]
    kept, every, _ = postings.reaching(built.filter("term = 'red'"), terms, totals, weights, ["red"], 4)
    assert 0 < len(kept["red"]) < len(every["red"])
    built.unpersist()


def test_scan_takes_terms_over(spark, tmp_path):
    """The plan of a search shows its terms as filters of the scan, and reads no places for single words."""
    store = Store(spark, str(tmp_path / "s"))
    store.save({"symbols": _symbols(spark, _random(random.Random(2), 50))}, _files(spark))
    plan = lambda q: store.search("symbols", q)._jdf.queryExecution().executedPlan().toString()
    text = plan('"red" OR wid*')
    assert "EqualTo(term,red)" in text and "StringStartsWith(term,wid)" in text and "positions" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "positions" in plan('"red blue"')


def test_update_writes_in_proportion(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [(f"s{i}", f"f{i}", f"name{i} red", "sig " * 20) for i in range(4000)]
    store.save({"symbols": _symbols(spark, rows)}, _files(spark))
    before = store.manifest()
    reader = store.read("symbols")
    store.save({"symbols": _symbols(spark, [(f"s{i}", f"f{i}", "other", "x") for i in range(10)])}, _files(spark, *[f"f{i}" for i in range(10)]))
    after = store.manifest()
    for name, segments in after["tables"].items():
        assert segments[:-1] == before["tables"][name] and segments[-1][2] < before["tables"][name][0][2] / 5, name
    assert store.read("symbols").filter("name = 'other'").count() == 10 and store.read("symbols").count() == 4000
    store.compact(full=True)
    assert {len(s) for s in store.manifest()["tables"].values()} == {1} and store.manifest()["deletions"] == []
    assert reader.count() == 4000 and reader.filter("name = 'other'").count() == 0  # began before, still finishes
    assert store.read("symbols", version=1).count() == 4000
    assert store.vacuum(keep_s=-10) > 0 and len(store.versions()) == 1 and store.read("symbols").filter("name = 'other'").count() == 10


def test_many_updates_equal_one_table(spark, tmp_path, monkeypatch):
    """Random replacements and deletions, with compaction on the way."""
    monkeypatch.setattr(Store, "MOST_SEGMENTS", 2)
    r, store, held = random.Random(4), Store(spark, str(tmp_path / "s")), {}
    for step in range(7):
        files = r.sample(range(8), 3)
        if step % 3 == 2:
            store.delete([f"f{f}" for f in files])
            held = {k: v for k, v in held.items() if k not in files}
        else:
            rows = [(f"{step}-{f}-{i}", f"f{f}", r.choice(WORDS), "") for f in files for i in range(r.randint(0, 3))]
            store.save({"symbols": _symbols(spark, rows)}, _files(spark, *[f"f{f}" for f in files]))
            held |= {f: [x for x in rows if x[1] == f"f{f}"] for f in files}
        want = sorted((x[0], x[2]) for rows in held.values() for x in rows)
        assert sorted(tuple(x) for x in store.read("symbols").select("id", "name").collect()) == want
    assert len(store.manifest()["tables"]["symbols"]) <= 3
    found = store.search("symbols", "re").count()
    assert found == sum(any(t.startswith("re") for t in n.lower().replace("_", " ").split()) for _, n in want)


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save({"symbols": _symbols(spark, [("a", "f", "one", "")])}, _files(spark))
    stale = store.manifest()
    store.save({"symbols": _symbols(spark, [("b", "g", "two", "")])}, _files(spark))
    with pytest.raises(Conflict):
        store._put(stale, {}, [])
    assert store.read("symbols").count() == 2


def test_config_search(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("1", "p", "scripts.build", "tsc -b"), ("2", "p", "scripts.test", "vitest build"), ("3", "q", "name", "@x/build-tool")], "id string, file_path string, path string, value string")
    store.save({"config_entries": migrated(rows, spark.createDataFrame([], RELATIONS["config_entries"]).schema)}, _files(spark))
    ids = lambda *a: {x["id"] for x in store.search_config(*a).collect()}
    assert ids("build") == {"1", "2", "3"} and ids("build", "keys") == {"1"} and ids("build", "values") == {"2", "3"} and ids("@", "both") == {"3"} and ids("%") == set()
