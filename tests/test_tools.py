"""The tool surface and the index at rest, over a small project."""

import json

import pytest
from pyspark.sql import functions as F

import quillmesh
from quillmesh.__main__ import init, serve
from quillmesh.functions import render
from quillmesh.operators import graph, imports, markov, search
from quillmesh.sources import ingest
from quillmesh.sources.store import Store, find_config
from quillmesh.streaming import awareness
from quillmesh.tools import FOCUS, Tools

FILES = {
    "src/index.ts": "export { load } from './core/load';\nexport * from './core/user';\n",
    "src/core/load.ts": """import { User } from './user';
import type { Opt } from '../types';
import axios from 'axios';
/** Loads. @param id the id */
export async function load(id: number, opt?: Opt): Promise<User> { return parse(await axios.get(id)); }
function parse(raw: string): User { return new User(raw); }
export const LIMIT = 3, LEAST = 1;
""",
    "src/core/user.ts": "export interface Named { name: string; }\nexport class User implements Named { name: string = ''; save(opt: Opt): void { load(1); } }\nexport class Admin extends User { }\nexport class Guest extends User { }\n",
    "src/types.ts": "export type Opt = { deep: boolean };\n",
    "src/core/load.test.ts": "import { load } from './load';\ndescribe('loading', () => { it('loads one', () => { load(1); }); });\n",
    "package.json": '{"name": "demo", "main": "./dist/index.js"}',
    "venv/lib/x.py": "def hidden():\n    return 1\n",
}


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    store = Store(spark, str(tmp_path_factory.mktemp("index") / "store"))
    report = store.index(str(root))
    assert report["failed"] == 0 and report["indexed"] == 6  # nothing of the virtual environment
    out = Tools(store)
    out.folder = str(root)
    return out


def test_search_by_name_and_type(tools):
    names = lambda df: {r["name"] for r in df.collect()}
    assert names(tools.search_symbols(return_type="Promise")) == {"load"}
    assert names(tools.search_symbols(return_type="user", match_mode="inner")) == {"load"}
    assert names(tools.search_symbols(return_type="User")) == {"parse"}
    assert names(tools.search_symbols(param_type="Opt")) == {"load", "save"} and names(tools.search_symbols("load", param_type="Opt")) == {"load"}
    assert names(tools.search_symbols(return_type="Promise", param_type="Opt")) == {"load"}
    assert "load" in names(tools.search_symbols("load")) and names(tools.search_symbols('"load" OR pars*', kind="function")) >= {"load", "parse"}
    assert "load" in names(tools.search_symbols("loed", expand_synonyms=False))  # one edit away


def test_lookups(tools):
    assert [r["name"] for r in tools.get_alias("Opt").collect()] == ["Opt"] and [r["name"] for r in tools.get_variable("LEAST").collect()] == ["LEAST"]
    assert {r["name"] for r in tools.get_class("User", methods_only=True).collect()} == {"User", "save"}
    assert {(r["section"], r["name"]) for r in tools.list_functions("load.test.ts").collect()} == {("test callback", "loading"), ("test callback", "loads_one")}
    assert [r["section"] for r in tools.list_functions("core/user.ts").collect()] == ["interface", "class", "class", "class"]
    above = {(r["name"], r["inherited_from"]) for r in tools.get_class("Admin", inherited=True).collect()}
    assert above == {("Admin", None), ("save", "User"), ("name", "User")}
    one = tools.get_function("load", folder=tools.folder).collect()
    assert [r["source"] for r in one] == [FILES["src/core/load.ts"].split("\n")[4]]
    assert "class User" in {r["name"]: r["source"] for r in tools.get_class("User", folder=tools.folder).collect()}["User"]
    assert tools.suggestions("nothing") == []
    found = {r["id"].split(":")[1] for r in tools.get_related_context("load", include_tests=True).collect()}
    assert {"load", "parse", "User", "Opt", "loading"} <= found


def test_dependencies(tools):
    nodes = lambda **more: {(r["node"], r["external"]) for r in tools.get_module_dependencies("src/core/load.ts", **more).collect()}
    assert nodes() == {("src/core/load.ts", False), ("src/core/user.ts", False), ("src/types.ts", False)}
    assert ("axios", True) in nodes(include_external=True) and ("src/types.ts", False) not in nodes(include_types=False)
    assert nodes(reverse=True) >= {("src/core/load.test.ts", False), ("src/index.ts", False)}


def test_overview_has_every_view(tools):
    assert {r["module"] for r in tools.get_architecture_overview().collect()} == {"src", "src/core", "."}
    assert [(r["file_path"], r["reason"]) for r in tools.get_architecture_overview("entry_points").collect()] == [("src/index.ts", "package.json main")]
    assert {r["export_name"] for r in tools.get_architecture_overview("public_api").collect()} == {"load"}
    assert ("User", 2) in {(r["target"], r["children"]) for r in tools.get_architecture_overview("patterns").collect()}
    assert {r["view"] for r in tools.get_architecture_overview("full").collect()} >= {"modules", "dependencies", "entry_points", "public_api", "patterns", "key_types"}
    assert all(tools.get_architecture_overview(f).count() >= 1 for f in FOCUS)
    with pytest.raises(ValueError):
        tools.get_architecture_overview("nothing")


def test_chains_are_stored(tools):
    store = tools.store
    registry = {r["chain"]: r for r in store.build_chains().collect()}
    rows = store.read("transitions").collect()
    for chain, r in registry.items():
        own = [x for x in rows if x["chain"] == chain]
        assert (r["total_states"], r["total_transitions"]) == (len({x["from_id"] for x in own}), len(own))
    assert store.chain_id("type_affinity") == "chain:type_affinity" and store.chain_id("none") is None
    before = registry["cooccurrence"]["total_transitions"]
    store.save_transitions(store.read("transitions").filter("chain = 'type_affinity'").limit(2))  # only that chain is replaced
    counts = {r["chain"]: r["total_transitions"] for r in store.read("chains").collect()}
    assert counts["type_affinity"] == 2 and counts["cooccurrence"] == before
    store.delete_chain("type_affinity", keep_registered=True)
    assert {r["chain"]: r["total_transitions"] for r in store.read("chains").collect()}["type_affinity"] == 0
    store.delete_chain("type_affinity")
    assert store.chain_id("type_affinity") is None
    store.build_chains()
    related = tools.suggest_related("User").collect()
    assert related and {r["reason"] for r in related} == {"chains"}
    alone = tools.suggest_related("load", chains=("type_affinity",)).collect()
    assert {r["reason"] for r in alone} <= {"callers", "callees", "co_located"} and alone


def test_a_half_written_manifest_does_no_harm(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.clear()
    (tmp_path / "s" / "_manifest-broken").write_text("{")
    assert store.read("files").count() == 0 and len(list((tmp_path / "s").glob("manifest-*.json"))) == 1
    mine = spark.range(3).cache()
    mine.count()
    store.index(str(tmp_path / "s"))
    assert mine.is_cached and spark.sparkContext._jsc.getPersistentRDDs().size() >= 1  # others' tables stay cached
    mine.unpersist()


def test_index_file_and_older_schemas(spark, tools, tmp_path):
    store = tools.store
    assert store.index_file(tools.folder, "src/types.ts") == {"indexed": 1, "removed": 0, "failed": 0}
    assert store.read("files").count() == 6
    store._commit({"exports": store.read("exports").drop("re_export_source")})
    assert store.read("exports").filter("re_export_source is null").count() == store.read("exports").count()
    assert store.migrate() == ["exports"] and store.migrate() == []


def test_pairs_in_blocks_are_all_pairs(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(40)] + [("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    plain, blocks = (sorted((r["x"], r["y"]) for r in markov.paired(rows, "k", "v", markov.hot_keys(rows, "k", block), block).select(F.col("a_v").alias("x"), F.col("b_v").alias("y")).collect()) for block in (100, 7))
    assert plain == blocks and len(plain) == 1600 + 4 + 1


def test_queries_and_aliases():
    assert search.parse_match("a b") == [[(("a",), False), (("b",), True)]] and search.parse_match('"a b" OR c*') == [[(("a", "b"), False)], [(("c",), True)]] and search.parse_match("") == []
    aliases, base = imports.load_tsconfig('{ /* x */ "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*",],}, "u": "http://x"}, }')
    assert (aliases, base) == ([("@/*", ["src/*"])], ".")
    assert awareness.canonical_key("t", {"b": 1, "a": [{"d": 1, "c": 2}]}) == 't::{"a":[{"c":2,"d":1}],"b":1}'
    assert awareness.target_of("list_files", None) == "*" and awareness.target_of("get_function", {"function_name": "  "}) is None and awareness.target_of("sync_index", {}) is None


def test_registry_and_exports():
    ingest.reset_registry()
    r = ingest.registry()
    assert r is ingest.registry() and r.languages() == ["config", "javascript", "python", "typescript"] and r.by_language("python") is not None and r.by_language("cobol") is None
    assert r.can_parse("a/b.py") and r.can_parse("package.json") and not r.can_parse("data.json") and not r.can_parse("x.md")
    assert set(quillmesh.__all__) <= set(dir(quillmesh))


def test_reports_say_what_they_leave_out(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("x", "y")], "src string, dst string")
    assert render.tree(edges, "a") == "a\n  b\n    c\n      a (circular)\n  d"
    assert render.tree(edges, "a", external={"d"}, depth=1) == "a\n  b\n  d [external]"
    assert "only the first" in render.tree(edges, "a", most=1) and "only the first 2 rows" in render.table(edges, ["src"], most=2)
    assert {r["cycle"] for r in graph.simple_cycles(edges.union(spark.createDataFrame([("y", "x")], edges.schema)), 4).collect()} == {"a -> b -> c", "x -> y"}
    root = spark.createDataFrame([("b",)], "node string")
    assert [r["cycle"] for r in graph.simple_cycles(edges.union(spark.createDataFrame([("y", "x")], edges.schema)), 4, root).collect()] == ["a -> b -> c"]


def test_service_and_init(tools, tmp_path):
    out, ask = [], lambda tool, **given: json.dumps({"tool": tool, "input": given})
    calls = [ask("get_function", name="load"), ask("get_function", name="load"), "not json", ask("nothing"), "", ask("list_files", size=2), *[ask("get_class", name=f"C{i}", methods_only=bool(i % 2)) for i in range(2)]]
    serve(tools, calls, lambda text: out.append(json.loads(text)))
    assert [o.get("state", "error") for o in out] == ["explore", "cache_hit", "error", "error", "explore", "explore", "explore"]
    assert out[0]["rows"] == out[1]["rows"] and out[0]["rows"][0]["name"] == "load" and len(out[4]["rows"]) == 2
    path = init(str(tmp_path))
    assert find_config(str(tmp_path))["exclude"] == list(ingest.EXCLUDE) and init(str(tmp_path)) == path


def test_call_flow_is_the_same_with_hot_callers(spark, monkeypatch):
    rows = [(c, t, 1 + (c + t) % 3, t % 2 == 0, t % 3 == 0) for c in range(4) for t in range(3 + 9 * (c == 0))]
    calls = spark.createDataFrame(rows, "caller int, callee int, call_count long, is_async boolean, is_conditional boolean")
    real, out = markov.hot_keys, []
    for block in (4096, 5):
        monkeypatch.setattr(markov, "hot_keys", lambda df, key, block=block: real(df, key, block))
        out.append(sorted((r["from_id"], r["to_id"], round(r["raw"], 9)) for r in markov.call_flow_weights(calls).collect()))
    assert out[0] == out[1] and len(out[0]) == 12 * 11
