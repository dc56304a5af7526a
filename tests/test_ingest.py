import json

import pytest
from pyspark.sql import functions as F

from quillmesh.__main__ import main
from quillmesh.sources import config_parser, ingest, python_parser, ts_parser
from quillmesh.sources.store import Store, find_config, validated
from quillmesh.tools import Tools

TS = '''import fs, { readFile as rf } from 'node:fs';
import { load } from './lib';
export * from './lib';
/** Adds numbers. */
export async function add<T extends object>(x: number, y = 2, ...rest: T[]): Promise<number> {
  const inner = (z: number): number => {
    const q = load(z);
    return q;
  };
  if (x) { await inner(y); }
  return sum(x, y);
}
export const LIMIT: number = 10;
export interface Repo<T> extends Base<T> { find(id: string): T; }
export class User extends Entity<User> implements Repo<User> {
  private name: string = 'x';
  constructor(public id: number) { super(); }
  async save(force?: boolean): Promise<void> { await this.persist(force); add(1, 2); }
  get label(): string { return `${this.name} // not a comment ${fmt(1)}`; }
}
describe('user things', () => { it('saves it', () => { add(1, 2); }); });
'''
PY = '''"""Module."""
from abc import ABC
import os.path as p

LIMIT = 3
_hidden = 1


class Base(ABC, Mixin[int]):
    size: int = 4

    def __init__(self, n: int, *rest, key="a", **more):
        self.n = n

    @staticmethod
    async def run(x: str = "a") -> int:
        """Runs."""
        if x:
            await helper(x)
        return compute(x)


def gen(a, b=1):
    yield helper(a)
'''


def test_typescript():
    o = ts_parser.parse("src/a.ts", TS)
    by = {s["name"]: s for s in o["symbols"]}
    assert [s["kind"] for s in o["symbols"] if s["name"] in ("add", "add.inner", "LIMIT", "Repo", "User", "save", "label")] == ["function", "function", "variable", "interface", "class", "method", "method"]
    add = by["add"]
    assert (add["line_start"], add["line_end"], add["is_async"], add["is_exported"], add["return_type"], add["doc"]) == (5, 12, True, True, "Promise<number>", "/** Adds numbers. */")
    assert [(q["name"], q["type"], q["has_default"], q["rest"]) for q in add["params"]] == [("x", "number", False, False), ("y", None, True, False), ("rest", "T[]", False, True)]
    assert by["add.inner"]["parent_function"] == "add" and not by["add.inner"]["is_exported"]
    assert by["save"]["parent_class"] == "User" and by["name"]["is_private"] and "constructor" not in by
    assert {(r["source_name"], r["target_name_base"], r["relationship_kind"]) for r in o["type_rels"]} == {("Repo", "Base", "extends"), ("User", "Entity", "extends"), ("User", "Repo", "implements")}
    calls = {(c["caller_name"], c["callee_name"]): c for c in o["calls"]}
    assert calls["add", "inner"]["is_async"] and calls["add", "inner"]["is_conditional"] and calls["User.save", "add"]["call_count"] == 1 and ("add.inner", "load") in calls
    assert ("add", "load") not in calls  # the innermost function makes the call
    assert [i["import_source"] for i in o["imports"]] == ["node:fs", "./lib", "./lib"] and o["imports"][2]["is_re_export"]
    assert by["saves_it"]["kind"] == "callback" and not any(r["symbol_name"] == "comment" for r in o["refs"])


def test_typescript_survives_odd_input():
    for text in ("", "}}}", "class", "export", "function (", "const x = `${`", "import {", "a < b > (c", "type X = {", "interface I extends", "/[/", "@", "class A { static", "export default"):
        ts_parser.parse("x.ts", text)


def test_python():
    o = python_parser.parse("m.py", PY)
    by = {s["name"]: s for s in o["symbols"]}
    assert {n: s["kind"] for n, s in by.items()} == {"LIMIT": "variable", "_hidden": "variable", "Base": "class", "size": "property", "__init__": "constructor", "run": "method", "gen": "function"}
    assert by["run"]["is_static"] and by["run"]["is_async"] and by["run"]["doc"] == "Runs." and by["gen"]["is_generator"] and by["_hidden"]["is_private"]
    assert [q["name"] for q in by["__init__"]["params"]] == ["n", "*rest", "key", "**more"]
    assert [(r["target_name_base"], r["relationship_kind"]) for r in o["type_rels"]] == [("ABC", "extends"), ("Mixin", "mixin")]
    calls = {(c["caller_name"], c["callee_name"]): c for c in o["calls"]}
    assert calls["Base.run", "helper"]["is_async"] and calls["Base.run", "helper"]["is_conditional"] and not calls["Base.run", "compute"]["is_conditional"]
    assert [e["export_name"] for e in o["exports"]] == ["LIMIT", "Base", "gen"]
    assert [e["export_name"] for e in python_parser.parse("m.py", "__all__ = ['b']\na = 1")["exports"]] == ["b"]
    assert python_parser.parse("m.py", "def (") == {} and python_parser.parse("m.py", "") != {}


def test_python_keeps_what_has_no_error():
    broken = "import os\n\ndef good(a):\n    return other(a)\n\ndef bad(a:\n    return a\n\nclass Box:\n    def fine(self):\n        return 1\n\n    def worse(self):\n        return (1 +\n\nx = = 3\nLIMIT = 2\n"
    o = python_parser.parse("m.py", broken)
    assert {(s["name"], s["line_start"]) for s in o["symbols"]} == {("good", 3), ("Box", 9), ("fine", 10), ("LIMIT", 17)}
    assert [i["import_source"] for i in o["imports"]] == ["os"] and [(c["caller_name"], c["callee_name"]) for c in o["calls"]] == [("good", "other")]


@pytest.mark.parametrize("path,text", [("tsconfig.json", '{"compilerOptions": {"strict": true, "lib": ["a", {"b": null}]}}'), ("c.yaml", "compilerOptions:\n  strict: true\n  lib:\n    - a\n    - b: null\n"), ("c.toml", '[compilerOptions]\nstrict = true\nlib = ["a", {b = 1}]\n')])
def test_config(path, text):
    rows = {r["path"]: r for r in config_parser.parse(path, text)["config_entries"]}
    strict = rows["compilerOptions.strict"]
    assert (strict["value_type"], strict["value"], strict["depth"], strict["parent_path"]) == ("boolean", "true", 1, "compilerOptions")
    assert rows["compilerOptions.lib[1]"]["value_type"] == "object" and "compilerOptions.lib[1].b" in rows
    assert strict["line_number"] == (1 if path.endswith("json") else 2)
    with pytest.raises(Exception):  # noqa: B017, PT011  each reader has its own; the file counts as partial
        config_parser.parse(path, "{[")


def test_paths_in_values():
    assert config_parser.value_at({"a": [{"b": 3}]}, "a[0].b") == 3 and config_parser.value_at({"a": 1}, "a.b[2]") is None


def test_store_and_tools(spark, tmp_path, capsys):
    src, out = tmp_path / "p", str(tmp_path / "store")
    (src / "src").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "src" / "a.ts").write_text(TS)
    (src / "src" / "lib.ts").write_text("export function load(n: number): number { return n; }\nexport function spare(): void { load(1); sum(2); }\n")
    (src / "m.py").write_text(PY)
    (src / "package.json").write_text('{"name": "x", "quillmesh": {"exclude": ["**/node_modules/**"]}}')
    (src / "data.json").write_text('{"a": 1}')
    (src / "node_modules" / "z.ts").write_text("export const z = 1;")
    store = Store(spark, out)
    assert store.index(str(src)) == {"indexed": 4, "removed": 0, "failed": 0}
    assert store.index(str(src)) == {"indexed": 0, "removed": 0, "failed": 0}
    assert {r["file_path"] for r in store.read("files").collect()} == {"src/a.ts", "src/lib.ts", "m.py", "package.json"}
    tools = Tools(store)
    assert tools.get_function("save").first()["parent_class"] == "User" and tools.get_function("User.save").count() == 1
    assert {r["name"] for r in tools.get_class("User").collect()} >= {"User", "save", "label"}
    assert tools.search_symbols("fetch").first()["name"] == "load"  # by a synonym
    assert tools.search_symbols("spaer").first()["name"] == "spare"  # by approximation
    assert {r["dst"] for r in tools.trace_calls("add", "callees").collect()} == {"inner", "sum"}
    assert {r["dst"] for r in tools.trace_calls("load", "callers").collect()} >= {"add.inner", "spare"}
    assert {r["node"] for r in tools.trace_types("User", "up").collect()} >= {"User", "Entity", "Repo", "Base"}  # by name, as calls are
    assert {(r["node"], r["depth"]) for r in tools.get_module_dependencies("src/a.ts").collect()} == {("src/a.ts", 0), ("src/lib.ts", 1)}
    assert tools.suggest_related("add").count() > 0 and tools.suggest_related("nothing").count() == 0
    assert tools.find_references("add").first()["total"] >= 2
    assert {r["module"]: r["files"] for r in tools.get_architecture_overview().collect()} == {".": 2, "src": 2}
    assert tools.get_related_context("add").count() >= 1 and tools.list_files(page=1, size=2).count() == 2
    assert store.read("config_entries").filter("path = 'name'").first()["value"] == "x"
    (src / "src" / "lib.ts").write_text("export function load2(): void {}\n")
    (src / "m.py").unlink()
    assert store.index(str(src)) == {"indexed": 1, "removed": 1, "failed": 0}
    names = {r["name"] for r in store.read("symbols").collect()}
    assert "load2" in names and "spare" not in names and "gen" not in names and "add" in names
    store.delete(["src/lib.ts"])
    assert store.read("symbols").filter("file_path = 'src/lib.ts'").count() == 0
    main(["query", out, "get_function", "add"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["name"] == "add"
    store.clear()
    assert store.read("files").count() == 0
    assert find_config(str(src / "src"))["exclude"] == ["**/node_modules/**"]


def test_settings():
    with pytest.raises(ValueError):
        validated({"nope": 1})
    with pytest.raises(ValueError):
        validated({"include": "x"})


def test_left_out_and_oversize_files_are_not_read(spark, tmp_path):
    """A file that cannot be opened does no harm where a glob or the limit leaves it out; names with odd characters are found."""
    for path, text in {"a+b c%20.ts": "const x = 1;", "node_modules/m.ts": "x", "big.ts": "y" * 300}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    rows = {r["file_path"]: r for r in ingest.scan(spark, str(tmp_path), limit=200).collect()}
    assert set(rows) == {"a+b c%20.ts", "big.ts"} and rows["a+b c%20.ts"]["content"] == "const x = 1;"
    assert rows["big.ts"]["content"] is None and rows["big.ts"]["checksum"].startswith("size:300:") and rows["big.ts"]["file_size"] == 300
    assert {(r["file_path"], r["file_size"]) for r in ingest.listing(spark, str(tmp_path)).collect()} == {("a+b c%20.ts", 12), ("big.ts", 300)}
    plan = ingest.scan(spark, str(tmp_path), limit=200)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,200)" in plan
    read = [line for line in plan.split("\n") if "FileScan binaryFile" in line or "BatchScan" in line]
    assert any("content" not in line.split("[")[1] for line in read) and all("_metadata" in line or "file_path" in line for line in read)


def test_broken_configuration_is_partial_and_values_stay_whole(spark, tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"name": "x" * 5000}))
    (tmp_path / "tsconfig.json").write_text('{ /* c */ "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],},}, }')
    (tmp_path / "jest.config.json").write_text("{ broken")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("import { b } from '@/b';\nimport x from 'axios';\n")
    (tmp_path / "src/b.ts").write_text("export const b = 1;\n")
    store = Store(spark, str(tmp_path / "index"))
    report = store.index(str(tmp_path), include=("**/*.ts", "*.json"))
    assert report == {"indexed": 5, "removed": 0, "failed": 1}
    assert [tuple(r) for r in store.failed().collect()] == [("jest.config.json", "partial")]
    assert store.read("config_entries").filter("path = 'name'").first()["value"] == "x" * 5000
    found = {(r["source"], r["resolved_path"], r["kind"]) for r in store.resolved_imports().collect()}
    assert found == {("@/b", "src/b.ts", "internal"), ("axios", None, "external")}
    (tmp_path / "src/b.ts").write_text("export const c = 1;\n")
    (tmp_path / "src/a.ts").unlink()
    (tmp_path / "package.json").write_text("{}")
    tools = Tools(store)
    done = tools.sync_index(str(tmp_path), paths=["src/b.ts", "src/a.ts"]).first()
    assert (done["indexed"], done["removed"], done["failed"], done["rebuild"]) == (1, 1, 0, False)  # nothing but what was named
    assert sorted(tuple(r) for r in store.changes(str(tmp_path), include=("**/*.ts", "*.json")).collect()) == [("package.json", "changed")]
    assert {r["name"] for r in store.read("symbols").collect()} == {"c"} and store.read("config_entries").filter("path = 'name'").count() == 1
    (tmp_path / "src/d.ts").write_text("export const d = 1;\n")
    globs = {"include": ("**/*.ts", "*.json")}
    assert store.follow(str(tmp_path), **globs) == {"indexed": 2, "removed": 0, "failed": 0}
    assert store.follow(str(tmp_path), **globs) == {"indexed": 0, "removed": 0, "failed": 0}
    assert {r["name"] for r in store.read("symbols").collect()} == {"c", "d"}


def test_relations_that_are_not_asked_for_cost_nothing(spark, monkeypatch):
    """Parsing for one relation gives its rows as parsing for all does, without looking for calls and references."""
    sources = [("a.ts", "import { b } from './b';\nexport class A extends B { go(): void { run(); } }\n", 90), ("b.py", "import os\n\nclass C(D):\n    def go(self):\n        return run(1)\n\nx = 1\n", 80), ("c.json", "{}", 2), ("d.py", "y = 2", 5)]
    scanned = spark.createDataFrame(sources, "file_path string, content string, file_size long")
    every = sorted(tuple(r) for r in ingest.parse_files(scanned).collect())
    for relation in ingest.RELATIONS:
        assert sorted(tuple(r) for r in ingest.parse_files(scanned, only=(relation,)).collect()) == [r for r in every if r[1] == relation]
    parsers = ingest.Parsers()
    for module, method in ((ingest.ts_parser, "uses"), (ingest.python_parser, "references"), (ingest.python_parser, "_calls")):
        monkeypatch.setattr(module._File, method, None)
    found = [rel for p, c, n in sources[:2] for rel, _ in ingest._records(p, c, n, parsers, 0, frozenset(["symbols"]))]
    assert found == ["symbols"] * 5
    parsers.register(".ts", lambda path, content: {"symbols": [{"name": "own"}], "refs": [{}]})
    assert list(ingest._records("a.ts", "", 1, parsers, 0, frozenset(["symbols"]))) == [("symbols", {"name": "own"})]


def test_parts_are_dealt_by_their_number(spark):
    """A small table of keys becomes many files to parse."""
    from quillmesh.plans import parsing

    rows = spark.range(10_000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).coalesce(1)
    sizes = [r["n"] for r in parsing.dealt(rows).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10_000 and len(sizes) >= 3 and max(sizes) < 2 * parsing.FILES_PER_TASK
