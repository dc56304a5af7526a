"""Context bundles: tests around references, blocks, equal shares, and the tool over a small project."""

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import scalars
from quillmesh.operators import bundles, retrieval
from quillmesh.sources.store import Store
from quillmesh.tools import Tools

TEST = """import { load } from './load';
beforeEach(() => {
  load(0);
});
describe('loading', () => {
  it("loads one", () => {
    load(1);
    load(2);
  });
  const later = beforeAll(() => { load(3); });
});
"""
FILES = {
    "src/load.ts": "import { User } from './user';\nexport function load(id: number): User {\n  readFileSync('x');\n  return parse(id);\n}\nfunction parse(id: number): User {\n  return make(id);\n}\nfunction make(id: number): User { return new User(); }\n",
    "src/user.ts": "export class User {\n  name = '';\n}\n", "src/load.test.ts": TEST,
    "src/test_load.py": "import load\nclass TestLoad:\n    def test_one(self):\n        load.load(1)\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    store = Store(spark, str(tmp_path_factory.mktemp("index") / "store"))
    store.index(str(root))
    return Tools(store), str(root)


def test_tests_around_references(spark):
    texts = spark.createDataFrame([("a.test.ts", TEST), ("test_b.py", FILES["src/test_load.py"]), ("c.test.ts", None), ("d.txt", TEST)], "file_path string, content string")
    refs = spark.createDataFrame([("load", p, n) for p in ("a.test.ts", "d.txt") for n in (1, 3, 7, 8, 10)] + [("load", "test_b.py", 4), ("load", "c.test.ts", 1), ("load", "none.ts", 1)], "symbol_name string, file_path string, line_number int")
    found = {(x["file_path"], x["line_number"], x["name"], x["framework"]) for x in bundles.enclosing_tests(refs, texts).collect()}
    # line 3 stands after a hook without a name, line 10 in one that a variable names
    assert found == {("a.test.ts", 6, "loads one", "vitest"), ("a.test.ts", 10, "later", "vitest"), ("test_b.py", 3, "test_one", "pytest")}


def test_blocks_equal_the_plain_form(spark):
    texts = [TEST, "", "a\n(b\n[c\n", "x\n" * 40, "{\n" * 30, "f(a)\ng(b)"]
    rows = spark.createDataFrame([(i, k, t) for i, t in enumerate(texts) for k in (0, 1, 4)], "i int, k int, t string")
    for x in rows.select("*", bundles.block_at(F.split("t", "\n"), F.col("k")).alias("block")).collect():
        assert x["block"] == retrieval.block_of(x["t"], x["k"])


def test_cut_bytes_equal_the_plain_form(spark):
    texts = ["é" * 10, "short", None, "", "a€" * 7, "𝄞𝄞𝄞𝄞", "abcdefghij"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (2, 3, 8, 9, 10, 11, 12):
        assert [x[0] for x in rows.select(scalars.bytes_within(F.col("t"), most)).collect()] == [scalars.cut_bytes(t, most) for t in texts]


def test_bundle(project):
    tools, folder = project
    rows = tools.get_context_bundle("load", folder, include_tests=True, callee_depth=2).collect()
    by = {(r["section"], r["name"]): r for r in rows}
    assert by["symbol", "load"]["source"] == "\n".join(FILES["src/load.ts"].split("\n")[1:5])
    assert by["types", "User"]["source"].startswith("export class User")
    assert by["callees", "parse"]["place"] == 1 and by["callees", "make"]["place"] == 2 and by["callees", "readFileSync"]["package"] == "node:fs" and by["callees", "parse"]["package"] is None
    assert by["tests", "loads one"]["source"].split("\n")[0] == '  it("loads one", () => {' and by["tests", "loads one"]["framework"] == "vitest"
    assert by["symbol", "load"]["tokens"] == 3200 and all(r["estimated_tokens"] <= r["tokens"] + 8 for r in rows)
    callees = [r for r in rows if r["section"] == "callees"]
    assert {r["tokens"] for r in callees} == {2000 // len(callees)}
    small = {(r["section"], r["name"]): r["source"] for r in tools.get_context_bundle("load", folder, max_tokens=40).collect()}
    assert small["symbol", "load"].endswith("// ... truncated ...") and not any(s == "tests" for s, _ in small)
    assert tools.get_context_bundle("nothing", folder, include_tests=True).collect() == []
