from pyspark.sql import functions as F

from quillmesh.functions import render, scalars
from quillmesh.functions.registration import register
from quillmesh.operators import graph, imports, lookups, markov, retrieval, search
from quillmesh.functions.thesaurus import thesaurus


def test_parse_type():
    t = scalars.parse_type
    assert t("Promise<User[]>") == {"raw": "Promise<User[]>", "normalized": "Promise<Array<User>>", "base": "promise", "inner": "array<user>", "is_async": True, "is_nullable": False, "is_array": False, "is_generic": True}
    assert t("Optional[Dict[str, int]]", "python")["normalized"] == "Nullable<Map<String, Number>> | null"
    assert t("(a: string) => void")["base"] == "(a: string) => void" and t("void") is None and t(None) is None and t("") is None
    assert t("null | Foo")["is_nullable"] and t("null | Foo")["base"] == "foo" and t("Buffer")["normalized"] == "ByteArray"
    assert scalars.split_arguments("a, Map<b, c>, [d, e]") == ["a", "Map<b, c>", "[d, e]"]


def test_cut_bytes():
    assert scalars.cut_bytes("é" * 10, 9) == "ééé..." and scalars.cut_bytes("short", 9) == "short" and scalars.cut_bytes(None, 3) is None


def test_globs():
    import re

    g = lambda p, s: bool(re.search(retrieval.glob_regex(p), s))
    assert g("**/*.ts", "a.ts") and g("**/*.ts", "x/y/a.ts") and not g("*.ts", "x/a.ts") and g("src/**", "src/a/b") and not g("**/tests/**", "mytests/x")
    assert retrieval.glob_regex("**/tests/**", legacy=True) == "\\.[^/]*/tests/\\.[^/]*"


def test_block_of():
    assert retrieval.block_of("a\nit(() => {\n x({\n })\n})\nmore", 1) == "it(() => {\n x({\n })\n})"


def test_golden_walk(spark):
    """A hop costs 0.7; what falls under 0.05 is dropped; the better of two ways stays."""
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.1), ("b", "c", 0.9), ("b", "d", 0.1)], "from_id string, to_id string, prob double")
    got = {r["state"]: (round(r["score"], 6), r["hops"]) for r in markov.walk(edges, "a").collect()}
    assert got == {"b": (0.35, 1), "c": (0.2205, 2)}


def test_golden_call_flow(spark):
    calls = spark.createDataFrame([("x", "b", 5, False, False), ("x", "c", 3, True, False), ("x", "d", 1, False, True)], "caller string, callee string, call_count long, is_async boolean, is_conditional boolean")
    got = {(r["from_id"], r["to_id"]): (round(r["raw"], 6), round(r["prob"], 6)) for r in markov.normalise(markov.call_flow_weights(calls)).collect()}
    assert got["b", "c"] == (1.225872, 0.660389) and got["d", "c"] == (0.762462, 0.491758) and len(got) == 6


def test_golden_types_and_clusters(spark):
    rels = spark.createDataFrame([("User", "Base", "extends"), ("User", "Repo", "implements"), ("Admin", "User", "extends")], "source string, target string, kind string")
    got = {(r["from_id"], r["to_id"]): round(r["prob"], 6) for r in markov.normalise(markov.type_affinity_weights(rels)).collect()}
    assert got["User", "Base"] == 0.37037 and got["User", "Admin"] == 0.296296 and got["Base", "User"] == 1.0
    imps = spark.createDataFrame([(f, s) for s, fs in {"s1": "ABC", "s2": "AB", "s3": "BC"}.items() for f in fs], "file string, source string")
    got = {(r["from_id"], r["to_id"]): r["prob"] for r in markov.normalise(markov.import_cluster_weights(imps)).collect()}
    assert got == {("A", "B"): 1.0, ("B", "A"): 0.5, ("B", "C"): 0.5, ("C", "B"): 1.0}


def test_golden_rerank(spark):
    rows = spark.createDataFrame([("user account", "", 2.0)], "name string, signature string, score double")
    terms = [("user", 1.0, "original"), ("account", 0.8, "synonym"), ("member", 0.9, "canonical")]
    assert search.rerank(rows, terms).first()["synonym_score"] == 1.0
    assert search.synonyms(spark, thesaurus(spark), "get", "load").first()[0] and not search.synonyms(spark, thesaurus(spark), "get", "drop").first()[0]


def test_cycles_and_trees(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    assert sorted(r["cycle"] for r in graph.simple_cycles(edges, 4).collect()) == ["a -> b", "a -> b -> c", "d"]
    assert render.tree(edges, "a", {"c"}) == "a\n  b\n    a (circular)\n    c [external]"
    levels = graph.reachable(edges, spark.createDataFrame([("a",)], "node string"), 3)
    assert render.hierarchy(levels, "T").split("\n")[:3] == ["# T", "## Level 0", "- a"]
    assert render.table(edges.orderBy("src", "dst").limit(1), ["src", "dst"]) == "src\tdst\na\tb"


def test_small_texts():
    assert render.specifiers([{"name": "a", "alias": "b", "is_namespace": False}, {"name": "*", "alias": "c", "is_namespace": True}]) == "a as b, * as c"
    assert "Did you mean save" in render.did_you_mean("svae", ["save", "load"]) and render.shorten("x" * 60).endswith("...")
    assert render.narrative("src", 2, list("abcdef"), ["t"]) == "src: 2 files; exports a, b, c, d, e and 1 more; about t."


def test_path_overlap(spark):
    row = spark.range(1).select(lookups.path_score(F.lit("indx.ts"), F.lit("index.ts")).alias("s")).first()
    assert round(row["s"], 3) == 13.125  # the part for characters in common


def test_import_resolution(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("lib/c.ts",)], "file_path string")
    imps = spark.createDataFrame([("src/x.ts", "./a.js"), ("src/x.ts", "./b"), ("src/x.ts", "@/c"), ("src/x.ts", "../lib/c"), ("src/x.ts", "fs"), ("src/x.ts", "./none")], "file string, source string")
    got = {r["source"]: (r["resolved_path"], r["kind"]) for r in imports.resolve(imps, files, [("@/*", "lib/*")]).collect()}
    assert got == {"./a.js": ("src/a.ts", "internal"), "./b": ("src/b/index.ts", "internal"), "@/c": ("lib/c.ts", "external"), "../lib/c": ("lib/c.ts", "internal"), "fs": (None, "builtin"), "./none": (None, "internal")}
    assert imports.resolve(imps, files, stripped=False).filter("source = './a.js'").first()["resolved_path"] is None


def test_registered_functions(spark):
    register(spark, {"shout": (str.upper, "string")})
    assert spark.sql("SELECT parse_type('string | null').base AS b, shout('x') AS s").first() == ("string", "X")


def test_fuzzy_uses_the_whole_pattern(spark):
    from quillmesh.operators import search

    rows = spark.createDataFrame([(1, "a" * 60 + "b" * 60), (2, "a" * 60 + "c" * 60)], "id long, name string")
    assert [(r["id"], r["score"]) for r in search.fuzzy(rows, "id", ["name"], "a" * 60 + "b" * 60).collect()] == [(1, 1.0)]


def test_resolve_paths_answers_every_query(spark):
    from quillmesh.operators import lookups

    queries = spark.range(10_050).selectExpr("concat('f', id, '.py') as query")
    got = lookups.resolve_paths(queries, spark.createDataFrame([("f3.py",), ("f10049.py",)], "file_path string"))
    assert got.filter("status = 'exact'").count() == 2
