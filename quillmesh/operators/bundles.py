"""Context of many symbols at once: tests that refer to them, and shares of a token budget for each of their parts (Q11, Q15-Q20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.scalars import estimate_tokens, truncate_lines
from quillmesh.operators.retrieval import enclosing, token_budgets

#: How a test, or what surrounds one, begins in each framework: with its name, and without.
_QUOTED = r"""\s*\(\s*['"`]([^'"`]+)['"`]"""
TEST_HEADS = {
    "vitest": ([r"\b(?:describe|it|test)" + _QUOTED], [r"\b(?:beforeEach|afterEach|beforeAll|afterAll)\s*\("]),
    "jest": ([r"\b(?:describe|it|test)" + _QUOTED], [r"\b(?:beforeEach|afterEach|beforeAll|afterAll)\s*\("]),
    "mocha": ([r"\b(?:describe|it|specify|context)" + _QUOTED], [r"\b(?:before|after|beforeEach|afterEach)\s*\("]),
    "pytest": ([r"\bdef\s+(test_\w+)\s*\(", r"\bclass\s+(Test\w+)"], [r"@pytest\.fixture"]),
}
#: Names of a line that begins a test without one.
FALLBACK_NAMES = [r"\bfunction\s+(\w+)", r"\bdef\s+(\w+)", r"\bconst\s+(\w+)\s*=", r"\b(\w+)\s*[=:]\s*(?:async\s*)?\("]


def framework_of(path: Column, text: Column) -> Column:
    """The framework of a test file: pytest by its ending, others by what they import, else what most projects have (Q15)."""
    imports = lambda name: text.rlike(rf"""(?:from\s+|require\()['"](?:@{name}/[^'"]*|{name})['"]""")
    out = F.when(path.endswith(".py"), "pytest")
    for name in ("vitest", "jest", "mocha"):
        out = out.when(imports(name), name)
    return out.when(path.rlike(r"\.[cm]?[jt]sx?$"), "vitest").otherwise("unknown")


def head_name(line: Column, framework: Column) -> Column:
    """The name of the test that a line begins, or null (Q16)."""
    first = lambda patterns: F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns])
    out = F.lit(None).cast("string")
    for name, (named, bare) in TEST_HEADS.items():
        out = F.when(framework == name, F.coalesce(first(named), F.when(line.rlike("|".join(bare)), first(FALLBACK_NAMES)))).otherwise(out)
    return out


def enclosing_tests(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """symbol_name, file_path, line_number, name, framework: the test around each reference, each once (Q16, Q17).

    refs: symbol_name, file_path, line_number (from 1); texts: file_path, content. References before any test, or in a file without text,
    give no row. A file's lines meet in one task; bodies above the scan's limit have no content.
    """
    known = texts.select("file_path", "content", framework_of(F.col("file_path"), F.col("content")).alias("framework"))
    lines = known.select("file_path", "framework", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    marked = enclosing(lines.withColumn("own", head_name(F.col("line"), F.col("framework"))), ["file_path"], "at", F.col("own").isNotNull(), F.col("own")).filter("head is not null")
    found = refs.select("symbol_name", "file_path", (F.col("line_number") - 1).alias("at")).join(marked.select("file_path", "at", "head_at", "head", "framework"), ["file_path", "at"])
    return found.select("symbol_name", "file_path", (F.col("head_at") + 1).alias("line_number"), F.col("head").alias("name"), "framework").distinct()


def first_places(rows: DataFrame, by: list[str], order: list[str], most: int = 5) -> DataFrame:
    """The first `most` of each group, each place once (Q17)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.dropDuplicates([*by, *order]).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def block_at(lines: Column, start: Column | int, most: int = 20) -> Column:
    """Lines from `start` (from 0) until their brackets are closed, at most `most` (Q18)."""
    count = lambda line, marks: F.length(line) - F.length(F.translate(line, marks, ""))
    begin = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(False).alias("done"))

    def add(acc: Column, line: Column) -> Column:
        depth = acc["depth"] + count(line, "({[") - count(line, ")}]")
        opened = acc["opened"] | (count(line, "({[") > 0)
        more = F.struct(F.array_append(acc["kept"], line).alias("kept"), depth.alias("depth"), opened.alias("opened"), (opened & (depth <= 0)).alias("done"))
        return F.when(acc["done"], acc).otherwise(more)

    return F.array_join(F.aggregate(F.slice(lines, (F.lit(start) if isinstance(start, int) else start) + 1, most), begin, add)["kept"], "\n")


def shared_out(items: DataFrame, by: list[str], total: Column, with_tests: bool) -> DataFrame:
    """Items with tokens: the budget of their section, in equal parts for its items (Q20). items: section, one of symbol, types, callees, tests."""
    shares = token_budgets(total, with_tests)
    own = F.create_map(*[x for name, share in shares.items() for x in (F.lit(name), share)])[F.col("section")]
    counted = items.groupBy(*by, "section").agg(F.count("*").alias("_n"))  # a hot group is counted before it is shuffled, and joined in parts
    return items.join(counted, [*by, "section"]).withColumn("tokens", F.floor(own / F.col("_n")).cast("long")).drop("_n")


def fitted(items: DataFrame, text: str) -> DataFrame:
    """Items with their text cut to whole lines within their tokens, and what that comes to; none where there is no text (Q7, F1, F2)."""
    cut = items.withColumn(text, truncate_lines(F.col(text), (F.col("tokens") * 4).cast("int"), "// ... truncated ..."))
    return cut.withColumn("estimated_tokens", F.coalesce(estimate_tokens(F.col(text)), F.lit(0)))
