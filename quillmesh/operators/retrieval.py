"""Budgeted context, ranking of candidates, test detection, listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_regex(glob: str, legacy: bool = False) -> str:
    """A regular expression for a glob. legacy: dots are escaped last, so `**` matches dots only, unanchored (Q2)."""
    if legacy:
        return glob.replace("**", ".*").replace("*", "[^/]*").replace(".", "\\.")
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def paginate(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of the rows, with how many there are in all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total))  # total: one row


def is_test_path(path: Column) -> Column:
    """Q14."""
    return path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$") | path.rlike(r"(^|/)test_[^/]*\.py$") | path.rlike(r"_test\.py$") | path.rlike(r"(^|/)(tests?|__tests__|spec)/")


def candidate_score(refs: Column, complexity: Column, lines: Column, is_method: Column) -> Column:
    """100 for each reference, up to 500 for complexity, up to 200 for lines, 5 for a method (Q5)."""
    return refs * 100 + F.least(complexity, F.lit(500)) + F.least(lines, F.lit(200)) + F.when(is_method, 5).otherwise(0)


def first_rank(rows: DataFrame, by: list[str], rank: Column) -> DataFrame:
    """Rows of the best rank in each group (Q4)."""
    return rows.withColumn("_k", rank).withColumn("_m", F.min("_k").over(Window.partitionBy(*by))).filter("_k = _m").drop("_k", "_m")


def reference_count(by_id: Column, by_name: Column, local: Column) -> Column:
    """What is counted by id, or else the greater of name and local counts (Q6)."""
    return F.coalesce(F.nullif(by_id, F.lit(0)), F.greatest(by_name, local))


def within_budget(rows: DataFrame, by: list[str], order: list[Column], size: str, budget: int, least_rest: int = 160) -> DataFrame:
    """Rows in order as long as they fit the budget; the first that doesn't is cut if enough room is left, and ends the list (Q7)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = rows.withColumn("upto", F.sum(size).over(w)).withColumn("before", F.col("upto") - F.col(size))
    rest = F.lit(budget) - F.col("before")
    shown = F.when(F.col("upto") <= budget, F.col(size)).when((F.col("before") <= budget) & (rest >= least_rest), rest)
    return c.withColumn("shown", shown).filter("shown is not null").drop("upto", "before")


def token_budgets(total: Column, with_tests: bool) -> dict[str, Column]:
    """Shares of symbol, types, callees and tests (Q20)."""
    shares = (0.4, 0.25, 0.25, 0.1) if with_tests else (0.45, 0.28, 0.27, 0.0)
    return {n: F.floor(total * s + 1e-9).cast("long") for n, s in zip(("symbol", "types", "callees", "tests"), shares, strict=True)}


def type_names(text: Column, built_in: list[str]) -> Column:
    """Distinct capitalised names that aren't built in (Q12)."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[A-Z][A-Za-z0-9_]*$"))
    return F.sort_array(F.array_except(F.array_distinct(words), F.array(*[F.lit(x) for x in built_in])))


def enclosing(lines: DataFrame, by: list[str], at: str, is_head: Column, head: Column) -> DataFrame:
    """Each line with the nearest line before it that opens a block."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("head_at", F.last(F.when(is_head, F.col(at)), ignorenulls=True).over(w)).withColumn("head", F.last(F.when(is_head, head), ignorenulls=True).over(w))


def block_of(text: str, start: int, most: int = 20) -> str:
    """Lines from `start` (from 0) until its brackets are closed, at most `most` (Q18)."""
    out, depth, opened = [], 0, False
    for line in text.split("\n")[start : start + most]:
        out.append(line)
        depth += sum(line.count(c) for c in "({[") - sum(line.count(c) for c in ")}]")
        opened = opened or any(c in line for c in "({[")
        if opened and depth <= 0:
            break
    return "\n".join(out)


#: Packages that names of callees tell of, tried in this order.
CALLEE_PACKAGES = {
    "react": ["^use[A-Z]", r"^React\.", "^useState$", "^useEffect$", "^useCallback$", "^useMemo$", "^useRef$", "^useContext$", "^useReducer$"],
    "lodash": [r"^_\.", r"^lodash\.", "^debounce$", "^throttle$", "^cloneDeep$", "^merge$", "^pick$", "^omit$"],
    "node": [r"^console\.", r"^process\.", "^require$", "^import$", r"^Buffer\.", "^__dirname$", "^__filename$"],
    "node:fs": ["^readFile", "^writeFile", "^stat", "^mkdir", "^readdir", "^unlink", "^rename$"],
    "node:path": ["^join$", "^resolve$", "^dirname$", "^basename$", "^extname$", "^relative$"],
    "async": [r"^Promise\.", "^async$", "^await$", "^setTimeout$", "^setInterval$"],
}


def callee_package(name: Column) -> Column:
    """The package that a callee's name tells of, or null for one of the project's own (Q19)."""
    out = F.lit(None).cast("string")
    for package, patterns in reversed(CALLEE_PACKAGES.items()):
        out = F.when(name.rlike("|".join(patterns)), package).otherwise(out)
    return out


def section(kind: Column, context: Column, parent: Column, test_calls: tuple[str, ...]) -> Column:
    """Where a symbol stands in the list of a file's functions (Q3)."""
    event = F.coalesce(context.rlike("^(on|once|addEventListener):"), F.lit(False))
    callback = F.when(context.isin(*test_calls), "test callback").when(event, "event callback").otherwise("other callback")
    own = F.when(kind == "callback", callback).when(parent.isNotNull(), "nested").otherwise("function")
    return F.when(kind.isin("class", "interface"), kind).when(kind == "type", "alias").when(kind.isin("function", "callback"), own).otherwise("member")


def resolve_types(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """The first symbol that is an interface, alias or class of exactly that name, or nulls (Q13). names: type_name."""
    own = symbols.filter(F.col("kind").isin("interface", "type", "class")).select(F.col("name").alias("type_name"), "kind", "file_path", "line_start")
    first = F.struct("file_path", "line_start", "kind")
    found = own.join(names, "type_name", "left_semi").groupBy("type_name").agg(F.min(first).alias("x"))
    return names.join(found, "type_name", "left").select("type_name", "x.kind", "x.file_path", "x.line_start")


def framework(text: Column) -> Column:
    """Which test framework a file is written for (Q15)."""
    return F.when(text.rlike("from ['\"]vitest"), "vitest").when(text.rlike("from ['\"]@jest|jest\\."), "jest").when(text.rlike("import pytest|def test_"), "pytest").when(text.rlike("import unittest"), "unittest").when(text.rlike(r"\bdescribe\(|\bit\("), "mocha").otherwise("unknown")
