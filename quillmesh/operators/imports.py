"""Import resolution and module entry points."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File endings tried in this order, and modules that come with the runtime.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
BUILT_IN = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os",
    "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def is_builtin(source: Column) -> Column:
    return source.startswith("node:") | F.substring_index(source, "/", 1).isin(*BUILT_IN)


def is_relative(source: Column) -> Column:
    return source.startswith("./") | source.startswith("../") | source.isin(".", "..")


def package_name(source: Column) -> Column:
    """The package of a specifier; two parts if it is scoped."""
    return F.when(source.startswith("@"), F.substring_index(source, "/", 2)).otherwise(F.substring_index(source, "/", 1))


def is_type_definition(source: Column) -> Column:
    """Whether a specifier names a package of type definitions."""
    return source.startswith("@types/")


def classify(source: Column) -> Column:
    """builtin, internal or external."""
    return F.when(is_builtin(source), "builtin").when(is_relative(source) | source.startswith("/"), "internal").otherwise("external")


def normal_path(directory: Column, source: Column) -> Column:
    """directory joined with a relative source, without dots."""
    parts = F.filter(F.split(F.concat_ws("/", directory, source), "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(up, "/")


def candidates(path: Column, stripped: bool = True) -> Column:
    """Ranked paths to try: with each ending, then as a folder's index; last, with a written ending replaced."""
    tries = [F.concat(path, F.lit(e)) for e in EXTENSIONS] + [F.concat(path, F.lit("/index"), F.lit(e)) for e in EXTENSIONS]
    if stripped:
        tries += [F.concat(F.regexp_replace(path, r"\.[cm]?jsx?$", ""), F.lit(e)) for e in EXTENSIONS]
    return F.posexplode(F.array(*tries)).alias("rank", "candidate")


def resolve(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = (), stripped: bool = True) -> DataFrame:
    """imports (file, source) with resolved_path, the first candidate that exists (I2, I3, J13). aliases: (prefix*, target*)."""
    directory = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    path = F.when(is_relative(F.col("source")), normal_path(directory, F.col("source")))
    for pattern, target in reversed(list(aliases)):
        head, to = pattern.rstrip("*"), target.rstrip("*")
        path = F.when(F.col("source").startswith(head), F.concat(F.lit(to), F.substring("source", len(head) + 1, 1 << 20))).otherwise(path)
    keyed = imports.select("file", "source").distinct().withColumn("path", path)
    tried = keyed.filter("path is not null").select("file", "source", candidates(F.col("path"), stripped))
    found = tried.join(files.select(F.col("file_path").alias("candidate")), "candidate").groupBy("file", "source").agg(F.min_by("candidate", "rank").alias("resolved_path"))
    return imports.join(found, ["file", "source"], "left").withColumn("kind", classify(F.col("source")))


def relaxed(content: str) -> str:
    """JSON without the comments and the commas at ends that compiler configurations may have."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", content, flags=re.S)
    return re.sub(r",(\s*[}\]])", r"\1", text)


def load_tsconfig(content: str) -> tuple[list[tuple[str, list[str]]], str | None]:
    """Path aliases, in order, and the base URL of a compiler configuration; comments and commas at ends do no harm."""
    options = json.loads(relaxed(content)).get("compilerOptions", {})
    return [(k, list(v)) for k, v in options.get("paths", {}).items()], options.get("baseUrl")


def resolve_aliases(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, list[str]]], base_url: str | None = None) -> DataFrame:
    """imports (file, source) with resolved_path: the first file that exists among the targets of each alias in turn, then below the base URL.

    A pattern's star stands for any text, which takes the place of the target's star.
    """
    base = (base_url or "").strip("./")
    under = lambda path: normal_path(F.lit(base), path)
    paths = []
    for pattern, targets in aliases:
        regex = "^" + re.escape(pattern).replace(r"\*", "(.*)", 1) + "$"
        star = F.regexp_extract("source", regex, 1) if "*" in pattern else F.lit("")
        paths += [F.when(F.col("source").rlike(regex), under(F.replace(F.lit(t), F.lit("*"), star))) for t in targets]
    if base_url is not None:
        paths.append(F.when(~is_relative(F.col("source")), under(F.col("source"))))
    tries = [F.concat(p, F.lit(x)) for p in paths for e in (".ts", ".tsx", ".js", ".jsx", "") for x in (e, f"/index{e}")]
    if not tries:
        return imports.withColumn("resolved_path", F.lit(None).cast("string"))
    keyed = imports.select("file", "source").distinct().select("file", "source", F.posexplode(F.array(*tries)).alias("rank", "candidate")).filter("candidate is not null")
    found = keyed.join(files.select(F.col("file_path").alias("candidate")), "candidate", "left_semi").groupBy("file", "source").agg(F.min_by("candidate", "rank").alias("resolved_path"))
    return imports.join(found, ["file", "source"], "left")


def hydrate(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (file, source, resolved_path) whose internal ones without a path get the file that their source means, if there is one (Q32)."""
    found = resolve(imports.filter(F.col("resolved_path").isNull() & is_relative(F.col("source"))).select("file", "source").distinct(), files).select("file", "source", F.col("resolved_path").alias("_found"))
    return imports.join(found, ["file", "source"], "left").withColumn("resolved_path", F.coalesce("resolved_path", "_found")).drop("_found")


#: Entry files that are tried where a package names none.
ENTRY_FILES = ("src/index.ts", "src/index.js", "index.ts", "index.js", "lib/index.ts", "lib/index.js", "src/main.ts", "src/main.js")


def package_entries(entries: DataFrame) -> DataFrame:
    """path, reason, rank from a package's configuration entries (path, value, value_type): exports, else module, else main; and bin (Q29)."""
    text = entries.filter("value_type = 'string'")
    head = F.regexp_extract("path", r"^(exports|module|main|bin)(\.|\[|$)", 1)
    named = text.withColumn("head", head).filter("head <> ''")
    library = named.filter("head <> 'bin'").withColumn("rank", F.when(F.col("head") == "exports", 1).when(F.col("head") == "module", 2).otherwise(3))
    best = library.agg(F.min("rank").alias("rank"))  # one row
    chosen = library.join(F.broadcast(best), "rank").select(F.col("value").alias("path"), F.concat(F.lit("package.json "), "head").alias("reason"), F.lit("library").alias("type"), F.lit(1).alias("rank"))
    return chosen.unionByName(named.filter("head = 'bin'").select(F.col("value").alias("path"), F.lit("package.json bin").alias("reason"), F.lit("bin").alias("type"), F.lit(2).alias("rank")))


def entry_points(files: DataFrame, entries: DataFrame | None = None, requested: str | None = None) -> DataFrame:
    """file_path, type, reason of a project's entry files; of several reasons the first counts (Q29). files: file_path, relative to the root."""
    path = F.col("file_path")
    own_type = F.when(path.rlike(r"(^|/)(cli|bin)/"), "cli").when(path.rlike(r"main\.(ts|js)$"), "main").otherwise("library")
    if requested is not None:
        name = re.sub(r"^\./", "", requested.replace("\\", "/"))
        hit = (path == name) | path.endswith(f"/{name}")
        hit = hit if "/" in name else hit | (F.substring_index(path, "/", -1) == name)
        return files.filter(hit).select("file_path", own_type.alias("type"), F.lit("user-specified").alias("reason"))
    rows = files.filter(path.rlike(r"^src/(cli|bin)/(index|main)\.(ts|js)$")).select("file_path", F.lit("cli").alias("type"), F.lit("cli convention").alias("reason"), F.lit(3).alias("rank"))
    rows = rows.unionByName(files.filter(path.isin(*ENTRY_FILES)).select("file_path", own_type.alias("type"), F.lit("default patterns").alias("reason"), F.lit(4).alias("rank")))
    if entries is not None:
        named = package_entries(entries)
        clean = F.regexp_replace("path", r"^\./", "")
        tried = named.select("reason", "type", "rank", F.explode(F.array_distinct(F.array(clean, entry_source(F.col("path"))))).alias("file_path"))
        rows = rows.unionByName(tried.join(files.select("file_path"), "file_path").select("file_path", "type", "reason", "rank"))
    best = rows.groupBy("file_path").agg(F.min(F.struct("rank", "reason", "type")).alias("x"))
    return best.select("file_path", "x.type", "x.reason")


def entry_source(path: Column) -> Column:
    """Where a built file comes from: dist and build to src, js to ts (Q30)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "^(dist|build|lib)/", "src/"), r"\.[cm]?js$", ".ts")


def excluded(path: Column) -> Column:
    """Tests, examples, built and coverage files (Q23)."""
    return path.rlike(r"(^|/)(tests?|__tests__|examples?|dist|build|coverage|node_modules)/") | path.rlike(r"\.(test|spec)\.[a-z]+$")
