"""Point lookups, listings, and resolution of names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def like_prefix(c: str, prefix: str, escape: bool = False) -> Column:
    """SQL LIKE with the prefix, without regard to case; % and _ in it are wildcards unless escaped (L2)."""
    if escape:
        prefix = prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(c).ilike(f"{prefix}%")


def list_files(files: DataFrame, directory: str | None = None, language: str | None = None, escape: bool = False) -> DataFrame:
    out = files if directory is None else files.filter(like_prefix("file_path", directory, escape))
    return out if language is None else out.filter(F.col("language") == language)


def function_cascade(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """query -> the symbol of that very name, else the only one of that last name part, else the only one that ends with it.

    status tells how it was found: exact, local, suffix, ambiguous or missing.
    """
    own = symbols.select("symbol_id", "name", F.substring_index("name", " ", -1).alias("local"))
    rank = lambda how, n, joined: joined.withColumn("how", F.lit(how)).withColumn("rank", F.lit(n))
    hits = rank("exact", 1, wanted.join(own, wanted["query"] == own["name"])).unionByName(rank("local", 2, wanted.join(own, wanted["query"] == own["local"])))
    counted = hits.groupBy("query", "rank", "how").agg(F.countDistinct("name").alias("names"), F.min("symbol_id").alias("symbol_id"), F.min("name").alias("name"))
    ok = counted.filter("rank = 1 or names = 1").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter("r = 1").select("query", "symbol_id", F.col("how").alias("status"))
    unclear = counted.filter("rank = 2 and names > 1").select("query", F.lit(True).alias("unclear"))
    return wanted.join(ok, "query", "left").join(unclear, "query", "left").select("query", "symbol_id", F.coalesce("status", F.when(F.col("unclear"), "ambiguous").otherwise("missing")).alias("status"))


def resolve_names(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """edges with symbol_id, the least id among the symbols of that name, or null (M7). The reference picks any."""
    chosen = symbols.groupBy(F.col("name").alias(name)).agg(F.min("symbol_id").alias("symbol_id"), F.count("*").alias("candidates"))
    return edges.join(chosen, name, "left")


def existing_references(refs: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """References whose name some symbol has."""
    return refs.join(symbols.select(F.col("name").alias(name)), name, "left_semi")


def implementations(relations: DataFrame, target: str) -> DataFrame:
    """Sources that implement or extend the target (L11, T6), each edge once."""
    return relations.filter((F.col("target") == target) & F.col("kind").isin("implements", "extends")).dropDuplicates(["source", "kind", "target"])


def reverse_dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """For each import that resolves to a file: who imports it."""
    return imports.join(files.select(F.col("path").alias("source"), F.col("file").alias("resolved")), "source").select("resolved", F.col("file").alias("importer")).distinct()


def config_value(entries: DataFrame, path: str, file: str | None = None, strict: bool = True) -> DataFrame:
    """Entries at the path, or else below it (L14). strict: the file filter holds for both."""
    of_file = F.lit(True) if file is None else F.col("file_path") == file
    exact, below = F.col("path") == path, F.col("path").startswith(f"{path}.")
    kept = entries.filter(((exact | below) & of_file) if strict else (exact & of_file) | below)
    return kept.withColumn("n", F.sum(exact.cast("int")).over(Window.partitionBy("file_path"))).filter((F.col("n") == 0) | exact).drop("n")


def config_children(entries: DataFrame, parent: str | None, file: str | None = None) -> DataFrame:
    """Entries right below a path, or the top ones for no path, in order of file and path."""
    of_file = F.lit(True) if file is None else F.col("file_path") == file
    at = F.col("parent_path").isNull() if parent is None else F.col("parent_path") == parent
    return entries.filter(at & of_file).orderBy("file_path", "path")


def overlap(a: Column, b: Column) -> Column:
    """Characters in common over those of the richer one."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def path_score(query: Column, path: Column) -> Column:
    """How well a path answers a query: base name, directory and character overlap."""
    base, directory = F.lower(F.substring_index(path, "/", -1)), F.lower(F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    q, q_base, q_dir = F.lower(query), F.lower(F.substring_index(query, "/", -1)), F.lower(F.regexp_extract(query, "^(.*)/[^/]*$", 1))
    name = F.when(base == q_base, 100).when(F.contains(base, q_base), 50).when(F.contains(q_base, base), 30).otherwise(0)
    place = F.when((q_dir != "") & F.contains(directory, q_dir), 25).otherwise(0) + F.when(F.contains(F.lower(path), q), 20).otherwise(0)
    return name + place + 15.0 * overlap(base, q_base) + F.when((q_dir != "") & (directory != ""), 10.0 * overlap(directory, q_dir)).otherwise(0.0)


def _parts(text: Column, lengths: list[int]) -> Column:
    """All distinct parts of a text that have one of the lengths."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(empty, *[F.when(F.length(text) >= n, of(n)).otherwise(empty) for n in lengths])))


def path_candidates(queries: DataFrame, files: DataFrame) -> DataFrame:
    """query, file_path: every file that path_score can give more than 60, found by equal parts of names, never by holding each request against each file.

    More than 60 takes one of four: equal base names, a base name within the other, in either way, or the request within the path. A request
    that ends with a slash has an empty base name, which lies within all; it takes a folder that holds the request's to pass 60.
    """
    base = lambda c: F.lower(F.substring_index(c, "/", -1))
    folder = lambda c: F.lower(F.regexp_extract(c, "^(.*)/[^/]*$", 1))
    asked = queries.select("query", base("query").alias("q_base"), F.lower("query").alias("q"), F.when(base("query") == "", folder("query")).otherwise("").alias("q_dir"))
    sizes = asked.agg(*[F.sort_array(F.collect_set(F.length(c))).alias(c) for c in ("q_base", "q", "q_dir")]).first()  # one row: lengths of names
    own = files.select("file_path", base("file_path").alias("base"), F.lower("file_path").alias("path"), folder("file_path").alias("folder"))
    at = lambda column, part: asked.select("query", F.col(column).alias("part")).filter("part <> ''").join(part, "part").select("query", "file_path")
    parted = lambda column, of: own.select("file_path", F.explode(_parts(F.col(of), [n for n in sizes[column] if n])).alias("part"))
    above, within, inside = (at(column, parted(column, of)) for column, of in (("q_base", "base"), ("q", "path"), ("q_dir", "folder")))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.length("q_base")), lambda n: F.transform(F.sequence(F.lit(1), F.length("q_base") - n + 1), lambda i: F.substring(F.col("q_base"), i, n))))
    below = asked.filter("q_base <> ''").select("query", F.explode(F.array_distinct(every)).alias("base")).join(own, "base").select("query", "file_path")
    return above.unionByName(within).unionByName(inside).unionByName(below).distinct()


def resolve_paths(queries: DataFrame, files: DataFrame, least: float = 80, lead: float = 20) -> DataFrame:
    """query -> status and path: exact, a single suffix, ambiguous, a clear fuzzy winner, or not found."""
    found = _suffixes(queries, files).groupBy("query").agg(F.count("*").alias("n"), F.min("file_path").alias("path"), F.max((F.col("file_path") == F.col("query")).cast("int")).alias("exact"))
    # only requests that no file ends with are sought further; what isn't a candidate is 30 below any winner
    rest = queries.join(found, "query", "left_anti")
    scored = path_candidates(rest, files).withColumn("score", path_score(F.col("query"), F.col("file_path")))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "file_path")
    best = scored.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("query").agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("s2"), F.min(F.when(F.col("r") == 1, F.col("file_path"))).alias("fuzzy"))
    clear = (F.col("s1") >= least) & (F.col("s1") - F.coalesce("s2", F.lit(0.0)) >= lead)
    status = F.when(F.col("exact") == 1, "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").when(clear, "fuzzy").otherwise("not_found")
    joined = queries.join(found, "query", "left").join(best, "query", "left").withColumn("status", status)
    return joined.select("query", "status", F.when(F.col("status") == "exact", F.col("query")).when(F.col("status") == "suffix", F.col("path")).when(F.col("status") == "fuzzy", F.col("fuzzy")).alias("path"))


def _suffixes(queries: DataFrame, files: DataFrame) -> DataFrame:
    """query, file_path of files that end with the request; these have its last part, so it is an equi join."""
    last = lambda c: F.substring_index(c, "/", -1)
    own, wanted = files.select("file_path", last("file_path").alias("base")), queries.select("query", last("query").alias("base"))
    return own.join(wanted, "base").filter(F.col("file_path").endswith(F.concat(F.lit("/"), F.col("query"))) | (F.col("file_path") == F.col("query"))).select("query", "file_path")


def path_suggestions(queries: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """query, rank, file_path: the first files that an ambiguous request may mean."""
    w = Window.partitionBy("query").orderBy("file_path")
    ends = _suffixes(queries, files)
    several = ends.groupBy("query").agg(F.count("*").alias("n"), F.max((F.col("file_path") == F.col("query")).cast("int")).alias("exact")).filter("n > 1 and exact = 0").select("query")
    return ends.join(several, "query", "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query", "rank", "file_path")


def nearest_directory(files: DataFrame, part: str, most_files: int = 15) -> DataFrame:
    """The directory with most files whose path holds the part, and its first files."""
    hits = files.filter(F.contains(F.lower("directory"), F.lit(part.lower())))
    top = hits.groupBy("directory").count().orderBy(F.desc("count"), "directory").limit(1).select("directory")
    return hits.join(F.broadcast(top), "directory").select("directory", "file_path").orderBy("file_path").limit(most_files)


FUNCTION_KINDS = ("function", "method", "constructor", "callback")


def function_details(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, status, name, suggestions: the function of that very name; else the only one of that local name; else the only one that ends with a dotted name.

    Where a rung has several, the status is ambiguous and all their names are suggested, in order. symbols: name, local_name, kind.
    """
    own = symbols.filter(F.col("kind").isin(*FUNCTION_KINDS)).select("name", "local_name")
    # the last part of a dotted query is the local name of whatever ends with it, so every rung is an equi join
    keyed = wanted.withColumn("last", F.substring_index("query", ".", -1))
    exact = keyed.join(own, F.col("query") == F.col("name")).select("query", F.lit(1).alias("rung"), "name")
    local = keyed.join(own, F.col("query") == F.col("local_name")).select("query", F.lit(2).alias("rung"), "name")
    suffix = keyed.filter(F.contains("query", F.lit("."))).join(own, F.col("last") == F.col("local_name")).filter(F.endswith("name", F.concat(F.lit("."), "query"))).select("query", F.lit(3).alias("rung"), "name")
    rungs = exact.unionByName(local).unionByName(suffix).groupBy("query", "rung").agg(F.sort_array(F.collect_list("name")).alias("names"))
    best = rungs.groupBy("query").agg(F.min_by("names", "rung").alias("names"), F.min("rung").alias("rung"))
    n = F.size("names")
    status = F.when(F.col("rung").isNull(), "missing").when((F.col("rung") > 1) & (n > 1), "ambiguous").otherwise(F.element_at(F.array(*map(F.lit, ("exact", "local", "suffix"))), F.col("rung")))
    out = wanted.join(best, "query", "left").withColumn("status", status)
    unclear = F.col("status") == "ambiguous"
    return out.select("query", "status", F.when(~unclear, F.element_at("names", 1)).alias("name"), F.when(unclear, F.col("names")).otherwise(F.array().cast("array<string>")).alias("suggestions"))


def of_kind(symbols: DataFrame, kinds: tuple[str, ...], wanted: DataFrame) -> DataFrame:
    """query with the symbol of that name whose kind comes first in kinds."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    own = symbols.filter(F.col("kind").isin(*kinds)).select(F.col("name").alias("query"), F.struct(rank.alias("rank"), "file_path", "line_start", "kind").alias("x"))
    found = own.join(wanted, "query", "left_semi").groupBy("query").agg(F.min("x").alias("x"))
    return wanted.join(found, "query", "left").select("query", "x.kind", "x.file_path", "x.line_start")


def display_file(rows: DataFrame, symbols: DataFrame, symbol_id: str = "symbol_id", name: str = "name") -> DataFrame:
    """rows with file: of the symbol of that id, else of the first symbol of that name, else null."""
    by_id = symbols.groupBy(F.col("id").alias(symbol_id)).agg(F.min("file_path").alias("_a"))
    by_name = symbols.groupBy(F.col("name").alias(name)).agg(F.min("file_path").alias("_b"))
    return rows.join(by_id, symbol_id, "left").join(by_name, name, "left").withColumn("file", F.coalesce("_a", "_b")).drop("_a", "_b")


def collated(c: Column) -> Column:
    """For ordering as people expect it, letters before their capitals; elsewhere strings are ordered by their bytes (F16)."""
    return F.collate(c, "UNICODE")
