"""Factors of chains as an index keeps them: rows that files own, so that an update replaces the rows of few files.

What depends on all files is left to the reader: how many files there are damps symbols that many of them hold, so rows carry counts and in
how many files their symbol stands (df), and the damping is applied as they are read. What the transitions of a state add up to is not
stored, but follows from sums over its keys, which one file owns each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import factored, markov

ROWS = ("chain", "owner", "key", "state", "u", "v", "df")


def frequencies(symbols: DataFrame) -> DataFrame:
    """symbol, df: in how many files a symbol stands."""
    return symbols.groupBy("symbol").agg(F.countDistinct("file").alias("df"))


def rows(calls: DataFrame, symbols: DataFrame, found: DataFrame, imports: DataFrame) -> DataFrame:
    """ROWS of the three chains that have keys. calls: owner and what call_flow_factors takes; a caller belongs to one owner. found: frequencies of at least these symbols."""
    none = F.lit(None).cast("long").alias("df")
    flow = factored.call_flow_factors(calls, keep=("owner",)).select(F.lit("call_flow").alias("chain"), "owner", "key", "state", "u", "v", none)
    own = factored.cooccurrence_keys(symbols.join(found, "symbol"), "df", F.col("file").alias("owner"))
    near = own.groupBy("owner", "key", "state").agg(F.count("*").cast("double").alias("u"), F.max("df").alias("df"))
    clusters = factored.import_cluster_factors(imports)
    return (
        flow.unionByName(near.select(F.lit("cooccurrence").alias("chain"), "owner", "key", "state", "u", F.col("u").alias("v"), "df"))
        .unionByName(clusters.select(F.lit("import_cluster").alias("chain"), F.col("state").alias("owner"), "key", "state", "u", "v", none))
    )


def _damping(files: int):
    return F.when(F.col("df").isNull(), F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.log(F.lit(float(files)) / F.col("df")), F.lit(0.0))))


def weighed(stored: DataFrame, files: int) -> DataFrame:
    """Stored rows with u (where there is one) and v as walks take them. files: how many hold symbols."""
    return stored.withColumns({c: F.col(c) * _damping(files) for c in ("u", "v") if c in stored.columns}).drop("df", "owner")


def sums(stored: DataFrame) -> DataFrame:
    """chain, owner, key, df, n, whole: members of each key by the files their symbols stand in; import clusters don't need them."""
    return stored.filter("chain <> 'import_cluster'").groupBy("chain", "owner", "key", "df").agg(F.count("*").alias("n"), F.sum("v").alias("whole"))


def totals(states: DataFrame, stored: DataFrame, files: int) -> DataFrame:
    """What factored.totals gives, from weighed states and stored sums of one chain. A filter of states reaches their scan."""
    whole = stored.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("whole") * _damping(files)).alias("whole")).filter("n > 1")
    weight = F.col("u") * F.greatest(F.col("whole") - F.col("v"), F.lit(0.0))
    return states.join(whole, "key").groupBy("state").agg(F.count("*").alias("keys"), F.sum(weight).alias("total")).filter("total > 0")


def links(types: DataFrame) -> DataFrame:
    """owner, from_id, to_id, raw: related types, as each file tells of them. types: owner and what type_affinity_weights takes."""
    return markov.type_affinity_weights(types, by=("owner",))


def linked(stored: DataFrame) -> DataFrame:
    """Transitions along links of all files. A filter of from_id reaches the scan."""
    return markov.normalise(stored.groupBy("from_id", "to_id").agg(F.sum("raw").alias("raw")))


def stale_owners(touched: DataFrame, names: DataFrame, states: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """file_path of files whose rows have to be made anew after those of the touched files have changed.

    Beside these: files that call a name whose least symbol is now another, and files with a symbol that stands in more or fewer files than
    it did. names: owner, name, id as stored; states: the stored rows of cooccurrence; symbols: owner, name, id; calls: file_path,
    callee_name; both as they are now. touched: file_path.
    """
    owners = touched.select(F.col("file_path").alias("owner"))
    near = names.select("owner", "name", "id").join(owners, "owner", "left_semi").unionByName(symbols.join(owners, "owner", "left_semi"))
    asked, ids = near.select("name").distinct(), near.select("id").distinct()
    least = lambda df, c: df.join(asked, "name", "left_semi").groupBy("name").agg(F.min("id").alias(c))
    moved = least(names, "was").join(least(symbols, "now"), "name", "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    callers = calls.join(moved.select(F.col("name").alias("callee_name")), "callee_name", "left_semi").select("file_path")
    was = states.select(F.col("state").alias("id"), "df").join(ids, "id", "left_semi").groupBy("id").agg(F.max("df").alias("df"))
    now = symbols.join(ids, "id", "left_semi").groupBy("id").agg(F.countDistinct("owner").alias("n"))
    spread = was.join(now, "id").filter("df <> n")
    holders = symbols.join(spread.select("id"), "id", "left_semi").select(F.col("owner").alias("file_path"))
    return touched.select("file_path").union(callers).union(holders).distinct()
