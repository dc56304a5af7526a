"""Markov chains over code relations, their statistics, and bounded best-path walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import lineage

CALL_WEIGHT, COOCCURRENCE_WEIGHT, TYPE_WEIGHT, IMPORT_WEIGHT = 0.4, 0.25, 0.2, 0.15
CHAIN_WEIGHTS = {"call_flow": CALL_WEIGHT, "cooccurrence": COOCCURRENCE_WEIGHT, "type_affinity": TYPE_WEIGHT, "import_cluster": IMPORT_WEIGHT}
DECAY, LEAST, DEPTH, FAN_OUT = 0.7, 0.05, 2, 50
BLOCK = 4096
WIDE = 65_536
HASHES = 1 << 17
SMALL = 500_000
LIST = 256


def _partitions(df: DataFrame) -> int:
    """How many partitions a shuffle has before adaptive reads put small ones together, which go by the bytes that come in and not by the rows that a task makes of them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def normalise(weights: DataFrame, whole: bool = False) -> DataFrame:
    """from_id, to_id, raw -> the same with prob; states without weight are dropped (A7). whole: all states are asked for, so that every partition of the shuffle is a task and sorts its own rows only."""
    weights = weights.repartition(_partitions(weights), "from_id") if whole else weights
    total = F.sum("raw").over(Window.partitionBy("from_id"))
    return weights.withColumn("total", total).filter("total > 0").select("from_id", "to_id", "raw", (F.col("raw") / F.col("total")).alias("prob"))


def hot_keys(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame | None:
    """key, _size of keys with over `block` rows, or None if there is none. Rows are counted by hashes of keys, and then only the keys of heavy hashes, so that keys aren't shuffled where none is hot."""
    at = F.pmod(F.xxhash64(key), F.lit(HASHES)).cast("int")
    heavy = rows.groupBy(at.alias("_hash")).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > block).select("_hash")
    if not heavy.limit(1).count():
        return None
    within = rows.withColumn("_hash", at).join(F.broadcast(heavy), "_hash", "left_semi")  # at most HASHES numbers
    hot = within.groupBy(key).agg(F.count("*").alias("_size")).filter(F.col("_size") > block)
    return hot if hot.limit(1).count() else None


def _dealt(rows: DataFrame, key: str, item: str, hot: DataFrame, block: int) -> DataFrame:
    """Rows with the number of blocks of their key and their own block."""
    return rows.join(hot, key, "left").withColumn("_n", F.coalesce(F.ceil(F.col("_size") / block), F.lit(1)).cast("int")).withColumn("_block", F.pmod(F.xxhash64(item), "_n").cast("int"))


def paired(rows: DataFrame, key: str, item: str, hot: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """Every two rows of one key: their other columns as a_ and b_. Hot keys are dealt in blocks, and every two blocks meet apart, so no task holds a hot key."""
    others = [c for c in rows.columns if c != key]
    side = lambda df, x, *more: df.select(key, *more, *[F.col(c).alias(f"{x}_{c}") for c in others])
    if hot is None:
        return side(rows, "a").join(side(rows, "b"), key).drop(key)
    dealt = _dealt(rows, key, item, hot, block)
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a, b = side(dealt, "a", F.col("_block").alias("_i"), every.alias("_j")), side(dealt, "b", F.col("_block").alias("_j"), every.alias("_i"))
    return a.join(b, [key, "_i", "_j"]).drop(key, "_i", "_j")


def call_flow_weights(calls: DataFrame, geometric: bool = True, fan_out_norm: bool = True, least_calls: int = 1) -> DataFrame:
    """Parts called together: damped counts, less for wide callers, more for asynchronous and less for conditional targets."""
    edges = calls.filter(F.col("call_count") >= least_calls).select("caller", "callee", "call_count", "is_async", "is_conditional")
    hot = hot_keys(edges, "caller")
    if hot is None:  # then a window of a caller is small, and the join that follows needs no further shuffle
        # a fixed number of partitions, as edges are much fewer than the pairs that a task makes and adds up of them
        rated = edges.repartition(_partitions(edges), "caller").withColumn("fan", F.count("*").over(Window.partitionBy("caller")))
    else:
        rated = edges.join(edges.groupBy("caller").agg(F.count("*").alias("fan")), "caller")
    both = paired(rated.filter("fan >= 2"), "caller", "callee", hot).filter("a_callee <> b_callee")
    damp = lambda c: F.log(F.col(c) + F.lit(1.0))
    w = F.sqrt(damp("a_call_count") * damp("b_call_count")) if geometric else F.least("a_call_count", "b_call_count").cast("double")
    w = w / F.sqrt((F.col("a_fan") - 1).cast("double")) if fan_out_norm else w
    w = w * F.when(F.col("b_is_async"), 1.1).otherwise(1.0) * F.when(F.col("b_is_conditional"), 0.8).otherwise(1.0)
    return both.groupBy(F.col("a_callee").alias("from_id"), F.col("b_callee").alias("to_id")).agg(F.sum(w).alias("raw"))


def inverse_document_frequency(occurrences: DataFrame) -> DataFrame:
    """symbol, df, idf = ln(files / df)."""
    n = occurrences.agg(F.countDistinct("file").alias("n"))
    df = occurrences.groupBy("symbol").agg(F.countDistinct("file").alias("df"))
    return df.join(F.broadcast(n)).select("symbol", "df", F.log(F.col("n") / F.col("df")).alias("idf"))  # n: one row


def cooccurrence_weights(occurrences: DataFrame) -> DataFrame:
    """Symbols of one file: twice the weight within one class, damped for symbols of many files."""
    rated = occurrences.join(inverse_document_frequency(occurrences), "symbol").select("file", "symbol", "parent", "idf")
    scope = F.when(F.col("a_parent") == F.col("b_parent"), 2.0).otherwise(1.0)
    # both directions at once, so that a filter on one state reaches the scan
    both = paired(rated, "file", "symbol", hot_keys(occurrences, "file")).filter("a_symbol <> b_symbol").groupBy(F.col("a_symbol").alias("from_id"), F.col("b_symbol").alias("to_id"))
    return both.agg(F.sum(scope * F.sqrt(F.col("a_idf") * F.col("b_idf"))).alias("raw"))


def type_affinity_weights(relations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Related types, weaker from target to source (C3); apart by further columns, if asked."""
    w = F.when(F.col("kind") == "extends", 1.0).when(F.col("kind") == "implements", 0.9).when(F.col("kind") == "mixin", 0.7).otherwise(0.5)
    both = relations.select(*by, F.explode(F.array(F.struct(F.col("source").alias("from_id"), F.col("target").alias("to_id"), w.alias("raw")), F.struct(F.col("target").alias("from_id"), F.col("source").alias("to_id"), (w * 0.8).alias("raw")))).alias("e")).select(*by, "e.*")
    return both.groupBy(*by, "from_id", "to_id").agg(F.sum("raw").alias("raw"))


def shared_degrees(rows: DataFrame, key: str, item: str, block: int = BLOCK) -> DataFrame:
    """state, d, df, owned: how many other items share a key with each item, in how many keys it stands, and of how many it is the least item (so these add up to the keys). Rows may repeat.

    No pair is shuffled: the items of a key travel as one list to each of them (as lists of blocks, where the key is hot), and pairs are made and counted where they arrive.
    """
    rows = rows.select(key, item).filter(F.col(key).isNotNull() & F.col(item).isNotNull())
    hot = hot_keys(rows, key, block)
    if hot is None:
        lists = rows.repartition(key).groupBy(key).agg(F.collect_set(item).alias("near"))
        sent = lists.select(F.explode("near").alias("state"), "near", F.array_min("near").alias("least"))
    else:
        dealt = _dealt(rows.distinct(), key, item, hot, block)
        every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
        lists = dealt.groupBy(key, "_n", F.col("_block").alias("_j")).agg(F.collect_list(item).alias("near"))
        least = lists.groupBy(key).agg(F.min(F.array_min("near")).alias("least"))
        sent = dealt.select(key, F.col(item).alias("state"), F.col("_block").alias("_i"), every.alias("_j")).join(lists.select(key, "near", "_j", every.alias("_i")), [key, "_i", "_j"]).join(least, key).select("state", "near", "least")
    # a fixed number of partitions, as lists are much smaller than what is made of them; it serves both counts
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.select("state", "near", (F.col("least") == F.col("state")).cast("int").alias("own")).repartition(n, "state").select("state", "own", F.explode("near").alias("other"))
    both = met.groupBy("state", "other").agg(F.count("*").alias("n"), F.sum("own").alias("own"))
    itself = F.col("state") == F.col("other")
    return both.groupBy("state").agg(F.count_if(~itself).alias("d"), F.sum(F.when(itself, F.col("n"))).alias("df"), F.sum(F.when(itself, F.col("own"))).alias("owned"))


def call_flow_degrees(sites: DataFrame) -> DataFrame:
    """from_id, d of the chain of calls, from caller and callee of each call (C1): every pair has weight."""
    return shared_degrees(sites, "caller", "callee").filter("d > 0").select(F.col("state").alias("from_id"), "d")


def cooccurrence_degrees(sites: DataFrame) -> DataFrame:
    """from_id, d of the chain of common files, from file and symbol of each occurrence.

    Symbols of every file weigh nothing, and all others meet them all, so states that meet nothing else have no weight.
    """
    states = lineage.stored(shared_degrees(sites, "file", "symbol"))
    files = states.agg(F.sum("owned").alias("files"))
    everywhere = states.join(F.broadcast(files)).agg(F.first("files").alias("files"), F.count_if(F.col("df") == F.col("files")).alias("everywhere"))  # one row each
    return states.join(F.broadcast(everywhere)).filter("df < files and d > everywhere").select(F.col("state").alias("from_id"), "d")


def most_shared(rows: DataFrame, key: str, item: str, block: int = WIDE) -> DataFrame:
    """state, df, owned, most: in how many keys each item stands, of how many it is the least item (so these add up to the keys), and how many items the widest of its keys has. Rows may repeat.

    A key is dealt once, as two columns, and its items are counted by a window that spills; keys with over `block` rows are counted apart, so no task holds one.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(item).alias("state")).filter("key is not null and state is not null")
    hot = hot_keys(rows, "key", block)
    cold, keys = rows, Window.partitionBy("key")
    if hot is not None:
        hot = lineage.stored(hot.select("key"))
        cold = rows.join(hot, "key", "left_anti")
    met = cold.repartition("key").distinct().select("state", F.count("*").over(keys).alias("n"), F.min("state").over(keys).alias("least"))
    if hot is not None:
        once = rows.join(hot, "key", "left_semi").distinct()
        met = met.unionByName(once.join(once.groupBy("key").agg(F.count("*").alias("n"), F.min("state").alias("least")), "key").select("state", "n", "least"))
    return met.groupBy("state").agg(F.count("*").alias("df"), F.count_if(F.col("least") == F.col("state")).alias("owned"), F.max("n").alias("most"))


def call_flow_support(shared: DataFrame) -> DataFrame:
    """state: those from which the chain of calls leads anywhere, from what most_shared gives of callers."""
    return shared.filter("most > 1").select("state")


def cooccurrence_support(shared: DataFrame) -> DataFrame:
    """The same of the chain of common files, of files (C2, L13). Symbols of every file weigh nothing and stand in all files, so a state needs one more beside them and itself."""
    files = shared.agg(F.sum("owned").alias("files"))
    everywhere = shared.join(F.broadcast(files)).agg(F.first("files").alias("files"), F.count_if(F.col("df") == F.col("files")).alias("everywhere"))  # one row each
    return shared.join(F.broadcast(everywhere)).filter("df < files and most > everywhere + 1").select("state")


def _import_classes(imports: DataFrame, least_shared: int) -> tuple[DataFrame, DataFrame]:
    """file, class, size; and from_class, to_class, raw, size of the second class. Files of equal sources have equal neighbours, so common sources are counted between classes (named by their least file)."""
    own = imports.filter("file is not null and source is not null").groupBy("file").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    keyed = lineage.stored(own.withColumn("key", F.sha2(F.to_json("sources"), 256)))
    classes = keyed.groupBy("key").agg(F.min("file").alias("class"), F.count("*").alias("size"), F.first("sources").alias("sources"))
    members = keyed.select("file", "key").join(classes.select("key", "class", "size"), "key").select("file", "class", "size")
    spread = classes.select("class", F.explode("sources").alias("source"))
    shared = paired(spread, "source", "class", hot_keys(spread, "source")).groupBy(F.col("a_class").alias("from_class"), F.col("b_class").alias("to_class")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_shared)
    links = shared.join(classes.select(F.col("class").alias("to_class"), "size"), "to_class").select("from_class", "to_class", (F.col("n") * 0.5).alias("raw"), "size")
    return members, links


def import_cluster(imports: DataFrame, least_shared: int = 2, digits: int | None = None) -> DataFrame:
    """from_id, to_id, raw, prob: files that import the same sources, from least_shared on (C4); prob to so many digits, if asked.

    Totals are those of classes, so pairs of files are only given out, neither counted nor sorted nor shuffled: a file meets the files of a class as lists of about LIST.
    Rows come list by list, so a column file of them holds runs and short repeats.
    """
    members, links = _import_classes(imports, least_shared)
    links = lineage.stored(links)
    itself = F.col("from_class") == F.col("to_class")
    total = links.groupBy("from_class").agg(F.sum(F.col("raw") * (F.col("size") - itself.cast("int"))).alias("total")).filter("total > 0")
    prob = F.col("raw") / F.col("total")
    every = lambda size: F.ceil(F.col(size) / LIST).cast("int")
    rated = links.join(total, "from_class").select("from_class", "to_class", "raw", (prob if digits is None else F.round(prob, digits)).alias("prob"), every("size").alias("lists"))
    members = lineage.stored(members)
    few = lambda df: df.limit(SMALL + 1).count() <= SMALL
    # small inputs make many rows, so the number of partitions is given; with few links, files of one class are dealt too
    n, few_links = int(imports.sparkSession.conf.get("spark.sql.shuffle.partitions")), few(links)
    a = members.select(F.col("file").alias("from_id"), F.col("class").alias("from_class"))
    near = a.repartition(n, "from_id").join(F.broadcast(rated), "from_class") if few_links else a.repartition(n, "from_class").join(rated.repartition(n, "from_class"), "from_class")
    near = near.select("from_id", "to_class", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"), "raw", "prob")
    b = members.groupBy(F.col("class").alias("to_class"), F.pmod(F.xxhash64("file"), every("size")).cast("int").alias("list")).agg(F.collect_list("file").alias("files"))
    to = ["to_class", "list"]
    # a merge join takes list by list; many links are as many rows as pairs, or nearly, and aren't dealt once more where the lists can be sent
    met = near.repartition(n, *to).join(b.repartition(n, *to).hint("merge"), to) if few_links or not few(members) else near.join(F.broadcast(b), to)
    return met.select("from_id", F.explode("files").alias("to_id"), "raw", "prob").filter("from_id <> to_id")


def import_cluster_weights(imports: DataFrame, least_shared: int = 2) -> DataFrame:
    """The same without prob."""
    return import_cluster(imports, least_shared).select("from_id", "to_id", "raw")


def import_cluster_degrees(imports: DataFrame, least_shared: int = 2) -> DataFrame:
    """from_id, d of the chain of common imports, by classes."""
    members, links = _import_classes(imports, least_shared)
    degree = links.groupBy("from_class").agg(F.sum(F.col("size") - (F.col("from_class") == F.col("to_class")).cast("int")).alias("d")).filter("d > 0")
    return members.join(degree, members["class"] == degree["from_class"]).select(F.col("file").alias("from_id"), "d")


def build_chains(**weights: DataFrame) -> DataFrame:
    """All chains in one relation: chain, from_id, to_id, raw, prob."""
    out = None
    for chain, w in weights.items():
        one = normalise(w).select(F.lit(chain).alias("chain"), F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), "raw", "prob")
        out = one if out is None else out.unionByName(one)
    return out


def name_states(transitions: DataFrame, names: DataFrame) -> DataFrame:
    """Transitions with the names of both states; a state without one is named by its id. names: id, name."""
    a, b = (names.select(F.col("id").cast("string").alias(f"{x}_id"), F.col("name").alias(f"{x}_name")) for x in ("from", "to"))
    named = transitions.join(a, "from_id", "left").join(b, "to_id", "left")
    return named.select("chain", "from_id", F.coalesce("from_name", "from_id").alias("from_name"), "to_id", F.coalesce("to_name", "to_id").alias("to_name"), F.col("raw").cast("double").alias("raw"), "prob")


def degrees(transitions: DataFrame) -> DataFrame:
    """chain, from_id, d: the transitions of each state."""
    return transitions.groupBy("chain", "from_id").agg(F.count("*").alias("d"))


def chain_registry(transitions: DataFrame, known: DataFrame) -> DataFrame:
    """An entry for each chain, old ids kept: its distinct states and its transitions (M8, M9). known: chain_id, chain, ..."""
    return registry_of_degrees(degrees(transitions), known)


def registry_of_degrees(degree: DataFrame, known: DataFrame) -> DataFrame:
    counted = degree.groupBy("chain").agg(F.count("*").alias("total_states"), F.sum("d").alias("total_transitions"))
    old = known.select("chain", "chain_id")
    both = counted.join(old, "chain", "full")
    return both.select(F.coalesce("chain_id", F.concat(F.lit("chain:"), "chain")).alias("chain_id"), "chain", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_states", "total_transitions")], F.current_timestamp().alias("updated_at"))


def chain_stats(transitions: DataFrame) -> DataFrame:
    """States, transitions, mean and most out-degree of each chain (A2, A3)."""
    return stats_of_degrees(degrees(transitions))


def stats_of_degrees(degree: DataFrame) -> DataFrame:
    return degree.groupBy("chain").agg(F.count("*").alias("states"), F.sum("d").alias("transitions"), F.avg("d").alias("mean_degree"), F.max("d").alias("most_degree"))


def best_transitions(transitions: DataFrame, k: int = FAN_OUT, by: tuple[str, ...] = ("from_id",)) -> DataFrame:
    """The k likeliest transitions of every state."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("prob", 9)), "to_id")
    return transitions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def walk(transitions: DataFrame, start: Column | object, depth: int = DEPTH, decay: float = DECAY, least: float = LEAST, fan_out: int = FAN_OUT) -> DataFrame:
    """Best decayed product of probabilities from the start to every other state, within `depth` hops.

    A longer walk is never likelier than its beginning, so pruning at each hop loses nothing.
    """
    first = best_transitions(transitions.filter(F.col("from_id") == F.lit(start)), fan_out)
    front = first.select(F.col("to_id").alias("state"), (F.col("prob") * decay).alias("score"), F.lit(1).alias("hops")).filter(F.col("score") >= least)
    found = front
    for hop in range(2, depth + 1):
        # only states at the front are ranked; a semi join on the state goes below windows and sums
        near = transitions.join(front.select(F.col("state").alias("from_id")), "from_id", "left_semi")
        steps = best_transitions(near, fan_out).select(F.col("from_id").alias("at"), F.col("to_id").alias("state"), "prob")
        nxt = front.select(F.col("state").alias("at"), F.col("score").alias("before")).join(steps, "at").select("state", (F.col("before") * F.col("prob") * decay).alias("score"), F.lit(hop).alias("hops"))
        front = nxt.filter((F.col("score") >= least) & (F.col("state") != F.lit(start))).groupBy("state").agg(F.max("score").alias("score"), F.min("hops").alias("hops"))
        found = found.unionByName(front)
    best = found.filter(F.col("state") != F.lit(start)).groupBy("state").agg(F.max("score").alias("score"), F.min_by("hops", F.struct(-F.round("score", 12), "hops")).alias("hops"))
    return best


def merge_chains(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """chain, state, score -> the weighted sum over chains that have support, weights shared out anew."""
    weights = weights or CHAIN_WEIGHTS
    rated = scores.withColumn("w", F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("chain")])
    total = rated.select("chain", "w").distinct().agg(F.sum("w").alias("all_w"))
    return rated.join(F.broadcast(total)).groupBy("state").agg(F.sum(F.col("w") / F.col("all_w") * F.col("score")).alias("score"), F.min("hops").alias("hops"), F.sort_array(F.collect_set("chain")).alias("chains"))


def fallback(callers: DataFrame, callees: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """Neighbours where no chain has support: callers at 0.8 (the first half), callees at 0.7, symbols nearby at 0.5; each state once."""
    first = callers.select("state").distinct().orderBy("state").limit(limit // 2).select("state", F.lit(0.8).alias("score"), F.lit("callers").alias("reason"))
    rest = callees.select("state").distinct().select("state", F.lit(0.7).alias("score"), F.lit("callees").alias("reason"))
    co = near.select("state").distinct().select("state", F.lit(0.5).alias("score"), F.lit("co_located").alias("reason"))
    every = first.unionByName(rest).unionByName(co)
    once = every.withColumn("r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("score")))).filter("r = 1").drop("r")
    return once.orderBy(F.desc("score"), "state").limit(limit)
