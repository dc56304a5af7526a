"""Markov chains by their factors: walks that multiply through keys, without any table of pairs.

Two states are linked by the keys they share: callers, files, classes in files, imported sources. Of each chain only the incidence is
kept, a row for each key and state: key, state, u, v; the weight from A to B is the sum over their common keys of A's u and B's v. A key
of a million members costs a million rows, where pairs would be a million millions. What a state's transitions add up to follows from
sums over its keys.

A walk needs the likely partners of few states. A partner that is likely enough has at least its share of the weight through one of the
state's keys, so each key is asked only for members whose v reaches that share; what is found is weighed over all common keys. There are
at most as many candidates as keys, times the least probability asked for, however large the keys are. Results are those of markov.walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import lineage
from quillmesh.operators.markov import DECAY, DEPTH, FAN_OUT, LEAST, best_transitions, inverse_document_frequency

INCIDENCE = "key string, state string, u double, v double"
TOTALS = "state string, keys bigint, total double"
#: Part of a bound by which it is widened; sums of doubles err by less.
SLACK = 1e-9


def _tag(*parts: Column | str) -> Column:
    """A key of several parts; lengths keep them apart."""
    named = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("", *[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in named])


def call_flow_factors(calls: DataFrame, fan_out_norm: bool = True, least_calls: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Incidence of callees in callers (C1): damped counts on both sides, the caller's width on the first, the target's kind on the second. keep: columns to carry along."""
    edges = calls.filter(F.col("call_count") >= least_calls).select("caller", "callee", "call_count", "is_async", "is_conditional", *keep)
    wide = edges.groupBy("caller").agg(F.count("*").alias("fan")).filter("fan >= 2")
    damped = F.sqrt(F.log(F.col("call_count") + F.lit(1.0)))
    u = damped / F.sqrt((F.col("fan") - 1).cast("double")) if fan_out_norm else damped
    v = damped * F.when(F.col("is_async"), 1.1).otherwise(1.0) * F.when(F.col("is_conditional"), 0.8).otherwise(1.0)
    return edges.join(wide, "caller").select(_tag("caller").alias("key"), F.col("callee").cast("string").alias("state"), u.alias("u"), v.alias("v"), *keep)


def cooccurrence_factors(occurrences: DataFrame) -> DataFrame:
    """Incidence of symbols in files, and once more in their classes there, which gives these twice the weight."""
    rated = occurrences.join(inverse_document_frequency(occurrences), "symbol").select("file", "symbol", "parent", F.sqrt("idf").alias("w"))
    return cooccurrence_keys(rated, "w").groupBy("key", "state").agg(F.sum("w").alias("u"), F.sum("w").alias("v"))


def cooccurrence_keys(occurrences: DataFrame, *keep: Column | str) -> DataFrame:
    """key, state of each occurrence: its file, and its class there if it has one; with the columns to carry along."""
    keys = F.when(F.col("parent").isNull(), F.array(_tag("file"))).otherwise(F.array(_tag("file"), _tag("file", "parent")))
    return occurrences.select(F.explode(keys).alias("key"), F.col("symbol").cast("string").alias("state"), *keep)


def import_cluster_factors(imports: DataFrame) -> DataFrame:
    """Incidence of files in the sources they import (C4); pairs count from two common sources on, which steps see to."""
    return imports.select(_tag("source").alias("key"), F.col("file").cast("string").alias("state")).distinct().select("key", "state", F.lit(1.0).alias("u"), F.lit(0.5).alias("v"))


def key_sums(incidence: DataFrame) -> DataFrame:
    """key, n, whole: members of each key and what they add up to on the second side."""
    return incidence.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("whole"))


def totals(incidence: DataFrame) -> DataFrame:
    """TOTALS: keys shared with others, and the sum of a state's transitions; states without any are left out."""
    shared = incidence.join(key_sums(incidence).filter("n > 1"), "key")
    weight = F.col("u") * F.greatest(F.col("whole") - F.col("v"), F.lit(0.0))
    return shared.groupBy("state").agg(F.count("*").alias("keys"), F.sum(weight).alias("total")).filter("total > 0")


def support(found: DataFrame, states: DataFrame) -> DataFrame:
    """state, supported: whether a chain leads anywhere from each of the states (L13), by what totals found."""
    return states.select(F.col("state").cast("string").alias("state")).join(found.select("state", F.lit(True).alias("s")), "state", "left").select("state", F.coalesce("s", F.lit(False)).alias("supported"))


def steps(front: DataFrame, states: DataFrame, members: DataFrame, found: DataFrame, least: float, fan_out: int = FAN_OUT) -> DataFrame:
    """at, state, prob, rank: transitions of the front's states with front.score * prob >= least, the likeliest fan_out of each.

    states: state, key, u; members: key, state, v: both the incidence, or its copies in either order. found: what totals gave. front: state, score.
    The front's own rows and the members of its keys are stored, so that found, states and members are read once each; by their sizes joins are chosen.
    """
    near = front.join(found.select("state", "keys", "total"), "state").select(F.col("state").alias("at"), "keys", "total", (F.col("total") * least / F.col("score")).alias("asked"))
    own = lineage.stored(near.join(states.select(F.col("state").alias("at"), "key", "u"), "at"))
    met = lineage.stored(members.select("key", "state", "v").join(own.select("key"), "key", "left_semi"))
    share = F.try_divide(F.col("asked") * (1 - SLACK), F.col("keys") * F.col("u"))
    # u of nothing reaches nothing; a partner reaches its share through one common key at least
    asked = own.filter("u > 0").withColumn("share", share).join(met, "key")
    candidates = asked.filter((F.col("v") >= F.col("share")) & (F.col("state") != F.col("at"))).select("at", "state").distinct()
    pairs = candidates.join(own, "at").join(met, ["key", "state"])
    weighed = pairs.groupBy("at", "state").agg((F.sum(F.col("u") * F.col("v")) / F.first("total")).alias("prob"))
    return _best(weighed, fan_out)


def cluster_steps(front: DataFrame, states: DataFrame, members: DataFrame, least_shared: int = 2, fan_out: int = FAN_OUT) -> DataFrame:
    """The same for pairs that count from least_shared common keys on (C4): the front's keys are read whole, as sums over keys don't tell which pairs count."""
    own = front.select(F.col("state").alias("at")).join(states.select(F.col("state").alias("at"), "key"), "at")
    shared = own.join(members.select("key", "state"), "key").filter("state <> at").groupBy("at", "state").agg(F.count("*").alias("n")).filter(F.col("n") >= least_shared)
    whole = shared.groupBy("at").agg(F.sum("n").alias("total"))
    return _best(shared.join(whole, "at").select("at", "state", (F.col("n") / F.col("total")).alias("prob")), fan_out)


def _best(weighed: DataFrame, fan_out: int) -> DataFrame:
    ranked = best_transitions(weighed.select(F.col("at").alias("from_id"), F.col("state").alias("to_id"), "prob"), fan_out)
    return ranked.select(F.col("from_id").alias("at"), F.col("to_id").alias("state"), "prob", "rank")


def walk(spark: SparkSession, start: object, step, depth: int = DEPTH, decay: float = DECAY, least: float = LEAST) -> DataFrame:
    """Best decayed product of probabilities from the start to every other state, within `depth` hops.

    step: from a front, its states and the least score * probability to transitions, see through. The front of each hop is fetched, so that
    its states are filters of the next hop's scans: at most the fan-out to the power of the hop, as the request sets it.
    """
    begin, front, best = str(start), {str(start): 1.0}, {}
    for hop in range(1, depth + 1):
        if not front:
            break
        here = spark.createDataFrame(list(front.items()), "state string, score double")
        taken = step(here, list(front), least / decay).join(here.select(F.col("state").alias("at"), F.col("score").alias("before")), "at")
        reached = taken.select("state", (F.col("before") * F.col("prob") * decay).alias("score")).filter((F.col("score") >= least) & (F.col("state") != begin))
        front = {r["state"]: r["score"] for r in reached.groupBy("state").agg(F.max("score").alias("score")).collect()}
        for state, score in front.items():
            if state not in best or round(score, 12) > round(best[state][0], 12):
                best[state] = (score, hop)
    return spark.createDataFrame([(s, x, n) for s, (x, n) in best.items()], "state string, score double, hops int")


def _of(table: DataFrame, states: list[str]) -> DataFrame:
    return table.filter(F.col("state").isin(states))


def through(states: DataFrame, members: DataFrame, found: DataFrame, fan_out: int = FAN_OUT):
    """A step for walk, through keys."""
    return lambda front, named, least: steps(front, _of(states, named), members, _of(found, named), least, fan_out)


def through_clusters(states: DataFrame, members: DataFrame, fan_out: int = FAN_OUT, least_shared: int = 2):
    """A step for walk, through keys of which pairs must share some."""
    return lambda front, named, least: cluster_steps(front, _of(states, named), members, least_shared, fan_out)


def along(transitions: DataFrame, fan_out: int = FAN_OUT):
    """A step for walk, along stored transitions."""
    rows = transitions.select(F.col("from_id").cast("string").alias("at"), F.col("to_id").cast("string").alias("state"), "prob")
    return lambda front, named, least: _best(rows.filter(F.col("at").isin(named)), fan_out)
