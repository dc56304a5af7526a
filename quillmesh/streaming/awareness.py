"""How a session of tool calls goes on: explore, synthesize, finalize; repeated calls are answered from a cache."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_TOTAL, MOST_NOVEL, NOTE_FROM, WARN_FROM = 25, 15, 8, 12


#: The input that says what a tool's call is about.
TARGETS = {
    "get_function": "function_name", "trace_calls": "function_name", "get_class": "class_name", "trace_types": "class_name", "find_references": "symbol_name", "suggest_related": "symbol_name",
    "get_related_context": "symbol_name", "list_functions": "file_path", "get_module_dependencies": "file_path", "list_files": "directory", "get_architecture_overview": "focus",
}
SEARCHED = ("query", "return_type", "param_type")


def canonical_key(tool: str | None, given: object) -> str:
    """A key that is equal for equal inputs, however their keys are ordered; what is searched for counts without regard to case and blanks."""
    if tool == "search_symbols" and isinstance(given, dict):
        given = given | {k: " ".join(v.split()).lower() for k in SEARCHED if isinstance(v := given.get(k), str)}
    return (f"{tool}::" if tool else "") + json.dumps(given, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def target_of(tool: str | None, given: object) -> str | None:
    """What a call is about, in lower case, or None."""
    if not tool or tool == "sync_index":
        return None
    if not isinstance(given, dict):
        return "*" if tool == "list_files" else None
    text = lambda k: (v.strip().lower() or None) if isinstance(v := given.get(k), str) else None
    if tool == "search_symbols":
        return "||".join(f"{k}:{v}" for k in SEARCHED if (v := text(k))) or None
    return (text(TARGETS[tool]) if tool in TARGETS else None) or ("*" if tool in ("list_files", "get_architecture_overview") else None)


def describe_calls():
    """Key and target of calls: a column function of the tool's name and its input as JSON."""

    @F.pandas_udf("key string, target string")
    def describe(tool: pd.Series, given: pd.Series) -> pd.DataFrame:
        inputs = [None if g is None else json.loads(g) for g in given]
        return pd.DataFrame({"key": [canonical_key(t, g) for t, g in zip(tool, inputs, strict=True)], "target": [target_of(t, g) for t, g in zip(tool, inputs, strict=True)]})

    return describe


def label_calls(calls: DataFrame) -> DataFrame:
    """calls: session, event_id, ts, tool, target, is_sync -> with total, novel and state, as window functions.

    Counters never fall, so a first call of its key is finalized from some point on for good; a repeated one is a cache hit unless
    its first one was finalized, and then is finalized itself.
    """
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    c = calls.withColumn("epoch", F.sum(F.col("is_sync").cast("int")).over(running)).withColumn("key", F.concat_ws("|", "tool", F.coalesce("target", F.lit(""))))
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("session", "epoch", "key").orderBy("ts", "event_id"))).withColumn("pn", F.row_number().over(Window.partitionBy("session", "key").orderBy("ts", "event_id")))
    c = c.withColumn("total", F.sum(F.when(~F.col("is_sync") & (F.col("rn") == 1), 1).otherwise(0)).over(running)).withColumn("novel", F.sum(F.when(~F.col("is_sync") & (F.col("pn") == 1) & F.col("target").isNotNull(), 1).otherwise(0)).over(running))
    final = (F.col("total") > MOST_TOTAL) | (F.col("novel") > MOST_NOVEL)
    own = F.when(final, "finalize").when(F.col("novel") > WARN_FROM, "synthesize_warning").when(F.col("novel") > NOTE_FROM, "synthesize_note").otherwise("explore")
    c = c.withColumn("own", own).withColumn("first_own", F.first("own").over(Window.partitionBy("session", "epoch", "key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(F.col("is_sync"), "sync").when(F.col("rn") == 1, F.col("own")).when(F.col("first_own") == "finalize", "finalize").otherwise("cache_hit")
    return c.select("session", "event_id", F.col("total").cast("long").alias("total"), F.col("novel").cast("long").alias("novel"), state.alias("state"))


class Session:
    """The same rules, call by call."""

    def __init__(self, total: int = 0, novel: int = 0, pairs: list[str] = (), cached: list[str] = (), ended: list[str] = ()):
        self.total, self.novel, self.pairs, self.cached, self.ended = total, novel, set(pairs), set(cached), set(ended)

    def call(self, tool: str, target: str | None, is_sync: bool, key: str | None = None) -> str:
        """key: what the cache knows the call by, if that is more than tool and target."""
        pair = f"{tool}|{target or ''}"
        key = key or pair
        if is_sync:
            self.cached, self.ended = set(), set()
            self.pairs.add(pair)
            return "sync"
        if key in self.cached:
            return "cache_hit"
        if key in self.ended:
            return "finalize"
        self.total += 1
        if pair not in self.pairs:
            self.pairs.add(pair)
            self.novel += target is not None
        if self.total > MOST_TOTAL or self.novel > MOST_NOVEL:
            self.ended.add(key)
            return "finalize"
        self.cached.add(key)
        return "synthesize_warning" if self.novel > WARN_FROM else "synthesize_note" if self.novel > NOTE_FROM else "explore"


OUT = "session long, event_id long, total long, novel long, state string"
STATE = "total long, novel long, pairs array<string>, cached array<string>, ended array<string>"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    s = Session(*state.get) if state.exists else Session()
    rows = []
    batch = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for r in batch.itertuples(index=False):
        label = s.call(r.tool, None if pd.isna(r.target) else r.target, bool(r.is_sync))
        rows.append((key[0], r.event_id, s.total, s.novel, label))
    state.update((s.total, s.novel, sorted(s.pairs), sorted(s.cached), sorted(s.ended)))
    yield pd.DataFrame(rows, columns=["session", "event_id", "total", "novel", "state"])


def label_stream(calls: DataFrame) -> DataFrame:
    """The same labels for a stream; state is kept by session."""
    return calls.groupBy("session").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")
