"""A small thesaurus of programming terms, and how it is merged with a project's own.

Fixed values: canonical term, category, and its synonyms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_WEIGHT = 0.8
ENTRIES = {
    "fetch": ("verb", ["get", "retrieve", "load", "read"]), "create": ("verb", ["make", "build", "new", "add"]), "delete": ("verb", ["remove", "drop", "erase"]),
    "update": ("verb", ["edit", "modify", "change", "patch"]), "user": ("noun", ["account", "member", "customer"]), "error": ("noun", ["exception", "failure", "fault"]),
    "config": ("noun", ["settings", "options", "preferences"]), "auth": ("domain", ["login", "session", "token"]), "parse": ("verb", ["decode", "scan", "tokenize"]),
    "widget": ("noun", ["gadget", "component", "gear"]), "click": ("event", ["tap", "press"]), "red": ("adjective", ["crimson", "scarlet"]),
    "save": ("verb", ["store", "persist", "write"]), "find": ("verb", ["search", "lookup", "query"]), "check": ("verb", ["verify", "validate", "assert"]), "start": ("verb", ["begin", "launch", "boot"]),
    "stop": ("verb", ["end", "halt", "shutdown"]), "send": ("verb", ["emit", "publish", "dispatch"]), "receive": ("verb", ["consume", "accept", "subscribe"]), "show": ("verb", ["display", "render", "print"]),
    "hide": ("verb", ["conceal", "collapse"]), "convert": ("verb", ["transform", "map", "cast"]), "merge": ("verb", ["combine", "join", "concat"]), "split": ("verb", ["divide", "partition", "chunk"]),
    "sort": ("verb", ["order", "rank"]), "filter": ("verb", ["select", "exclude"]), "compute": ("verb", ["calculate", "evaluate"]), "copy": ("verb", ["clone", "duplicate"]), "compare": ("verb", ["diff", "equals"]),
    "connect": ("verb", ["attach", "bind", "link"]), "handle": ("verb", ["process", "manage"]), "file": ("noun", ["document", "blob"]), "folder": ("noun", ["directory", "path"]), "list": ("noun", ["array", "collection"]),
    "dictionary": ("noun", ["hash", "record", "object"]), "text": ("noun", ["string", "message"]), "image": ("noun", ["picture", "photo", "icon"]), "request": ("noun", ["call", "http"]), "response": ("noun", ["reply", "result"]),
    "database": ("noun", ["db", "repository", "storage"]), "cache": ("noun", ["memo", "buffer"]), "event": ("noun", ["signal", "trigger"]), "callback": ("noun", ["handler", "listener", "hook"]), "test": ("noun", ["spec", "suite"]),
    "helper": ("noun", ["util", "utility"]), "permission": ("domain", ["role", "access", "grant"]), "payment": ("domain", ["invoice", "billing", "charge"]), "queue": ("noun", ["job", "task", "worker"]),
}
SCHEMA = "canonical string, category string, term string, weight double, bidirectional boolean"


def builtin_rows() -> list[tuple[str, str, str, float, bool]]:
    return [(c, cat, t, DEFAULT_WEIGHT, True) for c, (cat, ts) in ENTRIES.items() for t in ts]


def thesaurus(spark: SparkSession, custom: list[tuple] = (), overrides: list[tuple] = (), disabled: list[str] = ()) -> DataFrame:
    """Built-in and custom entries; an override replaces all of its canonical term, a disabled term goes."""
    frame = lambda rows, rank: spark.createDataFrame(list(rows), SCHEMA).withColumn("rank", F.lit(rank))
    replaced = [r[0] for r in overrides]
    base = frame(builtin_rows(), 2).unionByName(frame(custom, 1)).filter(~F.col("canonical").isin(replaced)) if replaced else frame(builtin_rows(), 2).unionByName(frame(custom, 1))
    every = base.unionByName(frame(overrides, 0))
    every = every.filter(~F.col("canonical").isin(list(disabled))) if disabled else every
    best = every.groupBy("canonical", "term").agg(F.min_by(F.struct("category", "weight", "bidirectional"), "rank").alias("e"))
    return best.select("canonical", "e.category", "term", "e.weight", "e.bidirectional")
