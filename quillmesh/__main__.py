"""python -m quillmesh index|query|serve|stats|watch STORE ..., or init FOLDER."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from quillmesh.sources.ingest import EXCLUDE, INCLUDE
from quillmesh.sources.store import Store, find_config, validated
from quillmesh.streaming import awareness
from quillmesh.tools import Tools

TOOLS = ("search_symbols", "get_function", "get_class", "list_functions", "list_files", "find_references", "trace_calls", "trace_types", "get_module_dependencies", "suggest_related", "get_related_context", "get_context_bundle", "get_architecture_overview")

#: Answers that the service keeps.
MOST_ANSWERS = 64


def serve(tools: Tools, lines, write) -> None:
    """Answer calls, a JSON object on each line: {"tool": ..., "input": {...}} -> {"rows": [...], "state": ...}. A repeated call is answered from the cache until the index is synchronised."""
    session, cache = awareness.Session(), {}
    for line in lines:
        if not line.strip():
            continue
        try:
            call = json.loads(line)
            tool, given = call["tool"], call.get("input") or {}
            if tool not in (*TOOLS, "sync_index"):
                raise ValueError(f"there is no tool {tool}")
            key = awareness.canonical_key(tool, given)
            state = session.call(tool, awareness.target_of(tool, given), tool == "sync_index", key)
            if tool == "sync_index":
                cache.clear()
            if state == "finalize":
                answer = {"state": state, "rows": []}  # not executed, not cached
            else:
                rows = cache[key] if key in cache else [json.loads(r) for r in getattr(tools, tool)(**given).toJSON().toLocalIterator()]
                if tool != "sync_index":
                    cache[key] = rows
                    if len(cache) > MOST_ANSWERS:  # the oldest goes; asked again it is answered anew
                        cache.pop(next(iter(cache)))
                answer = {"state": state, "rows": rows}
        except Exception as e:  # noqa: BLE001  a failed call must not end the service
            answer = {"error": f"{type(e).__name__}: {e}"}
        write(json.dumps(answer, default=str) + "\n")


def init(folder: str) -> str:
    """A project configuration with the defaults, unless there is one."""
    path = os.path.join(folder, "quillmesh.config.json")
    if not os.path.exists(path):
        with open(path, "w") as f:
            json.dump(validated({}) | {"include": list(INCLUDE), "exclude": list(EXCLUDE)}, f, indent=2)
    return path


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillmesh")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "watch"):
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("folder")
        c.add_argument("--full", action="store_true")
        c.add_argument("--every", type=float, default=2.0, help="seconds between looks, for watch")
        c.add_argument("--times", type=int, default=0, help="looks in all, for watch; 0: no end")
        c.add_argument("--checkpoint", help="for watch: a streaming query that goes on from this shared folder")
    q = sub.add_parser("query")
    q.add_argument("store")
    q.add_argument("tool", choices=TOOLS)
    q.add_argument("name", nargs="?")
    sub.add_parser("stats").add_argument("store")
    sub.add_parser("serve").add_argument("store")
    sub.add_parser("init").add_argument("folder")
    a = p.parse_args(argv)
    if a.command == "init":
        print(init(a.folder))
        return
    spark = SparkSession.builder.appName("quillmesh").getOrCreate()
    store = Store(spark, a.store)
    if a.command in ("index", "watch"):
        config = find_config(a.folder.removeprefix("file://")) or {}
        globs = {k: tuple(config[k]) for k in ("include", "exclude") if config.get(k)}
        if a.command == "watch" and a.checkpoint:
            every = None if a.times == 1 else f"{a.every} seconds"
            store.watching(a.folder, a.checkpoint, every, told=lambda report: print(json.dumps(report), flush=True), **globs).awaitTermination()
            return
        looks = 1 if a.command == "index" else a.times
        n = 0
        while not looks or n < looks:
            if n:
                time.sleep(a.every)
            look = store.follow(a.folder, **globs) if a.command == "watch" and not a.full else store.index(a.folder, a.full, **globs)
            print(json.dumps(look), flush=True)
            n += 1
    else:
        tools = Tools(store)
        if a.command == "serve":
            serve(tools, sys.stdin, lambda text: print(text, end="", flush=True))
            return
        rows = tools.stats() if a.command == "stats" else getattr(tools, a.tool)(*([a.name] if a.name else []))
        for r in rows.toJSON().toLocalIterator():
            print(r)


if __name__ == "__main__":
    main()
