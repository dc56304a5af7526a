"""The index at rest: relations as Parquet, replaced by file; stored chains and types."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.scalars import parse_types_of
from quillmesh.operators import factored, maintained, markov, postings
from quillmesh.operators.imports import resolve, resolve_aliases
from quillmesh.operators.search import parse_match
from quillmesh.sources import feed, ingest
from quillmesh.sources.model import CHAINED, OWNED, OWNER, RELATIONS, RELATIONS_AND_DERIVED, SEARCHED
from quillmesh.streaming.watch import snapshot_diff


#: Files that are named one by one when they are read again.
MOST_NAMED = 1000
#: What the chain of calls is made of.
CALLED = ("file_path", "caller_symbol_id", "callee_name", "call_count", "is_async", "is_conditional")


class Conflict(OSError):
    """Another writer has committed since this one read the index."""


class Store:
    """A folder of Parquet tables that are merged as they are read; small numbered manifests name what each version of the index consists of.

    A table is a list of segments. An update writes the new rows as further segments and the replaced files as a deletion, so what it writes
    follows the update and not the index; rows whose file was deleted after their segment was written are left out on reading. Segments are
    compacted when there are many. A commit renames a manifest to the next number, which fails if another writer was first. Old manifests
    and their files stay for a time, so a reader that has begun still finishes.
    """

    #: Segments of a table from which on a commit compacts it; seconds that files outlive the version that last named them.
    MOST_SEGMENTS = 8
    KEEP_S = 3600

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Numbers of the manifests there are, in order; the last is the present one."""
        fs, p = self._fs(self.root)
        return sorted(int(m[1]) for f in fs.listStatus(p) if (m := re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()))) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> dict:
        """version; tables: segments by name as path, number of the version that wrote it, bytes, schema; deletions: path, number, bytes, the tables' names; touched: paths of the deletions that factors of chains don't follow yet."""
        version = version or max(self.versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}, "deletions": []}
        fs, p = self._fs(f"{self.root}/manifest-{version}.json")
        stream = fs.open(p)  # as _put wrote it; a job for each table that is read would cost more than the table
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if "tables" not in found:  # as written before tables had segments
            found = {"tables": {n: [[at, 0, 0]] for n, at in found.items()}, "deletions": []}
        return found | {"version": version}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table in the present schema; columns that an older segment didn't have are null."""
        held = self.manifest(version)
        return self._merged(name, held["tables"].get(name, []), held["deletions"])

    def _merged(self, name: str, segments: list, deletions: list) -> DataFrame:
        schema = self.spark.createDataFrame([], RELATIONS_AND_DERIVED[name]).schema
        first, out = min((s[1] for s in segments), default=0), None
        later = [at for at, number, _, names in deletions if number > first and name in names]
        for at, number, _, *written in segments:
            present = written == [schema.simpleString()]  # else its files tell
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{at}") if present else migrated(self.spark.read.parquet(f"{self.root}/{at}"), schema)
            rows = rows.withColumn("_written", F.lit(number)) if later else rows
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], schema)
        if not later:
            return out
        gone = self.spark.read.parquet(*[f"{self.root}/{at}" for at in later]).groupBy(F.col("file_path").alias("_gone")).agg(F.max("number").alias("_number"))
        return out.join(gone, (F.col(OWNED[name]) == F.col("_gone")) & (F.col("_written") < F.col("_number")), "left_anti").drop("_written")

    def _write(self, df: DataFrame, name: str, number: int) -> list:
        at = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{at}")
        fs, p = self._fs(f"{self.root}/{at}")
        return [at, number, fs.getContentSummary(p).getLength(), df.schema.simpleString()]

    def _apart(self, df: DataFrame, name: str) -> DataFrame:
        """df, written beside the tables and read back, for few rows of a table that are used several times. No manifest names it, so it goes as what is left of a crash does (vacuum)."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self._write(df, name, 0)[0]}")

    def _write_all(self, tables: dict[str, DataFrame], number: int) -> dict[str, list]:
        """Segments of several tables, written side by side: most are small, and a job of its own each."""
        with ThreadPoolExecutor(8) as pool:
            jobs = {n: pool.submit(inheritable_thread_target(self.spark)(self._write), df, n, number) for n, df in tables.items()}
            return {n: job.result() for n, job in jobs.items()}

    def _put(self, base: dict, tables: dict[str, list], deletions: list, touched: list[str] | None = None) -> None:
        """Commit as the version after base; what is touched stays as it was unless given. The manifest is written under another name and renamed, so that a crash leaves the one before."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs, _ = self._fs(self.root)
        half, whole = path(f"{self.root}/_manifest-{uuid.uuid4().hex}"), path(f"{self.root}/manifest-{base['version'] + 1}.json")
        out = fs.create(half, True)
        out.write(bytearray(json.dumps({"tables": tables, "deletions": deletions, "touched": base.get("touched", []) if touched is None else touched}).encode()))
        out.close()
        if fs.exists(whole) or not fs.rename(half, whole):
            fs.delete(half, False)
            raise Conflict(f"{whole.toString()} was written by another")

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        """Replace whole tables."""
        base = self.manifest()
        new = {n: [s] for n, s in self._write_all(tables, base["version"] + 1).items()}
        self._put(base, base["tables"] | new, [[*d[:3], [n for n in d[3] if n not in new]] for d in base["deletions"]])

    def save(self, tables: dict[str, DataFrame], replaced: DataFrame) -> None:
        """Rows of the replaced files go from the tables that are given, and these tables' rows come (M1, M3, M5). replaced: file_path, of all files that rows come from or go."""
        base = self.manifest()
        number, searched = base["version"] + 1, [n for n in SEARCHED if n in tables]
        new = self._write_all(tables, number)
        new |= self._post({n: self.spark.read.schema(RELATIONS[n]).parquet(f"{self.root}/{new[n][0]}") for n in searched}, number)
        self._append(base, new, replaced)

    def _post(self, relations: dict[str, DataFrame], number: int) -> dict[str, list]:
        """Segments of the inverted index of searched relations' rows."""
        built = {f"{n}_postings": postings.laid_out(postings.build(rows, "id", list(SEARCHED[n]))) for n, rows in relations.items()}
        sized = {f"{n}_lengths": postings.lengths(rows, list(SEARCHED[n])) for n, rows in relations.items()}
        new = self._write_all(built | sized, number)
        return new | self._write_all({f"{n}_terms": self._dictionary(n, new[f"{n}_postings"]) for n in relations}, number)

    def _dictionary(self, name: str, segment: list) -> DataFrame:
        return postings.dictionary(self.spark.read.schema(postings.POSTINGS).parquet(f"{self.root}/{segment[0]}"), len(SEARCHED[name]))

    def _append(self, base: dict, new: dict[str, list], replaced: DataFrame, names: list[str] | None = None) -> None:
        number = base["version"] + 1
        names = [n for n in (new if names is None else names) if n in OWNER and base["tables"].get(n)]
        deletions, touched, followed = base["deletions"], base.get("touched", []), bool(base["tables"].get("chain_states"))
        if names or followed:
            gone = self._write(replaced.select("file_path").distinct().withColumn("number", F.lit(number)), "deletions", number)
            deletions = [*deletions, [*gone[:3], names]] if names else deletions
            touched = [*touched, gone[0]] if followed else touched
        self._put(base, base["tables"] | {n: [*base["tables"].get(n, []), s] for n, s in new.items()}, deletions, touched)
        self._compact_if_many()

    def _compact_if_many(self) -> None:
        held = self.manifest()
        if any(len(s) > self.MOST_SEGMENTS for s in held["tables"].values()) or len(held["deletions"]) > self.MOST_SEGMENTS:
            self.compact()

    def delete(self, paths: list[str]) -> None:
        """Files and all that belongs to them (M3): one deletion, no rows."""
        self._append(self.manifest(), {}, self.spark.createDataFrame([(p,) for p in paths], "file_path string"), list(OWNER))

    def clear(self) -> None:
        """Everything (M4)."""
        self._put(self.manifest(), {}, [], [])

    def compact(self, full: bool = False) -> None:
        """Merge small segments, without deleted rows; with full, all of each table. A segment that is larger than all smaller ones together waits.

        Postings, their dictionary and their lengths are merged in the same places, so the dictionary counts what is left.
        """
        base = self.manifest()
        number, tables, done = base["version"] + 1, dict(base["tables"]), set()
        for name in [*[n for n in tables if n in OWNED and not n.endswith(("_postings", "_lengths"))], *[f"{n}_postings" for n in SEARCHED if f"{n}_postings" in tables]]:
            few = tables[name] if full else _small(tables[name])
            if len(few) < (1 if full else 2) or (not full and len(tables[name]) <= self.MOST_SEGMENTS):
                continue
            written = {s[1] for s in few}
            rest = lambda n: [s for s in tables[n] if s[1] not in written]  # noqa: B023, E731
            merged = lambda n: self._merged(n, [s for s in base["tables"][n] if s[1] in written], base["deletions"])  # noqa: B023, E731
            if name.endswith("_postings"):
                relation = name.removesuffix("_postings")
                fresh = self._write_all({name: postings.laid_out(merged(name)), f"{relation}_lengths": merged(f"{relation}_lengths")}, number)
                fresh |= {f"{relation}_terms": self._write(self._dictionary(relation, fresh[name]), f"{relation}_terms", number)}
            else:
                fresh = {name: self._write(_laid_out(merged(name), CHAINED.get(name, (OWNED[name],))), name, number)}
            tables |= {n: [*rest(n), s] for n, s in fresh.items()}
            done |= set(fresh)
        open_to = lambda d: [n for n in d[3] if any(s[1] < d[1] for s in tables.get(n, []))]
        deletions = [[*d[:3], names] for d in base["deletions"] if (names := open_to(d))]
        for names in {tuple(d[3]) for d in deletions} if len(deletions) > self.MOST_SEGMENTS else ():
            same = [d for d in deletions if tuple(d[3]) == names]
            if len(same) > 1:
                rows = self.spark.read.parquet(*[f"{self.root}/{d[0]}" for d in same]).groupBy("file_path").agg(F.max("number").alias("number"))
                one = [self._write(rows, "deletions", number)[0], max(d[1] for d in same), sum(d[2] for d in same), list(names)]
                deletions = [d for d in deletions if d not in same] + [one]
                done.add("deletions")
        if done:
            self._put(base, tables, deletions)
        self.vacuum()

    def vacuum(self, keep_s: float | None = None) -> int:
        """Delete manifests that were replaced over keep_s seconds ago, and files that no manifest names and that are as old; how many of these."""
        keep = self.KEEP_S if keep_s is None else keep_s
        path, before = self.spark._jvm.org.apache.hadoop.fs.Path, (time.time() - keep) * 1000
        fs, folder = self._fs(self.root)
        numbers, when = self.versions(), {}
        for n in numbers:
            when[n] = fs.getFileStatus(path(f"{self.root}/manifest-{n}.json")).getModificationTime()
        old = [n for n, following in zip(numbers, numbers[1:], strict=False) if when[following] < before]
        for n in old:
            fs.delete(path(f"{self.root}/manifest-{n}.json"), False)
        used = {s[0] for n in numbers if n not in old for held in [self.manifest(n)] for s in [*[s for table in held["tables"].values() for s in table], *held["deletions"], *[[at] for at in held.get("touched", [])]]}
        lost = 0
        for table in fs.listStatus(folder):
            for at in fs.listStatus(table.getPath()) if table.isDirectory() else ():
                name = f"{table.getPath().getName()}/{at.getPath().getName()}"
                if name not in used and at.getModificationTime() < before:
                    fs.delete(at.getPath(), True)
                    lost += 1
        return lost

    def migrate(self) -> list[str]:
        """Rewrite the tables that have a segment of an older schema; their names."""
        held = self.manifest()
        old = [n for n, segments in held["tables"].items() if any(s[3:] != [self.read(n).schema.simpleString()] and self.spark.read.parquet(f"{self.root}/{s[0]}").columns != self.read(n).columns for s in segments)]
        if old:
            self._commit({n: self.read(n) for n in old})
        return old

    def search(self, name: str, query: str, weights: tuple[float | None, ...] | None = None, k: int | None = None) -> DataFrame:
        """id, score of rows of a searched relation that a full-text query matches, by its inverted index; the best k if asked."""
        held = self.manifest()
        if not held["tables"].get(f"{name}_postings") and held["tables"].get(name):  # written before there was an inverted index
            new = self._post({name: self.read(name)}, held["version"] + 1)
            self._put(held, held["tables"] | {n: [s] for n, s in new.items()}, held["deletions"])
            held = self.manifest()
        table = lambda part: self._merged(f"{name}_{part}", held["tables"].get(f"{name}_{part}", []), held["deletions"])
        weights = list(weights or [1.0] * len(SEARCHED[name]))
        if k is None:
            return postings.search(table("postings"), table("lengths"), weights, query)
        exact = not any(f"{name}_postings" in d[3] for d in held["deletions"])
        return postings.best(table("postings"), table("terms"), table("lengths"), weights, query, k, exact)

    def search_config(self, query: str, scope: str = "both", k: int = 20) -> DataFrame:
        """The best k configuration entries by keys, values or both; a query without a word is sought as it stands, at a score of 1."""
        entries = self.read("config_entries")
        if not parse_match(query):
            fields = {"keys": ["path"], "values": ["value"], "both": ["path", "value"]}[scope]
            hits = entries.filter(F.greatest(*[F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(query.lower())) for f in fields], F.lit(False))).withColumn("score", F.lit(1.0))
        else:
            hits = entries.join(self.search("config_entries", query, {"keys": (1.0, None), "values": (None, 1.0), "both": (1.0, 1.0)}[scope], k), "id")
        return hits.orderBy(F.desc(F.round("score", 9)), "id").limit(k)

    def index(self, folder: str, full: bool = False, keep_missing: bool = False, paths: list[str] | None = None, **scan) -> dict[str, int]:
        """Index what has changed in the folder, drop what is gone, and tell how much (M10-M12). keep_missing: deletions are not looked for.

        paths: only these files; those that are no more go. Files that could not be read or parsed are among the indexed, and have their status.
        """
        stored = self.read("files")
        if paths is not None:
            named = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
            stored = stored.join(named, "file_path", "left_semi")
        scanned = ingest.scan(self.spark, folder, only=paths, **scan)
        todo = scanned if full else ingest.changed(scanned, stored)
        todo, records = todo.repartition(max(1, min(10_000, todo.count() // 50 + 1)), "file_path").persist(), None
        try:
            records = ingest.parse_files(todo).persist()
            new = ingest.relations(records, todo)
            missing = stored.select("file_path").join(scanned.select("file_path"), "file_path", "left_anti")
            replaced = todo.select("file_path") if keep_missing else todo.select("file_path").union(missing)
            report = {"indexed": todo.count(), "removed": 0 if keep_missing else missing.count(), "failed": records.filter("relation = 'files' and payload like '%\"partial\"%'").count()}
            if report["indexed"] or report["removed"]:
                self.save(new, replaced)
            return report
        finally:
            todo.unpersist()
            if records is not None:
                records.unpersist()

    def changes(self, folder: str, **scan) -> DataFrame:
        """file_path, change: what was added, changed or removed since it was indexed, by sizes and times alone; no body is read."""
        stamp = lambda df: df.select("file_path", F.concat_ws(":", F.col("file_size").cast("string"), F.unix_micros("last_modified").cast("string")).alias("checksum"))
        return snapshot_diff(stamp(self.read("files")), stamp(ingest.listing(self.spark, folder, **scan)))

    def follow(self, folder: str, **scan) -> dict[str, int]:
        """Index what changes tells, reading these files' bodies only; where that is very much, the folder."""
        return self.take(folder, self.changes(folder, **scan), **scan)

    def take(self, folder: str, changes: DataFrame, chains: bool = False, **scan) -> dict[str, int]:
        """Index the files that a feed's rows (file_path) name, reading no other body; where they are very many, the folder (W5, M12). chains: let these follow, too."""
        paths = [r["file_path"] for r in changes.select("file_path").distinct().limit(MOST_NAMED + 1).collect()]
        report = {"indexed": 0, "removed": 0, "failed": 0}
        if paths:
            report = self.index(folder, full=True, paths=paths) if len(paths) <= MOST_NAMED else self.index(folder, **scan)
        if chains and paths:
            self.update_factors()
        return report

    def watching(self, folder: str, checkpoint: str, every: str | None = None, settle_seconds: float = 0.3, chains: bool = False, told: Callable[[dict], None] | None = None, **scan):
        """A running query that indexes what changes in the folder, from the first look on (W1-W5). checkpoint: a shared folder, from which a later one goes on.

        every: time between looks, or None for one look. settle_seconds: how long a file must have rested. told: is given each report.
        A batch that is done again after a failure indexes the same files once more, which changes nothing.
        """
        changes = feed.changes_stream(self.spark, folder, f"{checkpoint}/looks", initial=True, settle_seconds=settle_seconds, **scan)

        def batch(rows: DataFrame, number: int) -> None:
            report = self.take(folder, rows, chains, **scan)
            if told:
                told(report)

        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/query").trigger(**trigger).start()

    def failed(self) -> DataFrame:
        """Files that could not be parsed or were too large, with their status."""
        return self.read("files").filter("parse_status <> 'complete'").select("file_path", "parse_status").orderBy("file_path")

    def resolved_calls(self, calls: DataFrame | None = None) -> DataFrame:
        """Call edges, all or some, with the least id of a symbol of the callee's name (M7)."""
        symbols = self.read("symbols")
        if calls is not None:
            symbols = symbols.join(calls.select(F.col("callee_name").alias("local_name")).distinct(), "local_name", "left_semi")
        names = symbols.groupBy(F.col("local_name").alias("callee_name")).agg(F.min("id").alias("callee_symbol_id"))
        return (self.read("calls") if calls is None else calls).join(names, "callee_name", "left")

    def aliases(self) -> tuple[list[tuple[str, list[str]]], str | None]:
        """Path aliases and base folder of the compiler configuration with the shortest path, as its stored entries tell."""
        held = self.read("config_entries").filter((F.col("config_type") == "tsconfig") & F.col("path").isin("compilerOptions.paths", "compilerOptions.baseUrl"))
        entries = held.orderBy(F.length("file_path"), "file_path").select("file_path", "path", "value").limit(2).collect()  # of one file: two entries at most
        own = {r["path"]: r["value"] for r in entries if r["file_path"] == entries[0]["file_path"]}
        if not own:
            return [], None
        home = os.path.dirname(entries[0]["file_path"])
        below = os.path.normpath(os.path.join(home, own.get("compilerOptions.baseUrl", "."))).removeprefix("./")
        return [(k, list(v)) for k, v in json.loads(own.get("compilerOptions.paths", "{}")).items()], "" if below == "." else below

    def resolved_imports(self) -> DataFrame:
        """Imports with the stored file that each means: relative ones by their paths, others by the compiler's aliases."""
        imports = self.read("imports").select(F.col("file_path").alias("file"), F.col("import_source").alias("source"), "is_type_only", "specifiers")
        files = self.read("files").select("file_path")
        found, (aliases, base) = resolve(imports, files), self.aliases()
        if base is None:
            return found
        other = resolve_aliases(imports.select("file", "source").distinct(), files, aliases, base).filter("resolved_path is not null").withColumnRenamed("resolved_path", "_aliased")
        both = found.join(other, ["file", "source"], "left").withColumn("kind", F.when(F.col("_aliased").isNotNull() & F.col("resolved_path").isNull(), F.lit("internal")).otherwise(F.col("kind")))
        return both.withColumn("resolved_path", F.coalesce("resolved_path", "_aliased")).drop("_aliased")

    def _relations(self, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """What the four chains are made of: calls, symbols in files, type relations, imports; of all files, or of some (file_path). owner: the file a row comes from."""
        of = lambda name: self.read(name) if files is None else self.read(name).join(files, "file_path", "left_semi")
        owner = F.col("file_path").alias("owner")
        calls = None if files is None else self._apart(of("calls").select(*CALLED), "stale_calls")
        calls = self.resolved_calls(calls).select(owner, F.col("caller_symbol_id").alias("caller"), F.coalesce("callee_symbol_id", "callee_name").alias("callee"), "call_count", "is_async", "is_conditional")
        symbols = of("symbols").select(F.col("file_path").alias("file"), F.col("id").alias("symbol"), F.col("parent_class").alias("parent"), F.col("local_name").alias("name"))
        types = of("type_rels").select(owner, F.col("source_symbol_id").alias("source"), F.col("target_name").alias("target"), F.col("relationship_kind").alias("kind"))
        return calls, symbols, types, of("imports").select(F.col("file_path").alias("file"), F.col("import_source").alias("source"))

    def build_chains(self) -> DataFrame:
        """Build the four chains as tables of transitions over what is stored, and store them (C5, M8, M9). Walks don't need them, see build_factors."""
        calls, symbols, types, imports = self._relations()
        built = markov.build_chains(call_flow=markov.call_flow_weights(calls), cooccurrence=markov.cooccurrence_weights(symbols), type_affinity=markov.type_affinity_weights(types), import_cluster=markov.import_cluster_weights(imports))
        names = self.read("symbols").groupBy("id").agg(F.min("name").alias("name"))
        return self.save_transitions(markov.name_states(built, names), replace=True)

    def build_factors(self) -> None:
        """Store the factors of the four chains: a row for each key and state, none for pairs.

        They lie in the order of states and once more of keys, the heaviest members first; relations between types are links as they are.
        """
        base, whole = self.manifest(), self._relations()
        number, symbols = base["version"] + 1, whole[1]
        new = self._factors(whole, maintained.frequencies(symbols), number) | {"chain_counts": self._write(symbols.agg(F.countDistinct("file").alias("files")), "chain_counts", number)}
        known = {n: s for n, s in base["tables"].items() if n in RELATIONS_AND_DERIVED}
        self._put(base, known | {n: [s] for n, s in new.items()}, [[*d[:3], kept] for d in base["deletions"] if (kept := [n for n in d[3] if n not in CHAINED])], [])

    def _factors(self, relations: tuple[DataFrame, ...], found: DataFrame, number: int) -> dict[str, list]:
        """Segments of the factors of these relations. found: in how many files their symbols stand."""
        calls, symbols, types, imports = relations
        states = self._write(_laid_out(maintained.rows(calls, symbols, found, imports).select("chain", "owner", "state", "key", "u", "v", "df"), CHAINED["chain_states"]), "chain_states", number)
        stored = self.spark.read.schema(RELATIONS_AND_DERIVED["chain_states"]).parquet(f"{self.root}/{states[0]}")
        parts = {
            "chain_members": _laid_out(stored.select("chain", "owner", "key", "state", "v", "df"), (*CHAINED["chain_members"], F.desc("v"))), "chain_sums": _laid_out(maintained.sums(stored), CHAINED["chain_sums"]),
            "chain_links": _laid_out(maintained.links(types), CHAINED["chain_links"]), "chain_names": _laid_out(symbols.select(F.col("file").alias("owner"), "name", F.col("symbol").alias("id")).distinct(), CHAINED["chain_names"]),
        }
        return {"chain_states": states} | self._write_all(parts, number)

    def update_factors(self) -> int:
        """Bring stored factors up to what is stored of files; how many files' rows were made anew.

        From the files that were saved or deleted since follow those whose rows they change: callers of a name that now means another symbol,
        and holders of symbols that stand in more or fewer files. The rows of these are replaced as any file's are, so what is written follows
        the change. Equal to build_factors.
        """
        base = self.manifest()
        if not base["tables"].get("chain_counts"):
            self.build_factors()
            return self.read("files").count()
        if not base.get("touched"):
            return 0
        number, names = base["version"] + 1, self.read("chain_names")
        touched = self.spark.read.parquet(*[f"{self.root}/{at}" for at in base["touched"]]).select("file_path").distinct()
        symbols = self.read("symbols").select(F.col("file_path").alias("owner"), F.col("local_name").alias("name"), "id")
        stale = maintained.stale_owners(touched, names, self.read("chain_states").filter("chain = 'cooccurrence'"), symbols, self.read("calls").select("file_path", "callee_name"))
        gone = self._write(stale.withColumn("number", F.lit(number)), "deletions", number)
        files = self.spark.read.parquet(f"{self.root}/{gone[0]}").select("file_path")
        some = self._relations(files)
        everywhere = symbols.join(some[1].select(F.col("symbol").alias("id")).distinct(), "id", "left_semi")
        new = self._factors(some, maintained.frequencies(everywhere.select(F.col("owner").alias("file"), F.col("id").alias("symbol"))), number)
        now = self.spark.read.schema(RELATIONS_AND_DERIVED["chain_names"]).parquet(f"{self.root}/{new['chain_names'][0]}").agg(F.countDistinct("owner").alias("now"))
        was = names.join(files.withColumnRenamed("file_path", "owner"), "owner", "left_semi").agg(F.countDistinct("owner").alias("was"))
        counted = self.read("chain_counts").join(now).join(was).select((F.col("files") + F.col("now") - F.col("was")).alias("files"))  # one row each
        tables = base["tables"] | {n: [*base["tables"].get(n, []), s] for n, s in new.items()} | {"chain_counts": [self._write(counted, "chain_counts", number)]}
        self._put(base, tables, [*base["deletions"], [*gone[:3], list(CHAINED)]], [])
        self._compact_if_many()
        return files.count()

    def chain_factors(self) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
        """Of the two chains whose transitions sums tell: states, members and totals, as factored.steps takes them; built at first use."""
        if not self.manifest()["tables"].get("chain_counts"):
            self.build_factors()
        files = self.read("chain_counts").first()[0]
        of = lambda name, chain: self.read(name).filter(F.col("chain") == chain)
        out = {}
        for c in ("call_flow", "cooccurrence"):
            states = maintained.weighed(of("chain_states", c), files)
            out[c] = states, maintained.weighed(of("chain_members", c), files), maintained.totals(states, of("chain_sums", c), files)
        return out

    def walks(self) -> dict[str, Callable]:
        """For each chain the step that a walk takes, over stored factors; these are built at first use."""
        keyed = {c: factored.through(*tables) for c, tables in self.chain_factors().items()}
        clusters = [self.read(n).filter("chain = 'import_cluster'") for n in ("chain_states", "chain_members")]
        return keyed | {"type_affinity": factored.along(maintained.linked(self.read("chain_links"))), "import_cluster": factored.through_clusters(*clusters)}

    def save_transitions(self, transitions: DataFrame, replace: bool = False) -> DataFrame:
        """Store transitions; chains among them, or all with replace, are replaced. Refreshes and returns the chains' registry (M8, M9).

        Rows lie in the order of chain and state, so that a state's transitions are few row groups of one file.
        """
        kept = transitions
        if not replace:
            kept = self.read("transitions").join(transitions.select("chain").distinct(), "chain", "left_anti").unionByName(transitions.select(*self.read("transitions").columns))
        ordered = kept.repartitionByRange("chain", "from_id").sortWithinPartitions("chain", "from_id", F.desc("prob"))
        self._commit({"transitions": ordered})
        registry = markov.chain_registry(self.read("transitions"), self.read("chains"))
        self._commit({"chains": registry})
        return self.read("chains")

    def chain_id(self, chain: str) -> str | None:
        row = self.read("chains").filter(F.col("chain") == chain).select("chain_id").first()
        return row and row[0]

    def delete_chain(self, chain: str, keep_registered: bool = False) -> None:
        """A chain's transitions go, and its entry too unless keep_registered (M8)."""
        self._commit({"transitions": self.read("transitions").filter(F.col("chain") != chain)})
        chains = self.read("chains")
        cleared = chains.withColumns({c: F.when(F.col("chain") == chain, F.lit(0)).otherwise(F.col(c)).cast("long") for c in ("total_states", "total_transitions")})
        self._commit({"chains": cleared if keep_registered else chains.filter(F.col("chain") != chain)})

    def chains(self) -> DataFrame:
        """The stored transitions; they are built at first use."""
        if not self.manifest()["tables"].get("transitions"):
            self.build_chains()
        return self.read("transitions")

    def index_file(self, folder: str, path: str) -> dict[str, int]:
        """Index one file of a folder, changed or not."""
        return self.index(folder, full=True, keep_missing=True, paths=[path])

    def types(self) -> tuple[DataFrame, DataFrame]:
        """Types of symbols and of their parameters."""
        return type_tables(self.read("symbols"))


def _laid_out(rows: DataFrame, order: tuple) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _small(segments: list) -> list:
    """The segments worth merging: from the smallest on, as long as one isn't larger than all before it together."""
    out, total = [], 0
    for s in sorted(segments, key=lambda s: s[2]):
        if len(out) > 1 and s[2] > total:
            break
        out.append(s)
        total += s[2]
    return out


def migrated(table: DataFrame, schema) -> DataFrame:
    return table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def type_tables(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbol_types and param_types: parsed types with the base in lower case and inner types joined by commas."""
    own = symbols.filter(F.col("kind").isin("function", "method", "constructor", "callback"))
    head = (F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), "file_path", "language")
    of = lambda c: parse_types_of()(c, "language")
    symbol_types = own.withColumn("t", of("return_type")).select(
        *head, F.col("return_type").alias("raw"), "t.normalized", "t.base", "t.inner", *[F.coalesce(f"t.{f}", F.lit(False)).alias(f) for f in FLAGS],
        F.size("params").alias("param_count"), F.col("kind").isin("method", "constructor").alias("is_method"), "parent_class",
    )
    flat = own.select(*head, F.posexplode("params").alias("param_index", "p")).select("symbol_id", "symbol_name", "file_path", "language", "param_index", F.col("p.name").alias("param_name"), F.col("p.type").alias("raw"), F.col("p.optional").alias("is_optional"), F.col("p.has_default").alias("has_default"))
    param_types = flat.withColumn("t", of("raw")).select(*flat.columns, "t.normalized", "t.base", "t.inner", *[F.coalesce(f"t.{f}", F.lit(False)).alias(f) for f in FLAGS])
    return symbol_types, param_types


FLAGS = ("is_async", "is_nullable", "is_array", "is_generic")


def find_config(start: str) -> dict | None:
    """The nearest project configuration at or above a folder: one of three file names, or a key of package.json."""
    here = os.path.abspath(start)
    while True:
        for name in ("quillmesh.config.json", ".quillmeshrc.json", ".quillmeshrc"):
            if os.path.isfile(path := os.path.join(here, name)):
                with open(path) as f:
                    return validated(json.load(f))
        if os.path.isfile(path := os.path.join(here, "package.json")):
            with open(path) as f:
                if "quillmesh" in (own := json.load(f)):
                    return validated(own["quillmesh"])
        if here == (up := os.path.dirname(here)):
            return None
        here = up


def validated(config: dict) -> dict:
    """Known keys with their defaults; others and wrong kinds are errors."""
    defaults = {"include": [], "exclude": [], "max_bytes": ingest.MAX_BYTES}
    if unknown := set(config) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for k, v in config.items():
        if not isinstance(v, type(defaults[k])) or isinstance(v, bool):
            raise ValueError(f"{k} must be a {type(defaults[k]).__name__}")
    return defaults | config
