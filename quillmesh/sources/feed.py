"""Changes of a folder as a streaming source: files that were added, changed or removed between two looks.

Each look lists the folder and keeps paths, sizes and times as a snapshot in a folder that driver and executors share; an offset is the
number of a snapshot. Snapshots lie in parts by a hash of the path, each with a digest, so a task compares one part of two snapshots and
parts without a change are not read. No body is read here. A restarted query goes on from the snapshot that its checkpoint names.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillmesh.operators.retrieval import glob_regex
from quillmesh.sources import ingest
from quillmesh.sources.config_parser import can_parse

SCHEMA = "file_path string, change string, file_size bigint, last_modified timestamp, look bigint"
HELD = pa.schema([("file_path", pa.string()), ("size", pa.int64()), ("us", pa.int64())])
TOLD = pa.schema([("file_path", pa.string()), ("change", pa.string()), ("file_size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")), ("look", pa.int64())])
#: Rows that a writer holds back before a part gets them.
BUFFER = 20_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "/", path))


class Globs:
    """Included and excluded globs as Python expressions; folders that a glob excludes with all below are not entered."""

    def __init__(self, include: list[str] | tuple[str, ...], exclude: list[str] | tuple[str, ...]):
        joined = lambda globs: re.compile("|".join(glob_regex(g) for g in globs) or r"(?!)")
        self.include, self.exclude, self.whole = joined(include or ingest.INCLUDE), joined(exclude or ingest.EXCLUDE), joined([g for g in exclude or ingest.EXCLUDE if g.endswith("/**")])

    def takes(self, path: str) -> bool:
        return bool(self.include.search(path)) and not self.exclude.search(path) and can_parse(path)

    def enters(self, folder: str) -> bool:
        return not self.whole.search(f"{folder}/x")


def walk(root: str, globs: Globs) -> Iterator[tuple[str, int, int]]:
    """Path below the root, size and time in microseconds of each wanted file, folder by folder."""
    system, base = _open(root)
    base, waiting = base.rstrip("/"), [""]
    while waiting:
        below = waiting.pop()
        for info in system.get_file_info(fs.FileSelector(f"{base}/{below}".rstrip("/"), allow_not_found=True)):
            path = f"{below}/{info.base_name}".lstrip("/")
            if info.type == fs.FileType.Directory and globs.enters(path):
                waiting.append(path)
            elif info.type == fs.FileType.File and globs.takes(path):
                yield path, info.size, (info.mtime_ns or 0) // 1000


class Snapshots:
    """Numbered snapshots in a folder: N/part-B.parquet, and N/about.json with the digest of each part."""

    def __init__(self, at: str):
        self.system, self.base = _open(at)

    def numbers(self) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return sorted(int(i.base_name) for i in found if i.type == fs.FileType.Directory and i.base_name.isdigit())

    def digests(self, n: int) -> list[int]:
        """One digest a part; number 0 is the snapshot of nothing."""
        if not n:
            return []
        with self.system.open_input_stream(f"{self.base}/{n}/about.json") as f:
            return json.loads(f.read())["digests"]

    def part(self, n: int, b: int) -> dict[str, tuple[int, int]]:
        if not n:
            return {}
        t = pq.read_table(f"{self.base}/{n}/part-{b}.parquet", filesystem=self.system)
        return dict(zip(t["file_path"].to_pylist(), zip(t["size"].to_pylist(), t["us"].to_pylist(), strict=True), strict=True))

    def take(self, files: Iterator[tuple[str, int, int]], parts: int, settle_us: int) -> int:
        """Look, and keep what is seen if it differs from the last snapshot; the number of the last one then.

        A file that was written less than settle_us ago is kept as it was seen before, so that a burst of writes is told once, at its end.
        """
        last = max(self.numbers(), default=0)
        before = self.digests(last)
        parts = len(before) or parts  # as the first one was cut
        half = f"{self.base}/_{time.time_ns()}"
        self.system.create_dir(half, recursive=True)
        digests, waiting, young = [0] * parts, [[] for _ in range(parts)], [[] for _ in range(parts)]
        writers = [pq.ParquetWriter(f"{half}/part-{b}.parquet", HELD, filesystem=self.system) for b in range(parts)]

        def flush(b: int) -> None:
            if waiting[b]:
                writers[b].write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting[b], strict=True), HELD.types, strict=True)], schema=HELD))
                waiting[b].clear()

        def keep(b: int, row: tuple[str, int, int]) -> None:
            digests[b] = (digests[b] + xxhash.xxh64_intdigest("\0".join(map(str, row)))) % (1 << 64)
            waiting[b].append(row)
            if len(waiting[b]) >= BUFFER:
                flush(b)

        settled = time.time_ns() // 1000 - settle_us
        for row in files:
            b = zlib.crc32(row[0].encode()) % parts
            if settle_us and row[2] > settled:
                young[b].append(row[0])
            else:
                keep(b, row)
        for b in range(parts):
            held = self.part(last, b) if young[b] else {}
            for path in young[b]:
                if path in held:
                    keep(b, (path, *held[path]))
            flush(b)
            writers[b].close()
        if digests == before or (not last and not any(digests)):
            self.system.delete_dir(half)
            return last
        with self.system.open_output_stream(f"{half}/about.json") as f:
            f.write(json.dumps({"digests": digests}).encode())
        self.system.move(half, f"{self.base}/{last + 1}")
        return last + 1

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self.system.delete_dir(f"{self.base}/{n}")


class _Part(InputPartition):
    def __init__(self, start: int, end: int, b: int):
        self.start, self.end, self.b = start, end, b


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.kept = options["path"], Snapshots(options["snapshots"])
        listed = lambda name: [g for g in options.get(name, "").split("\n") if g]
        self.globs, self.parts = Globs(listed("include"), listed("exclude")), int(options.get("parts", 16))
        self.settle_us, self.initial = round(float(options.get("settleSeconds", 0)) * 1e6), options.get("initial", "false").lower() == "true"

    def _look(self) -> int:
        return self.kept.take(walk(self.folder, self.globs), self.parts, self.settle_us)

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"look": 0 if self.initial else self._look()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"look": self._look()}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        a, b = start["look"], end["look"]
        if a == b:
            return []
        old, new = self.kept.digests(a), self.kept.digests(b)
        return [_Part(a, b, i) for i, digest in enumerate(new) if digest != (old[i] if old else 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        old, new = (self.kept.part(n, partition.b) for n in (partition.start, partition.end))
        told = [(p, "added" if p not in old else "changed", *about) for p, about in new.items() if old.get(p) != about]
        told += [(p, "removed", *about) for p, about in old.items() if p not in new]
        if told:
            columns = [*zip(*told, strict=True), [partition.end] * len(told)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TOLD.types, strict=True)], schema=TOLD)

    def commit(self, end: dict) -> None:
        self.kept.forget(end["look"])


class FolderChanges(DataSource):
    """spark.readStream.format("folder_changes").option("snapshots", SHARED).load(FOLDER).

    Options: include and exclude, globs on lines of their own; initial: whether the first look tells all files (false); parts of a snapshot
    (16, as the first look has them); settleSeconds: how long a file must have rested (0). Removals are told at once, with the last size and
    time. An empty folder and one that isn't there give no row. The storage's clock should agree with the driver's if settleSeconds is set.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options)


def changes_stream(spark: SparkSession, folder: str, snapshots: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), initial: bool = False, settle_seconds: float = 0, parts: int = 16) -> DataFrame:
    """The stream of a folder's changes, see FolderChanges."""
    spark.dataSource.register(FolderChanges)
    options = {"snapshots": snapshots, "include": "\n".join(include), "exclude": "\n".join(exclude), "initial": str(initial).lower(), "settleSeconds": str(settle_seconds), "parts": str(parts)}
    return spark.readStream.format("folder_changes").options(**options).load(folder)
