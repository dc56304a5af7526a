"""From a folder of sources to canonical relations.

Files are read by Spark's binary source, parsed in batches on the executors, and come out as one row for each record: relation and
payload. Each relation is then a projection of that one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.retrieval import glob_regex
from quillmesh.sources import config_parser, python_parser, ts_parser
from quillmesh.sources.model import LANGUAGES, RELATIONS

#: What is scanned and left out if nothing else is asked for.
INCLUDE = (
    "**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.py", "**/package.json", "**/tsconfig.json", "**/tsconfig.*.json", "**/jsconfig.json", "**/pyproject.toml", "**/.eslintrc*", "**/eslint.config.*",
    "**/.prettierrc*", "**/prettier.config.*", "**/vite.config.*", "**/vitest.config.*", "**/jest.config.*", "**/babel.config.*", "**/.babelrc*", "**/docker-compose*.yml", "**/docker-compose*.yaml",
    "**/.github/workflows/*.yml", "**/.github/workflows/*.yaml",
)
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/venv/**", "**/__pycache__/**")
MAX_BYTES = 1 << 20


class Parsers:
    """Which parser takes a file, by its last ending."""

    def __init__(self) -> None:
        self.by_ending = {}
        for ending, language in LANGUAGES.items():
            self.register(ending, {"python": python_parser.parse, "config": config_parser.parse}.get(language) or self._script(language))

    @staticmethod
    def _script(language: str):
        def parse(path: str, content: str, wanted: frozenset[str] | None = None) -> dict[str, list[dict]]:
            return ts_parser.parse(path, content, language, wanted)

        parse.prunes = True
        return parse

    def register(self, ending: str, parse) -> None:
        self.by_ending[ending.lower()] = parse

    def endings(self) -> list[str]:
        return sorted(self.by_ending)

    def languages(self) -> list[str]:
        return sorted({LANGUAGES[e] for e in self.by_ending if e in LANGUAGES})

    def by_language(self, language: str):
        return next((self.by_ending[e] for e, x in LANGUAGES.items() if x == language and e in self.by_ending), None)

    def can_parse(self, path: str) -> bool:
        return self.find(path) is not None and config_parser.can_parse(path)

    def find(self, path: str):
        m = re.search(r"\.[^./]+$", path.lower())
        return self.by_ending.get(m[0]) if m else None


_registry: Parsers | None = None


def registry() -> Parsers:
    """The parsers that a process shares."""
    global _registry
    _registry = _registry or Parsers()
    return _registry


def reset_registry() -> None:
    global _registry
    _registry = None


def language_of(path: Column) -> Column:
    """By the last ending; null for files that no parser takes."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ending)


def taken(path: Column, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> Column:
    """Whether a path is among the included globs and none of the excluded ones; empty lists mean the defaults."""
    some = lambda globs: path.rlike("|".join(glob_regex(g) for g in globs))
    return some(include or INCLUDE) & ~some(exclude or EXCLUDE)


def _below(path: Column, root: str) -> Column:
    """A path without the root it lies below."""
    prefix = root.removeprefix("file://").rstrip("/") + "/"
    base = F.regexp_replace(path, "^file:/+", "/")
    return F.when(base.startswith(prefix), F.substring(base, len(prefix) + 1, 1 << 20)).otherwise(base)


def _listed(spark: SparkSession, root: str, include: tuple[str, ...], exclude: tuple[str, ...], config_gate: bool, only: list[str] | None) -> DataFrame:
    """The binary source, with files that aren't wanted dropped from its listing."""
    # metadata paths are encoded as in URLs, where a plus sign is one; a filter of metadata alone prunes the listing
    path = _below(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), root)
    wanted = taken(path, include, exclude) if only is None else path.isin(only)
    if config_gate:
        wanted = wanted & (~path.endswith(".json") | path.rlike(config_parser.GATED.pattern.replace("(^|/)", "(?i)(^|/)")))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(wanted)


def listing(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, config_gate: bool = True) -> DataFrame:
    """file_path, file_size and last_modified of the files to index; no body is read."""
    return _listed(spark, root, include, exclude, config_gate, None).select(_below(F.col("path"), root).alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"))


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, config_gate: bool = True, limit: int = MAX_BYTES, only: list[str] | None = None) -> DataFrame:
    """file_path (below the root), content, checksum, file_size, last_modified, language of the files to index.

    Files that the globs leave out are dropped from the listing; bodies above the limit (0: none) are not read, so these files have no
    content, and their size and time stand in for a checksum. only: these paths instead of globs.
    """
    listed = _listed(spark, root, include, exclude, config_gate, only)
    path, about = _below(F.col("path"), root).alias("file_path"), (F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"))
    small = listed.filter(F.col("length") <= limit) if limit else listed
    rows = small.select(path, F.decode("content", "UTF-8").alias("content"), F.sha2(F.col("content"), 256).alias("checksum"), *about)
    if limit:
        stamp = F.concat_ws(":", F.lit("size"), F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
        rows = rows.unionByName(listed.filter(F.col("length") > limit).select(path, F.lit(None).cast("string").alias("content"), stamp.alias("checksum"), *about))
    return rows.withColumn("language", language_of(F.col("file_path")))


def changed(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned files whose content isn't what is stored (S3)."""
    return scanned.join(files.select("file_path", "checksum"), ["file_path", "checksum"], "left_anti")


def _records(path: str, content: str | None, size: int, parsers: Parsers, limit: int, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, dict]]:
    parse, status, found = parsers.find(path), "complete", {}
    if content is None or size > limit > 0:
        status = "skipped"
    elif parse:
        try:
            found = parse(path, content, wanted) if wanted is not None and getattr(parse, "prunes", False) else parse(path, content)
        except Exception:  # noqa: BLE001  one file must not end the job; its status tells
            status = "partial"
    if wanted is not None:
        yield from ((relation, r) for relation, rows in found.items() if relation in wanted for r in rows)
        return
    counts = {k: len(v) for k, v in found.items() if v}
    yield "files", {"file_path": path, "summary": ", ".join(f"{n} {k}" for k, n in sorted(counts.items())), "parse_status": status, "line_count": (content or "").count("\n") + 1}
    for relation, rows in found.items():
        for r in rows:
            yield relation, r


def parse_files(scanned: DataFrame, limit: int = MAX_BYTES, only: tuple[str, ...] | None = None) -> DataFrame:
    """file_path, relation, payload: all records of the files (S6-S8, S12), or those of some relations, which spares the work for others. limit 0: no limit."""
    kept = frozenset(RELATIONS if only is None else only)
    wanted = None if "files" in kept else kept  # a file's row counts its other records

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers = registry()
        for b in batches:
            rows = [(p, rel, json.dumps(r)) for p, c, n in zip(b["file_path"], b["content"], b["file_size"], strict=True) for rel, r in _records(p, c, n, parsers, limit, wanted) if only is None or rel in kept]
            yield pd.DataFrame(rows, columns=["file_path", "relation", "payload"])

    return scanned.select("file_path", "content", "file_size").mapInPandas(run, "file_path string, relation string, payload string")


def relations(records: DataFrame, scanned: DataFrame) -> dict[str, DataFrame]:
    """The canonical relations of parsed records."""
    out = {}
    for name, schema in RELATIONS.items():
        rows = records.filter(F.col("relation") == name).select(F.from_json("payload", schema).alias("r")).select("r.*")
        if name == "files":
            own = rows.select("file_path", "summary", "parse_status", "line_count")
            rows = scanned.drop("content").join(own, "file_path").withColumn("relative_path", F.col("file_path"))
            rows = rows.select(*[c.split()[0] for c in schema.split(", ")])
        out[name] = rows
    return out


def source_slice(content: Column, start: Column, end: Column, context: int = 0) -> Column:
    """Lines from start to end, and some around them, as far as there are."""
    lines = F.split(content, "\n")
    first = F.greatest(start - context, F.lit(1))
    last = F.least(end + context, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def import_gate(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Exports of files that import something: what an index keeps that stores both together, and only for files with imports (M6)."""
    return exports.join(imports.select("file_path"), "file_path", "left_semi")
