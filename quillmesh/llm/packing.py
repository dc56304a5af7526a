"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Each partition of pieces is packed by best-fit decreasing. Dual-feasible functions give a lower bound for its
number of sequences; a partition that meets its bound is certified optimal and left alone. Partitions with a gap deal
their pieces anew among each other and are packed again, as long as that saves sequences. At the end each
partition gives its emptiest sequence to a common pool, whose parts are packed once more.

Only lengths travel: a piece is (document, piece, start, length, checksum of its ids). A partition holds at most
about PER_GROUP pieces, whatever the input's size or its longest document.

Defined results: a null text is the empty text, one end token; repeated rows are packed as often as they
stand; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, body, tune

CAPACITY, END, SPECIAL = 2048, 0, "<|endoftext|>"
PER_GROUP = 40_000
SAFE_RUN = 50_000  # tiktoken's stack overflows on runs of white space somewhere above 500,000
BLANKS = re.compile(r"\s+")


@lru_cache(2)
def encoder(name: str):
    """The byte-level vocabulary of `name`.json, from its file of ranks; ids equal those of the tokenizers library."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


@lru_cache(2)
def slow_encoder(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str, name: str = "byte_bpe_50k") -> np.ndarray:
    """Ids of the text and the end token, as little-endian unsigned 32-bit numbers."""
    if len(text) > SAFE_RUN and any(m.end() - m.start() > SAFE_RUN for m in BLANKS.finditer(text)):
        return np.array([*slow_encoder(name).encode(text, add_special_tokens=False).ids, END], "<u4")
    enc = encoder(name)
    ids = enc.encode(text, allowed_special="all") if SPECIAL in text else enc.encode_ordinary(text)
    return np.array([*ids, END], "<u4")


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each piece, best-fit decreasing: the fullest sequence that still holds it."""
    out = np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by room left
    some, n = 0, 0  # bit r: a sequence with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_at[room].pop()
            if not open_at[room]:
                some ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        out[i] = at
        if room > size:
            open_at[room - size].append(at)
            some |= 1 << (room - size)
    return out


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: the best of the total and of two families of dual-feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    above, total = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * sizes)
    for small in range(1, capacity // 2 + 1):
        # over capacity - small counts as whole, under small as nothing, the rest as its size
        whole = int(above[capacity - small + 1]) if small else 0
        rest = int(total[capacity - small] - total[small - 1])
        best = max(best, whole + -(-rest // capacity))
    for k in range(1, 41):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times 1 / (k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"
PACKED = "group long, bin long, offset long"


def token_pieces(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with_ids adds their ids."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_at, rows, held = [], [], []
            for i, x in enumerate(b.column(1)):
                ids = token_ids(x.as_py(), tokenizer)
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    docs_at.append(i)
                    part = ids[start : start + length]
                    rows.append((k, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        held.append(part.tolist())
            if rows:
                piece, start, length, crc = zip(*rows, strict=True)
                cols = [b.column(0).take(pa.array(docs_at)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(held, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = PIECES.format(docs.schema[doc_id].dataType.simpleString()) + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text")).mapInArrow(run, schema)


def _pack_group(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable")
        at = best_fit(pdf["length"].to_numpy(), capacity)
        order = np.argsort(at, kind="stable")
        pdf = pdf.iloc[order]
        at, size = at[order], pdf["length"].to_numpy()
        before = np.cumsum(size) - size
        first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        offset = before - before[first][np.cumsum(first) - 1]
        return pdf.assign(bin=at, offset=offset, bound=lower_bound(size, capacity))

    return pack


def pack_pieces(spark: SparkSession, pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, per_group: int = PER_GROUP) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a written table."""
    names = pieces.columns
    keyed = pieces.withColumn("key", F.xxhash64(*[F.col(c) for c in names if c != "ids"]))
    n = pieces.count()
    groups = max(1, -(-n // per_group))

    def packed(rows: DataFrame, seed: int, n_groups: int, first: int, name: str) -> DataFrame:
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("key", "doc_id", "piece", F.lit(seed)), F.lit(n_groups)) + first)
        out = dealt.repartition(n_groups, "group").groupBy("group").applyInPandas(_pack_group(capacity), schema=f"{dealt._jdf.schema().toDDL()}, bin long, offset long, bound long")
        return scratch.write(out, name)

    rows = keyed.withColumn("key", F.col("key"))
    done = packed(rows, 0, groups, 0, "round-0")
    bare = done.columns
    rows_of = [c for c in bare if c not in ("group", "bin", "offset", "bound")]
    first, held = groups, ["round-0"]
    final: list[DataFrame] = []
    for r in itertools.count(1):  # each round but the last saves a sequence
        # one row a partition: its sequences, and the bound that certifies them
        state = done.groupBy("group").agg((F.max("bin") + 1).alias("n"), F.first("bound").alias("bound"))
        gaps = scratch.write(state.filter("n > bound").select("group", "n"), f"gaps-{r}")
        n_gaps, before = gaps.agg(F.count("*"), F.sum("n")).first()
        if n_gaps < 2:
            break
        tried = packed(done.join(gaps.select("group"), "group", "left_semi").select(*rows_of), r, n_gaps, first, f"round-{r}")
        held.append(f"round-{r}")
        after = tried.groupBy("group").agg((F.max("bin") + 1).alias("n")).agg(F.sum("n")).first()[0]
        if after >= before:
            scratch.drop(held.pop())
            break
        final.append(done.join(gaps.select("group"), "group", "left_anti").select(*bare))
        done, first = tried, first + n_gaps
    for d in final:
        done = done.unionByName(d)
    # each partition's emptiest sequence goes to the pool: one row a partition tells which
    if n and groups > 1:
        fill = done.groupBy("group", "bin").agg(F.sum("length").alias("fill"))
        least = fill.groupBy("group").agg(F.min(F.struct("fill", "bin")).alias("x")).select("group", F.col("x.bin").alias("bin"), F.lit(True).alias("pooled"))
        marked = done.join(least, ["group", "bin"], "left")
        pool = marked.filter("pooled").select(*rows_of)
        pools = max(1, -(-groups * 64 // per_group))
        again = packed(pool, -1, pools, first, "pool")
        done = marked.filter("pooled is null").select(*bare).unionByName(again)
    return done.select(*names, ((F.col("group") * (1 << 24)) + F.col("bin")).alias("sequence_id"), "offset")


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(token_pieces(spark, docs, capacity, tokenizer, doc_id, text, with_ids), "pieces")
    return pack_pieces(spark, pieces, scratch, capacity)
