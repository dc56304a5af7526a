"""Removal of repeated byte strings, by merging Burrows-Wheeler transforms of shards.

A string of LENGTH bytes repeats if it also starts earlier: in a document of a smaller id, or earlier in the same one.
Every byte that a repeating string covers is removed; strings are judged on the input.

1. Each window of LENGTH bytes has an anchor, the K bytes in it with the least hash (the leftmost of equals), so equal windows have equal
   anchors. Anchors are counted over the whole corpus; those seen once cannot lie in a repeat. A bitmap of the others,
   of at most MOST_BITS bits, goes to every task; a chance hit costs work, never exactness.
2. The stretch of bytes that the windows of a repeated anchor cover is a segment, a phrase of a dictionary as in prefix-free parsing: equal
   phrases get one name, 128 bits of anchor and hash, and every window of all but the first of them is a repeat. Shards give their phrases
   sorted by name, and phrases of one anchor meet. One that is alone at its anchor has nothing to be merged with; the bytes of the others' first occurrences are fetched.
   With by_name=False this step is left out; a test holds that it settles nothing that the merges don't.
3. Segments with the same anchor but different bytes are cut into shards. Each shard's suffixes are sorted once, over symbols of STEP
   bytes, which gives its Burrows-Wheeler transform. The shards' transforms are merged by refining their interleave: every round
   reads the transforms in the present order, and deals their entries, stably, by symbol. After LENGTH / STEP rounds
   the order is that of the first LENGTH bytes. The boundaries between different prefixes are kept through the rounds,
   so intervals of equal windows come out without sorting the suffixes again. Bytes are compared at the end.
4. An anchor seen more than HOT times is taken apart by window instead: the first of each window's hash is found by aggregation.

Defined results: ids are integers, others are refused with a TypeError; a null text is empty; rows with the same id and text are the same document, and those with the
same id and different texts stand in the order of a hash; a missing id counts as the smallest; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, body, integer_ids, tune

LENGTH, K, STEP = 100, 32, 25
CHUNK, SHARD_BYTES, MERGE_BYTES, HOT = 1 << 19, 14 << 10, 56 << 10, 4096
LEAST_BITS, MOST_BITS, NUMBER_ROWS = 20, 30, 2048
PLACE = 24  # bits of a key that hold the place in a chunk
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes, by doubling."""
    with np.errstate(over="ignore"):
        n = len(data) - k + 1
        part, size, factor = (data.astype(np.uint64) + np.uint64(1)) * FACTOR, 1, FACTOR * FACTOR + np.uint64(2)
        out, done = None, 0
        while k:
            if k & 1:
                if out is None:
                    out, done = part[: len(data) - size + 1], size
                else:
                    m = len(data) - done - size + 1
                    out, done = out[:m] * factor + part[done : done + m], done + size
            k >>= 1
            if k:
                part = part[: len(part) - size] * factor + part[size:]
                size, factor = 2 * size, factor * factor
        out = out[:n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def segments(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, anchors, starts, ends): for each anchor of a text, the stretch that its windows cover."""
    held, size = [], 0

    def work(parts: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        if len(data) < LENGTH:
            return
        h = _rolling(data, K)
        key = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        place = (_least(key, LENGTH - K + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        at = 0
        for i, base, part in parts:
            n = len(part) - LENGTH + 1
            if n > 0:
                own = place[at : at + n]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                last = np.r_[first[1:], n] - 1
                yield i, h[own[first]], first + base, last + base + LENGTH
            at += len(part)

    for i, text in enumerate(texts):
        # a long text is worked in chunks whose windows follow each other
        for base in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            part = text[base : base + CHUNK + LENGTH - 1]
            held.append((i, base, part))
            size += len(part)
            if size >= CHUNK:
                yield from work(held)
                held, size = [], 0
    if held:
        yield from work(held)


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order of ranks, by 16 bits at a time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and keys.max() > 0xFFFF:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Shard:
    """Sorted suffixes of some segments, and the symbol before each: the transform. Symbol 0 ends a segment."""

    def __init__(self, rank: np.ndarray, offset: np.ndarray, terminal: np.ndarray):
        live = np.arange(len(rank))
        for _ in range(LENGTH // STEP):
            before = live[offset[live] >= STEP] - STEP
            live = np.concatenate([terminal, before[_order(rank[before])]])
        self.suffixes = live
        self.transform = np.where(offset[live] >= STEP, rank[np.maximum(live - STEP, 0)], 0)


def merge(transforms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the merged order of suffixes: its place among all shards' suffixes laid end to end, and the class of its prefix."""
    shard = np.concatenate([np.full(len(t), i, np.uint16) for i, t in enumerate(transforms)])
    symbols = np.concatenate(transforms)
    n = len(shard)
    prefix = np.zeros(n, np.int64)
    for _ in range(LENGTH // STEP):
        at = np.empty(n, np.int64)
        at[np.argsort(shard, kind="stable")] = np.arange(n)  # the next entry of its shard's transform
        symbol = symbols[at]
        ends, live = np.flatnonzero(symbol == 0), np.flatnonzero(symbol)
        live = live[_order(symbol[live])]
        dealt, known = symbol[live], prefix[live]
        new = np.ones(n, bool)
        new[len(ends) + 1 :] = (dealt[1:] != dealt[:-1]) | (known[1:] != known[:-1])
        shard = np.concatenate([shard[ends], shard[live]])
        prefix = np.cumsum(new)
    at = np.empty(n, np.int64)
    at[np.argsort(shard, kind="stable")] = np.arange(n)
    return at, prefix


def repeated_windows(parts: list[bytes], where: np.ndarray) -> list[np.ndarray]:
    """For each segment, the starts of its windows that also start earlier. where: numbers that order the segments' first bytes; a window's number is that plus its start."""
    out = [np.zeros(0, np.int64)] * len(parts)
    if not parts:
        return out
    lengths = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    bases = np.concatenate([[0], np.cumsum(lengths + 1)])  # a segment of n bytes has n + 1 suffixes
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    part = np.repeat(np.arange(len(parts)), lengths + 1)
    offset = np.arange(bases[-1]) - bases[part]
    full = offset <= lengths[part] - STEP
    symbol = np.zeros(len(part), np.uint64)
    symbol[full] = _rolling(data, STEP)[(starts[part] + offset)[full]]
    rank = np.zeros(len(part), np.int64)
    rank[full] = np.unique(symbol[full], return_inverse=True)[1] + 1
    shards, first = [], 0
    edges = [0]
    while first < len(parts):
        last = max(first + 1, int(np.searchsorted(bases, bases[first] + SHARD_BYTES, side="right")) - 1)
        a, b = bases[first], bases[last]
        shards.append(Shard(rank[a:b], offset[a:b], np.flatnonzero(~full[a:b])))
        first = last
        edges.append(b)
    at, prefix = merge([s.transform for s in shards])
    suffix = np.concatenate([s.suffixes + e for s, e in zip(shards, edges, strict=False)])[at]
    some = offset[suffix] + LENGTH <= lengths[part[suffix]]
    suffix, prefix = suffix[some], prefix[some]
    if not len(suffix):
        return out
    new = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
    size = np.diff(np.r_[new, len(prefix)])
    number = where[part[suffix]] + offset[suffix]
    least = np.minimum.reduceat(number, new)
    own = np.repeat(np.arange(len(new)), size)
    chosen = np.flatnonzero(number == least[own])
    head = np.full(len(new), -1)
    head[own[chosen[::-1]]] = chosen[::-1]
    hit = np.flatnonzero(number != least[own])
    byte = starts[part[suffix]] + offset[suffix]
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = np.ones(len(hit), bool)
    for i in range(0, len(hit), 1 << 14):
        h = hit[i : i + (1 << 14)]
        same[i : i + len(h)] = (view[byte[h]] == view[byte[head[own[h]]]]).all(1)
    if not same.all():  # symbols of different bytes had one hash: take those classes by their bytes
        odd = np.unique(own[hit[~same]])
        hit = hit[~np.isin(own[hit], odd)]
        for c in odd.tolist():
            best: dict[bytes, int] = {}
            members = np.arange(new[c], new[c] + size[c])
            for m in members[np.argsort(number[members], kind="stable")].tolist():
                w = view[byte[m]].tobytes()
                if best.setdefault(w, int(number[m])) != number[m]:
                    hit = np.append(hit, m)
    found = suffix[hit]
    order = np.lexsort((offset[found], part[found]))
    found = found[order]
    owner = part[found]
    for lo, hi in zip(*(np.searchsorted(owner, np.unique(owner), side=s) for s in ("left", "right")), strict=True):
        out[owner[lo]] = offset[found[lo:hi]]
    return out


def cover(starts: np.ndarray) -> list[tuple[int, int]]:
    """The stretches that windows at these ascending starts cover."""
    if not len(starts):
        return []
    if starts[-1] - starts[0] < LENGTH + len(starts) - 1:  # no room for a gap
        return [(int(starts[0]), int(starts[-1]) + LENGTH)]
    gap = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + LENGTH).tolist(), strict=True))


INTERVALS = pa.schema([("id", pa.int64()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
#: A segment by its anchor and hash, or, without an anchor, an interval to remove.
MET = pa.schema([("route", pa.int64()), ("anchor", pa.int64()), ("hash", pa.int64()), *INTERVALS])
JUDGED = pa.schema([*INTERVALS, ("mark", pa.int64())])
ROWS = pa.schema([("hot", pa.bool_()), ("anchor", pa.int64()), ("id", pa.int64()), ("version", pa.int32()), ("start", pa.int64()), ("data", pa.binary())])


def _table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.bool_(): "boolean", pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _mark(anchor: int, hashed: int, version: int, start: int) -> int:
    """A 64-bit name of one segment of one document."""
    x = (anchor * 0x9E3779B97F4A7C15 ^ hashed * 0xC2B2AE3D27D4EB4F ^ (version * 0x165667B19E3779F9 + start) * 0xD6E8FEB86659FD93) & (1 << 64) - 1
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def _bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for the leading `bits` bits of every hash; at most 2^bits bits come to the driver."""
    place = F.shiftrightunsigned(column, 64 - bits) + 1  # place p has bit p % 32768 of bucket p // 32768 + 1
    rows = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    out = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for bucket, held in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        at = (bucket - 1) * 4096
        part = np.frombuffer(held, np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def _has(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(n * 32).bit_length()))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [x[1] for x in segments([t.as_py() for t in b.column(0)])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["anchor"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _repeated(shared, b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, list]]:
    """For each text of (id, version, bytes): its segments of repeated anchors, as anchor, start, end, hash, hot."""
    from xxhash import xxh3_64_intdigest

    ids, versions, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
    for i, anchors, starts, ends in segments(texts):
        bitmap, bits, busy, busy_bits = shared.value
        some = np.flatnonzero(_has(bitmap, bits, anchors))
        hot = _has(busy, busy_bits, anchors[some]).tolist()
        text = texts[i]
        yield ids[i], versions[i], text, [(a, s, e, _signed(xxh3_64_intdigest(text[s:e])), b) for a, s, e, b in zip(anchors.view(np.int64)[some].tolist(), starts[some].tolist(), ends[some].tolist(), hot, strict=True)]


def _route(anchor: int, hashed: int) -> int:
    """Where a segment of a hot anchor goes; never to the anchor itself, which tells that it isn't hot."""
    to = _signed((anchor * 31 + hashed) & (1 << 64) - 1)
    return to ^ 1 if to == anchor else to


def _meet(shared):
    """A row for each first segment of this task, by hash; intervals for segments that repeat one of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, int, bool], tuple[int, int, int, int]] = {}
        rows: list[tuple] = []

        def firsts() -> Iterator[pa.RecordBatch]:
            nonlocal first
            held = list(first.items())
            first = {}
            for i in range(0, len(held), 20_000):
                # a hot anchor's segments are dealt by their own hashes
                yield _table_of([(_route(a, h) if hot else a, a, h, *at) for (a, h, hot), at in held[i : i + 20_000]], MET)

        for b in batches:
            for d, v, _, found in _repeated(shared, b):
                for a, s, e, h, hot in found:
                    at = (d, v, s, e)
                    held = first.setdefault((a, h, hot), at)
                    if held == at:
                        continue
                    if at < held:
                        first[a, h, hot], at = at, held
                    last = rows[-1] if rows else None
                    if last and last[3:5] == at[:2] and last[5] <= at[2] <= last[6]:
                        rows[-1] = (*last[:6], max(last[6], at[3]))
                    else:
                        rows.append((at[2] * 0x9E3779B1 + at[0] & (1 << 62) - 1, None, None, *at))
                if len(rows) >= 20_000:
                    yield _table_of(rows, MET)
                    rows = []
            if len(first) >= 150_000:
                yield from firsts()
        if rows:
            yield _table_of(rows, MET)
        yield from firsts()

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of MET sorted by anchor, hash and place: intervals for all but the first of equal segments, marks for those with others at their anchor."""
    anchor, hashed, lone, first = None, None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        bare = b.column(1).is_null().to_numpy(zero_copy_only=False)
        out = [pa.RecordBatch.from_arrays([*b.filter(pa.array(bare)).columns[3:], pa.nulls(int(bare.sum()), pa.int64())], schema=JUDGED)]
        b = b.filter(pa.array(~bare))
        if b.num_rows:
            route, a, h, d, v, s, e = (c.to_numpy() for c in (c.fill_null(0) for c in b.columns))
            same = np.r_[(a[0], h[0]) == (anchor, hashed), (a[1:] == a[:-1]) & (h[1:] == h[:-1])]
            new = np.flatnonzero(~same)
            group = np.cumsum(~same) - 1  # -1: goes on with the segment of the batch before
            lead = np.array([first] if first else [(0, 0, 0)] * 1, np.int64)
            firsts = np.concatenate([lead, np.stack([d[new], v[new].astype(np.int64), s[new]], 1)])
            own = firsts[group + 1]
            later = same & ((d != own[:, 0]) | (v != own[:, 1]) | (s != own[:, 2]))  # else a repeated row of the same document
            keep = later.copy()
            marks = np.zeros(len(a), np.int64)
            extra = []
            for i in new.tolist():
                at = (int(d[i]), int(v[i]), int(s[i]), int(e[i]))
                mark = _mark(int(a[i]), int(h[i]), at[1], at[2])
                if a[i] != anchor and route[i] == a[i]:
                    lone = (*at, mark)  # needs no comparison as long as it is the only one
                else:
                    if lone and a[i] == anchor:
                        extra.append(lone)
                    lone = None
                    keep[i], marks[i] = True, mark
                anchor = a[i]
            hashed = h[-1] if len(new) else hashed
            first = tuple(own[-1].tolist())
            some = np.flatnonzero(keep)
            mark = pa.array(marks[some], mask=later[some])
            out.append(pa.RecordBatch.from_arrays([pa.array(d[some]), pa.array(v[some].astype(np.int32)), pa.array(s[some]), pa.array(e[some]), mark], schema=JUDGED))
            if extra:
                out.append(_table_of(extra, JUDGED))
        yield from out


def _fetch(shared, marks, bits: int):
    """The bytes of marked segments, or of all if marks is None; a chance mark gives a row that is compared in vain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, v, text, found in _repeated(shared, b):
                if found:
                    some = found
                    if marks is not None:
                        own = np.array([_mark(a, h, v, s) for a, s, _, h, _ in found], np.int64)
                        some = [x for x, on in zip(found, _has(marks.value, bits, own).tolist(), strict=True) if on]
                    rows += [(hot, a, d, v, s, text[s:e]) for a, s, e, _, hot in some]
            for i in range(0, len(rows), 10_000):
                yield _table_of(rows[i : i + 10_000], ROWS)

    return run


def _merge_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, id, version, start, data) sorted by anchor, as the intervals to remove."""
    pending: list[tuple[int, int, int, bytes]] = []
    size = 0
    out: list[tuple] = []

    def flush() -> None:
        nonlocal pending, size
        docs = {d: i for i, d in enumerate(sorted({(p[0], p[1]) for p in pending}))}
        where = np.array([(docs[p[0], p[1]] << 40) + p[2] for p in pending], np.int64)
        for p, starts in zip(pending, repeated_windows([p[3] for p in pending], where), strict=True):
            out.extend((p[0], p[1], p[2] + s, p[2] + e) for s, e in cover(starts))
        pending, size = [], 0

    def close(group: dict[bytes, tuple[int, int, int]]) -> None:
        nonlocal size
        if len(group) > 1:
            pending.extend((*at, data) for data, at in group.items())
            size += sum(map(len, group))
            if size >= MERGE_BYTES:
                flush()

    group: dict[bytes, tuple[int, int, int]] = {}
    anchor = None
    for b in batches:
        for _, a, d, v, s, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if a != anchor:
                close(group)
                group, anchor = {}, a
            at = (d, v, s)
            held = group.setdefault(data, at)
            if held != at:
                if at < held:
                    group[data], at = at, held
                out.append((*at, at[2] + len(data)))
        if len(out) >= 20_000:
            yield _table_of(out, INTERVALS)
            out = []
    close(group)
    flush()
    for i in range(0, len(out), 20_000):
        yield _table_of(out[i : i + 20_000], INTERVALS)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the segments, by its hash."""
    from xxhash import xxh3_128_digest

    for b in batches:
        ids, versions, starts, data = (b.column(i).to_pylist() for i in range(2, 6))
        rows = [(xxh3_128_digest(x[q : q + LENGTH]), d, v, s + q) for d, v, s, x in zip(ids, versions, starts, data, strict=True) for q in range(len(x) - LENGTH + 1)]
        for i in range(0, len(rows), 20_000):
            yield _table_of(rows[i : i + 20_000], pa.schema([("w", pa.binary()), *list(INTERVALS)[:3]]))


def removed_intervals(spark: SparkSession, docs: DataFrame, scratch: Scratch, hot: int = HOT, by_name: bool = True) -> list[DataFrame]:
    """Tables of id, version, start, end of stretches of repeating strings. docs: id, version and bytes.

    by_name=False skips step 2: the bytes of every segment of a repeated anchor go to the merges. The result is the same, at the cost of more bytes.
    """
    tune(spark)
    texts = docs.filter(F.octet_length("bytes") >= LENGTH).select("id", "version", "bytes")
    counted = texts.select("bytes").mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = scratch.write(counted, "anchors")
    busy = repeated.filter(F.col("n") > hot)
    bits, n_busy = _bits_for(repeated.count()), busy.count()
    busy_bits = _bits_for(n_busy)
    # two bitmaps of at most 2^MOST_BITS bits; one taken for hot by chance is compared by window, with the same result
    shared = spark.sparkContext.broadcast((_bitmap(repeated, "anchor", bits), bits, _bitmap(busy, "anchor", busy_bits), busy_bits))
    scratch.drop("anchors")
    intervals, marks, mark_bits = [], None, 0
    tune(spark, NUMBER_ROWS)  # rows of numbers are many and small; texts stay bounded by bytes
    if by_name:
        met = texts.mapInArrow(_meet(shared), _ddl(MET)).repartition("route").sortWithinPartitions("anchor", "hash", "id", "version", "start")
        judged = scratch.write(met.mapInArrow(_judge, _ddl(JUDGED)), "judged")
        marked = judged.filter("mark is not null").select("mark")
        mark_bits = _bits_for(marked.count())
        marks = spark.sparkContext.broadcast(_bitmap(marked, "mark", mark_bits))
        intervals.append(judged.filter("mark is null").select("id", "version", "start", "end"))
    fetched = texts.mapInArrow(_fetch(shared, marks, mark_bits), _ddl(ROWS))
    if n_busy:
        fetched = scratch.write(fetched, "fetched")
        windows = scratch.write(fetched.filter("hot").mapInArrow(_windows, "w binary, id long, version int, start long"), "windows")
        first = windows.groupBy("w").agg(F.min(F.struct("id", "version", "start")).alias("first"))
        later = windows.join(first, "w").filter(F.struct("id", "version", "start") != F.col("first"))
        intervals.append(scratch.write(later.select("id", "version", "start", (F.col("start") + LENGTH).alias("end")), "later"))
        fetched = fetched.filter("not hot")
    tune(spark)
    merged = fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merge_tasks, _ddl(INTERVALS))
    return [*intervals, scratch.write(merged, "merged")]


def _cut(data: bytes, found: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, and what is left."""
    kept, at, removed, runs = [], 0, 0, 0
    for s, e in sorted(found):
        if s > at or not runs:
            kept.append(data[at:s])
            runs += 1
            removed += e - s
            at = e
        elif e > at:
            removed += e - at
            at = e
    kept.append(data[at:])
    return removed, runs, b"".join(kept)


def dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, with_text: bool = False, by_name: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (kept, the bytes that are left) of every row."""
    integer_ids(docs, doc_id)
    scratch = Scratch(spark, "suffix")
    least = F.lit(-(1 << 63))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), least).alias("id"), F.shiftright(F.xxhash64(body(text)), 32).cast("int").alias("version"), body(text).cast("binary").alias("bytes"))
    intervals = removed_intervals(spark, own.select("id", "version", "bytes"), scratch, hot, by_name)
    found = intervals[0]
    for x in intervals[1:]:
        found = found.union(x)
    touched = found.groupBy("id", "version").agg(F.collect_list(F.struct("start", "end")).alias("found")).withColumn("mark", F.xxhash64("id", "version"))
    touched = scratch.write(touched, "touched")
    bits = _bits_for(touched.count())
    shared = spark.sparkContext.broadcast(_bitmap(touched, "mark", bits))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for data, found in zip(b.column(1), b.column(2), strict=True):
                data = data.as_py()
                removed, runs, kept = _cut(data, [(f["start"], f["end"]) for f in found.as_py() or []])
                for c, x in zip(cols, (len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(x)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays][: len(names) - (not with_text)], names=names[: len(names) - (not with_text)])

    def choose(touched: bool):
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                on = _has(shared.value, bits, b.column(b.schema.get_field_index("mark")).to_numpy())
                yield b.filter(pa.array(on == touched))

        return some

    marked = own.withColumn("mark", F.xxhash64("id", "version"))
    none = pa.nulls(0, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in choose(False)(batches):
            yield from run([pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(b.num_rows, none.type)], names=["doc_id", "bytes", "found"])])

    # only texts that may have lost something are shuffled
    whole = marked.select("doc_id", "bytes", "mark").mapInArrow(run_whole, schema)
    held = marked.mapInArrow(choose(True), marked.schema).join(touched.drop("mark").hint("shuffle_hash"), ["id", "version"], "left")
    return whole.union(held.select("doc_id", "bytes", "found").mapInArrow(run, schema))
