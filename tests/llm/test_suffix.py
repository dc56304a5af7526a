import hashlib
import os
import random

import numpy as np
import pytest

from quillmesh.llm import suffix


def _brute(docs):
    """docs: (id, bytes) with distinct ids -> id: removed bytes, runs, kept."""
    first, out = {}, {}
    for d, data in sorted(docs):
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if first.setdefault(data[s : s + 100], (d, s)) != (d, s):
                gone[s : s + 100] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)) == 1)
        out[d] = (int(gone.sum()), len(edges), np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def _corpus(r, n):
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(60, 400))) for _ in range(6)]
    docs = []
    for i in range(n):
        x = r.random()
        if x < 0.15 and docs:
            text = docs[r.randrange(len(docs))]
        elif x < 0.3 and docs:
            text = docs[r.randrange(len(docs))]
            if text:
                at = r.randrange(len(text))
                text = text[:at] + r.choice("xyz") + text[at + r.randint(0, 3) :]
        elif x < 0.4:
            text = r.choice(["la, ", "a", "ab", "abcdefghijklmnopqrstuvwxyz" * 3]) * r.randint(1, 200)
        else:
            text = "".join(r.choice([r.choice(passages), "".join(r.choice("efgh ") for _ in range(r.randint(0, 150)))]) for _ in range(r.randint(0, 5)))
        docs.append(text)
    return docs


def test_merge_finds_repeated_windows(monkeypatch):
    r = random.Random(7)
    for shard in (300, 1 << 18):
        monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
        for _ in range(40):
            parts = [t.encode()[: r.randint(100, 260)] for t in _corpus(r, 30)]
            parts = [p for p in parts if len(p) >= 100]
            got = suffix.repeated_windows(parts, np.arange(len(parts)) << 40)
            seen = {}
            for i, p in enumerate(parts):
                want = [q for q in range(len(p) - 99) if seen.setdefault(p[q : q + 100], (i, q)) != (i, q)]
                assert got[i].tolist() == want


@pytest.mark.parametrize("seed,hot", [(0, 4096), (1, 4096), (2, 0)])
def test_dedup_equals_brute_force(spark, seed, hot, monkeypatch):
    r = random.Random(seed)
    texts = _corpus(r, 120)
    ids = r.sample(range(1000), len(texts))
    if seed == 1:
        monkeypatch.setattr(suffix, "CHUNK", 500)
    rows = [(d, t, 1) for d, t in zip(ids, texts, strict=True)]
    want = _brute([(d, t.encode()) for d, t, _ in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = suffix.dedup(spark, docs, hot=hot, with_text=True).collect()
    assert len(got) == len(rows)
    for x in got:
        removed, runs, kept = want[x["doc_id"]]
        assert (x["n_removed"], x["n_spans"], bytes(x["kept"])) == (removed, runs, kept)
        assert x["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_odd_rows(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdef ") for _ in range(3000))
    rows = [(1, None, 1), (2, "", 1), (3, "short", 1), (4, long, 1), (4, long, 1), (None, long[:500], 2), (5, "x" + long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"]) for x in suffix.dedup(spark, docs).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("3", 5, 0), ("4", 3000, 500), ("4", 3000, 500), ("5", 3001, 3000), ("None", 500, 0)]
    assert suffix.dedup(spark, docs.limit(0)).count() == 0


def _by_merges(docs):
    """id: removed bytes, runs, kept, with every segment of a repeated anchor, equal ones too, put through the merged transforms."""
    docs = sorted(docs)
    members = {}
    for i, anchors, starts, ends in suffix.segments([data for _, data in docs]):
        for a, s, e in zip(anchors.tolist(), starts.tolist(), ends.tolist()):
            members.setdefault(a, []).append((i, s, e))
    found, batch, size = [[] for _ in docs], [], 0

    def flush():
        where = np.array([(i << 40) + s for i, s, _ in batch], np.int64)
        for (i, s, _), hits in zip(batch, suffix.repeated_windows([docs[i][1][s:e] for i, s, e in batch], where)):
            found[i].extend((s + a, s + b) for a, b in suffix.cover(hits))

    for held in members.values():
        if len(held) > 1:
            batch += held
            size += sum(e - s for _, s, e in held)
            if size > 200_000:
                flush()
                batch, size = [], 0
    flush()
    out = {}
    for (d, data), spans in zip(docs, found):
        removed, runs, kept = suffix._cut(data, spans)
        out[d] = (removed, runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("table", ["generated", "/root/testdata/sf0.01/documents.parquet"])
def test_names_settle_nothing_that_the_merge_does_not_confirm(spark, table):
    if table == "generated":
        r = random.Random(12)
        docs = spark.createDataFrame(list(enumerate(_corpus(r, 250))), "doc_id long, text string")
    elif os.path.exists(table):
        docs = spark.read.parquet(table)
    else:
        pytest.skip("no such table here")
    want = _by_merges([(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()])
    assert sum(x[0] for x in want.values()) > 10_000
    for by_name in (True, False):
        got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(spark, docs, by_name=by_name).collect()}
        assert got == want


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        suffix.dedup(spark, spark.createDataFrame([("x1", "a")], "doc_id string, text string"))
