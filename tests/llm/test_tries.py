import hashlib
import random
import zlib

import pytest

from quillmesh.llm import tries


def _plain(rows, group=100, most=6):
    """Rebuilt conversations, all their prefixes, and every subtree by prefix."""
    talks = {}
    for c, n, r, t in rows:
        if c is not None:
            talks.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    talks = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(talks.get(int(c / group) * group, [])[:h] + own[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, convs in nodes.items():
        under = [x for x in nodes if x[: len(path)] == path]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in under if x)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        out.append((min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), sum(len(x) == len(path) + 1 for x in under), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _run(spark, rows, **how):
    turns = spark.createDataFrame([(*x, "q", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(6)
    found = tries.branched_trie(spark, turns, **how)
    assert found.columns == ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r)[1:] for r in found.collect()), key=str)


def _talks(r, n):
    return [(c, t, r.choice(["user", "assistant", None, "ab"]), r.choice(["", None, "b", "é☃", "long " * r.randint(1, 300)])) for c in range(n) for t in range(r.choice([1, 2, 3, 7]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_prefixes(spark, seed):
    r = random.Random(seed)
    rows = _talks(r, 230)
    rows += [(3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (4, 1, "user", "twice"), (4, 1, "user", "twice"), (5, None, "user", "first"), (None, 0, "user", "none"), (-7, 0, "user", "below"), (90_000, 0, "user", "x")]
    assert _run(spark, rows) == _plain(rows)


def test_copies_and_small_tables(spark, monkeypatch):
    """Many conversations that end at one node, in many runs; tries emitted early; merges in several rounds; deep paths."""
    monkeypatch.setattr(tries, "RUN", 3)
    monkeypatch.setattr(tries, "MOST_NODES", 5)
    monkeypatch.setattr(tries, "FAN_IN", 2)
    rows = [(c, t, "user", "same") for c in range(150) for t in range(2)] + [(c, t, "user", f"{c % 5}{t}") for c in range(200, 260) for t in range(9)] + [(299, t, "user", "deep") for t in range(600)]
    got = _run(spark, rows)
    assert got == _plain(rows) and max(r[1] for r in got) == 600
    assert _run(spark, [(100, 0, "user", "a")]) == _plain([(100, 0, "user", "a")])
    assert _run(spark, [(101, 0, None, None)]) == _plain([(101, 0, None, None)])
    assert _run(spark, []) == []


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        tries.branched_trie(spark, spark.createDataFrame([("a", 0, "user", "x")], "conv_id string, turn long, role string, text string"))
