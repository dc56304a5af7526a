import random

import pytest

from quillmesh.llm import sharding


def _sums_of(sizes):
    def sums(bits, parents, parent_bits):
        out = {}
        for h, size in sizes.items():
            u = h & ((1 << 64) - 1)
            if parents is not None and (u >> (64 - parent_bits)) not in parents:
                continue
            p = u >> (64 - bits)
            r = out.setdefault(p, {"prefix": p, "bytes": 0, "low": h, "high": h})
            r["bytes"] += size
            r["low"], r["high"] = min(r["low"], h), max(r["high"], h)
        return list(out.values())

    return sums


def _heavy(sizes, n):
    """Groups that get a shard of their own."""
    rest, left, heavy = sum(sizes), n, []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if left > 2 and sizes[k] * left > rest and len(sizes) - len(heavy) > 1:
            heavy.append(k)
            rest, left = rest - sizes[k], left - 1
        else:
            break
    while sum(k not in heavy and (k == 0 or k - 1 in heavy) for k in range(len(sizes))) > n - len(heavy):
        heavy.pop()
    return set(heavy)


def _brute(sizes, n):
    """The shard of each group: greedy cuts at the least capacity, tried one by one."""
    heavy = _heavy(sizes, n)

    def cut(c):
        shards, at, room = [], -1, 0
        for k, s in enumerate(sizes):
            if k in heavy:
                at, room = at + 1, 0
            elif s > c:
                return None
            elif s > room:
                at, room = at + 1, c - s
            else:
                room -= s
            shards.append(at)
        return shards if at < n else None

    c = 1
    while (out := cut(c)) is None:
        c += 1
    return out


@pytest.mark.parametrize("seed", range(24))
def test_cuts_are_those_of_the_greedy_scan_at_the_least_capacity(seed):
    r = random.Random(seed)
    n_groups, n = r.choice([1, 3, 40, 300]), r.choice([1, 2, 5, 8])
    tight = r.random() < 0.5  # many hashes in one range, so it is split often
    sizes = {r.getrandbits(30 if tight else 64) - (0 if tight else 1 << 63): r.randint(1, 60) for _ in range(n_groups)}
    if seed % 3 == 0:  # hot groups
        for h in r.sample(sorted(sizes), min(3, len(sizes))):
            sizes[h] = r.choice([400, 3000])
    cuts = sharding.plan_cuts(_sums_of(sizes), n)
    order = sorted(sizes, key=lambda h: h & ((1 << 64) - 1))
    assert [sum((h & ((1 << 64) - 1)) >= c for c in cuts) for h in order] == _brute([sizes[h] for h in order], n)


def test_shards_and_slots(spark):
    rows = [(i, "t%d" % (i % 50) if i % 3 else "hot", 1) for i in range(300)] + [(None, None, 2), (7, "", 2), (7, "x" * 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(spark, docs, 8).toPandas()
    assert len(got) == len(rows) and got.doc_id.isna().sum() == 1
    assert got.groupby("text_hash").shard.nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard_documents(spark, docs.limit(0), 8).count() == 0
