import random

import numpy as np
import pytest

from quillmesh.llm import neardup, simhash

WORDS = [f"{a}{b}" for a in "ka lo mi ne pu ra so te".split() for b in "ba de fi go hu".split()]


def _texts():
    """Families whose members have 1 to 4 words of 120 replaced, texts alone, copies and empty texts."""
    r = random.Random(4)
    out = []
    for _ in range(40):
        base = [r.choice(WORDS) for _ in range(120)]
        for _ in range(4):
            words = base[:]
            for at in r.sample(range(120), r.randint(1, 4)):
                words[at] = "x" + r.choice(WORDS)
            out.append(" ".join(words))
    out += [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))) for _ in range(60)]
    return [*out, out[3], out[170].upper(), "", None]


def _plain(texts):
    """Links and the least place in each component, by brute force."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    label, links = list(range(len(texts))), []
    for b in range(len(texts)):
        for a in range(b):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                links.append((a, b))
                x, y = sorted((label[a], label[b]))
                label = [x if c == y else c for c in label]
    return links, label


@pytest.mark.parametrize("block", [neardup.BLOCK, 2])
def test_all_links_of_similarity_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = _texts()
    links, label = _plain(texts)
    fps = simhash.fingerprints([t or "" for t in texts]).tolist()
    far = [p for p in links if bin(fps[p[0]] ^ fps[p[1]]).count("1") > simhash.DISTANCE]
    assert len(far) > 20  # op9's rule loses these
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_one(spark, docs).collect()) == sorted(set(label))


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "g h"), (None, "g h"), (7, "q"), (7, "q")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(spark, docs).collect()), key=str) == [(5, "g h"), (7, "q"), (None, "a b c d e f")]
    assert neardup.keep_one(spark, docs.limit(0)).count() == 0


def test_rows_without_ids_stay_only_alone_and_names_may_clash(spark):
    t, u = "t " * 9, "u v w x y z"
    rows = [(8, "", 1, 2), (None, "", 1, 2), (3, t, 1, 2), (None, t, 1, 2), (None, u, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, Kept_Set int").withColumnRenamed("Kept_Set", "KEPT_SET")
    got = neardup.keep_one(spark, docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("3", t), ("8", ""), ("None", u)]


def test_candidates_come_from_fingerprints_too(spark):
    """The pairs that the SimHash operator links are tested, before any band is looked at."""
    r = random.Random(3)
    base = [r.choice(WORDS) + str(i) for i in range(400)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join([*base, "end"]), "other words here now and then"]
    fps = simhash.fingerprints(texts, 5).tolist()
    assert all(bin(fps[0] ^ f).count("1") <= simhash.DISTANCE for f in fps[:3])
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    scratch = neardup.Scratch(spark, "test")
    found = neardup.components(spark, docs, scratch)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    named = [neardup.set_hash(neardup.shingle_set(t)) for t in texts]
    pairs = {x for r in spark.read.parquet(scratch.paths["pairs"]).collect() for x in (r["u"], r["v"])}
    assert pairs == set(named[:3])
