import random
import re

import numpy as np
import pytest
import xxhash

from quillmesh.llm import simhash


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _components(fps, distance):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def _family(r, n):
    """Fingerprints in chains a few bits apart, and strays."""
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            out.append(x)
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
    return out[:n]


def test_fingerprints_match_the_definition():
    texts = ["", "One", "ONE two", "Ä b c d", "a b c d e f g a b c d", " x\x0b y\tz ", "word " * 300, None]
    r = random.Random(1)
    texts += [" ".join(r.choice("ab cd EF gh ü".split()) for _ in range(r.randint(1, 60))) for _ in range(40)]
    assert simhash.fingerprints([t or "" for t in texts]).tolist() == [_fingerprint(t) for t in texts]


@pytest.mark.parametrize("seed", range(2))
def test_links_lose_nothing(spark, seed, monkeypatch):
    r = random.Random(seed)
    fps = list(dict.fromkeys(_family(r, 140)))
    want = _components(fps, 4)
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)]
    table = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprint_table", lambda *a: table)
    docs = spark.createDataFrame([], "doc_id long, text string")
    for split in (1 << 15, 3):
        got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark, docs, split=split).collect()}
        assert [got[i] for i in range(len(fps))] == want


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(3, base, 1), (1, base + " end", 1), (9, None, 2), (8, "", 2), (8, "", 2), (None, "", 3), (20, "quite another text of some words", 1), (None, "all alone here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((x["doc_id"], x["fp"], x["component_id"]) for x in simhash.near_duplicates(spark, docs).collect()), key=str)
    near = bin(_fingerprint(base) ^ _fingerprint(base + " end")).count("1") <= 4
    comp = {x[0]: x[2] for x in got if x[0] is not None}
    assert len(got) == len(rows) and comp[9] == comp[8] == 8 and comp[20] == 20 and comp[3] == (1 if near else 3)
    with pytest.raises(TypeError):
        simhash.near_duplicates(spark, spark.createDataFrame([("x1", "a")], "doc_id string, text string"))
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_long_text():
    words = [str(i % 977) for i in range(150_000)]
    fp = simhash.fingerprints([" ".join(words)])
    assert fp.dtype == np.uint64 and fp.tolist() == [_fingerprint(" ".join(words))]
