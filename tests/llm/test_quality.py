import random
import zlib

import numpy as np

from quillmesh.llm import quality


def _texts(r, n):
    good = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(5, 120)))
    bad = lambda: r.choice([lambda: "SHOUT!! " * r.randint(5, 80), lambda: "w%%% x### y$$$ " * r.randint(3, 40), lambda: " | ".join("ab" for _ in range(40))])()
    return [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = _texts(random.Random(1), 900)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "alpha beta gamma", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(spark, docs, labels, per_label=150)
    got = quality.scores(spark, docs, model).toPandas()
    assert len(got) == 904 and got.score.between(0, 1).all()
    truth = {d: y for d, _, y in rows}
    held = got[got.doc_id.map(lambda d: not np.isnan(d) and int(d) in truth and zlib.crc32(str(int(d)).encode()) % 5 == 0)]
    right = [(s >= quality.THRESHOLD) == truth[int(d)] for d, s in zip(held.doc_id, held.score, strict=True)]
    assert len(right) > 100 and np.mean(right) > 0.97
    kept = quality.scores(spark, docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() == (got.score >= quality.THRESHOLD).sum()
    assert quality.scores(spark, docs.limit(0), model).count() == 0
    none = quality.fit(spark, docs, labels.limit(0))
    assert (quality.scores(spark, docs, none).toPandas().score == 0.5).all()
    ones = quality.fit(spark, docs, labels.filter("quality = 1"))
    assert (quality.scores(spark, docs, ones).toPandas().score == 1).all()


def test_vote_equals_brute_force():
    r = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    model = {"labels": r.integers(0, 2, 200).astype(float), "vectors": unit(r.standard_normal((200, 8))).astype(np.float32)}
    q = unit(r.standard_normal((50, 8))).astype(np.float32)
    for x, got in zip(q, quality.vote(model, q, 7), strict=True):
        sims = model["vectors"] @ x
        near = np.argsort(-sims)[:7]
        w = np.exp(quality.SHARPNESS * sims[near].astype(float))
        assert abs(got - (w * model["labels"][near]).sum() / w.sum()) < 1e-5
