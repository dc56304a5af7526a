import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmesh.llm import lm


def _corpus(r, n):
    chain = {w: r.sample("alpha beta gamma delta epsilon zeta eta theta iota kappa Ünder w1 w2 w3".split(), 3) for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa Ünder w1 w2 w3".split()}
    texts = []
    for i in range(n):
        w, out = r.choice(sorted(chain)), []
        for _ in range(r.randint(0, 60)):
            out.append(w if r.random() > 0.03 else f"rare{r.randint(0, 500)}")
            w = r.choice(chain[w])
        texts.append(" ".join(out).title() if i % 5 == 0 else " ".join(out))
    return texts


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def test_scores(spark):
    texts = _corpus(random.Random(1), 900)
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(5000, None, 1.0), (5001, "", 1.0), (None, "alpha beta", 1.0), (7, texts[7], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    got = lm.score(spark, docs).toPandas()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for d, t, _ in rows if not held(d) for w in _tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and (got.train_tokens == n).all()
    want = {}
    for d, t, _ in rows:
        words = _tokens(t)
        want[-1 if d is None else d] = (held(d), len(words), sum(w in counts for w in words), sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    for x in got.itertuples():
        h, size, known, base = want[-1 if np.isnan(x.doc_id) else int(x.doc_id)]
        assert (x.held_out, x.n_tokens, x.n_known) == (h, size, known) and x.base_score == pytest.approx(base)
        assert x.score < 0
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() + 50  # it learns which word follows which
    assert lm.score(spark, docs.limit(0)).count() == 0


def test_probabilities_add_up_and_lanes_do_not_matter(monkeypatch):
    texts = _corpus(random.Random(2), 120)
    counts = Counter(w for t in texts for w in lm.tokens(t))
    rare = {}
    for w, c in counts.items():
        a, b = rare.get(lm.bucket(w), (0, 0))
        rare[lm.bucket(w)] = (a + c, b + 1)
    monkeypatch.setattr(lm, "MODEL_WORDS", 10)
    monkeypatch.setattr(lm, "START", 10 + lm.RARE)
    v = lm.Vocabulary(sorted(counts.items(), key=lambda r: (-r[1], r[0])), sum(counts.values()), len(counts), rare)
    p = lm.train(lm.initial(v), v, [v.encode(t)[1] for t in texts])
    state = np.random.default_rng(0).standard_normal((lm.HIDDEN, 1)).astype(np.float32)
    total = sum(np.exp(lm._output(p, v, state, np.array([t]))[0][0]) for t in range(10 + lm.RARE))
    assert total == pytest.approx(1, abs=1e-4)
    docs = [v.encode(t)[1] for t in texts]
    whole = lm.log_likelihoods(p, v, docs)
    monkeypatch.setattr(lm, "LANES", 3)
    monkeypatch.setattr(lm, "WINDOW", 5)  # the state goes on from window to window
    assert lm.log_likelihoods(p, v, docs) == pytest.approx(whole, rel=1e-4)


def _rare(counts):
    rare = {}
    for w, c in counts.items():
        a, b = rare.get(lm.bucket(w), (0, 0))
        rare[lm.bucket(w)] = (a + c, b + 1)
    return rare


def test_output_gradient():
    """The output layer against finite differences."""
    counts = Counter(w for t in _corpus(random.Random(3), 40) for w in lm.tokens(t))
    rare = _rare(counts)
    v = lm.Vocabulary(sorted(counts.items(), key=lambda r: (-r[1], r[0])), sum(counts.values()), len(counts), rare)
    r = np.random.default_rng(1)
    p = {k: (x + 0.1 * r.standard_normal(x.shape)).astype(np.float64) for k, x in lm.initial(v).items()}
    state, target = r.standard_normal((lm.HIDDEN, 6)), np.array([0, 1, 2, 3, lm.MODEL_WORDS + 2, 5])
    grad = {k: np.zeros_like(x) for k, x in p.items()}
    _, back = lm._output(p, v, state, target, grad)
    for name, at in (("c", (3, 4)), ("cb", (7,)), ("w", (2, 1)), ("wb", (5,))):
        moved = {k: x.copy() for k, x in p.items()}
        moved[name][at] += 1e-5
        slope = (lm._output(p, v, state, target)[0].sum() - lm._output(moved, v, state, target)[0].sum()) / 1e-5
        assert slope == pytest.approx(grad[name][at], abs=1e-3)
    moved = state.copy()
    moved[3, 2] += 1e-5
    assert (lm._output(p, v, state, target)[0].sum() - lm._output(p, v, moved, target)[0].sum()) / 1e-5 == pytest.approx(back[3, 2], abs=1e-3)


def test_recurrent_gradient():
    """Backpropagation through a window of several lanes, with starts of texts and places without tokens, against finite differences."""
    counts = Counter(w for t in _corpus(random.Random(4), 40) for w in lm.tokens(t))
    v = lm.Vocabulary(sorted(counts.items(), key=lambda r: (-r[1], r[0])), sum(counts.values()), len(counts), _rare(counts))
    r = np.random.default_rng(2)
    p = {k: (x + 0.3 * r.standard_normal(x.shape)).astype(np.float64) for k, x in lm.initial(v).items()}
    targets = r.integers(0, v.n_model, (5, 3))
    inputs = np.vstack([np.full((1, 3), lm.START), targets[:-1]])
    inputs[2, 1], inputs[0, 2] = lm.START, 4
    live = np.ones((5, 3), bool)
    live[4, 2] = live[3, 2] = False
    state = r.standard_normal((lm.HIDDEN, 3))
    run = lambda q: lm.gradients(q, v, inputs, targets, live, state)
    _, grad, rows, _ = run(p)
    places = [("u", (2, 3)), ("u", (5, 40)), ("u", (1, 70)), ("b", (3,)), ("b", (35,)), ("b", (80,)), ("c", (3, 4)), ("w", (int(targets[0, 0]), 1))]
    places += [("x", (int(inputs[1, 0]), k)) for k in (0, 33, 90)] + [("x", (lm.START, k)) for k in (1, 34, 91)]
    for name, at in places:
        up, down = ({k: x.copy() for k, x in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = -(run(up)[0] - run(down)[0]) / 2e-5
        held = grad[name][(int(np.searchsorted(rows, at[0])), *at[1:])] if name == "x" else grad[name][at]
        assert slope == pytest.approx(held, abs=1e-6), (name, at)
    untouched = [i for i in range(lm.START) if i not in set(inputs.ravel().tolist())]
    assert not set(untouched) & set(rows.tolist())


def test_training_uses_every_token(monkeypatch):
    counts = Counter(w for t in _corpus(random.Random(5), 60) for w in lm.tokens(t))
    v = lm.Vocabulary(sorted(counts.items(), key=lambda r: (-r[1], r[0])), sum(counts.values()), len(counts), _rare(counts))
    docs = [v.encode(t)[1] for t in _corpus(random.Random(6), 50)] + [v.encode("alpha " * 700)[1]]
    seen, real = [], lm.gradients
    monkeypatch.setattr(lm, "gradients", lambda p, v, i, t, live, s: seen.append(int(live.sum())) or real(p, v, i, t, live, s))
    lm.train(lm.initial(v), v, docs)
    assert sum(seen) == sum(map(len, docs))


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARE_TOKENS", 3000)  # several shares
    rows = [(i, t) for i, t in enumerate(_corpus(random.Random(7), 500))] + [(None, "alpha beta"), (3, "beta"), (3, "beta"), (600, "gamma delta " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in lm.score(spark, d).collect())
    for (i, n, a), (j, m, b) in zip(score(docs.repartition(2)), score(docs.orderBy("text").repartition(7)), strict=True):
        assert (i, n) == (j, m) and abs(a - b) <= 1e-6 * n


def test_network_trains_on_every_training_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "fit", lambda spark, encoded, v: seen.append(encoded.count()) or lm.initial(v))
    docs = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(100)], "doc_id long, text string")
    lm.score(spark, docs)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(100))]


def test_few_texts_extra_columns_and_text_ids(spark):
    docs = spark.createDataFrame([("x1", "alpha", 1, 2, "z"), (None, None, 3, 4, "z")], "doc_id string, text string, n_tokens int, row int, tail string")
    got = lm.score(spark, docs)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and got.count() == 2


def test_few_exponentials_for_each_token(monkeypatch):
    """Groups, classes and words are told apart step by step, so a token takes far fewer exponentials than there are classes."""
    rows = [(f"w{i}".encode(), 100_000 // (i + 1)) for i in range(lm.MODEL_WORDS)]
    rare = _rare(dict(rows))
    v = lm.Vocabulary(rows, 2 * sum(c for _, c in rows), len(rows), {b: (2 * n, k) for b, (n, k) in rare.items()})
    r = np.random.default_rng(3)
    target = np.r_[r.choice(lm.MODEL_WORDS, 2000, p=v.counts / v.counts.sum()), lm.MODEL_WORDS + r.integers(0, lm.RARE, 1000)]
    done, real = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: done.append(np.size(x)) or real(x, *a, **k))
    lm._output(lm.initial(v), v, np.zeros((lm.HIDDEN, 3000), np.float32), target)
    assert 0 < sum(done) < 3000 * 64


def test_averaged_shares_keep_what_one_share_learns(spark, monkeypatch):
    texts = _corpus(random.Random(8), 2500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gains = []
    for n in (1 << 30, 15_000):
        monkeypatch.setattr(lm, "SHARE_TOKENS", n)
        out = lm.score(spark, docs).filter("held_out").toPandas()
        gains.append(out.score.sum() - out.base_score.sum())
    assert gains[1] > 0.8 * gains[0] > 0


def test_many_texts_are_encoded_as_one_by_one():
    texts = [*_corpus(random.Random(9), 80), "", " ", "\t a\x0bb \r", "x\x1cy É\x85Ab　c", "zz ZZ q zz", "".join(f"a{chr(i)}B" for i in range(300))]
    counts = Counter(w for t in texts[:60] for w in lm.tokens(t))
    rows = sorted(counts.items(), key=lambda r: (-r[1], r[0]))[1:20]  # without the ends, which may be beyond the head
    ids = {w: i for i, (w, _) in enumerate(rows)}
    v = lm.Vocabulary(rows, sum(counts.values()), len(counts), _rare(counts))
    n, head, net, tail, of = v.encode_all(pa.array(texts))
    words = [lm.tokens(t) for t in texts]
    assert n.tolist() == [len(w) for w in words]
    flat = [w for some in words for w in some]
    assert head.tolist() == [ids.get(w, -1) for w in flat]
    assert net.tolist() == [ids[w] if w in ids else lm.MODEL_WORDS + lm.bucket(w) for w in flat]
    assert [(int(i), w) for i, w in zip(of, tail.to_pylist(), strict=True)] == [(i, w) for i, some in enumerate(words) for w in some if w not in ids]


def test_sums_of_rows_by_id():
    r = np.random.default_rng(4)
    ids, rows = np.minimum(r.geometric(0.02, 3000), 60), r.standard_normal((3000, 5))
    want = np.zeros((61, 5))
    np.add.at(want, ids, rows)
    found, sums = lm._sums(ids, rows)
    assert found.tolist() == sorted(set(ids.tolist())) and np.allclose(sums, want[found])


def test_scores_equal_a_plain_evaluation_token_by_token(spark, monkeypatch):
    texts = _corpus(random.Random(10), 150)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for d, t in enumerate(texts) if not held(d) for w in lm.tokens(t))
    r, kept = np.random.default_rng(5), []

    def fit(spark, encoded, v):
        kept.append((v, {k: (x + 0.3 * r.standard_normal(x.shape)).astype(np.float32) for k, x in lm.initial(v).items()}))
        return kept[0][1]

    monkeypatch.setattr(lm, "HEAD", 12)  # so that known words are rare, too
    monkeypatch.setattr(lm, "fit", fit)
    got = {x.doc_id: x.score for x in lm.score(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    v, p = kept[0][0], {k: x.astype(float) for k, x in kept[0][1].items()}
    model = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:12]
    h, per, sigmoid = lm.HIDDEN, lm.CLASSES // lm.GROUPS, lambda x: 1 / (1 + np.exp(-x))
    among = lambda logits, i: logits[i] - np.log(np.exp(logits).sum())
    for d, t in enumerate(texts):
        state, before, total = np.zeros(h), lm.START, 0.0
        for w in lm.tokens(t):
            x, g = p["x"][before] + p["b"], state @ p["u"]
            z, reset = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
            m = np.tanh(x[2 * h :] + reset * g[2 * h :])
            state = z * state + (1 - z) * m
            groups, classes = state @ p["g"] + p["gb"], state @ p["c"] + p["cb"]
            if w in model:
                before = model.index(w)
                c = int(v.word_class[before])
                own = [i for i in range(12) if v.word_class[i] == c]
                total += among(groups, c // per) + among(classes[c - c % per : c - c % per + per], c % per) + among(p["w"][own] @ state + p["wb"][own], own.index(before))
            else:
                b = lm.bucket(w)
                before = lm.MODEL_WORDS + b
                others = [n for k, n in counts.items() if lm.bucket(k) == b and k not in model]
                total += among(groups, lm.GROUPS) + among(classes[lm.CLASSES :], b) + np.log((counts[w] + 0.5) / (sum(others) + 0.5 * (len(others) + 1)))
        assert got[d] == pytest.approx(total / np.log(10), rel=1e-4)
