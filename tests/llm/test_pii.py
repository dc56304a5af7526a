import itertools
import random
import re

import numpy as np
import pytest

from quillmesh.llm import pii

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_patterns_match_plain_regular_expressions():
    r = random.Random(3)
    parts = ["a.b@c.de", "@", "@x.y", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "+12", "5", " ", "-", ".", "é", "\n", "٣", "x@y.z@w.v", "a@b", "%+", "4111111111111111", "00000000000000"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(text) == _plain(text), repr(text)


def test_linear_on_long_runs():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "+1" + " " * 400_000, "1." * 200_000, "@" * 100_000):
        pii.find([text], pii.train([]))


def test_agreement_adds_repeats_and_keeps_clean():
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} now, mail u{i}@mail.example.com from 10.0.0.{i % 200} version 3. of 2024" for i in range(200)]
    model = pii.train(texts)
    text = "reach +1 (431) 555-7788 today. " + "filler words " * 300 + "ask at (431) 555-7788 again"
    got = pii.find([text, "version 3. of chapter 12", ""], model)
    assert [g for g in got[0] if g[3]] == [(*s, True) for s in _plain(text)]
    added = [text[s:e] for k, s, e, p in got[0] if not p and k == 3]
    assert added and "555-7788" in added[-1]
    assert got[1] == [] and got[2] == []


def test_skip_weights_are_learned_from_repeats_that_differ_in_form():
    texts = [f"mail u{i}@mail.example.com from 10.0.7.{i % 200} or +1 (431) 555-{1000 + i} and 4111 1111 1111 1111" for i in range(100)]
    model = pii.train(texts)
    assert model["skip"][0] == 0 and (model["skip"][1:] > 0.5).all()
    assert (pii.train(["version 3 of 2024"] * 50)["skip"] == 0).all()  # nothing to learn from


def test_added_spans_pass_the_test_of_their_kind():
    texts = [f"mail u{i}@mail.example.com from 10.0.7.{i % 200} or +1 (431) 555-{1000 + i} and 4111 1111 1111 1111" for i in range(100)]
    model = pii.train(texts)
    text = "card 4111 1111 1111 1111 again 4111.1111.1111.1111 but 4111.1111.1111.1112 order 9890149938096989 from 10.0.7.3 then 10-0-7-3 or 10-0-7-999"
    added = [text[s:e] for k, s, e, p in pii.find([text], model)[0] if not p]
    assert "4111.1111.1111.1111" in added and "10-0-7-3" in added
    assert all(pii.passes(k, text[s:e]) for k, s, e, p in pii.find([text], model)[0] if not p)
    assert not any("1112" in x or "9890" in x or "999" in x for x in added)


def _enumerated(g, model):
    own, n = g.matrix() @ model["unary"], 1 + len(pii.KINDS)
    out = np.zeros((len(g.on), n))
    for labels in itertools.product(range(n), repeat=len(g.on)):
        if any(s >= 0 and s != x for s, x in zip(g.seen, labels)):
            continue
        score = sum(own[i, x] for i, x in enumerate(labels)) + sum(model["chain"][labels[a], labels[b]] for a, b in g.chain) + sum(model["skip"][labels[a]] for a, b in g.skip if labels[a] == labels[b])
        for i, x in enumerate(labels):
            out[i, x] += np.exp(score)
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("seed", range(6))
def test_marginals_equal_enumeration(seed):
    r = np.random.default_rng(seed)
    n = 1 + len(pii.KINDS)
    model = {"unary": r.standard_normal((pii.N_FEATURES, n)), "chain": r.standard_normal((n, n)), "skip": np.r_[0, r.random(n - 1)]}
    trees = ["12345 a b 77 88 c 12345", "x@y 12 a x@z b 99 c d 1.2.3.4", "1 2 3 4 5"]
    loops = ["5551234 12 a 5551234 12", "9999 9999 b 9999"]
    for text, exact in [(t, 1e-3) for t in trees] + [(t, 0.12) for t in loops]:
        g = pii.Graph()
        g.add(0, text, pii.base_spans(text), pii.candidates(text))
        assert np.abs(pii.marginals(g, model) - _enumerated(g, model)).max() < exact, text


def test_sample_covers_passages_of_long_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "train", lambda texts: seen.append(texts))
    docs = spark.createDataFrame([(i, f"w {i}") for i in range(20)] + [(99, "plain " * 10_000 + " 1.2.3.4 " + "plain " * 5000 + "a@b.cd")], "doc_id long, text string")
    pii.fit(spark, docs, sample=10_000)
    assert len(seen[0]) == 22 and any("1.2.3.4" in t for t in seen[0]) and any("a@b.cd" in t for t in seen[0])
    pii.fit(spark, docs, sample=5)
    assert len(seen[1]) == 5 and set(seen[1]) < set(seen[0])


def test_repeat_as_the_next_candidate_gets_an_edge():
    far, near, text = pii.Graph(), pii.Graph(), "4111111111111112 and then 4111111111111112"
    far.add(0, text, [], pii.candidates(text))
    assert far.chain == [] and set(far.skip) == {(0, 1)}
    near.add(0, "4111111111111112 4111111111111112", [], [(0, 16), (17, 33)])
    assert near.chain == [(0, 1)] and near.skip == []


def test_tables(spark):
    rows = [(1, "a b@c.de x 1.2.3.4", 3), (1, "a b@c.de x 1.2.3.4", 3), (None, None, 0), (4, "", 0), (5, "+1 (988) 555-2485 " * 50, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    model = pii.fit(spark, docs)
    got = pii.spans(spark, docs, model).collect()
    assert sorted(len(x["spans"]) for x in got) == [0, 0, 2, 2, 50]
    clean = {x["doc_id"]: x["text"] for x in pii.redact(spark, docs, model, length="spans").collect()}
    assert clean[1] == "a [EMAIL] x [IP]" and clean[None] is None and "555" not in clean[5]
    assert pii.spans(spark, docs.limit(0), model).count() == 0 and pii.fit(spark, docs.limit(0))
