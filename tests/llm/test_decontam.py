import random

import numpy as np
import pytest

from quillmesh.llm import decontam


def _text(r, n, vocab):
    return " ".join(r.choice(vocab) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_scoring_all(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    index = decontam.Index([(i, _text(r, r.randint(1, 30), vocab)) for i in range(r.choice([1, 5, 300]))])
    for _ in range(60):
        terms = r.sample(range(len(index.ids)), min(len(index.ids), r.randint(1, 40)))
        least = r.choice([0.05, 0.3, 0.5, 0.9])
        scores = [sum(dict(zip(index.docs[t], index.weights[t], strict=True)).get(d, 0) for t in terms) for d in range(len(index.items))]
        got = dict(index.search(np.array(terms), least))
        assert got == pytest.approx({d: s for d, s in enumerate(scores) if s >= least})


def test_leaks_found_and_clean_kept(spark):
    r = random.Random(5)
    vocab = ["the", "of", "and"] * 20 + [f"v{i}" for i in range(4000)]
    items = [(i, _text(r, r.randint(12, 50), vocab) + "? " + _text(r, r.randint(1, 8), vocab)) for i in range(120)] + [(500, None), (501, "")]
    docs, want = [], set()
    for d in range(200):
        text = _text(r, r.choice([3, 50, 900]), vocab)
        if d % 4 == 0:
            i = r.randrange(120)
            words = text.split()
            at = r.randint(0, len(words))
            text = " ".join([*words[:at], items[i][1].upper() if d % 8 else items[i][1].replace(" ", "\n"), *words[at:]])
            want.add((d, i))
        docs.append((d, text, d))
    docs += [(900, None, 1), (901, "", 1), (None, items[3][1], 1)]
    want |= {(None, 3)}
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part_bytes in (1 << 20, 3000):
        got = decontam.leaked(spark, table, bench, part_bytes=part_bytes).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
        clean = decontam.keep_clean(spark, table, bench, part_bytes=part_bytes)
        assert clean.columns == table.columns and clean.count() == len(docs) - len(want)
    assert decontam.leaked(spark, table, bench.limit(0)).count() == 0
    assert decontam.leaked(spark, table.limit(0), bench).count() == 0


def test_case_and_punctuation_beyond_ascii():
    item = "El niño preguntó “¿dónde está mañana la última señal de Ñandú?” y después volvió — según él — a la región. ¿Quién preguntó? Straße número uno está aquí"
    index = decontam.Index([(0, item)])
    plain = item.translate(str.maketrans("“”—¿", '""- '))
    for text in (item.upper(), plain, item.replace(" ", "\u00a0")):
        assert [x[0] for x in index.leaks(f"otro texto {text} sigue")] == [0], text
    assert decontam.words_of("A_b-c d\x1fé ’x’") == [w.encode() for w in ("a", "b", "c", "d", "é", "x")]


def test_long_items_leave_short_passages_alone():
    """A long item has an index of its own; items of every length are found in very long texts, repeated ones once."""
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(5000)]
    items = [(i, _text(r, n, vocab) + "? " + _text(r, 4, vocab)) for i, n in enumerate([10, 30, 200, 900, 6000, 30])]
    both = decontam.Indexes([*items, (9, items[1][1])])
    assert [p.longest for p in both.parts] == [34, 204, 904, 6004]
    text = " ".join([_text(r, 20_000, vocab), *(t for _, t in items), _text(r, 20_000, vocab), items[0][1]])
    assert sorted(x[0] for x in both.leaks(text)) == [0, 1, 2, 3, 4, 5, 9]
    assert both.leaks("") == [] and both.leaks(_text(r, 3000, vocab)) == [] and decontam.Indexes([]).leaks("a b c") == []
