import random
from collections import Counter

import numpy as np

from quillmesh.llm import licenses


def test_winnowing_shares_a_fingerprint():
    r = random.Random(2)
    for _ in range(300):
        common = bytes(r.choice(b"abc ") for _ in range(licenses.K + licenses.WINDOW - 1))
        a, b = (bytes(r.choice(b"abc ") for _ in range(r.randint(0, 60))) + common + bytes(r.choice(b"abc ") for _ in range(r.randint(0, 60))) for _ in range(2))
        prints = [set(licenses.winnow(np.frombuffer(x, np.uint8))[1].tolist()) for x in (a, b)]
        assert prints[0] & prints[1]


def _scores(a, b):
    table = {}
    for i in range(len(a)):
        for j in range(len(b)):
            table[i, j] = max(0, table.get((i - 1, j - 1), 0) + (2 if a[i] == b[j] else -1), table.get((i - 1, j), 0) - 1, table.get((i, j - 1), 0) - 1)
    return table.values()


def test_alignment_equals_full_table():
    """Against a plain local alignment table, where the band holds all of it."""
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice([b"x", b"y", b"z"]) for _ in range(r.randint(1, 8))] for _ in range(2))
        best, table = 0, {}
        for i in range(len(a)):
            for j in range(len(b)):
                table[i, j] = max(0, table.get((i - 1, j - 1), 0) + (2 if a[i] == b[j] else -1), table.get((i - 1, j), 0) - 1, table.get((i, j - 1), 0) - 1)
                best = max(best, table[i, j])
        n, first, last = licenses.align(a, b, licenses.band(len(a), [(0, 0)]))
        assert (n > 0) == (best > 0) and (not n or 0 <= first <= last < len(b))
        assert not best or max(_scores(a, b[first : last + 1])) == best  # the span alone reaches the best score


def _edits(r, words):
    """Edited forms of a notice, by name."""
    n, junk = len(words), lambda k: [f"zz{r.randint(0, 10**6)}" for _ in range(k)]
    at = sorted(r.sample(range(1, n), min(2, n - 1)))
    gone = set(r.sample(range(n), int(0.15 * n)))
    swapped = set(r.sample(range(n), int(0.15 * n)))
    yield "whole", words
    yield "deleted", [w for i, w in enumerate(words) if i not in gone]
    yield "sixth", [junk(1)[0] if i % 6 == 5 else w for i, w in enumerate(words)]
    yield "replaced", [junk(1)[0] if i in swapped else w for i, w in enumerate(words)]
    yield "inserted", [*words[: at[0]], *junk(8), *words[at[0] :]] if len(at) < 2 else [*words[: at[0]], *junk(8), *words[at[0] : at[1]], *junk(8), *words[at[1] :]]
    yield "starred", " ".join(w + (" * " if i % 10 == 9 else "") for i, w in enumerate(words)).split()


def test_recall_against_aligning_every_template():
    """Of all templates that a full alignment table says are covered, at least 0.9 of each kind of edit are found."""
    r = random.Random(9)
    index = licenses.Index(licenses.TEMPLATES)
    found, wanted = Counter(), Counter()
    for name in sorted(licenses.TEMPLATES):
        words = licenses.TEMPLATES[name].split()
        for _ in range(6):
            for kind, edited in _edits(r, words):
                text = " ".join(f"w{r.randint(0, 99)}" for _ in range(40)) + " " + " ".join(edited) + " tail"
                own = licenses.normal_words(text)
                template = licenses.normal_words(licenses.TEMPLATES[name])
                m = licenses.align(template, own, [(0, len(own))] * len(template))[0]
                if m < licenses.MIN_COVERAGE * len(template):
                    continue
                wanted[kind] += 1
                got = licenses.matches(index, text)
                found[kind] += any(g[0] == name or g[2] >= m for g in got)  # or a longer notice that holds it
    assert min(wanted.values()) >= 40
    assert all(found[k] >= 0.9 * wanted[k] for k in wanted), (found, wanted)


def test_copies_that_follow_each_other_and_chunks(monkeypatch):
    index = licenses.Index(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["mit"]
    got = licenses.matches(index, f"{mit}\n{mit} {licenses.TEMPLATES['isc']} " + "plain words " * 30 + mit)
    assert [g[0] for g in got] == ["mit", "mit", "isc", "mit"] and all(g[1] == 1 for g in got)
    whole = licenses.matches(index, ("filler " * 90 + mit) * 3)
    monkeypatch.setattr(licenses, "CHUNK", 300)
    assert licenses.matches(index, ("filler " * 90 + mit) * 3) == whole and len(whole) == 3


def test_repeated_rows_clashing_columns_and_text_ids(spark):
    text = licenses.TEMPLATES["isc"]
    docs = spark.createDataFrame([("x", text, 1), ("x", text, 1), (None, text, 2)], "doc_id string, text string, start int")
    got = licenses.scan(spark, docs).collect()
    assert len(got) == 3 and all(g["license"] == "isc" and g["start"] == 0 for g in got)


def test_matches_and_clean_texts(spark):
    r = random.Random(6)
    filler = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet the of and in a".split()) for _ in range(n))
    rows, want = [], set()
    for i, name in enumerate(sorted(licenses.TEMPLATES) * 2):
        text = licenses.TEMPLATES[name]
        words = text.split()
        if i % 2 and len(words) > 30:
            words[len(words) // 2] = "replaced"  # an edit
            del words[len(words) // 3]
        before = filler(r.randint(0, 400)) + " é\n" if i % 3 else ""
        rows.append((i, before + " \n ".join(words) + " " + filler(r.randint(0, 50)), "x"))
        want.add((i, name))
    rows += [(100 + i, filler(300), "x") for i in range(20)] + [(200, None, "x"), (201, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.scan(spark, docs).collect()
    found = {(x["doc_id"], x["license"]) for x in got}
    assert want <= found and all(x["doc_id"] < 100 for x in got)
    texts = {x[0]: x[1] for x in rows}
    for x in got:
        if (x["doc_id"], x["license"]) in want:
            span = texts[x["doc_id"]][x["start"] : x["end"]]
            assert x["coverage"] >= 0.8 and licenses.normal_words(span)[0] == licenses.normal_words(licenses.TEMPLATES[x["license"]])[0]
    assert licenses.scan(spark, docs.limit(0)).count() == 0
