import random

from quillmesh.operators import search


def _edits(pattern, text):
    """Least edits of any part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_approximate_search_equals_the_whole_table(spark):
    """Three fields, nulls and empty texts; texts that lack all pieces of a pattern are left out without loss."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcé") for _ in range(n)) or None
    rows = [(i, word(r.randint(0, 12)), word(r.randint(0, 5)), word(r.randint(0, 20))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, name string, full string, signature string").cache()
    for pattern in ("abc", "AbcaBé", "cc", "a", "abcabcabca"):
        low, want = pattern.lower(), {}
        for i, *texts in rows:
            best = min(_edits(low, t or "") for t in texts)
            if best <= int(0.4 * len(low)):
                want[i] = round(1 - best / len(low), 9)
        assert {x["id"]: round(x["score"], 9) for x in search.fuzzy(df, "id", ["name", "full", "signature"], pattern).collect()} == want, pattern
    df.unpersist()
