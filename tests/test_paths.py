import random

from quillmesh.operators import lookups


def _score(query, path):
    """The score of a path for a request, from its definition."""
    base, folder = path.lower().rsplit("/", 1)[-1], path.lower().rsplit("/", 1)[0] if "/" in path else ""
    q = query.lower()
    q_base, q_dir = q.rsplit("/", 1)[-1], q.rsplit("/", 1)[0] if "/" in q else ""
    share = lambda a, b: len(set(a) & set(b)) / max(len(set(a)), len(set(b)), 1)
    name = 100 if base == q_base else 50 if q_base in base else 30 if base in q_base else 0
    return name + (25 if q_dir and q_dir in folder else 0) + (20 if q in path.lower() else 0) + 15 * share(base, q_base) + (10 * share(folder, q_dir) if q_dir and folder else 0)


def test_candidates_lose_no_winner(spark):
    """Every file that can win or keep another from winning is found, and the plan holds no request against every file."""
    r = random.Random(6)
    name = lambda: "".join(r.choice("abcX.") for _ in range(r.randint(1, 6)))
    files = sorted({"/".join(name() for _ in range(r.randint(1, 4))) for _ in range(80)})
    queries = sorted({r.choice(files) for _ in range(6)} | {"/".join(name() for _ in range(r.randint(1, 3))) for _ in range(25)} | {f.split("/")[-1] for f in files[:8]} | {f.rsplit("/", 1)[0] + "/" for f in files[5:30:5] if "/" in f})
    q, f = spark.createDataFrame([(x,) for x in queries], "query string"), spark.createDataFrame([(x,) for x in files], "file_path string")
    found = {(x["query"], x["file_path"]) for x in lookups.path_candidates(q, f).collect()}
    for a in queries:
        for b in files:
            assert (a, b) in found or _score(a, b) <= 60 + 1e-9, (a, b, _score(a, b))
    got = {x["query"]: (x["status"], x["path"]) for x in lookups.resolve_paths(q, f).collect()}
    for a in queries:
        ends = [b for b in files if b == a or b.endswith("/" + a)]
        ranked = sorted(((-round(_score(a, b), 9), b) for b in files if _score(a, b) > 10))
        clear = ranked and -ranked[0][0] >= 80 and -ranked[0][0] + (ranked[1][0] if len(ranked) > 1 else 0) >= 20
        want = ("exact", a) if a in files else ("suffix", ends[0]) if len(ends) == 1 else ("ambiguous", None) if ends else ("fuzzy", ranked[0][1]) if clear else ("not_found", None)
        assert got[a] == want, a
    plan = lookups.path_candidates(q, f)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
