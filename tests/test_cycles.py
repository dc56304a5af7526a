import random

import pytest

from quillmesh.operators import cycles


def _plain(edges):
    """Reachability by search from every node."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach, paths = {}, {}
    for s in out:
        front, seen, best = {s: [s]}, set(), None
        while front:
            ahead = {}
            for at, path in sorted(front.items(), key=lambda x: x[1]):
                for d in sorted(out[at]):
                    if d not in ahead or path < ahead[d]:
                        ahead[d] = path
            if s in ahead and best is None:
                best = ahead[s]
            seen |= set(ahead)
            front = {d: [*p, d] for d, p in ahead.items() if d not in reach.get(s, set())}
            reach[s] = reach.get(s, set()) | seen
        paths[s] = best
    parts = {s: min([d for d in reach[s] if s in reach[d]] + [s]) for s in out}
    sizes = {p: sum(q == p for q in parts.values()) for p in parts.values()}
    return {s: (parts[s], sizes[parts[s]], s in reach[s]) for s in out}, {s: (len(p), p) for s, p in paths.items() if p}


@pytest.mark.parametrize(("n", "m", "seed"), [(16, 26, 1)])
def test_equals_brute_force(spark, n, m, seed):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(3, 3), (3, 3)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src int, dst int")
    parts, paths = _plain(edges)
    found = cycles.strong_components(df)
    assert {x["node"]: (x["component"], x["size"], x["on_cycle"]) for x in found.collect()} == parts
    asked = spark.createDataFrame([(i,) for i in range(n)], "node int")
    short = {x["node"]: (x["length"], x["cycle"]) for x in cycles.shortest_cycles(df, found, asked).collect()}
    assert {s: x[0] for s, x in short.items()} == {s: x[0] for s, x in paths.items()}
    for s, (length, cycle) in short.items():
        assert cycle[0] == s and len(cycle) == length and set(zip(cycle, [*cycle[1:], s], strict=True)) <= set(edges)


def test_long_cycles_and_empty_graphs(spark):
    """A ring of 12 nodes with tails: no cap of its length."""
    edges = [(f"n{i:02d}", f"n{(i + 1) % 12:02d}") for i in range(12)] + [("in", "n05"), ("n07", "out"), ("out", "end")]
    df = spark.createDataFrame(edges, "src string, dst string")
    found = cycles.strong_components(df)
    assert {(x["component"], x["size"]) for x in found.filter("on_cycle").collect()} == {("n00", 12)} and found.filter("on_cycle").count() == 12 and found.count() == 15
    one = cycles.shortest_cycles(df, found, spark.createDataFrame([("n04",), ("in",)], "node string")).collect()
    assert [(x["node"], x["length"], x["cycle"][:2], x["cycle"][-1]) for x in one] == [("n04", 12, ["n04", "n05"], "n03")]
    assert cycles.strong_components(df.limit(0)).count() == 0
    tree = cycles.strong_components(spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string"))
    assert cycles.shortest_cycles(df, tree, spark.createDataFrame([("a",)], "node string")).count() == 0
