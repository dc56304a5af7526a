"""Transitions of the chain of calls, from odd rows, and how they are dealt."""

import math
import re
from collections import defaultdict

import pytest

from quillmesh.operators import markov

CALLS = "caller string, callee string, call_count long, is_async boolean, is_conditional boolean"
ROWS = [
    *[(f"c{i % 7}", f"s{i * i % 11}", 1 + i % 4, i % 3 == 0, i % 5 == 0) for i in range(60)],  # callers and callees repeat
    (None, "s1", 2, True, False), (None, "s2", 1, False, False), ("c1", None, 3, False, True), ("c2", "s1", None, True, True), ("c3", "s2", 2, None, None), ("c4", "s3", 0, False, False), ("alone", "s9", 5, True, False),
]


def _plain(rows):
    """from, to -> raw, prob, pair by pair."""
    by, raw, total = defaultdict(list), defaultdict(float), defaultdict(float)
    for r in rows:
        if r[2] is not None and r[2] >= 1:
            by[r[0]].append(r)
    for caller, own in by.items():
        for a in own:
            for b in own:
                if caller is not None and len(own) >= 2 and a[1] is not None and b[1] is not None and a[1] != b[1]:
                    raw[a[1], b[1]] += math.sqrt(math.log(a[2] + 1) * math.log(b[2] + 1)) / math.sqrt(len(own) - 1) * (1.1 if b[3] else 1.0) * (0.8 if b[4] else 1.0)
    for (state, _), w in raw.items():
        total[state] += w
    return {k: (w, w / total[k[0]]) for k, w in raw.items()}


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("rows", [ROWS, ROWS[:0], ROWS[-1:]])
def test_odd_rows(spark, rows, whole):
    """Null callers, callees, counts and flags, repeated rows, a caller of one part, and no rows."""
    found = markov.normalise(markov.call_flow_weights(spark.createDataFrame(rows, CALLS)), whole).collect()
    got, want = {(r["from_id"], r["to_id"]): (r["raw"], r["prob"]) for r in found}, _plain(rows)
    assert len(found) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_every_partition_is_a_task(spark):
    """Edges take few bytes and make many pairs, so shuffles before pairs and before totals of all states aren't put together by their bytes."""
    calls = spark.createDataFrame(ROWS, CALLS)
    fixed = lambda df: re.findall(r"hashpartitioning\((\w+)#\w+, 4\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())
    weights = markov.call_flow_weights(calls)
    assert set(fixed(weights)) == {"caller"} == set(fixed(markov.normalise(weights)))
    assert set(fixed(markov.normalise(weights, whole=True))) == {"caller", "from_id"}
