import hashlib
import math

import numpy as np
import pytest

from quillmesh.llm import centroids


def _plain(rows, k, rounds, dim):
    """All distances in every round, in whole numbers without bound."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    mid = [v for _, v in kept[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for at in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(mid)) for _, v in kept]
        if at < rounds:
            for j in range(len(mid)):
                mine = [v for (_, v), (_, o) in zip(kept, near, strict=True) if o == j]
                if mine:
                    mid[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    whole = {j: sum(d for d, o in near if o == j) for j in range(len(mid))}
    return sorted(((i, j, d, whole[j], sum(whole.values()), mid[j]) for (i, _), (d, j) in zip(kept, near, strict=True)), key=str)


def _run(spark, rows, **how):
    found = centroids.cluster(spark, spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double"), **how)
    assert found.columns == ["vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in found.collect()), key=str)


@pytest.mark.parametrize(("n", "k", "rounds", "spread"), [(400, 16, 3, 0.2), (300, 24, 6, 0.02), (60, 5, 4, 0.0), (3, 16, 3, 1.0), (90, 1, 2, 1.0)])
def test_equals_all_distances(spark, n, k, rounds, spread):
    """Also where vectors are equal or lie on a coarse grid, so that many distances tie."""
    r = np.random.default_rng(n)
    rows = [(i, (r.integers(-2, 3, 6) / 8 + spread * r.standard_normal(6)).tolist()) for i in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1])]
    assert _run(spark, rows, k=k, rounds=rounds, dim=6) == _plain(rows, k, rounds, 6)


def test_what_cannot_be_clustered_is_left_out(spark):
    good = [(i, [i / 10, -i / 10]) for i in range(20)]
    odd = [(30, None), (31, []), (32, [1.0]), (33, [1.0, None]), (34, [1.0, math.nan]), (35, [math.inf, 0.0]), (36, [1.0, 2.0, 3.0])]
    assert _run(spark, good + odd, k=4, dim=2) == _plain(good, 4, 3, 2)
    assert _run(spark, odd, k=4, dim=2) == []
    assert _run(spark, [], k=4, dim=2) == []
    far = _run(spark, [*good, (40, [1e300, -1e300]), (41, [-1e300, 1e300])], k=4, dim=2)
    assert len(far) == 22 and all(x[2] >= 0 for x in far)


def test_bounds_spare_scans_and_never_lie():
    r = np.random.default_rng(3)
    mid = r.integers(-40, 40, (16, 8))
    v = np.concatenate([m + r.integers(-3, 4, (50, 8)) for m in mid])
    own, _, near, low = centroids.scan(v, mid, 4)
    spared = 0
    for bounds in (4, 4, 3, 2, 2):
        moved = mid + r.integers(-1, 2, mid.shape)
        moves = np.sqrt(((moved - mid) ** 2).sum(axis=1))
        own, d2, near, low, used = centroids.reassign(v, own, near, low, moves, moved, bounds)
        every = ((v[:, None] - moved[None]) ** 2).sum(axis=2)
        assert (own == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all()
        assert (low[:, :bounds] <= np.sqrt(np.take_along_axis(every, near, axis=1)) + 1e-9).all()
        others = np.ones(every.shape, bool)
        np.put_along_axis(others, np.column_stack([own, near]), False, axis=1)
        assert (np.where(others, np.sqrt(every), np.inf).min(axis=1) >= low[:, bounds] - 1e-9).all()
        spared += (used <= bounds).sum()
        mid = moved
    assert spared > 0.5 * 5 * len(v)
