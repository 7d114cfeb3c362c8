import math
import random

import pytest
from brute import stored
from pyspark.sql import functions as F

from lumenrec.llm import hard_negatives as H


def plain(rows, every, positives=5, negatives=3, low=50, high=95):
    kept = []
    for vec_id, label, v, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        while q and q[-1] == 0:
            q.pop()
        if sum(x * x for x in q) < 2**56 and (vec_id, label, q) not in kept:
            kept.append((vec_id, label, q))
    out = []
    for a, la, va in kept:
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(va, v)), i, label == la) for i, label, v in kept if i != a]
        for s, p, _ in sorted(x for x in scores if x[2])[:positives]:
            fit = sorted(x for x in scores if not x[2] and 100 * -x[0] >= low * -s and 100 * -x[0] <= high * -s)[:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n=600, dim=6, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    return [(i, rng.randrange(4), [scale * (c + rng.gauss(0, 0.4)) for c in rng.choice(centres)], "x") for i in range(n)]


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 40.0), (3, 1e5)])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, seed, scale):
    """Small blocks and few at first, so that rounds, bounds and salts all take part."""
    for name, value in (("BLOCK", 16), ("FIRST", 2), ("GROWTH", 2), ("AT_ONCE", 8)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(seed, scale=scale)
    got = H.mine(stored(spark, tmp_path, rows, "vec_id long, label int, embedding array<double>, block string"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows, 20)


def test_odd_rows_and_ties(spark, tmp_path):
    same = [(i, i % 2, [1.0, 0.5], "x") for i in range(40)]
    odd = [(100, None, [1.0, 0.0], "x"), (101, 0, None, "x"), (102, 0, [1.0, None], "x"), (103, 0, [float("nan"), 1.0], "x"), (104, 1, [float("inf"), 1.0], "x"), (105, 1, [], "x"), (106, 1, [0.8, 0.3, 0.1], "x"), (107, 1, [1e30, 1.0], "x"), (None, 1, [1.0, 1.0], "x"), (110, 1, [-1.0, -1.0], "x")]
    odd += [(108, 1, [0.9, 0.1], "x"), (108, 1, [0.9, 0.1], "y"), (3, 1, [1.0, 0.5], "x"), (109, 1, [0.7, 0.2], "x"), (112, 1, [0.6, 0.3], "x")]
    rows = same + odd
    got = H.mine(stored(spark, tmp_path, rows, "vec_id long, label int, embedding array<double>, a string"), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5)


def test_no_rows_no_anchors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert H.mine(none, F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    assert H.mine(one, F.col("vec_id") % 5 == 0).count() == 0
    assert H.mine(one, F.col("vec_id") > 0).count() == 0


def test_bounds_hold(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.integers(-300, 300, (200, 8))
    squared = (m**2).sum(axis=1)
    longest = int(squared.max())
    space = H._Space(8, longest, H._fit_pivots([x.tobytes() for x in m], 8, longest, 5))
    keys = space.keys(m, squared, True)
    nearest = np.argmin(keys, axis=1)
    space.block_pivot = np.arange(keys.shape[1])
    own = [keys[nearest == p, p] for p in space.block_pivot]
    space.lo, space.hi = np.array([x.min() if len(x) else 0 for x in own]), np.array([x.max() if len(x) else 0 for x in own])
    most, least = space.bounds(m, squared)
    scores = m @ m.T
    for p in space.block_pivot:
        block = scores[:, nearest == p]
        if block.size:
            assert (block.max(axis=1) <= most[:, p]).all() and (block.min(axis=1) >= least[:, p]).all()
