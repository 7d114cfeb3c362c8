import numpy as np

import brute
from lumenrec.llm import embedding_dedup as D


def test_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 64))
    near = base[rng.integers(0, 60, 500)] + rng.normal(size=(500, 64)) * 0.15
    x = np.concatenate([base, near, base[:30], base[:5] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan")] * 64, 1), (5003, [float("inf")] + [1.0] * 63, 1), (5004, [], 1), (5005, [None] + [1.0] * 63, 1), (None, x[0].tolist(), 1), (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1)]
    df = brute.stored(spark, tmp_path, rows, "vec_id long, embedding array<float>, rep int")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1)))] + [(5006, 5007)]
    ids = [*range(len(x)), *range(5000, 5008)]
    n, component = dict.fromkeys(ids, 0), brute.components(ids, links)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    out = {r["vec_id"]: r for r in D.near_duplicates(df).collect()}
    assert len(out) == len(rows)
    missed = sum(n[i] - out[i]["n_links"] for i in ids)
    assert all(out[i]["n_links"] <= n[i] for i in ids) and missed <= 0.01 * sum(n.values())
    assert sum(out[i]["component_id"] != component[i] for i in ids) <= 5
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in ids)


def test_blocks_agree(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(3, 16)), 80, axis=0) + rng.normal(size=(240, 16)) * 0.05
    df = brute.stored(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, D.near_duplicates(df).collect()))
    monkeypatch.setattr(D, "BLOCK", 50)
    assert sorted(map(tuple, D.near_duplicates(df).collect())) == one


def test_empty_table_and_calibration(spark):
    assert D.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert D.COUNTED / 2 < D.least_count() < D.COUNTED


def test_recall_does_not_depend_on_depth():
    """Pairs at exactly the threshold meet in one of the tables, however finely they are dealt."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for depth in (1, 2, 3):
        meet = np.zeros(len(x), bool)
        for t in range(D.tables(64, 0.95, depth)):
            meet |= D.codes(x, t, depth) == D.codes(y, t, depth)
        assert meet.mean() >= 0.985, (depth, meet.mean())


def test_repeated_ids_and_ties(spark, tmp_path):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = brute.stored(spark, tmp_path, [(1, v), (1, v), (2, v), (3, w)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, D.near_duplicates(df).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_very_large_and_very_small_components(spark):
    """Collinear vectors link whatever their lengths."""
    rows = [(i, [x * s for x in (3.0, 4.0, 1.0)]) for i, s in enumerate((1e-200, 1e200, 1.0, 1e-160, 1e154))] + [(9, [-3.0, 4.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in D.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {9: (0, 9)}
