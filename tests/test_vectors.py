"""Indexes, towers and files of vectors against plain numpy."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrec.functions import blocks
from lumenrec.operators import compressed as Z
from lumenrec.operators import graph as G
from lumenrec.operators import metrics as M
from lumenrec.operators import retrieval as R
from lumenrec.operators import towers as W
from lumenrec.sources import npy


def vectors(n, dim=16, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.5 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def stored_items(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items"))
    spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(vectors(700))], "item_id long, v array<double>").repartition(4).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def asked(items, n=40):
    return items.where(F.col("item_id") < n).select(F.col("item_id").alias("user_id"), "v")


def recall(spark, found, items, k=10):
    return R.recall_at_k(found, R.knn(asked(items), items, "user_id", k), "user_id", k).first()["recall"]


@pytest.mark.parametrize("kind,least", [("pq", 0.75), ("sq8", 0.97), ("sq4", 0.75), ("fp16", 0.99)])
def test_codecs_rank_like_vectors(spark, stored_items, kind, least):
    """By codes alone, in all cells; the more bytes, the closer."""
    index = Z.build(stored_items, 6, kind)
    assert recall(spark, Z.candidates(index, asked(stored_items), "user_id", 10, 6), stored_items) >= least
    assert recall(spark, Z.search(index, asked(stored_items), stored_items, "user_id", 10, 6, 60), stored_items) >= 0.97


def test_codes_are_small_and_reload(spark, stored_items, tmp_path):
    index = Z.build(stored_items, 6, "pq")
    assert index.bytes_stored().first()["code_bytes"] == 700 * 8
    index.save(str(tmp_path / "pq"))
    loaded = Z.CompressedIndex.load(spark, str(tmp_path / "pq"))
    key = lambda df: sorted(map(tuple, df.select("user_id", "item_id", "score").collect()))
    assert key(Z.search(loaded, asked(stored_items), stored_items, "user_id", 5, 3)) == key(Z.search(index, asked(stored_items), stored_items, "user_id", 5, 3))


def test_residual_scores_add_up():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(50, 8)), rng.normal(size=(3, 8))
    codec = Z.Codec("pq", 2, 4, [Z._codewords(x[:, :4], 256), Z._codewords(x[:, 4:], 256)])  # fewer rows than codewords: nothing is lost
    assert np.allclose(codec.scores(q, codec.encode(x)), q @ x.T)
    ends = Z.Codec("sq4", 2, 4, [np.stack([x[:, i : i + 4].min(0), x[:, i : i + 4].max(0)]) for i in (0, 4)])
    assert np.abs(ends.scores(q, ends.encode(x)) - q @ x.T).max() < np.abs(q).sum(1).max() * (x.max() - x.min()) / 15
    with pytest.raises(ValueError):
        Z.build(None, 1, "none")


def test_hot_cell_is_many_tasks(spark, stored_items):
    """All requests name one key: they meet its blocks in several groups and lose nothing."""
    q = asked(stored_items, 100).withColumn("cell_id", F.lit(0))
    held = stored_items.groupBy(F.pmod("item_id", F.lit(3)).alias("block")).agg(F.collect_list("item_id").alias("ids")).withColumn("cell_id", F.lit(0))
    meet = lambda a, b: {"user_id": np.repeat(a.column("user_id").to_numpy(), sum(map(len, b.column("ids").to_pylist()))), "item_id": np.tile(np.concatenate(b.column("ids").to_pylist()), a.num_rows)}
    out = blocks.dealt_meet(q, held, ["cell_id"], "user_id", meet, "user_id long, item_id long", at_once=7)
    assert out.count() == out.distinct().count() == 100 * 700


def test_graph_finds_neighbours(spark, stored_items, tmp_path):
    index = G.build(stored_items, degree=16, entries=24)
    assert index.edges.groupBy("item_id").count().agg(F.max("count")).first()[0] <= 32
    index.save(str(tmp_path / "graph"))
    assert recall(spark, G.search(G.GraphIndex.load(spark, str(tmp_path / "graph")), asked(stored_items), "user_id", 10), stored_items) >= 0.95


def test_graph_of_few_and_equal_items(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)]
    items = spark.createDataFrame(rows, "item_id long, v array<double>")
    found = G.search(G.build(items, degree=2), items.withColumnRenamed("item_id", "user_id").limit(1), "user_id", 3)
    assert [(r["item_id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_many_equal_vectors_leave_a_task_few(spark):
    items = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(3000, 0, -1)], "item_id long, v array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [0.6, 0.8])], "user_id long, v array<double>")
    raw = blocks.meet_all(q, items, "user_id", blocks.best("user_id", 5), "user_id long, item_id long, score double")
    assert raw.count() <= 20
    assert [r["item_id"] for r in R.knn(q, items, "user_id", 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_tower_by_hand():
    w = W.Weights({"p": (np.array([[2.0]]), np.array([1.0])), "block_0.fc1": (np.array([[1.0, -1.0]]), np.array([0.5])), "block_0.fc2": (np.array([[1.0], [0.0]]), np.array([0.0, 0.25])), "block_0.norm": (np.array([[1.0, 2.0]]), np.array([0.0, 1.0])), "output": (np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([0.0, 0.5]))})
    got = w.forward(W.Tower(("a", "p"), ("p",)), [np.array([[0.3]]), np.array([[0.7]])])[0]
    x = [0.3, 2.4]
    h = x[0] - x[1] + 0.5
    h = h * 0.5 * (1 + math.erf(h / math.sqrt(2)))
    y = [h + x[0], 0.25 + x[1]]
    mean = sum(y) / 2
    var = sum((v - mean) ** 2 for v in y) / 2
    z = [(y[0] - mean) / math.sqrt(var + 1e-5), 2 * (y[1] - mean) / math.sqrt(var + 1e-5) + 1]
    o = [z[0] + z[1], z[1] + 0.5]
    assert np.allclose(got, np.array(o) / math.hypot(*o))


def test_too_many_weights_are_refused(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_WEIGHTS", 3)
    with pytest.raises(ValueError):
        W.Weights.read(spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", -1, [1.0, 2.0])], "layer string, row int, values array<double>"))


def test_numpy_files(spark, stored_items, tmp_path):
    path = str(tmp_path / "v")
    npy.write_vectors(stored_items, path, dtype="float64")
    back = npy.read_vectors(spark, f"file://{path}", 90)
    assert sorted(map(str, back.collect())) == sorted(map(str, stored_items.collect()))
    assert back.rdd.getNumPartitions() >= 700 // 90
    npy.write_vectors(stored_items.limit(10), path, mode="append", dtype="float64")
    assert npy.read_vectors(spark, path).count() == 710
    for name in os.listdir(path):
        assert "tmp" not in name
    with open(f"{path}/manifest.json") as f:
        assert sum(p["rows"] for p in json.load(f)["parts"]) == 710
    x = vectors(33, 4)
    np.save(tmp_path / "m.npy", x)
    assert [r["v"] for r in npy.read_array(spark, str(tmp_path / "m.npy"), 10).orderBy("item_id").collect()] == x.tolist()
    with pytest.raises(ValueError):
        npy._local("store://bucket/x")


def test_failed_write_is_no_table(spark, stored_items, tmp_path):
    path = str(tmp_path / "broken")
    broken = stored_items.withColumn("v", F.when(F.col("item_id") < 600, F.col("v")).otherwise(F.slice("v", 1, 3)))
    with pytest.raises(Exception):
        npy.write_vectors(broken.coalesce(1), path)
    assert not os.path.exists(f"{path}/manifest.json")


def test_early_stopping_fold(spark):
    rng = np.random.default_rng(4)
    series = {i: [float(x) for x in rng.normal(size=25).cumsum().round(2)] for i in range(12)} | {99: [1.0], 100: [1.0] * 9}
    rows = spark.createDataFrame([(s, t, v) for s, vs in series.items() for t, v in enumerate(vs)] + [(5, 100, None)], "series long, step long, value double")
    got = {r["series"]: r for r in M.early_stopping(rows, 3, 0.1).collect()}
    for s, vs in series.items():
        assert got[s]["stopped_at"] == M.stop_early(vs, 3, 0.1)
    assert M.stop_early([1, 1, 1, 1], 3) == 3 and M.stop_early([1, 2, 3], 1) is None
    low = {r["series"]: r for r in M.early_stopping(rows, 3, 0.1, "min").collect()}
    assert low[0]["stopped_at"] == M.stop_early([-x for x in series[0]], 3, 0.1)

def test_best_of_items_that_pass_by(spark):
    """More items than a task holds at once, many of them equal, against all products; what leaves is a few rows a query."""
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(3_000, 8)), 2)
    vectors[1_000:1_400] = vectors[7]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_id long, v array<double>").repartition(7)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:300])], "user_id long, v array<double>")
    raw = blocks.meet_best(q, items, "user_id", 5, small=0)
    assert raw.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 8 * 20
    for drop_self in (False, True):
        got = {}
        for r in R.knn(q, items, "user_id", 5, drop_self, small=0).collect():
            got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"]))
        scores = np.round(vectors[:300] @ vectors.T, 6)
        for u in range(300):
            order = [i for i in np.lexsort((np.arange(3_000), -scores[u])) if not (drop_self and i == u)][:5]
            assert [i for _, i in sorted(got[u])] == order


def test_exact_search_makes_no_rows_for_each_block_of_items(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ITEM_BLOCK", 100)
    items = spark.range(2_000).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    q = spark.range(1_500).select(F.col("id").alias("user_id"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    monkeypatch.setattr(blocks, "STREAM_ROWS", 100)
    assert blocks.meet_best(q, items, "user_id", 3, small=0).count() < 1_500 * 6
