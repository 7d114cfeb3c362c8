"""The ranker on lists with a known order."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenrec.operators import ranker as L


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    rng, rows = random.Random(1), []
    for user in range(80):
        for item in range(15):
            a, b, noise = rng.random(), rng.random(), rng.random()
            rows.append((user, item, float(min(4, int(5 * (0.7 * a + 0.3 * (b > 0.5)) + rng.random() * 0.5))), a, b, noise))
    path = str(tmp_path_factory.mktemp("lists"))
    spark.createDataFrame(rows, "user_id long, item_id long, label double, a double, b double, noise double").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_learns_the_order_and_reloads(spark, lists, tmp_path):
    train, held = L.split_users(lists)
    assert not set(r[0] for r in train.select("user_id").distinct().collect()) & set(r[0] for r in held.select("user_id").distinct().collect())
    model = L.train(train, ["a", "b", "noise"], held, L.Settings(trees=8, rate=0.3))
    mean = lambda rows, c: L.ndcg(rows, c).agg(F.avg("ndcg")).first()[0]
    scored = model.predict(held)
    assert mean(scored, "prediction") > mean(held, "a") > mean(held, "noise")
    gains = {r["feature"]: r["gain"] for r in model.importances(spark).collect()}
    assert gains["a"] > gains["b"] > gains["noise"]
    assert len(model.trees) == int(np.argmax(model.history)) + 1
    model.save(spark, str(tmp_path / "m"))
    again = L.Ranker.load(spark, str(tmp_path / "m")).predict(held)
    assert sorted(map(str, again.collect())) == sorted(map(str, scored.collect()))


def test_gradients_by_hand():
    """Every pair of different labels pushes by its wrong order times what a swap changes in the NDCG."""
    rng = np.random.default_rng(3)
    label, score = rng.integers(0, 4, 9).astype(float), rng.normal(size=9)
    table = pa.table({"user_id": np.r_[np.zeros(9, int), [5]], "item_id": np.arange(10), "label": np.r_[label, 2.0], "score": np.r_[score, 0.0]})
    got = L._gradients(L.Settings(truncate=4, at=3))(table)
    order = np.argsort(-score)
    place = {int(i): p for p, i in enumerate(order)}
    ideal = sum((2.0**x - 1) / math.log2(p + 2) for p, x in enumerate(sorted(label, reverse=True)[:3]))
    want, curve = np.zeros(9), np.zeros(9)
    for i in range(9):
        for j in range(9):
            if label[i] > label[j] and min(place[i], place[j]) < 4:
                delta = abs((2 ** label[i] - 2 ** label[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
                rho = 1 / (1 + math.exp(score[i] - score[j]))
                want[i] += rho * delta
                want[j] -= rho * delta
                curve[i] += rho * (1 - rho) * delta
                curve[j] += rho * (1 - rho) * delta
    assert np.allclose(got.column("grad").to_numpy()[:9], want) and np.allclose(got.column("hess").to_numpy()[:9], curve)
    assert got.column("grad").to_numpy()[9] == 0


def test_graded_ndcg(spark):
    rows = [(1, 1, 3.0, 0.1), (1, 2, 0.0, 0.9), (1, 3, 1.0, 0.5), (2, 1, 0.0, 1.0)]
    got = L.ndcg(spark.createDataFrame(rows, "user_id long, item_id long, label double, s double"), "s", 2).collect()
    assert [(r["user_id"], round(r["ndcg"], 9)) for r in got] == [(1, round((1 / math.log2(3)) / (7 + 1 / math.log2(3)), 9))]


def test_equal_features_make_no_split(spark):
    rows = [(u, i, float(i % 3), 1.0, None) for u in range(10) for i in range(6)]
    data = spark.createDataFrame(rows, "user_id long, item_id long, label double, a double, b double")
    model = L.train(data, ["a", "b"], None, L.Settings(trees=1))
    assert all(len(n) == 1 for t in model.trees for n in t.values())
    assert model.predict(data).count() == 60


def test_rounds_write_no_rows(spark, lists, monkeypatch):
    """More trees store no more tables and shuffle sums alone, whatever the number of rows."""
    stores, keep = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df: stores.append(1) or keep(df))
    written = lambda: spark._jsparkSession.sparkContext().statusStore().executorSummary("driver").totalShuffleWrite()
    train, held = L.split_users(lists)
    made = []
    for trees in (1, 4):
        before = written()
        L.train(train, ["a"], held, L.Settings(trees=trees, depth=1))
        made.append((len(stores), written() - before))
        stores.clear()
    assert made[0][0] == made[1][0] == 2
    assert made[1][1] - made[0][1] < 3 * 8 * 3_000


def test_training_scores_lists_as_predict_does(spark, lists):
    """The NDCG that training follows, from bins, is that of the expression, from values."""
    train, held = L.split_users(lists)
    model = L.train(train, ["a", "b", "noise"], held, L.Settings(trees=3, rate=0.3))
    got = L.ndcg(model.predict(held), "prediction").agg(F.avg("ndcg")).first()[0]
    assert math.isclose(max(model.history), got, rel_tol=1e-9)
