"""Hand-computed cases of the operators' special rules."""

import math

import pytest
from pyspark.sql import functions as F

from lumenrec.operators import catalog as C
from lumenrec.operators import features as X
from lumenrec.operators import metrics as M
from lumenrec.operators import preprocess as P
from lumenrec.operators import rerank as K
from lumenrec.operators import retrieval as R
from lumenrec.operators import search as S


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rating_bins_at_edges(spark):
    df = spark.sql("select 1L user_id, cast(id as long) item_id, r rating, timestamp_ntz'2024-01-01 00:00:00' ts, 0L sec from values (1, 0.5D), (2, 1.5D), (3, 2.5D), (4, 4.5D), (5, 5.0D) t(id, r)")
    u = X.user_stats(df).first()
    assert [u[f"rating_{k}_ratio"] for k in range(1, 6)] == [0.2, 0.2, 0.2, 0.0, 0.4]
    items = {r["item_id"]: [r[f"rating_{k}_ratio"] for k in range(1, 6)].index(1.0) + 1 for r in X.item_stats(df).collect()}
    assert items == {1: 1, 2: 1, 3: 2, 4: 4, 5: 5}
    assert all(r["rating_std"] == 0 for r in X.item_stats(df).collect())


def test_percentile_averages_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 1)], "item_id long, rating_count long")
    assert rows(X.popularity_percentile(df), "item_id", "popularity_percentile") == [(1, 0.625), (2, 0.625), (3, 1.0), (4, 0.25)]


def test_titles(spark):
    df = spark.createDataFrame([(1, "1999 (2001) ", "A|B"), (2, "Plain", None), (3, "X (1980)", "C")], "item_id long, title string, genres string")
    assert rows(P.parse_movies(df), "item_id", "year", "clean_title", "genres_list") == [(1, 1999, "1999", ["A", "B"]), (2, None, "Plain", []), (3, 1980, "X", ["C"])]


def test_k_core_cascades(spark):
    pairs = [(u, i) for u in range(3) for i in range(3)] + [(3, 0), (3, 9), (4, 9)]
    df = spark.createDataFrame(pairs, "user_id long, item_id long")
    assert P.k_core(df, 2, 2, cut=lambda x: x).count() == 9
    assert P.k_core(df, 4, 4, cut=lambda x: x).count() == 0


def test_dense_index_is_rank(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 3, 90, -2, None)], "user_id long")
    assert rows(P.dense_index(df, "user_id", "i"), "user_id", "i") == [(-2, 0), (3, 1), (5, 2), (90, 3)]


def test_split_is_a_partition(spark):
    df = spark.range(105).select((F.col("id") % 10).alias("user_id"), F.col("id").alias("item_id"), F.floor(F.col("id") / 7).alias("sec"))
    assert rows(P.time_split(df, ["item_id"]).groupBy("split").count(), "split", "count") == [("test", 11), ("train", 84), ("val", 10)]


@pytest.fixture(scope="module")
def ranked(spark):
    lists = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (3, 10, 1)], "user_id long, item_id long, rank long")
    truth = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (2, 5)], "user_id long, item_id long")
    return lists, truth


def test_metrics(ranked):
    r = {x["user_id"]: x for x in M.per_user(*ranked, 10).collect()}
    assert r.keys() == {1, 2}
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert r[1]["ndcg"] == pytest.approx((1 + 1 / 2) / ideal)
    assert r[1]["map"] == pytest.approx((1 + 2 / 3) / 3)
    assert r[1]["precision"] == pytest.approx(2 / 3) and r[1]["recall"] == pytest.approx(2 / 3)
    assert r[2]["mrr"] == 0 and r[2]["hit_rate"] == 0


def test_rules_bring_promoted_items_back(spark):
    c = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "user_id long, item_id long, score double")
    watched = spark.createDataFrame([(1, 1), (1, 3)], "user_id long, item_id long")
    assert rows(K.business_rules(c, watched, [3]), "rank", "item_id", "score") == [(1, 3, 999.0), (2, 2, 0.8)]


def test_mmr_equals_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(12, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = rng.uniform(size=12)
    df = spark.createDataFrame([(1, i, float(s[i]), v[i].tolist()) for i in range(12)], "user_id long, item_id long, score double, v array<double>")
    scaled, chosen, rest = (s - s.min()) / (s.max() - s.min() + 1e-8), [], list(range(12))
    while len(chosen) < 5:
        gain = [0.7 * scaled[i] - 0.3 * max([v[i] @ v[j] for j in chosen], default=0) for i in rest]
        chosen.append(rest.pop(int(np.argmax(gain))))
    assert [i for _, i in rows(K.mmr(df, 5), "rank", "item_id")] == chosen
    assert [i for _, i in rows(K.mmr(df, 20, 1.0), "rank", "item_id")] == np.argsort(-s).tolist()


def test_search_points(spark):
    c = spark.createDataFrame([(1, "Big Ring", ["ring", "ri"], ["Drama"], 1990, "en"), (2, "ring", [], ["Ring of fire"], None, "hi")], "item_id long, title string, tags array<string>, genres array<string>, year int, original_language string")
    assert rows(S.search(c, "ring"), "item_id", "score") == [(1, 50 + 30 + 15), (2, 100)]
    assert rows(S.search(c, "hindi ring"), "item_id", "score") == [(1, 25 + 15), (2, 100)]
    # the language that comes first in the table counts, not the one that comes first in the query
    assert rows(S.search(c, "hindi english ring"), "item_id", "score") == [(1, 100 + 25 + 15)]
    assert rows(S.search(c, "drama"), "item_id", "score") == [(1, 20)]
    assert C.suggest(c, "r").count() == 0


def test_blocks_give_the_same_neighbours(spark):
    items = spark.range(40).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    q = items.where("item_id < 5").select(F.col("item_id").alias("q"), "v")
    assert rows(R.knn(q, items, "q", 4), "q", "rank", "item_id") == rows(R.knn(q, items, "q", 4, small=7), "q", "rank", "item_id")


def test_probing_all_cells_is_exact(spark):
    items = spark.range(60).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    q = items.where("item_id < 5").select(F.col("item_id").alias("q"), "v")
    index = R.ivf_build(items, 6)
    found = R.ivf_search(index, q, "q", 5, 6)
    probes, curve = R.ivf_tune(index, q, items, "q", 5, 0.9)
    recall = {r["probes"]: r["recall"] for r in curve.collect()}
    assert recall[probes] >= 0.9 and all(v < 0.9 for k, v in recall.items() if k < probes)
    assert R.recall_at_k(R.ivf_search(index, q, "q", 5, probes), R.knn(q, items, "q", 5), "q", 5).first()["recall"] == pytest.approx(recall[probes])
    assert R.recall_at_k(found, R.knn(q, items, "q", 5), "q", 5).first()["recall"] == 1.0


def test_negatives_are_complete_and_unseen(spark):
    pairs = [(u, i) for u in range(8) for i in range(u + 1)] + [(99, i) for i in range(200)]
    df = spark.createDataFrame(pairs, "user_id long, item_id long")
    for sample in (P.sample_negatives, P.sample_negatives_drawn):
        out = rows(sample(df), "user_id", "item_id")
        assert len(out) == len(set(out)) and not set(out) & set(pairs)
        n = {u: sum(x == u for x, _ in out) for u in range(8)}
        assert n == {u: min(4 * (u + 1), 200 - u - 1) for u in range(8)}


def test_losses_by_name_and_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, u[i].tolist(), v[i].tolist()) for i in range(30)], "id long, u array<double>, v array<double>")
    s = u @ v.T / 0.07
    want = float(np.mean(np.log(np.exp(s - s.max(axis=1)[:, None]).sum(axis=1)) + s.max(axis=1) - np.diag(s)))
    assert M.loss("infonce", df).first()["loss"] == pytest.approx(want)
    assert M.loss("infonce", df, small=5).first()["loss"] == pytest.approx(want)
    others = -np.sort(-np.where(np.eye(30, dtype=bool), -np.inf, u @ v.T), axis=1)[:, :3]
    hard = float(np.maximum(0, 0.2 + others - np.diag(u @ v.T)[:, None]).mean())
    for small in (5, 100):
        assert M.loss("in_batch_hard_negative", df, hardest=3, small=small).first()["loss"] == pytest.approx(hard)
    with pytest.raises(ValueError):
        M.loss("none", df)


def test_unknown_users_get_a_row(spark):
    items = spark.range(20).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    users = items.where("item_id < 2").select(F.col("item_id").alias("user_id"), "v")
    out = R.recommend_for(spark.range(1, 4).withColumnRenamed("id", "user_id"), users, items, None, 3).collect()
    assert sorted((r["user_id"], r["rank"] or 0, r["error"] or "") for r in out) == [(1, 1, ""), (1, 2, ""), (1, 3, ""), (2, 0, "User not found"), (3, 0, "User not found")]
