import numpy as np
import pytest

from lumenrec.operators import features as X
from lumenrec.operators import metrics as M
from lumenrec.operators import preprocess as P
from lumenrec.operators import retrieval as R
from lumenrec.operators import search as S


@pytest.fixture
def shuffled(spark):
    """Bytes that are shuffled while a table is made."""
    written = lambda: spark._jsparkSession.sparkContext().statusStore().executorSummary("driver").totalShuffleWrite()

    def run(make) -> int:
        before = written()
        make().write.format("noop").mode("overwrite").save()
        return written() - before

    return run


def _vectors(spark, key: str, n: int):
    x = np.random.default_rng(5).normal(size=(n, 64))
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], f"{key} long, v array<double>")


def test_user_vectors_shuffles_ids(spark, shuffled):
    rows = spark.range(8_000).selectExpr("id % 2000 user_id", "id * 7 % 50 item_id").repartition(4)
    items = _vectors(spark, "item_id", 50)
    # a sum for each of 64 components of a user would be more than 500 bytes a row
    assert shuffled(lambda: R.user_vectors(rows, items)) < 8_000 * 50
    want = rows.join(items, "item_id").where("user_id = 7").toPandas()
    mean = np.stack(want["v"]).mean(axis=0)
    got = R.user_vectors(rows, items).where("user_id = 7").first()["v"]
    assert np.allclose(got, mean / np.linalg.norm(mean))


def test_pairwise_shuffles_no_vector_with_a_pair(spark, shuffled):
    users, items = _vectors(spark, "user_id", 400), _vectors(spark, "item_id", 100)
    pairs = spark.range(40_000).selectExpr("id % 400 user_id", "cast(id / 400 as long) item_id").repartition(4)
    known = lambda key, n: spark.range(n).selectExpr(f"id {key}", "2.0D rating_mean", "3L rating_count")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = X.pairwise(pairs, users, items, known("user_id", 400), known("item_id", 100))
        assert shuffled(lambda: made) < 40_000 * 50
        assert made.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_draws_are_not_shuffled(spark, shuffled):
    rows = spark.range(4_000).selectExpr("id % 200 user_id", "pmod(id * 7919, 3001) item_id").repartition(4)
    # 48,000 draws
    assert shuffled(lambda: P.sample_negatives(rows)) < 48_000 * 10
    out = P.sample_negatives(rows)
    assert out.count() == out.distinct().count() == 4 * rows.distinct().count()
    assert out.join(rows, ["user_id", "item_id"], "left_semi").isEmpty()


def test_queries_of_a_table_make_no_hit_for_each_item(spark, shuffled):
    catalog = spark.range(1_000).selectExpr("id item_id", "concat('Red ring ', id) title", "array('red', 'ring') tags", "array('SMALL', concat('Brand', id % 5)) genres", "cast(1950 + id % 7 as int) year", "'en' original_language")
    queries = spark.range(1_000).selectExpr("id query_id", "'red small' query", "array('SMALL', concat('Brand', id % 5)) genres", "1950 + id % 7 year_min", "cast(null as long) year_max")
    # a million pairs of a query and an item
    assert shuffled(lambda: S.search_all(catalog, queries, 5)) < 1_000_000
    found = S.search_all(catalog, queries, 5).where("query_id = 9").orderBy("rank").collect()
    want = S.search(catalog, "red small", 5, {"genres": ["SMALL", "Brand4"], "year_min": 1952}).collect()
    assert [(r["item_id"], r["score"]) for r in found] == [(r["item_id"], r["score"]) for r in want]


def test_chat_queries_make_no_hit_for_each_item(spark, shuffled):
    catalog = spark.range(2_000).selectExpr("id item_id", "concat('Red ring ', id % 7) title", "array(concat('Ann', id % 3)) cast", "array('SMALL', concat('Brand', id % 5)) genres", "case when id % 400 = 9 then concat('a small film of ', id) else '' end overview", "if(id % 6 = 1, 'hi', 'en') original_language")
    texts = ["red", "small red ring 3 with ann2", "bollywood small", "film", "brand4 or ann1", "a small film of 1209", "red ring 5"]
    queries = spark.range(2_000).selectExpr("id query_id", f"array({', '.join(map(repr, texts))})[id % {len(texts)}] query")
    # more than a million pairs of a query and an item
    assert shuffled(lambda: S.chat_search_all(catalog, queries, 5)) < 1_000_000
    found = S.chat_search_all(catalog, queries, 5).where(f"query_id >= 700 and query_id < {700 + len(texts)}").orderBy("query_id", "rank").collect()
    for i, text in enumerate(texts):
        want = S.chat_search(catalog, text, 5).collect()
        assert [(r["item_id"], r["score"]) for r in found if r["query_id"] == 700 + i] == [(r["item_id"], r["score"]) for r in want], text


def test_exact_scores_shuffle_no_vector_with_a_pair(spark, shuffled):
    users, items = _vectors(spark, "user_id", 400), _vectors(spark, "item_id", 100)
    pairs = spark.range(40_000).selectExpr("id % 400 user_id", "cast(id / 400 as long) item_id").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert shuffled(lambda: R.exact_scores(pairs, users, items, "user_id")) < 40_000 * 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_metrics_shuffle_the_lists_once(spark, shuffled):
    spread = "pmod(xxhash64(id), 1000000000000)"
    lists = spark.range(100_000).selectExpr("id % 1000 user_id", f"{spread} item_id", "cast(id / 1000 as long) + 1 rank")
    truth = spark.range(40_000).selectExpr("id % 1000 user_id", f"{spread} item_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        once = shuffled(lambda: lists.repartition(8, "user_id")) + shuffled(lambda: truth.repartition(8, "user_id"))
        assert shuffled(lambda: M.per_user(lists, truth, 10)) < 1.2 * once
        row = M.per_user(lists, truth, 10).where("user_id = 7").first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the first 40 of a list are the truth
    assert (row["precision"], row["recall"], row["map"], row["mrr"]) == (1.0, 0.25, 1.0, 1.0)
