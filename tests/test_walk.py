import numpy as np
from pyspark.sql import functions as F

from lumenrec.operators import graph as G
from lumenrec.operators import retrieval as R


def _vectors(spark, n, key, seed):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i * 3 + 1, [float(x) for x in row]) for i, row in enumerate(r.normal(size=(n, 16)))], f"{key} long, v array<double>")


def test_a_small_graph_is_walked_where_the_queries_are(spark, monkeypatch):
    """The rounds in arrays and as joins meet the same items, also where more are wanted than the beam holds; no table is written for a round."""
    items, queries = _vectors(spark, 600, "item_id", 1), _vectors(spark, 40, "user_id", 2)
    index = G.build(items, degree=8, entries=12)
    monkeypatch.setattr(G, "WALKED_EDGES", 0)
    joined = {(beam, k): sorted(map(tuple, G.search(index, queries, "user_id", k, beam).collect())) for beam, k in ((16, 5), (4, 9))}
    monkeypatch.undo()
    tables = []
    monkeypatch.setattr(G, "stored", lambda df, keep=G.stored: tables.append(1) or keep(df))
    for (beam, k), want in joined.items():
        assert sorted(map(tuple, G.search(index, queries, "user_id", k, beam).collect())) == want and want
    assert len(tables) == 2
    none = G.search(index, queries.limit(0), "user_id", 5)
    assert none.count() == 0 and none.columns == ["user_id", "item_id", "score", "rank"]


def test_scores_of_pairs_carry_no_vectors(spark, monkeypatch):
    """Few vectors go to the tasks once; the scores are those of the joins, and ids without a vector give nothing."""
    items, queries = _vectors(spark, 50, "item_id", 3), _vectors(spark, 20, "user_id", 4)
    pairs = queries.select("user_id").crossJoin(items.select("item_id")).unionByName(spark.createDataFrame([(1, 2), (2, 1), (None, 1)], "user_id long, item_id long"))
    few = R.exact_scores(pairs, queries, items, "user_id")
    assert "Join" not in few.where(F.col("score") > 9)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    got = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(R, "SMALL_BYTES", 0)
    assert got == sorted(map(tuple, R.exact_scores(pairs, queries, items, "user_id").collect())) and len(got) == 1000
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "qv" not in plan
