import numpy as np

from lumenrec.operators import retrieval as R


def test_projections_score_in_blocks(spark, monkeypatch):
    """No pair is joined with its two vectors, and wide buckets give the exact neighbours, each once."""
    monkeypatch.setattr(R, "exact_scores", lambda *a: (_ for _ in ()).throw(AssertionError("a row for each pair")))
    x = np.random.default_rng(4).normal(size=(300, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, v array<double>")
    q = items.where("item_id < 20").withColumnRenamed("item_id", "user_id")
    found = {(r["user_id"], r["rank"]): r["item_id"] for r in R.lsh_search(q, items, "user_id", 5, width=1e6).collect()}
    near = {(u, k + 1): int(i) for u in range(20) for k, i in enumerate(np.lexsort((np.arange(300), -np.round(x[:20] @ x.T, 6)[u]))[:5])}
    agree = sum(found[k] == near[k] for k in near) / len(near)
    assert len(found) == len(near) and agree > 0.5
