import random

import numpy as np

import brute
from lumenrec.llm import mixing as M


def test_rates_reach_the_targets(spark, tmp_path):
    rng = random.Random(6)
    words = {s: [f"{s}{i}" for i in range(40)] for s in "abc"}
    rows = []
    for i in range(600):
        s = "a" if i % 6 < 4 else "bc"[i % 2]
        rows.append((i, " ".join(rng.choices(words[s], k=30)), s, 2.0))
    rows += [(1000, None, None, 1.0), (1001, "", "b", 1.0), (None, "a1 a2", "a", 1.0)]
    docs = brute.stored(spark, tmp_path, rows, "doc_id long, text string, source string, rate double")
    labels = spark.range(0, 600, 2).selectExpr("id as doc_id", "1 as quality").unionByName(spark.sql("select null doc_id, 0 quality"))
    out = M.fit_rates(docs, labels, targets={"a": 1, "b": 1, "c": 1}, settings=M.Settings(steps=40))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in got.values())
    tokens = {s: sum(r["rate"] * r["n_tokens"] for i, r in got.items() if i is not None and i < 600 and rows[i][2] == s) for s in "abc"}
    total = sum(tokens.values())
    assert all(abs(t / total - 1 / 3) < 0.1 for t in tokens.values()), tokens
    assert got[1001]["rate"] == 1.0 and got[1000]["copies"] == 1
    # every document stays, copies are rates rounded, and the gaps are those of the documents' own numbers
    assert all(r["rate"] >= 1 and abs(r["copies"] - r["rate"]) < 1 for r in got.values())
    assert got[0]["gap"] < 0.02 and got[0]["copies_gap"] < 0.05
    copied = {s: sum(r["copies"] * r["n_tokens"] for i, r in got.items() if i is not None and i < 600 and rows[i][2] == s) for s in "abc"}
    assert all(abs(t / sum(copied.values()) - 1 / 3) < 0.1 for t in copied.values()), copied
    mixed = M.apply_rates(docs, out)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got.values() if r["doc_id"] is not None) + 1


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert M.fit_rates(docs, labels).count() == 2
    assert M.fit_rates(docs.limit(0), labels).count() == 0


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = M.fit_rates(docs, spark.read.parquet(f"{sf}/labels.parquet"), settings=M.Settings(steps=1))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_many_domains_long_texts_and_repeated_ids(spark, tmp_path):
    rows = [(i, f"w{i % 300} v{i % 7} x", f"s{i % 300}") for i in range(900)] + [(0, "long " * 40_000, "s0"), (900, None, "unlabelled")]
    docs = brute.stored(spark, tmp_path, rows, "doc_id long, text string, source string")
    labels = spark.range(0, 900, 3).selectExpr("id as doc_id")
    out = M.fit_rates(docs, labels, settings=M.Settings(steps=2, calibrations=1))
    assert out.count() == len(rows) and out.where("rate < 1 or copies < 1").isEmpty()
    mixed = M.apply_rates(docs, out)
    assert mixed.select("doc_id").distinct().count() == 901


def test_targets_may_leave_a_domain_out_where_documents_may_go(spark, tmp_path):
    rows = [(i, f"{'ab'[i % 2]}{i % 5} {'ab'[i % 2]}9", "ab"[i % 2]) for i in range(100)]
    docs = brute.stored(spark, tmp_path, rows, "doc_id long, text string, source string")
    out = M.fit_rates(docs, spark.range(100).withColumnRenamed("id", "doc_id"), targets={"a": 1.0}, settings=M.Settings(floor=0.0, sharpness=1e6)).collect()
    assert out[0]["gap"] < 0.01
    assert all((r["rate"] > 1.5) == (rows[r["doc_id"]][2] == "a") for r in out)


def test_query_equals_projected_gradient_in_numpy(spark, sf):
    """The same steps on all rows at once, from the same posteriors, and shares recomputed from the result."""
    from lumenrec.llm import queries as Q

    s = M.Settings()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    raw, names = M._posteriors(docs.select("doc_id", "text", "source"), labels, "source", s)
    k, rows = len(names), raw.orderBy("doc_id").collect()
    n, p, own = np.array([r["n"] for r in rows], float), np.array([r["p"] for r in rows]), np.array([r["own"] for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and p.min() >= 0
    tokens = np.bincount(own, n, k)
    for _ in range(s.calibrations):  # posteriors scaled by domain until their totals are the domains' own
        w = tokens / (n @ p) if _ == 0 else w * tokens / (n @ q)
        q = p * w
        q /= q.sum(axis=1, keepdims=True)
    goal = (tokens / tokens.sum()) ** s.flatten
    goal /= goal.sum()
    share = lambda r: (n * r) @ q / n.sum()
    total = max(1.0, (s.floor * share(np.ones(len(n)))[goal > 0] / goal[goal > 0]).max())
    inverse = np.linalg.pinv((q * n[:, None]).T @ q / n.sum(), rcond=1e-6, hermitian=True)
    r, best, gap = np.ones(len(n)), np.ones(len(n)), np.inf
    for step in range(s.steps + 1):
        now = np.abs(share(r) / share(r).sum() - goal).max()
        if now < gap:
            best, gap = r, now
        if gap < s.tolerance:
            break
        r = np.where(n > 0, np.maximum(s.floor, r - q @ (inverse @ (share(r) - total * goal))), 1.0)
    got = {x["doc_id"]: x for x in Q.op8_source_mixing(spark, sf).collect()}
    ids = [x["doc_id"] for x in rows]
    assert np.allclose([got[i]["rate"] for i in ids], best, atol=1e-6)
    assert abs(got[ids[0]]["gap"] - gap) < 1e-9
    copies = np.array([got[i]["copies"] for i in ids], float)
    assert abs(np.abs(share(copies) / share(copies).sum() - goal).max() - got[ids[0]]["copies_gap"]) < 1e-9
