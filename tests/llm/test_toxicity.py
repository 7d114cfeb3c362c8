import random

import brute
from lumenrec.llm import toxicity as T


def corpus(rng, n, insults):
    plain = ["".join(rng.choices("aeiorstnl", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words, y = rng.choices(plain, k=rng.randint(5, 300)), int(rng.random() < 0.3)
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((" ".join(words), y))
    return rows


def test_held_out_and_misspelt_words():
    rng = random.Random(1)
    model = T.fit(corpus(rng, 500, ["wickedfool", "dumbclod"]), T.Settings(epochs=5))
    test = corpus(rng, 200, ["wickedfool", "dumbclod"])
    right = sum((model.score(t) >= 0.3) == bool(y) for t, y in test)
    assert right >= 190
    worse = corpus(rng, 100, ["wickedfoool", "dumbclodd", "wicked-fool"])
    assert sum(model.score(t) >= 0.3 for t, y in worse if y) >= 0.7 * sum(y for _, y in worse)


def test_edges(spark, tmp_path):
    model = T.fit([("bad " * 20, 1), ("good " * 20, 0), (None, 1), ("", 0), ("x", None)], T.Settings(epochs=2))
    docs = brute.stored(spark, tmp_path, [(1, None, 0.5), (2, "", None), (3, "good", 1.0), (None, "bad", 1.0), (5, "é " * 50_000, 0.0)], "doc_id long, text string, score double")
    out = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert out.keys() == {1, 2, 3, None, 5} and all(0 <= s <= 1 for s in out.values()) and out[1] == out[2]
    assert T.score(docs.limit(0), T.fit([])).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "'t' as text")
    labels = spark.range(80).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").unionByName(spark.sql("select null doc_id, 1 toxic union all select 3L, null"))
    assert len(T.labelled_sample(docs, labels, "toxic", T.Settings(max_rows=30))) <= 30
    assert len(T.labelled_sample(docs, labels, "toxic", T.Settings())) == 50


def test_query_on_held_out_labels(spark):
    """Labels of the held-out fold are never seen: most toxic documents are found, clean ones are left alone.

    At a scale with thousands of labels; the few hundred of the smaller tables find about half.
    """
    import zlib

    from lumenrec.llm import queries as Q

    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in Q.op6_toxicity(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    marks = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    bad, good = [r["predicted"] for r, y in marks if y], [r["predicted"] for r, y in marks if not y]
    assert len(bad) >= 50 and sum(bad) >= 0.8 * len(bad) and sum(good) <= 0.03 * len(good), (sum(bad), len(bad), sum(good), len(good))
