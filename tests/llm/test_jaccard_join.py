import random

import brute
from lumenrec.llm import jaccard_join as J


def expected(texts):
    sets = {k: brute.shingles(v) for k, v in texts.items()}
    return sets, brute.components(texts, brute.jaccard_links(sets))


def check(spark, folder, texts, **more):
    docs = brute.stored(spark, folder, [(k, v, "x", 3) for k, v in texts.items()], "doc_id long, text string, component_id string, n int")
    sets, component = expected(texts)
    rows = J.jaccard_components(docs, **more).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == component[r["doc_id"]], r["doc_id"]


def test_equals_brute_force_on_documents(spark, sf, tmp_path):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(spark, tmp_path, texts | {1000: None, 1001: "", 1002: " \n\t", 1003: "one two", 1004: "ONE\ttwo", 1005: "w " * 30_000})


def test_small_and_chained_sets(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, k = {}, 0
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(1, 40))
        for _ in range(rng.randint(1, 6)):
            texts[k] = " ".join(words)
            k += 1
            words = words + [rng.choice(vocabulary)] if rng.random() < 0.6 else words[: rng.randint(0, 3)] + words[1:]
    common = " ".join(rng.choices(vocabulary, k=60))
    for _ in range(150):
        texts[k] = " ".join(rng.choices(vocabulary, k=30)) + " " + common
        k += 1
    check(spark, tmp_path, texts)


def test_one_large_group_of_near_copies(spark, tmp_path):
    """Copies of one text with a few words changed each: most are linked with the first, many with others only, some with none."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for k in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        if k % 7 == 0:
            words = words[: rng.randint(110, 150)]
        texts[k] = " ".join(words)
    check(spark, tmp_path, texts)


def test_empty_and_all_null_tables(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = J.jaccard_components(spark.createDataFrame([(1, None), (2, None), (None, "a b c d e f")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == {(1, 0, 1), (2, 0, 2), (None, 2, None)}


def test_boundary_follows_cost():
    assert J.choose_boundary({}, {}, 80) == 0
    sets = {s: 100 for s in range(1, 31)}
    short_lists = {s: 100.0 * J.prefix_length(s, 80) for s in sets}
    hot_lists = {s: 1e6 for s in sets}
    assert J.choose_boundary(sets, short_lists, 80) <= 4 < 10 <= J.choose_boundary(sets, hot_lists, 80)


def test_enumeration_alone_and_lists_alone_agree(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    texts, k = {}, 0
    for _ in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 18))]
        for _ in range(5):
            texts[k], k = " ".join(words), k + 1
            words = words + [f"w{rng.randrange(500)}"] if rng.random() < 0.5 else words[1:]
    for boundary in (0, 5, 14):
        monkeypatch.setattr(J, "choose_boundary", lambda *_, b=boundary: b)
        check(spark, tmp_path, texts)
