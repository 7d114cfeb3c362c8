import collections
import math

import numpy as np

import brute
from lumenrec.llm import lm_scoring as L
from lumenrec.llm.storage import materialize


def test_equals_plain_counts(spark, sf, tmp_path):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts |= {1000: None, 1001: "", 1002: "w " * 40_000, 1003: "Zzz zzz"}
    docs = brute.stored(spark, tmp_path, [(k, v, 1.0) for k, v in texts.items()], "doc_id long, text string, score double")
    train = docs.where("doc_id % 5 <> 1")
    counts = materialize(L.count_ngrams(train))
    model = L.fit(counts, head=500)
    token = {k: brute.WORD.findall(brute.lower(t or "")) + ["\0end"] for k, t in texts.items()}
    c = collections.Counter(w for k, ws in token.items() if k % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)
    out = {r["doc_id"]: r for r in L.score(docs, model, counts).collect()}
    assert out.keys() == texts.keys()
    for k, ws in token.items():
        r = out[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] <= 0
    assert sum(r["score"] for r in out.values()) > sum(r["base_score"] for r in out.values())

    # the filter gives every stored count's level back, or more
    f = L.Filter(model.bits)
    uni = counts.where("order = 1").toPandas()
    levels = f.levels(uni["key"].to_numpy().view(np.uint64), 1)
    want = 1 + np.floor(np.log2(uni["n"].to_numpy()))
    assert (levels >= want).all() and (levels > want).mean() < 0.03


def test_bounded_filter_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b a b a b c d e f g h"), (2, None)], "doc_id long, text string")
    counts = materialize(L.count_ngrams(docs))
    small = L.fit(counts, max_bits=1 << 14)
    assert small.bits.size * 8 <= 1 << 16
    none = materialize(L.count_ngrams(docs.limit(0)))
    rows = L.score(docs, L.fit(none), none).collect()
    assert {r["n_known"] for r in rows} == {0} and all(math.isfinite(r["score"]) for r in rows)
    assert L.score(docs.limit(0), small, counts).count() == 0


def test_scores_do_not_depend_on_the_filters_size(spark, sf, tmp_path, monkeypatch):
    """N-grams that do not fit the broadcast filter are looked up in the count table; those seen once count."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(1001, "unheard of words " * 50), (1002, None), (1003, "rareone raretwo")]
    docs = brute.stored(spark, tmp_path, rows, "doc_id long, text string")
    train = docs.where("doc_id % 5 <> 1 or doc_id = 1003")
    counts = materialize(L.count_ngrams(train))
    token = {k: [w for w in brute.WORD.findall(brute.lower(t or ""))] + ["\0end"] for k, t in rows}
    texts = [ws for k, ws in token.items() if k % 5 != 1 or k == 1003]
    c = collections.Counter(w for ws in texts for w in ws)
    c2 = collections.Counter(pair for ws in texts for pair in zip(["\0start"] + ws[:-1], ws))
    c["\0start"] = len(texts)
    value = lambda n: (2.0 ** (n.bit_length() - 1) + 2.0 ** n.bit_length() - 1) / 2 if n else 0.0
    floor = sum(value(n) for w, n in c.items() if w != "\0start") + 0.5 * len(c)

    def want(ws):
        pairs = zip(["\0start"] + ws[:-1], ws)
        return sum(math.log10((value(c2[a, b]) + L.PRIOR * (value(c[b]) + 0.5) / floor) / (value(c[a]) + L.PRIOR)) for a, b in pairs)

    for bits, unigrams_fit in ((L.MAX_FILTER_BITS, True), (1 << 17, True), (1 << 18, False)):
        # many bits a key where few keys fit, so that false positives stay rare
        monkeypatch.setattr(L, "BITS_PER_KEY", 10 if unigrams_fit else 160)
        model = L.fit(counts, max_bits=bits, head=50)
        assert (model.lowest[1] == 1) == unigrams_fit and (model.lowest[2] == 1) == (bits == L.MAX_FILTER_BITS)
        got = {r["doc_id"]: r["score"] for r in L.score(docs, model, counts).collect()}
        off = {k: abs(got[k] / want(ws) - 1) for k, ws in token.items()}
        assert max(off.values()) < 0.01, (bits, model.lowest, off)


def test_few_bytes_are_shuffled_for_an_ngram(spark, tmp_path):
    """An n-gram is counted, and asked for where the filter lacks it, in a few bytes."""
    r = np.random.default_rng(5)
    docs = brute.stored(spark, tmp_path, [(i, " ".join(f"w{w}" for w in r.integers(0, 4_000, 2_000))) for i in range(200)], "doc_id long, text string").coalesce(2)

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the tables are large
    try:
        counts = materialize(L.count_ngrams(docs))
        model = L.fit(counts, max_bits=1 << 20)
        assert model.lowest[2] > 1
        assert L.score(docs, model, counts).agg({"score": "sum"}).first()[0] < 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # 400,000 bigrams, nearly all different: counted, asked for, and held
    assert written() - before < 20 * 400_000
