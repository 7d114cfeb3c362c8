import hashlib
import random
import re

from brute import stored
from pyspark.sql import functions as F

from lumenrec.llm import queries as Q
from lumenrec.llm import secret_scan as S


def spans(text, rules=S.RULES):
    out = []
    for i, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.IGNORECASE | re.ASCII if rule.either_case else 0):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), i, m.end()))
    return ",".join(f"{rules[i].kind}:{a}:{b}" for a, i, b in sorted(out))


def test_queries_hold_for_matches():
    assert S.trigram_query(r"[0-9a-f]+") == S.EVERYTHING
    assert S.trigram_query(r"ab|abc") == S.EVERYTHING
    assert S.trigram_query(r"x*abcd+") == [frozenset({"abc", "bcd"})] or S.trigram_query(r"x*abcd+") == [frozenset({"abc"})]
    assert sorted(map(sorted, S.trigram_query(r"(foo|bars)=[a-z]+"))) == [["ars", "bar", "rs="], ["foo", "oo="]]
    assert S.trigram_query(r"(?:abc)?x") == S.EVERYTHING
    hits = ["token=abcdefg", "Api_Key : 'x.y.z-1234'", "AKIA" + "Z" * 16, "https://bob:s3cret@host", "xoxb-0123456789", "sk_live_" + "a" * 16, "ghp_" + "A" * 36, "-----BEGIN RSA PRIVATE KEY-----"]
    for rule in S.RULES:
        for text in hits:
            if re.search(rule.pattern, text, re.IGNORECASE if rule.either_case else 0):
                low = text.lower()
                assert any(all(g in low for g in x) for x in S.trigram_query(rule.pattern)), (rule.kind, text)


def test_equals_plain_regexes(spark, tmp_path):
    rng = random.Random(5)
    pieces = ["token", "=", ":", " ", "'", '"', "secret", "PassWord", "passwd", "api_key", "apikey", "ab", "abcdef", "AKIA", "Q" * 16, "0123456789abcdef" * 2, "é", "😀", "\n", "://", "user", "@", "ghp_", "a" * 36, "xoxb-", "z" * 12, "k", "-----BEGIN ", "PRIVATE KEY-----"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += ["", None, "secret=token: abcdefg", "token=password=abcdefg", "x" * 50_000 + " token=abcdefgh", ("é" + "a" * 24 + " ") * 400]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, texts[0], "again", 2), (None, "token=abcdef", None, None)]
    got = S.find_secrets(stored(spark, tmp_path, rows, "doc_id long, text string, rules string, key int"))
    got = got.select("doc_id", S.written(F.col("found")).alias("s")).collect()
    assert sorted((str(r["doc_id"]), r["s"]) for r in got) == sorted((str(i), spans(t)) for i, t, *_ in rows)


def test_same_result_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    from lumenrec.llm import storage

    docs = stored(spark, tmp_path, [(i, "token=abcdef" if i % 3 else "plain") for i in range(90)], "doc_id long, text string")
    want = sorted(map(str, S.find_secrets(docs).collect()))
    monkeypatch.setattr(S, "few", storage.materialize)
    assert sorted(map(str, S.find_secrets(docs).collect())) == want


def test_query_and_empty(spark, sf, tmp_path):
    assert S.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for r in Q.op11_secret_scan(spark, sf).collect():
        text = next(x["text"] for x in docs if x["doc_id"] == r["doc_id"])
        base = spans(text, S.BASE_RULES)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [base.count(k + ":") for k in ("assign", "access", "hex")]
        assert r["spans"] == spans(text)
