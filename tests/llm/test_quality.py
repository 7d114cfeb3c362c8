import collections
import re

import brute
from lumenrec.llm import quality as Q


def counts(text):
    w = brute.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for ps in at.values() if len(ps) > 1 for p in ps for j in range(p, p + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark, sf, tmp_path):
    rows = {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows |= {1000: (None, None, None), 1001: ("", "en", "s"), 1002: (" \n\t", "en", None), 1003: ("a b c d e " * 30, "en", "s"), 1004: ("x#* y\n" * 4 + "é ü z", "en", "s"), 1005: ("ab " * 30_000, "de", "s")}
    clean = [v for v in rows.values() if v[1] == "en"][0]
    rows |= {3000 + i: (f"{clean[0]} number{i} {'tail' * (i % 5)}", "en", "same") for i in range(80)}
    rows[4000] = (" ".join(f"###{i}***" for i in range(300)), "en", "same")
    docs = brute.stored(spark, tmp_path, [(k, *v, 1.5) for k, v in rows.items()], "doc_id long, text string, lang string, source string, distance double")
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    assert got.keys() == rows.keys()
    for k, r in got.items():
        want = counts(rows[k][0])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, k
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert not got[4000]["kept"] and not got[4000]["base_failed"]
    assert sum(got[3000 + i]["kept"] for i in range(80)) >= 78


def test_estimate_is_robust(spark):
    """A third of wild outliers does not move the estimate of a cell, as a plain covariance would."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5)) * [2, 1, 1, 1, 1]
    x[:150] += 50
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x_{i}" for i in range(5)])).selectExpr("struct(1 as level) as cell", "*")
    e = Q.estimate_cells(df).first()
    assert all(abs(e[f"m_{i}"]) < 0.4 for i in range(5))
    assert 1.3 < 1 / e["k_0_0"] < 2.6
    d2 = np.array([r["d2"] for r in Q._distance(df, Q.estimate_cells(df)).collect()])
    assert (d2 > Q.CUTOFF).sum() == 150


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_small_sources_are_judged_by_all_rows_of_their_language(spark, tmp_path):
    """A source of one junk text must not be its own centre; large sources shape its language's estimate."""
    prose = lambda i: " ".join(f"word{i * j % 97}{'abcdefg'[i * j % 7]}" for j in range(1, 80 + i % 9))
    junk = " ".join(f"###{i}***" for i in range(300))
    rows = [(i, prose(i), "en", "large") for i in range(200)] + [(1000, prose(500), "en", "one"), (1001, junk, "en", "junk")]
    rows += [(2000, prose(600), "xx", "few"), (2001, junk, "xx", "odd")]
    docs = brute.stored(spark, tmp_path, rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    assert len(got) == len(rows)
    assert not got[1001]["base_failed"] and not got[1001]["kept"] and got[1000]["kept"]
    assert not got[2001]["base_failed"] and not got[2001]["kept"] and got[2000]["kept"]
