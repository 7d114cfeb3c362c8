import hashlib
import random

import numpy as np

import brute
from lumenrec.llm import suffix_dedup as S


def expected(rows):
    """By a table of the first place of every 100-byte string."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows.items()):
        raw, cover = (text or "").encode(), np.zeros(len((text or "").encode()) + 1, int)
        for i in range(len(raw) - S.LENGTH + 1):
            if seen.setdefault(raw[i : i + S.LENGTH], (doc_id, i)) != (doc_id, i):
                cover[i : i + S.LENGTH] = 1
        cover = cover[: len(raw)]
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        out[doc_id] = (len(raw), int(cover.sum()), int((np.diff(cover, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, folder, rows, monkeypatch=None):
    docs = brute.stored(spark, folder, [(k, v, b"x") for k, v in rows.items()], "doc_id long, text string, kept binary").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in S.remove_repeats(docs).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_equals_brute_force(spark, sf, tmp_path):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefg ", k=400))
    rows |= {1000: None, 1001: "", 1002: "x" * 99, 1003: "y" * 100, 1004: "y" * 101, 1005: "ab" * 5000, 1006: passage + "!", 1007: "?" + passage[150:] + passage[:130], 1008: passage, 1009: "é" * 120, -5: passage}
    for i in range(40):
        a = rng.randrange(200)
        rows[2000 + i] = "".join(rng.choices("hijk", k=50)) + passage[a : a + 60 + i] + "".join(rng.choices("hijk", k=30))
    check(spark, tmp_path, rows)


def test_repeats_by_sorting():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(97, 100, 250), 6), rng.integers(97, 99, 300)]).astype(np.uint8)
    starts = rng.permutation(len(data) - S.LENGTH + 1)
    seen, want = set(), []
    for s in starts:
        x = data[s : s + S.LENGTH].tobytes()
        want.append(x in seen)
        seen.add(x)
    assert (S.repeats(data, starts) >= 0).tolist() == want


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(map(str, range(80)))
    docs = brute.stored(spark, tmp_path, [(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in S.remove_repeats(docs).collect()) == [(0, 0), (1, 0), (1, 0), (2, 150)]


def test_one_id_with_several_texts(spark, tmp_path):
    """Each text of an id is judged on its own; only what stands earlier goes."""
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("klmnop", k=n))
    a, b, c = make(300), make(269), make(150)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c + a[50:200]), (3, b[:180] + c), (3, "short")]
    docs = brute.stored(spark, tmp_path, rows, "doc_id long, text string")
    places = sorted({(i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in rows})
    want = expected({k: t for k, (_, _, t) in enumerate(places)})
    per = {(i, t): want[k] for k, (i, _, t) in enumerate(places)}
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in S.remove_repeats(docs).collect())
    assert got == sorted((i, *per[i, t]) for i, t in rows)
    assert (2, 269, 0, 0, hashlib.sha256(b.encode()).hexdigest()) in got
