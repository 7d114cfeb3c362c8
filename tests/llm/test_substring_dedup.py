import random

import brute
from lumenrec.llm import substring_dedup as S


def test_finds_planted_passages_and_nothing_else(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() + ("\n" if rng.random() < 0.03 else "") for _ in range(n))
    rows = {i: prose(rng.randint(30, 400)) for i in range(200)}
    planted = {}
    for p in range(30):
        passage = " ".join(word() for _ in range(rng.randint(60, 90)))
        docs = rng.sample(range(200), 3)
        planted[p] = sorted(docs)
        for d in docs:
            a, b = rows[d].split(" ", 1)
            rows[d] = f"{a} {passage} {b}" if p % 2 else f"{rows[d]}\n{passage}"
    rows |= {500: None, 501: "", 502: rows[0], 503: "w " * 20_000}
    docs = brute.stored(spark, tmp_path, [(k, v, 1, "z") for k, v in rows.items()], "doc_id long, text string, n int, key string")
    out = S.repeated_spans(docs).collect()
    flagged = {r["doc_id"] for r in out}
    later = {d for docs in planted.values() for d in docs[1:]}
    assert len(later - flagged) <= 2, later - flagged
    assert flagged <= later | {502, 503}
    assert all(0 <= r["start_word"] and r["start_word"] + r["n_words"] <= len(rows[r["doc_id"]].split()) for r in out)
    whole = [r for r in out if r["doc_id"] == 502]
    assert sum(r["n_words"] for r in whole) > 0.6 * len(rows[0].split()) and all(0 in r["first_doc_ids"] for r in whole if r["n_words"] > 60)


def test_empty_table(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _pieces(text):
    _, _, starts, ends, _, number = S.cut([text])
    words = brute.WORD.findall(brute.lower(text or ""))
    for a, b, k in zip(starts.tolist(), ends.tolist(), number.tolist()):
        if b - a >= S.LEAST_PIECE:
            yield k, a, b, frozenset(tuple(words[i : i + 5]) for i in range(a, b - 4))


def test_equals_brute_force_over_pieces(spark, sf, tmp_path):
    """Every run of removable pieces lies in a reported span, and every span holds one (bands may miss a fuzzy link)."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rng = random.Random(5)
    for i in range(40):  # near copies, a word of 40 changed, re-wrapped in short lines
        w = rows[rng.randrange(50)].split()
        w = [x if rng.random() > 1 / 40 else "changed" for x in w]
        rows[1000 + i] = "\n".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7))
    docs = brute.stored(spark, tmp_path, [(k, v, 1) for k, v in rows.items()], "doc_id long, text string, id int")
    spans = {}
    for r in S.repeated_spans(docs).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["start_word"] + r["n_words"]))
    pieces = {(d, k): (a, b, s) for d, t in rows.items() for k, a, b, s in _pieces(t)}
    root = brute.components(pieces, brute.jaccard_links({x: s for x, (_, _, s) in pieces.items()}))
    removed = sorted(x for x in pieces if root[x] != x)
    runs = []
    for d, k in removed:
        a, b, _ = pieces[d, k]
        if runs and runs[-1][0] == d and runs[-1][2] == a:
            runs[-1][2] = b
        else:
            runs.append([d, a, b])
    runs = [r for r in runs if r[2] - r[1] >= S.LEAST_WORDS]
    missed = [r for r in runs if not any(a <= r[1] and r[2] <= b for a, b in spans.get(r[0], []))]
    assert len(runs) > 100 and len(missed) <= 0.03 * len(runs), (len(runs), missed[:5])
    for d, found in spans.items():
        assert all(any(d == e and a < pieces[e, k][1] and pieces[e, k][0] < b for e, k in removed) for a, b in found)


def test_passages_in_short_lines_are_covered_to_their_ends(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    passage = [word() for _ in range(60)]
    rows, at = [], {}
    for d in range(30):
        own = [word() for _ in range(rng.randint(5, 60))]
        cut = rng.randrange(len(own))
        width = rng.randint(5, 14)
        w = own[:cut] + passage + own[cut:]
        at[d] = cut
        rows.append((d, "\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width))))
    out = {}
    for r in S.repeated_spans(brute.stored(spark, tmp_path, rows, "doc_id long, text string")).collect():
        out.setdefault(r["doc_id"], []).append(r)
    covered = [sum(max(0, min(r["start_word"] + r["n_words"], at[d] + 60) - max(r["start_word"], at[d])) for r in out.get(d, [])) for d in range(1, 30)]
    assert 0 not in out and min(covered) >= 40 and sum(covered) >= 0.9 * 60 * 29, covered


def test_large_ids_repeated_rows_and_nulls(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(200))
    big = 1 << 62
    rows = [(big, text), (big, text), (-big, text), (7, None), (None, text), (8, "")]
    out = S.repeated_spans(brute.stored(spark, tmp_path, rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {big} and all(r["first_doc_ids"] == [-big] for r in out)
    assert sum(r["n_words"] for r in out) >= 180
