import random

import brute
from lumenrec.llm import line_dedup as L


def expected(rows):
    lines = {(d, i): s for d, t in rows.items() for i, s in L.lines_of(t)}
    sets = {k: frozenset(L.shingles(s)) for k, s in lines.items()}
    return {k: c for k, c in brute.components(lines, brute.jaccard_links(sets)).items()}


def test_equals_brute_force(spark, sf, tmp_path):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()}
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefghij  ", k=300))
    for i in range(60):
        at = rng.randrange(280)
        rows[1000 + i] = "short\n\n" + base[:at] + "#" * (i % 3) + base[at:] + "\n" + "".join(rng.choices("klmnop ", k=60))
    rows |= {2000: None, 2001: "", 2002: "\n\n", 2003: base, 2004: "  " + base + "\t", 2005: "é" * 50_000, 2006: "é" * 50_000}
    docs = brute.stored(spark, tmp_path, [(k, v, 7) for k, v in rows.items()], "doc_id long, text string, line_no int")
    classes = L.line_components(docs)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in classes.collect()}
    want = expected(rows)
    wrong = {k for k in want if got.get(k, k) != want[k]}
    assert len(wrong) <= 2, [(k, got.get(k), want[k]) for k in wrong][:5]
    assert got.keys() <= want.keys()

    left = {r["doc_id"]: r["text"] for r in L.remove_lines(docs, classes).collect()}
    assert left[2000] is None and left[2001] == "" and 2003 not in left and 2006 not in left
    assert left[1000].startswith("short\n\n") and base[:5] in left[1000]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    classes = L.line_components(docs)
    assert classes.count() == 0 and L.remove_lines(docs, classes).count() == 0


def test_short_lines_take_part(spark, tmp_path):
    rows = [(1, "Share\nfirst text of its own"), (2, "a second text\n Share\nRead more"), (3, "Read more\nshare\n\n \n"), (4, "点击这里阅读更多内容吧\nx"), (5, "点击这里阅读更多内容吧\nx\ny")]
    docs = brute.stored(spark, tmp_path, rows, "doc_id long, text string")
    classes = L.line_components(docs)
    got = {((r["doc_id"], r["line_no"]), (r["class_doc_id"], r["class_line_no"])) for r in classes.collect()}
    assert got == {((1, 0), (1, 0)), ((2, 1), (1, 0)), ((2, 2), (2, 2)), ((3, 0), (2, 2)), ((4, 0), (4, 0)), ((5, 0), (4, 0)), ((4, 1), (4, 1)), ((5, 1), (4, 1))}
    left = {r["doc_id"]: r["text"] for r in L.remove_lines(docs, classes).collect()}
    assert left[2] == "a second text\nRead more" and left[3] == "share\n\n \n" and left[5] == "y"


def test_large_ids_repeated_rows_and_nulls(spark, tmp_path):
    line = "a line of its own that repeats, word for word"
    big = 1 << 62
    rows = [(big, line), (big, line), (-big, f"x\n{line}"), (7, None), (None, line), (8, "")]
    got = L.line_components(brute.stored(spark, tmp_path, rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["line_no"], r["class_doc_id"], r["class_line_no"], r["kept"]) for r in got) == [(-big, 1, -big, 1, True), (big, 0, -big, 1, False)]
