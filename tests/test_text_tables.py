"""Containment, tables of queries, rules, intents and streams against plain versions."""

import random

from pyspark.sql import functions as F

from lumenrec.functions.containment import contained
from lumenrec.operators import catalog as C
from lumenrec.operators import rerank as K
from lumenrec.operators import search as S
from lumenrec.streaming import events as E


def test_containment_equals_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abé😀 c") for _ in range(n))
    texts = [make(rng.randrange(0, 30)) for _ in range(120)] + [None, "", "x" * 3000 + "needle"]
    terms = [make(rng.randrange(1, 6)) for _ in range(150)] + ["needle", "", None, "a", "zz"]
    got = contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {(t, m) for t in texts for m in terms if t is not None and m and m in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_tables_of_queries_equal_single_ones(spark):
    rng = random.Random(3)
    words = ["ring", "hindi", "king", "love", "sci-fi", "scifi", "space", "at", "action", "drama"]
    items = [(i, " ".join(rng.sample(words, 2)).title(), [rng.choice(words) for _ in range(rng.randrange(4))], [rng.choice(["Action", "Drama", "Sci-Fi"]) for _ in range(rng.randrange(3))], rng.choice([None, 1980, 1995, 2010]), rng.choice(["en", "hi", "fr"])) for i in range(200)]
    catalog = spark.createDataFrame(items, "item_id long, title string, tags array<string>, genres array<string>, year int, original_language string")
    asked = [(1, "Ring", None, None, None), (2, " hindi english LOVE", None, None, None), (3, "sci-fi king", ["action", "Drama"], 1990, None), (4, "space at drama", ["drama"], 1970, 1990), (5, "action", ["drama"], 1990, None), (6, "french film", None, 0, 5), (7, "nothing here", [], 2000, 1990), (8, "  ", None, None, None)]
    got = S.search_all(catalog, spark.createDataFrame(asked, "query_id long, query string, genres array<string>, year_min int, year_max int"), 7).collect()
    for i, q, genres, low, high in asked:
        one = [] if not q.strip() else [(r["item_id"], r["score"]) for r in S.search(catalog, q, 7, {"genres": genres, "year_min": low, "year_max": high}).collect()]
        assert sorted((-r["score"], r["item_id"]) for r in got if r["query_id"] == i) == sorted((-s, x) for x, s in one), q


def test_rules_leave_the_guard_word_alone(spark):
    catalog = spark.createDataFrame([(1, "Great Escape"), (2, "Heat (1995)"), (3, "Heat"), (4, "Heat (1995) (cut)"), (5, "Heats"), (6, "The Heat (Escape) (1)")], "item_id long, title string")
    rules = spark.createDataFrame([("great escape", "a"), ("heat", "b"), ("heat (1995)", "c"), ("the heat", "d")], "name string, kind string")
    assert sorted(map(tuple, C.match_rules(catalog, rules).collect())) == [(2, "heat", "b"), (2, "heat (1995)", "c"), (3, "heat", "b"), (4, "heat", "b"), (4, "heat (1995)", "c")]


def test_promoted_keep_their_order(spark):
    lists = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(6)], "user_id long, item_id long, score double")
    watched = spark.createDataFrame([(1, 5), (1, 0)], "user_id long, item_id long")
    got = K.business_rules(lists, watched, [5, 2, 77, 4]).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == [5, 2, 4, 1, 3]
    assert [r["item_id"] for r in K.business_rules(lists, watched, []).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_chat_filters_and_ranks(spark):
    catalog = spark.createDataFrame(
        [(1, ["Drama"], 1994, 4.0, 100), (2, ["Drama", "Action"], 1995, 4.0, 5000), (3, ["Action"], 1996, 5.0, 1), (4, ["Drama"], 2005, 4.9, 1), (5, [], None, 4.95, 1)],
        "item_id long, genres array<string>, year int, vote_average double, vote_count long",
    )
    turns = [(1, 0, "user", "any drama?"), (1, 1, "assistant", "from?"), (1, 2, "user", "the 1990s, Drama or action"), (2, 0, "user", "surprise me"), (3, 0, "assistant", "hello"), (4, 0, "user", "1970s western")]
    got = S.chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), catalog, k=3)
    rows = sorted((r["conv_id"], r["rank"], r["item_id"], r["score"], r["n_history"]) for r in got.collect())
    assert rows == [(1, 1, 3, 5.0001, 3), (1, 2, 2, 4.5, 3), (1, 3, 1, 4.01, 3), (2, 1, 3, 5.0001, 1), (2, 2, 5, 4.9501, 1), (2, 3, 4, 4.9001, 1)]


def batches(spark, path, parts, schema="event_id long, user_id long, ts timestamp"):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_sessions_with_timers_over_batches(spark, tmp_path):
    """Sessions grow over batches, two are joined by a row between them, and the open one waits."""
    from datetime import datetime, timedelta

    t = lambda m: datetime(2024, 1, 1, 10) + timedelta(minutes=m)
    parts = [[(1, 1, t(0)), (2, 1, t(40)), (3, 2, t(5))], [(4, 1, t(20)), (5, 2, t(100))], [(6, 3, t(600))]]
    with E.with_state_store(spark):
        got = E.drain(E.timed_sessions(batches(spark, str(tmp_path / "in"), parts)))
    base = int(spark.sql("select unix_millis(timestamp'2024-01-01 10:00:00')").first()[0])
    offset = lambda ms: (ms - base) / 60_000
    shift = offset(min(r["start_ms"] for r in got.collect()))  # the session's zone against the writer's
    rows = sorted((r["key"], offset(r["start_ms"]) - shift, offset(r["last_ms"]) - shift, r["n"]) for r in got.collect())
    assert rows == [(1, 0, 40, 3), (2, 5, 5, 1), (2, 100, 100, 1)]


def test_late_rows_are_kept_aside(spark, tmp_path):
    from datetime import datetime, timedelta

    t = lambda m: datetime(2024, 1, 1, 10) + timedelta(minutes=m)
    parts = [[(1, 1, t(0)), (2, 1, t(200))], [(3, 1, t(141)), (4, 1, t(139)), (5, 1, t(400))], [(6, 1, t(350)), (7, 1, t(330)), (8, 1, None)]]
    in_time, late = E.split_late(batches(spark, str(tmp_path / "in"), parts))
    assert sorted((r["event_id"], r["batch"]) for r in late.collect()) == [(4, 1), (7, 2)]
    assert sorted(r["event_id"] for r in in_time.collect()) == [1, 2, 3, 5, 6, 8]


def test_append_mode_leaves_open_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    t = lambda m: datetime(2024, 1, 1, 10) + timedelta(minutes=m)
    stream = batches(spark, str(tmp_path / "in"), [[(1, 1, t(0)), (2, 1, t(10)), (3, 1, t(70)), (4, 1, t(190))]])
    got = E.drain(E.tumbling_counts(stream.withColumn("event_type", F.lit("x"))))
    assert sorted(r["n"] for r in got.collect()) == [1, 2]


def test_intents_have_a_row_for_each_part(spark, sf):
    from lumenrec.plans.queries import QUERIES

    assert QUERIES["intent_parse"](spark, sf).count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_windows_hold_every_event(spark, sf):
    from lumenrec.plans.queries import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert QUERIES["stream_event_counts"](spark, sf).agg(F.sum("n")).first()[0] == events


def test_sliding_windows_hold_every_event_six_times(spark, sf):
    from lumenrec.plans.queries import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert QUERIES["stream_trending_sliding"](spark, sf).agg(F.sum("n")).first()[0] == 6 * events


def test_sessions_hold_every_event(spark, sf):
    from lumenrec.plans.queries import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert QUERIES["stream_sessions"](spark, sf).agg(F.sum("n")).first()[0] == events
