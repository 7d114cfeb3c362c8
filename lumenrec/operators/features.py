"""User, item and pair features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import SMALL_ROWS
from ..functions.vectors import dot
from ..sources.store import small_side, stored


def _share(condition):
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def user_stats(rows: DataFrame) -> DataFrame:
    """Counts, moments, shares of ratings by left-closed bins, hours, weekends and velocity."""
    r = F.col("rating")
    days = (F.max("sec") - F.min("sec")) / 86400
    return rows.groupBy("user_id").agg(
        F.count("*").alias("rating_count"), F.avg("rating").alias("rating_mean"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("rating_std"),
        F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"),
        *(_share((r >= k - 0.5) & (r < k + 0.5)).alias(f"rating_{k}_ratio") for k in range(1, 6)),
        F.avg(F.hour("ts")).alias("avg_hour"), _share(F.weekday("ts") >= 5).alias("weekend_ratio"),
        days.alias("activity_days"), (F.count("*") / F.greatest(days, F.lit(1.0))).alias("velocity"),
    )


def genre_affinity(rows: DataFrame, movies: DataFrame) -> DataFrame:
    """Mean rating by user and genre, joined on the raw item id; the sentinel genre is left out."""
    g = movies.select("item_id", F.explode("genres_list").alias("genre")).where("genre <> '(no genres listed)'")
    return rows.join(g, "item_id").groupBy("user_id", "genre").agg(F.avg("rating").alias("affinity"), F.count("*").alias("n"))


def item_stats(rows: DataFrame) -> DataFrame:
    """Counts and moments, and shares of ratings by right-closed bins."""
    r = F.col("rating")
    edges = {1: (0.0, 1.5), 2: (1.5, 2.5), 3: (2.5, 3.5), 4: (3.5, 4.5), 5: (4.5, 5.5)}
    return rows.groupBy("item_id").agg(
        F.count("*").alias("rating_count"), F.avg("rating").alias("rating_mean"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("rating_std"),
        F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"), F.countDistinct("user_id").alias("num_users"),
        *(_share((r > lo) & (r <= hi)).alias(f"rating_{k}_ratio") for k, (lo, hi) in edges.items()),
    )


def popularity_percentile(stats: DataFrame, value: str = "rating_count") -> DataFrame:
    """Average rank of ties as a share of the rows, from the histogram of distinct values."""
    hist = stats.groupBy(value).agg(F.count("*").alias("ties"))
    below = F.coalesce(F.sum("ties").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("ties").over(Window.partitionBy())
    pct = hist.select(value, ((below + 1 + (F.col("ties") - 1) / 2) / n).alias("popularity_percentile"))
    return stats.join(pct, value).select("item_id", value, "popularity_percentile")


def item_age(movies: DataFrame, as_of_year: int = 2024) -> DataFrame:
    return movies.withColumn("item_age", (F.lit(as_of_year) - F.coalesce("year", F.lit(as_of_year))).cast("long"))


def genre_multihot(movies: DataFrame) -> DataFrame:
    """0/1 by item and genre for all genres of the table (long form; pivot for the wide one)."""
    vocabulary = movies.select(F.explode("genres_list").alias("genre")).distinct()
    has = F.array_contains("genres_list", F.col("genre")).cast("long")
    return movies.select("item_id", "genres_list").crossJoin(small_side(vocabulary, 100_000)).select("item_id", "genre", has.alias("flag"))


def tfidf(texts: DataFrame, vocabulary: int = 1000, columns: int = 50) -> DataFrame:
    """``item_id, text`` -> ``item_id, term, weight`` of the alphabetically first ``columns`` terms.

    Tokens of two word characters and more; vocabulary by corpus frequency; smoothed idf; rows
    normalised over the whole vocabulary.
    """
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)).alias("term")
    # the vocabulary needs no item, so that only its own tokens are shuffled with one
    common = stored(texts.select(words).groupBy("term").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(vocabulary).select("term"))
    tokens = texts.select("item_id", words).join(F.broadcast(common), "term")  # as few as asked for
    tf = stored(tokens.groupBy("item_id", "term").agg(F.count("*").alias("tf")))
    terms = stored(tf.groupBy("term").agg(F.count("*").alias("df")))
    n = texts.agg(F.count("*").alias("n"))
    idf = terms.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = weights.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    first = terms.orderBy("term").limit(columns).select("term")
    return weights.join(F.broadcast(first), "term").join(lengths, "item_id").select("item_id", "term", (F.col("w") / F.col("l")).alias("weight"))


#: Items whose vectors and features go to all pairs by a broadcast.
USED_ROWS = 10_000


def pairwise(pairs: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Similarity, user and item features of given pairs; NaN and nulls become 0.

    Vectors and features of a side are put together first. Few items that pairs name are broadcast,
    so that only the pairs' ids are shuffled, to their users; of many, each vector is shuffled to a
    pair once.
    """
    u, i = user_vectors.withColumnRenamed("v", "uv"), item_vectors.withColumnRenamed("v", "iv")
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    uf = users.select("user_id", clean("rating_mean").alias("user_mean"), clean("rating_count").alias("user_count"))
    ff = items.select("item_id", clean("rating_mean").alias("item_mean"), clean("rating_count").alias("item_count"))
    named = small_side(pairs.select("item_id").distinct(), SMALL_ROWS)
    of_item = small_side(i.join(named, "item_id", "left_semi").join(ff, "item_id"), USED_ROWS)
    joined = pairs.join(u.join(uf, "user_id"), "user_id").join(of_item, "item_id")
    return joined.select("user_id", "item_id", dot("uv", "iv").alias("similarity"), "user_mean", "user_count", "item_mean", "item_count")


def daily_sketches(rows: DataFrame, what: dict[str, Column], bits: int = 14) -> DataFrame:
    """``rows(ts, ..)`` -> ``day`` and a HyperLogLog sketch of each of the named columns, of fixed size (2 ** bits cells)."""
    day = F.to_date(F.col("ts").cast("timestamp")).alias("day")
    return rows.groupBy(day).agg(*(F.hll_sketch_agg(c, F.lit(bits)).alias(name) for name, c in what.items()))


def merged_sketches(days: DataFrame, by: Column, names: list[str]) -> DataFrame:
    """Estimates ``<name>_about`` over ranges of stored days: sketches are merged, no row is read again."""
    return days.groupBy(by).agg(*(F.hll_sketch_estimate(F.hll_union_agg(n)).alias(f"{n}_about") for n in names))
