"""Readers, writers and the adapters from stored tables to the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("rating", T.DoubleType()), T.StructField("sec", T.LongType())])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_ratings_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Ratings with a declared schema; ``rows`` keeps the first ones by (sec, user, item)."""
    df = spark.read.schema(RATINGS).csv(path, header=True)
    return df if rows is None else df.orderBy("sec", "user_id", "item_id", "rating").limit(rows)


def seconds(ts: str):
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: user_id, item_id (0..99), rating (0.5..5), ts, sec."""
    e = read(spark, sf_dir, "events")
    rating = (F.pmod(F.floor("value"), F.lit(10)) + 1) * F.lit(0.5)
    return e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), rating.cast("double").alias("rating"), "ts", seconds("ts").alias("sec"), "event_id")


def ratings_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as ratings of parts by customers."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rating = (F.pmod(F.col("l_quantity").cast("int") - 1, F.lit(10)) + 1) * F.lit(0.5)
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), rating.cast("double").alias("rating"), seconds("l_shipdate").alias("sec"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw movie rows: item_id, title ``name (yyyy)``, genres ``a|b``, tags text."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit(" ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")")).alias("title"),
        F.concat_ws("|", "p_type", "p_brand").alias("genres"), F.col("p_name").alias("tag_text"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving catalog: parsed movies with votes, media type and language."""
    m = movies(spark, sf_dir)
    votes = interactions(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("vote_count"), F.avg("rating").alias("mean"))
    language = F.element_at(F.array(*(F.lit(x) for x in ("en", "hi", "fr", "es", "ja", "ko"))), (F.pmod("item_id", F.lit(6)) + 1).cast("int"))
    return m.join(votes, "item_id", "left").select(
        "item_id", "title", F.split("genres", r"\|").alias("genres"), F.split(F.lower("tag_text"), " ").alias("tags"),
        F.regexp_extract("title", r"(\d{4})\)$", 1).cast("int").alias("year"),
        F.when(F.pmod("item_id", F.lit(10)) == 0, "tv").otherwise("movie").alias("media_type"), language.alias("original_language"),
        F.coalesce("vote_count", F.lit(0)).cast("long").alias("vote_count"), F.coalesce("mean", F.lit(0.0)).alias("vote_average"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))


def write_table(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_events_json(df: DataFrame, path: str) -> None:
    """Search events in their JSON envelope, one object a line."""
    df.select(F.to_json(F.struct("timestamp", "event_type", F.struct("query").alias("data"))).alias("value")).write.mode("overwrite").text(path)
