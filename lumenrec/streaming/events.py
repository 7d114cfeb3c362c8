"""Event analytics that run alike on a stream and on a table.

Each function takes a frame with ``ts`` as timestamp; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import shared_path

ENVELOPE = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("data", T.StructType([T.StructField("query", T.StringType())]))])


def timed(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """``ts`` as timestamp; with a watermark on a stream."""
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late) if df.isStreaming else df


def decode(raw: DataFrame) -> DataFrame:
    """JSON envelopes in ``value`` -> ts, event_type, query."""
    e = raw.select(F.from_json(F.col("value").cast("string"), ENVELOPE).alias("e"))
    return e.select(F.to_timestamp("e.timestamp").alias("ts"), "e.event_type", F.col("e.data.query").alias("query"))


def tumbling_counts(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return timed(events).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_trend(events: DataFrame, size: str = "6 hours", step: str = "1 hour") -> DataFrame:
    return timed(events).groupBy(F.window("ts", size, step).alias("w"), "item_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "item_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    s = timed(events).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """First occurrence of each event id; on a stream within the watermark."""
    df = timed(events)
    return df.dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else df.dropDuplicates(["event_id"])


def drain(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over what is there into a Parquet table and returns that; no row passes the driver.

    In append mode a window or session is written once, when the watermark has passed its end, and
    its state goes; those that the watermark has not passed stay in the state for the next run.
    With ``complete`` each batch replaces the table and all state is kept: for small results only.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    if mode == "append":
        q = writer.format("parquet").option("path", path).start()
    else:
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


#: Later than any event.
END = "9000-01-01 00:00:00"


def drain_to_end(source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(source)`` drained in append mode over an input that ends: windows and sessions still open at its end are written too.

    A second run of the stream reads one more row, a mark with ``ts`` at ``END`` and nulls beside
    it, so the watermark passes all that is in the state. The mark's own window stays open and is
    never written.
    """
    spark = source.sparkSession
    path = shared_path(spark)
    spark.createDataFrame([], source.schema).write.parquet(f"{path}-end")
    out = build(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{path}-end")))
    drain(out, path=path)
    ends = [F.lit(END if x.name == "ts" else None).cast(x.dataType).alias(x.name) for x in source.schema]
    spark.range(1).select(*ends).write.mode("append").parquet(f"{path}-end")
    return drain(out, path=path)


def split_late(stream: DataFrame, delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Runs a stream into two tables: rows in time, and rows older than what earlier batches had reached, less ``delay``.

    A watermark drops late rows without a trace; here they stay, with the number of their batch
    and the mark that they missed. Each batch writes its own folders, so a batch that is run again
    after a failure replaces what it had written.
    """
    spark = stream.sparkSession
    path = shared_path(spark)
    marks = "latest timestamp, batch long"
    spark.createDataFrame([], "latest timestamp").write.parquet(f"{path}/marks/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.withColumn("ts", F.col("ts").cast("timestamp")).persist()
        before = session.read.schema(marks).parquet(f"{path}/marks").where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        mark = F.lit(before).cast("timestamp") - F.expr(f"interval {delay}")
        late = F.coalesce(F.col("ts") < mark, F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/in_time/batch={number}")
        batch.where(late).withColumn("mark", mark).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        batch.unpersist()

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-state").foreachBatch(put).start().awaitTermination()
    fields = [f"{x.name} {'timestamp' if x.name == 'ts' else x.dataType.simpleString()}" for x in stream.schema]
    in_time = spark.read.schema(", ".join([*fields, "batch long"])).parquet(f"{path}/in_time")
    return in_time, spark.read.schema(", ".join([*fields, "mark timestamp", "batch long"])).parquet(f"{path}/late")


class _Sessions(StatefulProcessor):
    """Open sessions of a key as state, with one event-time timer at the first end.

    When it fires, all sessions that the watermark has passed are written and forgotten: a
    timer for each session would read and write the key's whole state as often as it has sessions.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start_ms long, last_ms long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        spans = sorted(held + [(r.ms, r.ms, 1) for r in rows])
        merged: list[tuple[int, int, int]] = []
        for start, last, n in spans:
            if merged and start < merged[-1][1] + self.gap:
                merged[-1] = (merged[-1][0], max(last, merged[-1][1]), merged[-1][2] + n)
            else:
                merged.append((start, last, n))
        self._keep(merged, self._first(held))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fired, open_ = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        now = max(fired, timerValues.getCurrentWatermarkInMs())
        done = [x for x in open_ if x[1] + self.gap <= now]
        self._keep([x for x in open_ if x[1] + self.gap > now], None)
        for start, last, n in done:
            yield Row(key=key[0], start_ms=start, last_ms=last, n=n)

    def close(self) -> None:
        pass

    def _held(self):
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def _first(self, spans: list[tuple[int, int, int]]) -> int | None:
        return min((last + self.gap for _, last, _ in spans), default=None)

    def _keep(self, spans: list[tuple[int, int, int]], there: int | None) -> None:
        """The open sessions, and the timer moved from ``there`` to the end of the first of them."""
        wanted = self._first(spans)
        if wanted != there:
            if there is not None:
                self.handle.deleteTimer(there)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if spans:
            self.open.put(spans)
        else:
            self.open.clear()


def timed_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions by keyed state and event-time timers: ``key, start_ms, last_ms, n``, each written once when the watermark has passed its end.

    ``events(user_id, ts)`` must be a stream; a user's state is what is open and nothing else.
    Needs the RocksDB state store (``with_state_store``).
    """
    rows = timed(events).select(F.col("user_id").alias("key"), "ts", F.expr("unix_millis(ts)").alias("ms"))
    return rows.groupBy("key").transformWithState(statefulProcessor=_Sessions(gap_minutes * 60_000), outputStructType="key long, start_ms long, last_ms long, n long", outputMode="Append", timeMode="EventTime")


@contextmanager
def with_state_store(spark: SparkSession):
    """The RocksDB state store while the block runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def envelopes(events: DataFrame, *keep: str) -> DataFrame:
    """``timestamp, event_type, query`` as one JSON object in ``value``, the message that a topic or a file gets."""
    return events.select(*keep, F.to_json(F.struct("timestamp", "event_type", F.struct("query").alias("data"))).alias("value"))


def to_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Sends envelopes to a topic; needs Spark's Kafka connector on the class path."""
    sink = envelopes(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return sink.option("checkpointLocation", checkpoint).start()


def to_files(events: DataFrame, path: str, checkpoint: str):
    """Sends envelopes to text files, one object a line, where no topic is at hand; what was there is sent and the stream ends."""
    sink = envelopes(events).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start()
