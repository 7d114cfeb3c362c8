"""Where the operators of this package cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. A session on one machine, as in tests, gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = f"{tempfile.gettempdir()}/lumenrec-lineage"
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and a table that several
    branches use is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Frees the shuffles of plans that nobody holds any more, as behind a stored table: they stay until the driver's next collection."""
    gc.collect()  # Python's own handles first
    spark.sparkContext._jvm.System.gc()


#: Rows that may be broadcast.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, stored, with a hint to broadcast it if it has ``bound`` rows of a few numbers or fewer."""
    df = materialize(df)
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def restrict(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join on one long column.

    The ids are counted first: up to ``bound`` of them (16 MB) are broadcast, which spares
    a shuffle of whole texts; more are joined by a shuffle. The rows are the same.
    """
    small = ids.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(ids) if small else ids, key, how)
