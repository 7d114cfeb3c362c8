"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; in a local one where a session on one machine has none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.gettempdir() + '/lumenrec-tables').rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: several readers compute it once, and a lost executor costs a read."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a stored table from which on it is not broadcast, however small its files are.
SENT_ROWS = 100_000


def dealt(df: DataFrame) -> DataFrame:
    """``stored``, and joined by shuffles if it has more than ``SENT_ROWS`` rows.

    Spark takes the size of compressed files for that of the rows, and would collect millions of
    rows that repeat one another on the driver to broadcast them.
    """
    df = stored(df)
    return df.hint("merge") if df.limit(SENT_ROWS + 1).count() > SENT_ROWS else df


def small_side(df: DataFrame, bound: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
