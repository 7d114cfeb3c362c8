"""Ids of parts of documents: a document's id and the part's number in one long."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


@dataclass(frozen=True)
class Parts:
    """Packs (doc_id, part) into one long that is ordered like the two; ``bits`` are the part's."""

    bits: int

    def pack(self, doc_id: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (doc_id << self.bits) | part

    def doc_of(self, packed: Column) -> Column:
        return F.shiftright(packed, self.bits)

    def part_of(self, packed: Column) -> Column:
        return packed.bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")


def in_order(ids: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows ``keys`` with their place from 0 in the order of ``keys`` as ``row``, without sending all to one task.

    Rows are dealt by ranges; a range's first number is the count of the ranges before it.
    """
    ranged = materialize(ids.select(*keys).repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # a row for each range
    first, at = {}, 0
    for k in sorted(sizes):
        first[k] = at
        at += sizes[k]
    offsets = ids.sparkSession.createDataFrame(list(first.items()), "range int, first long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*keys)) - 1
    return materialize(ranged.join(F.broadcast(offsets), "range").select(*keys, (F.col("first") + within).alias("row")))


def numbered(texts: DataFrame) -> tuple[DataFrame, DataFrame | None, Parts]:
    """``texts(doc_id, text)`` with ids that leave room for the numbers of a text's parts, of which it has no more than bytes.

    Where the ids are too large for that (hashes, for example), documents get numbers in the
    order of their ids; the second result then maps ``row`` to ``doc_id``.
    """
    most = texts.agg(F.max(F.octet_length("text")).alias("size"), F.max(F.greatest(F.col("doc_id"), -(F.col("doc_id") + 1))).alias("id")).first()
    bits = max(1, int(most["size"] or 0)).bit_length()
    if int(most["id"] or 0).bit_length() + bits <= 63:
        return texts, None, Parts(bits)
    numbers = in_order(texts.select("doc_id").distinct(), "doc_id")
    renumbered = materialize(texts.join(numbers, "doc_id").select(F.col("row").alias("doc_id"), "text"))
    return renumbered, numbers, Parts(bits)


def named(frame: DataFrame, numbers: DataFrame | None, *columns: str) -> DataFrame:
    """``frame`` with the documents' own ids again in ``columns``."""
    for c in columns if numbers is not None else ():
        frame = frame.join(numbers.select(F.col("row").alias(c), F.col("doc_id").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return frame
