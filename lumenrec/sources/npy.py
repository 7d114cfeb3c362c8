"""Vectors in numpy's files as a data source of their own: ``spark.read.format("vectors_npy")``.

A table is a folder: each writing task leaves ``<task>.ids.npy`` and ``<task>.vectors.npy``, and the
commit writes ``manifest.json`` with the files and their rows; a folder without one is no table, so
what failed or aborted tasks left is never read. Reading deals the files out in ranges of rows,
each mapped into memory, so a large file is many tasks.

``read_array`` reads single arrays, such as a matrix of embeddings that another program saved, where
a row's place is its id. Paths must be mounted on all executors: numpy does not know object stores.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "item_id long, v array<double>"
RANGE_ROWS, BATCH_ROWS = 65_536, 4_096


def _local(path: str) -> str:
    path = path.removeprefix("file://")
    if "://" in path:
        raise ValueError(f"numpy files must lie under a mounted path, not {path}")
    return path.rstrip("/")


@dataclass
class _Range(InputPartition):
    ids: str | None
    vectors: str
    first: int
    rows: int


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, array: bool, rows_each: int):
        self.path, self.array, self.rows_each = path, array, rows_each

    def partitions(self) -> list[InputPartition]:
        if self.array:
            files = [(None, self.path, len(np.load(self.path, mmap_mode="r")))]
        else:
            with open(f"{self.path}/manifest.json") as f:
                files = [(f"{self.path}/{p['name']}.ids.npy", f"{self.path}/{p['name']}.vectors.npy", p["rows"]) for p in json.load(f)["parts"]]
        return [_Range(i, v, at, min(self.rows_each, n - at)) for i, v, n in files for at in range(0, n, self.rows_each)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        v = np.load(partition.vectors, mmap_mode="r")
        ids = np.load(partition.ids, mmap_mode="r") if partition.ids else None
        for at in range(partition.first, partition.first + partition.rows, BATCH_ROWS):
            end = min(at + BATCH_ROWS, partition.first + partition.rows)
            rows = np.asarray(v[at:end], np.float64)
            own = np.arange(at, end) if ids is None else np.asarray(ids[at:end], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), lists], names=["item_id", "v"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, dtype: str):
        self.path, self.overwrite, self.dtype = path, overwrite, dtype

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        ids, rows = [], []
        for batch in iterator:
            if batch.num_rows:
                ids.append(batch.column("item_id").to_numpy())
                rows.append(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(self.dtype))
        name = uuid.uuid4().hex
        if ids:
            os.makedirs(self.path, exist_ok=True)
            np.save(f"{self.path}/{name}.ids.npy", np.concatenate(ids))
            np.save(f"{self.path}/{name}.vectors.npy", np.concatenate(rows))
        return _Part(name, sum(map(len, ids)))

    def commit(self, messages: list[_Part | None]) -> None:
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m and m.rows]
        known = []
        if not self.overwrite and os.path.exists(f"{self.path}/manifest.json"):
            with open(f"{self.path}/manifest.json") as f:
                known = json.load(f)["parts"]
        os.makedirs(self.path, exist_ok=True)
        with open(f"{self.path}/manifest.new", "w") as f:
            json.dump({"parts": known + parts}, f)
        os.replace(f"{self.path}/manifest.new", f"{self.path}/manifest.json")  # readers see the old table or the new one

    def abort(self, messages: list[_Part | None]) -> None:
        for m in messages:
            for kind in ("ids", "vectors"):
                if m and os.path.exists(f"{self.path}/{m.name}.{kind}.npy"):
                    os.remove(f"{self.path}/{m.name}.{kind}.npy")


class VectorsNpy(DataSource):
    """Options: ``path``; ``array`` true for one matrix whose places are ids; ``rows`` of a range; ``dtype`` that is written (float32)."""

    @classmethod
    def name(cls) -> str:
        return "vectors_npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_local(self.options["path"]), self.options.get("array", "false") == "true", int(self.options.get("rows", RANGE_ROWS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_local(self.options["path"]), overwrite, self.options.get("dtype", "float32"))


def write_vectors(items: DataFrame, path: str, mode: str = "overwrite", dtype: str = "float32") -> None:
    """``items(item_id, v)``, all of one width, to a folder of numpy files."""
    items.sparkSession.dataSource.register(VectorsNpy)
    items.select("item_id", "v").write.format("vectors_npy").mode(mode).option("path", path).option("dtype", dtype).save()


def read_vectors(spark: SparkSession, path: str, rows: int = RANGE_ROWS) -> DataFrame:
    spark.dataSource.register(VectorsNpy)
    return spark.read.format("vectors_npy").option("path", path).option("rows", rows).load()


def read_array(spark: SparkSession, path: str, rows: int = RANGE_ROWS) -> DataFrame:
    """A saved matrix as ``item_id, v``, the id being the row's place."""
    spark.dataSource.register(VectorsNpy)
    return spark.read.format("vectors_npy").option("path", path).option("rows", rows).option("array", "true").load()
