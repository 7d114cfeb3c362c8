"""Forward pass of the two retrieval towers over given weights, a block of rows at a time.

A tower takes a row's parts (an id's embedding, dense features, a genre multi-hot, a text
embedding), projects those that have a projection, joins them into one vector, and passes it through
blocks of two dense layers with GELU, a residual and layer normalisation, then a projection and L2
normalisation. Dropout is the identity here, as in any evaluation.

Weights are a table ``layer, row, values``: a row of the matrix of each layer, and its bias as the
row -1. They are the size of the model and go to every task; embeddings of ids are a table of any
size and are joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights that may go to every task, in numbers (256 MB).
MOST_WEIGHTS = 32_000_000
EPSILON_NORM, EPSILON_LENGTH = 1e-5, 1e-12

_erf = np.frompyfunc(math.erf, 1, 1)


@dataclass(frozen=True)
class Tower:
    """``parts`` are columns in order; those in ``projected`` go through the layer of that name first. ``blocks`` name the hidden blocks."""

    parts: tuple[str, ...]
    projected: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ("block_0",)
    output: str = "output"


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + _erf(x / math.sqrt(2)).astype(np.float64))


class Weights:
    """Dense layers by name: ``x @ matrix.T + bias``; layer norms have ``<block>.norm`` with scale as row 0 and shift as bias."""

    def __init__(self, layers: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.layers = layers

    @staticmethod
    def read(table: DataFrame) -> Weights:
        size = table.agg(F.sum(F.size("values"))).first()[0] or 0
        if size > MOST_WEIGHTS:
            raise ValueError(f"{size} weights are more than go to every task; keep embeddings of ids in a table of their own")
        rows: dict[str, dict[int, list[float]]] = {}
        for r in table.collect():
            rows.setdefault(r["layer"], {})[r["row"]] = r["values"]
        return Weights({name: (np.array([v for k, v in sorted(x.items()) if k >= 0], np.float64), np.array(x[-1], np.float64)) for name, x in rows.items()})

    def dense(self, name: str, x: np.ndarray) -> np.ndarray:
        matrix, bias = self.layers[name]
        return x @ matrix.T + bias

    def block(self, name: str, x: np.ndarray) -> np.ndarray:
        own = self.dense(f"{name}.residual", x) if f"{name}.residual" in self.layers else x
        y = self.dense(f"{name}.fc2", gelu(self.dense(f"{name}.fc1", x))) + own
        scale, shift = self.layers[f"{name}.norm"]
        centred = y - y.mean(axis=1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + EPSILON_NORM) * scale[0] + shift

    def forward(self, tower: Tower, parts: Sequence[np.ndarray]) -> np.ndarray:
        x = np.concatenate([self.dense(name, p) if name in tower.projected else p for name, p in zip(tower.parts, parts)], axis=1)
        for name in tower.blocks:
            x = self.block(name, x)
        x = self.dense(tower.output, x)
        return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), EPSILON_LENGTH)


def forward(rows: DataFrame, key: str, tower: Tower, weights: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """``rows(key, <parts>)`` -> ``key, v``. ``embeddings(key, embedding)`` are joined as the part ``embedding``.

    Parts are arrays of numbers. Rows with a null part, or whose key has no embedding, give none.
    """
    if embeddings is not None:
        rows = rows.join(embeddings.select(key, "embedding"), key)
    shared = rows.sparkSession.sparkContext.broadcast(Weights.read(weights))
    known = rows.select(F.col(key).cast("long").alias(key), *(F.col(p).cast("array<double>").alias(p) for p in tower.parts)).dropna(subset=list(tower.parts))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                parts = [batch.column(p).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for p in tower.parts]
                out = shared.value.forward(tower, parts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(key), lists], names=[key, "v"])

    return known.mapInArrow(run, f"{key} long, v array<double>")


def weight_rows(layers: dict[str, tuple[list[list[float]], list[float]]]) -> list[tuple[str, int, list[float]]]:
    """Rows of a weights table from matrices and biases."""
    return [(name, i, [float(x) for x in row]) for name, (matrix, bias) in layers.items() for i, row in [*enumerate(matrix), (-1, bias)]]
