"""Operator 3: embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random directions. Two vectors of cosine c differ along a
direction by about a normal variable of deviation sqrt((2 - 2 c) / dim), so a window of
``WINDOW`` deviations of the threshold's, centred on a query, holds a linked vector with
probability 0.988, and others less often. Each of ``COUNTED`` projections is sorted, the ends of
every query's window are searched in it, and the collisions of every pair are counted; pairs
with at least ``least_count`` of them are verified by cosine in double precision.
``least_count`` is the largest count that keeps a linked pair with probability ``COUNT_RECALL``.

Such a window is wide (at cosine 0.95 and 64 dimensions it holds two fifths of unrelated
vectors), so windows alone would bring nearly all pairs together. Further projections therefore
deal the vectors out first: of ``dim`` directions and their opposites a vector goes to the one
on which it projects farthest (``depth`` times over, so that a cell holds about ``CELL_ROWS``
vectors). Linked vectors mostly go together; how often is measured on simulated pairs at exactly
the threshold, and as many independent tables are dealt as it takes for a recall of ``RECALL``,
whatever the number of vectors. A pair counts in the first table where it meets.

A cell with many vectors is split in blocks that meet two by two in tasks of their own; links
are summed up there, so a group of k near copies gives k rows a block and not k * k.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import few, materialize

COSINE, WINDOW, COUNTED, COUNT_RECALL = 0.95, 2.5, 24, 0.9999
RECALL, CELL_ROWS, BLOCK, SEED = 0.995, 8192, 2048, 11
#: Simulated pairs that measure how often linked vectors go together.
SIMULATED = 4000


def least_count(counted: int = COUNTED, recall: float = COUNT_RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(WINDOW / math.sqrt(2))
    tail, count = 0.0, 0
    while count < counted and tail + (t := math.comb(counted, count) * p**count * (1 - p) ** (counted - count)) <= 1 - recall:
        tail, count = tail + t, count + 1
    return count


def _directions(dim: int, n: int, part: int) -> np.ndarray:
    d = np.random.default_rng([SEED, part, dim]).normal(size=(dim, n))
    return d / np.linalg.norm(d, axis=0)


def _unit(rows: list) -> np.ndarray:
    """Unit vectors; the largest component is divided out first, so that no square over- or underflows."""
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, table: int, depth: int) -> np.ndarray:
    """Cells of unit vectors in one table: ``depth`` times the direction, or its opposite, of the farthest projection."""
    dim, out = x.shape[1], np.zeros(len(x), np.int64)
    for level in range(depth):
        p = x @ _directions(dim, dim, 1000 + 100 * table + level)
        at = np.abs(p).argmax(axis=1)
        out = out * (2 * dim) + 2 * at + (p[np.arange(len(x)), at] < 0)
    return out


@cache
def tables(dim: int, cosine: float, depth: int) -> int:
    """Tables that bring a pair of this cosine together at least once with probability ``RECALL``."""
    rng = np.random.default_rng(SEED)
    x = rng.normal(size=(SIMULATED, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    together = np.mean([(codes(x, t, depth) == codes(y, t, depth)).mean() for t in range(4)])
    return 1 if together >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - max(together, 0.05)))


def _code(depth: int, cosine: float):
    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                x = _unit([vectors[i] for i in at])
                cells = np.stack([codes(x, t, depth) for t in range(tables(dim, cosine, depth))], axis=1)
                rows = batch.take(pa.array(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("rep", "copies", "embedding")), pa.array(np.full(len(at), dim, np.int32)), lists], names=["rep", "copies", "embedding", "dim", "codes"])

    return run


def _count_links(cosine: float):
    need = least_count()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        side = part["side"].to_numpy()
        x = _unit(part["embedding"].tolist())
        width = WINDOW * math.sqrt((2 - 2 * cosine) / x.shape[1])
        p = (x @ _directions(x.shape[1], COUNTED, 1)).astype(np.float32)
        within = part["i"].iloc[0] == part["j"].iloc[0]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 2))
        hits = np.zeros((len(a), len(b)), np.uint8)
        for j in range(COUNTED):
            order = np.argsort(p[b, j], kind="stable")
            line, place = p[b, j][order], np.empty(len(b), np.int32)
            place[order] = np.arange(len(b), dtype=np.int32)
            low = np.searchsorted(line, p[a, j] - np.float32(width)).astype(np.int32)
            high = np.searchsorted(line, p[a, j] + np.float32(width), "right").astype(np.int32)
            # place - low as unsigned is under the window's length just inside the window
            hits += (place[None, :] - low[:, None]).view(np.uint32) < (high - low).astype(np.uint32)[:, None]
        i, j = np.nonzero(hits >= need)
        i, j = a[i], b[j]
        rep, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
        table, cells = int(part["table"].iloc[0]), np.array(part["codes"].tolist(), np.int64)[:, : int(part["table"].iloc[0])]
        keep = rep[i] != rep[j]
        if table:
            keep &= ~(cells[i] == cells[j]).any(axis=1)
        if within:
            keep &= i < j
        i, j = i[keep], j[keep]
        ok = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 17):
            ok[s : s + (1 << 17)] = np.einsum("ij,ij->i", x[i[s : s + (1 << 17)]], x[j[s : s + (1 << 17)]]) >= cosine
        i, j = i[ok], j[ok]
        links = np.bincount(i, copies[j], len(part)) + np.bincount(j, copies[i], len(part))
        root = np.arange(len(part))
        while len(i):
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links)
        return pd.DataFrame({"id": rep[some], "n": links[some].astype(np.int64), "root": rep[root[some]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``vec_id, n_links, component_id, kept``.

    One row per input row. ``n_links`` counts the other rows of cosine ``cosine`` or more,
    ``component_id`` is the smallest vec_id reachable. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null vec_id, link with nothing; vectors
    of different lengths never link. Rows that share a vec_id are counted as rows, with the links
    of all their vectors; they do not link with one another unless the vectors are equal. Other
    columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    good = materialize(v.where(usable))
    reps = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    widest = reps.agg(F.max(F.size("embedding"))).first()[0] or 2
    depth = max(1, math.ceil(math.log(max(1, reps.count()) / CELL_ROWS, 2 * max(2, widest))))

    coded = materialize(reps.mapInArrow(_code(depth, cosine), "rep long, copies long, embedding array<double>, dim int, codes array<long>"))
    cell = ["dim", "table", "code"]
    sizes = coded.select("dim", F.posexplode("codes").alias("table", "code")).groupBy(*cell).agg(F.count("*").alias("rows"))
    sizes = sizes.where("rows > 1").select(*cell, F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    dealt = coded.select("rep", "copies", "embedding", "codes", "dim", F.posexplode("codes").alias("table", "code"))
    own = dealt.join(few(sizes), cell).withColumn("own", F.pmod(F.xxhash64("rep", "table"), F.col("blocks")).cast("int"))
    # block i meets block j in the task (i, j), i <= j: side 0 is i, side 2 is j
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(2).alias("side"), "codes", "rep", "copies", "embedding")
    found = materialize(met.groupBy(*cell, "i", "j").applyInPandas(_count_links(cosine), "id long, n long, root long"))

    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = reps.join(links, reps["rep"] == links["id"], "left").drop("id").join(labels, F.col("rep") == labels["id"], "left")
    classes = classes.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(classes, "embedding").select("vec_id", "n_links", "component_id")
    alone = v.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
