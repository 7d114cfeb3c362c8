"""Every query vector against every item vector, a block of each at a time, as numpy products in tasks.

Items up to ``SMALL_ROWS`` of ``SMALL_BYTES`` go to every worker. More are dealt in blocks that meet portions of
the queries two by two in tasks of bounded size; what a task returns for a query and a block is
merged by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

SMALL_ROWS, SMALL_BYTES, ITEM_BLOCK, QUERY_BLOCK, AT_ONCE = 50_000, 32_000_000, 16_384, 8_192, 256
#: (query ids, query matrix, item ids, item matrix) -> columns of the result.
Meet = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def matrix(column) -> np.ndarray:
    """Vectors of one length as rows; from Arrow lists without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not isinstance(column, pa.Array):
        return np.array(column, np.float64).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _portions(ids: np.ndarray, x: np.ndarray, items: np.ndarray, y: np.ndarray, meet: Meet) -> Iterator[dict[str, np.ndarray]]:
    for at in range(0, len(ids), AT_ONCE):
        yield meet(ids[at : at + AT_ONCE], x[at : at + AT_ONCE], items, y)


def meet_all(queries: DataFrame, items: DataFrame, by: str, meet: Meet, schema: str, small: int = SMALL_ROWS) -> DataFrame:
    """``queries(by, v)`` and ``items(item_id, v)``, all vectors of one length, ids long; rows that ``meet`` gives."""
    queries = queries.select(F.col(by).cast("long").alias(by), "v").where(F.col("v").isNotNull())
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "v").where(F.col("v").isNotNull())
    about = items.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n = about["n"]
    if n <= small and n * (about["width"] or 0) * 8 <= SMALL_BYTES:
        table = items.toArrow()
        shared = queries.sparkSession.sparkContext.broadcast((table.column("item_id").to_numpy(), matrix(table.column("v"))))

        def run(batches):
            ids, y = shared.value
            for batch in batches:
                x = matrix(batch.column("v"))
                if batch.num_rows and len(ids):
                    for out in _portions(batch.column(by).to_numpy(), x, ids, y, meet):
                        yield pa.RecordBatch.from_pydict(out)

        return queries.mapInArrow(run, schema)

    q_blocks, i_blocks = queries.count() // QUERY_BLOCK + 1, n // ITEM_BLOCK + 1
    own = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("long")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = queries.withColumn("qb", own(by, q_blocks)).withColumn("ib", every(i_blocks))
    # names of its own: both sides may come from one table
    right = items.select(own("item_id", i_blocks).alias("to_ib"), F.col("item_id").alias("other"), F.col("v").alias("other_v")).withColumn("to_qb", every(q_blocks))
    columns = [c.split()[0] for c in schema.split(", ")]

    def both(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(i):
            return pd.DataFrame({c: [] for c in columns})
        parts = _portions(q[by].to_numpy(), matrix(q["v"].tolist()), i["other"].to_numpy(), matrix(i["other_v"].tolist()), meet)
        return pd.concat([pd.DataFrame(x) for x in parts])

    return left.groupBy("qb", "ib").cogroup(right.groupBy("to_qb", "to_ib")).applyInPandas(both, schema)


#: Queries of a task that all items pass by, and the rows that these may keep.
STREAM_ROWS, KEPT_ROWS = 32_768, 2_500_000


class _Running:
    """The best ``k`` of each of some queries among items that come batch by batch; what lies ``slack`` under the k-th stays too."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, drop_self: bool, slack: float):
        self.ids, self.x, self.k, self.drop_self, self.slack = ids, x, k, drop_self, slack
        self.least = np.full(len(ids), -np.inf)
        self.row, self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_fresh = 0

    def add(self, items: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(self.ids), AT_ONCE):
            s = self.x[at : at + AT_ONCE] @ y.T
            if self.drop_self:
                s[self.ids[at : at + AT_ONCE, None] == items[None, :]] = -np.inf
            wanted = (s >= (self.least[at : at + AT_ONCE] - self.slack)[:, None]) & (s > -np.inf)
            if s.shape[1] > self.k and np.count_nonzero(wanted) > 2 * self.k * len(s):
                wanted &= s >= np.partition(s, -self.k, axis=1)[:, -self.k][:, None] - self.slack
            row, column = np.nonzero(wanted)
            self.fresh.append((row + at, items[column], s[row, column]))
            self.n_fresh += len(row)
            if self.n_fresh > max(len(self.ids) * self.k, KEPT_ROWS):
                self._cut()
        if self.n_fresh > len(self.ids) * self.k // 2:
            self._cut()

    def _cut(self) -> None:
        row, item, score = (np.concatenate([old, *new]) for old, new in zip((self.row, self.item, self.score), zip(*self.fresh)))
        self.fresh, self.n_fresh = [], 0
        order = np.lexsort((item, -score, row))
        row, item, score = row[order], item[order], score[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[: len(row)]
        sizes = np.diff(np.r_[starts, len(row)])
        full = starts[sizes >= self.k]
        self.least[row[full]] = score[full + self.k - 1]
        keep = np.arange(len(row)) - np.repeat(starts, sizes) < self.k
        if self.slack:
            keep |= score >= self.least[row] - self.slack
            kept = np.bincount(row[keep], minlength=len(self.ids))
            crowded = np.flatnonzero(keep & (kept[row] > 4 * self.k))
            if len(crowded):  # of many that round to one score only the k of the smallest ids can count
                bins = np.floor(score[crowded] * 1e6 + 0.5)
                by_id = np.lexsort((item[crowded], -bins, row[crowded]))
                r, b = row[crowded][by_id], bins[by_id]
                first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (b[1:] != b[:-1])])
                within = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
                keep[crowded[by_id[within >= self.k]]] = False
        self.row, self.item, self.score = row[keep], item[keep], score[keep]

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.fresh:
            self._cut()
        for at in range(0, len(self.row), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.row[part]]), pa.array(self.item[part]), pa.array(self.score[part])], names=names)


def meet_best(queries: DataFrame, items: DataFrame, by: str, k: int, drop_self: bool = False, small: int = SMALL_ROWS, slack: float = 1e-6) -> DataFrame:
    """The ``k`` best items of each query, and those within ``slack`` of the k-th, as ``by, item_id, score``: a few times ``k`` rows a query.

    Few items go to every worker. More pass by the queries of a task in batches, sorted behind
    them, and the task keeps the best so far: only these leave it, however many items there are.
    Items are copied for each block of queries; there are parts of items only where the blocks of
    queries are fewer than the session's cores.
    """
    queries = stored(queries.select(F.col(by).cast("long").alias(by), "v").where(F.col("v").isNotNull()))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "v").where(F.col("v").isNotNull())
    about = items.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, cores = about["n"], queries.sparkSession.sparkContext.defaultParallelism
    schema, names = f"{by} long, item_id long, score double", [by, "item_id", "score"]
    if n <= small and n * (about["width"] or 0) * 8 <= SMALL_BYTES:
        # a few vectors may be much work: small files of queries are spread over the cores
        return meet_all(queries.repartition(cores, by), items, by, best(by, k, drop_self, slack), schema, small)

    rows = min(STREAM_ROWS, max(1_024, KEPT_ROWS // k))
    q_blocks = -(-queries.count() // rows) or 1
    i_parts = min(n // ITEM_BLOCK + 1, -(-cores // q_blocks))
    own = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("long")
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    left = queries.select(own(by, q_blocks).alias("qb"), every(i_parts).alias("ip"), F.lit(0).alias("side"), F.col(by).alias("id"), "v")
    right = items.select(every(q_blocks).alias("qb"), own("item_id", i_parts).alias("ip"), F.lit(1).alias("side"), F.col("item_id").alias("id"), "v")
    both = left.unionByName(right).select((F.col("qb") * i_parts + F.col("ip")).cast("int").alias("task"), "side", "id", "v")

    def run(batches):
        task, held, running = None, [], None
        for batch in batches:
            tasks, sides, ids = (batch.column(c).to_numpy() for c in ("task", "side", "id"))
            edges = np.flatnonzero((tasks[1:] != tasks[:-1]) | (sides[1:] != sides[:-1])) + 1
            for at, end in zip(np.r_[0, edges], np.r_[edges, len(ids)]):
                if at == end:
                    continue
                if tasks[at] != task:
                    if running is not None:
                        yield from running.batches(names)
                    task, held, running = tasks[at], [], None
                part = ids[at:end], matrix(batch.column("v").slice(at, end - at))
                if not sides[at]:
                    held.append(part)
                elif held:
                    if running is None:
                        running = _Running(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), k, drop_self, slack)
                    running.add(*part)
        if running is not None:
            yield from running.batches(names)

    dealt = both.repartitionById(q_blocks * i_parts, F.col("task")).sortWithinPartitions("task", "side")
    return dealt.mapInArrow(run, schema)


#: Requests that meet one block in a task.
REQUESTS = 1_024


def dealt_meet(asked: DataFrame, blocks: DataFrame, on: list[str], by: str, meet: Callable[[pa.Table, pa.Table], dict[str, np.ndarray]], schema: str, at_once: int = REQUESTS) -> DataFrame:
    """Requests meet the blocks with the same ``on`` columns: ``meet(requests, blocks)`` for a few blocks and ``at_once`` requests each time.

    The requests of a key are counted first and dealt out by salts (a hash of ``by``), and its
    blocks are repeated for each salt, so a key that all requests name is many tasks. A block has
    a number in ``block``; blocks of one key meet requests in tasks of their own.
    """
    asked = stored(asked)
    salts = stored(asked.groupBy(*on).agg(F.ceil(F.count("*") / at_once).cast("int").alias("salts")))
    left = asked.join(salts, on).withColumn("salt", F.pmod(F.xxhash64(by), F.col("salts")).cast("int")).drop("salts")
    named = blocks.join(salts, on)
    right = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    # names of its own for the requests' side: both may come from one table
    left = left.join(blocks.select(*on, F.col("block").alias("to_block")).distinct(), on).select(*(F.col(c).alias(f"to_{c}") if c in (*on, "salt") else F.col(c) for c in [*left.columns, "to_block"]))
    columns = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(requests: pa.Table, held: pa.Table) -> pa.Table:
        requests = requests.rename_columns([c.removeprefix("to_") for c in requests.column_names])
        out = meet(requests, held) if requests.num_rows and held.num_rows else {c: [] for c in columns}
        return pa.table({c: pa.array(out[c], k) for c, k in zip(columns, kinds)})

    keys = [*on, "block", "salt"]
    return left.groupBy(*(f"to_{k}" for k in keys)).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def best(by: str, k: int, drop_self: bool = False, slack: float = 1e-6) -> Meet:
    """The ``k`` items of the largest inner product, and those within ``slack`` of the k-th, so that rounding decides later.

    Of many that round to one score only the ``k`` of the smallest ids can count, so a row gives
    no more than a few times ``k``, however many equal vectors there are.
    """

    def least_ids(scores, own):
        place = np.flatnonzero(scores > -np.inf)
        order = place[np.lexsort((own[place], -np.floor(scores[place] * 1e6 + 0.5)))]
        bins = np.floor(scores[order] * 1e6 + 0.5)
        starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        within = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        scores[order[within >= k]] = -np.inf

    def meet(ids, x, items, y):
        s = x @ y.T
        if drop_self:
            s[ids[:, None] == items[None, :]] = -np.inf
        if s.shape[1] > k:
            s[s < np.partition(s, -k, axis=1)[:, -k][:, None] - slack] = -np.inf
            for crowded in np.flatnonzero((s > -np.inf).sum(axis=1) > 4 * k):
                least_ids(s[crowded], items)
        row, column = np.nonzero(s > -np.inf)
        return {by: ids[row], "item_id": items[column], "score": s[row, column]}

    return meet
