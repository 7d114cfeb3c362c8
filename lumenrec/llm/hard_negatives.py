"""Operator 13: hard negatives by one-dimensional distance keys, certified.

Vectors of integers are augmented by one component that brings all of them to the length of the
longest, so the inner product with an anchor (whose own further component is 0) orders them as
the distance from the anchor does: ``|a - v|^2 = |a|^2 + L^2 - 2 a.v``. Pivots come from a bounded
sample; each vector belongs to its nearest pivot and is stored sorted by (pivot, distance), cut
into blocks that each cover one interval of keys of one pivot.

An anchor at distance d from a pivot meets only those of its blocks whose keys lie near d: by the
triangle inequality a block of keys [lo, hi] holds nothing nearer than ``max(lo - d, d - hi)`` and
nothing farther than ``d + hi``. Blocks are scanned in that order, ``FIRST`` of them in the first
round and ``GROWTH`` times as many up to the end of each further one; whatever can no longer
change the result is left out, and an anchor is done when the next block's bound is below its
k-th score. Two searches run so: the positives (same label), then for each positive the best rows
of other labels inside its window of scores.

A round is an equi-join of requests and blocks on the block, both dealt out by salts so that a
block that all anchors ask for is not one task; scores are exact products of integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Rows of the sample that pivots are fitted on, and pivots at most.
SAMPLE, MOST_PIVOTS, FIT_STEPS = 2_048, 256, 8
#: Rows of a block, and blocks at most: what is known of every block goes to every task.
BLOCK, MOST_BLOCKS = 2_048, 32_768
FIRST, GROWTH = 8, 4
#: Anchors that meet a block in one task.
AT_ONCE = 1_024
#: Squared length from which a vector takes no part: its scores, times 100, would not fit a long.
MOST_SQUARED = 2**56


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _quantise(scale: float):
    def run(batches):
        for batch in batches:
            values, sizes = _lists(batch.column("v"))
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(values * scale)
                of = np.repeat(np.arange(len(sizes)), sizes)
                rough = np.bincount(of, whole * whole, minlength=len(sizes)) if len(of) else np.zeros(len(sizes))
            usable = rough < MOST_SQUARED
            ends = np.cumsum(sizes)
            rows = [np.trim_zeros(whole[e - n : e].astype(np.int64), "b") if ok else None for e, n, ok in zip(ends.tolist(), sizes.tolist(), usable.tolist())]
            squared = [int(x @ x) if x is not None else None for x in rows]
            keep = pa.array([x is not None and q < MOST_SQUARED for x, q in zip(rows, squared)])
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([None if x is None else x.tobytes() for x in rows], pa.binary()), pa.array([0 if x is None else len(x) for x in rows], pa.int32()), pa.array(squared, pa.int64())], names=["vec_id", "label", "v", "width", "squared"])
            yield out.filter(keep)

    return run


def _matrix(blobs: pa.Array, width: int) -> np.ndarray:
    """Vectors of different widths as rows of one matrix; what is missing is 0."""
    out = np.zeros((len(blobs), width), np.int64)
    for row, blob in enumerate(blobs.to_pylist()):
        x = np.frombuffer(blob, np.int64)
        out[row, : len(x)] = x
    return out


def _kind(longest: int):
    """A number type in which sums of products of such vectors are exact, for fast products where they are short."""
    return np.float32 if longest < 2**24 else np.float64 if longest < 2**53 else np.int64


class _Space:
    """The augmented space: its width, squared length, pivots and, later, the blocks' intervals of keys."""

    def __init__(self, width: int, longest: int, pivots: np.ndarray):
        self.width, self.longest = width, longest
        self.pivots, self.rise = pivots[:, :width], pivots[:, width]
        self.block_pivot = self.lo = self.hi = np.zeros(0)

    def keys(self, m: np.ndarray, squared: np.ndarray, augmented: bool) -> np.ndarray:
        """Distances of rows from all pivots. Pivots are whole numbers, so equal rows get equal distances in any company."""
        exact = np.float64 if self.longest < 2**50 else np.int64  # exact sums, so the same in any batch
        flat = (m.astype(exact) @ self.pivots.astype(exact).T).astype(np.float64)
        length = np.full(len(m), float(self.longest)) if augmented else squared.astype(np.float64)
        if augmented:
            flat += np.sqrt(np.maximum(self.longest - squared, 0).astype(np.float64))[:, None] * self.rise
        own = (self.pivots.astype(np.float64) ** 2).sum(axis=1) + self.rise.astype(np.float64) ** 2
        return np.sqrt(np.maximum(length[:, None] + own - 2 * flat, 0))

    def bounds(self, m: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest and least score that a row of each block can have with each anchor, with room for rounding."""
        d = self.keys(m, squared, False)[:, self.block_pivot]
        length = (squared.astype(np.float64) + self.longest)[:, None]
        slack = 1e-9 * length + 1
        near = np.maximum(np.maximum(self.lo - d, d - self.hi), 0)
        return np.floor((length - near * near) / 2 + slack), np.floor((length - (d + self.hi) ** 2) / 2 - slack)


def _fit_pivots(sample: list, width: int, longest: int, n: int) -> np.ndarray:
    """``n`` whole-number centres of the augmented sample by Lloyd's steps, from rows spread over it."""
    x = np.zeros((len(sample), width + 1))
    for row, blob in enumerate(sample):
        v = np.frombuffer(blob, np.int64)
        x[row, : len(v)] = v
    x[:, width] = np.sqrt(np.maximum(longest - (x[:, :width] ** 2).sum(axis=1), 0))
    x = np.unique(x, axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(FIT_STEPS):
        nearest = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        some = np.unique(nearest)
        centres = np.stack([x[nearest == k].mean(axis=0) for k in some])
    return np.unique(np.rint(centres).astype(np.int64), axis=0)


def _key_rows(shared):
    def run(batches):
        space = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            squared = batch.column("squared").to_numpy()
            keys = space.keys(_matrix(batch.column("v"), space.width), squared, True)
            nearest = np.argmin(keys, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(keys[np.arange(len(keys)), nearest]), batch.column("vec_id"), batch.column("label"), batch.column("v")], names=["pivot", "key", "vec_id", "label", "v"])

    return run


_BLOCKS = "block long, pivot int, lo double, hi double, ids binary, labels binary, vectors binary"


def _blocks(shared, rows_each: int):
    """Sorted rows of a partition -> blocks of one pivot each; rows that equal the one before are left out."""

    def run(batches):
        space, part = shared.value, TaskContext.get().partitionId()
        narrow = np.int16 if space.longest < 2**30 else np.int64
        made = 0
        table = pa.Table.from_batches(list(batches), pa.schema([("pivot", pa.int32()), ("key", pa.float64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary())]))
        if not table.num_rows:
            return
        pivot, key, ids, labels = (table.column(c).to_numpy() for c in ("pivot", "key", "vec_id", "label"))
        blobs = table.column("v").to_pylist()
        again = np.zeros(len(ids), bool)
        same = (pivot[1:] == pivot[:-1]) & (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1])
        for i in np.flatnonzero(same) + 1:
            again[i] = blobs[i] == blobs[i - 1]
        rows = np.flatnonzero(~again)
        cuts = np.flatnonzero(np.diff(pivot[rows])) + 1
        for run_ in np.split(rows, cuts):
            for at in range(0, len(run_), rows_each):
                r = run_[at : at + rows_each]
                m = _matrix(pa.array([blobs[i] for i in r], pa.binary()), space.width)
                made += 1
                columns = [[part << 32 | made], [pivot[r[0]]], [key[r].min()], [key[r].max()], [ids[r].tobytes()], [labels[r].tobytes()], [m.astype(narrow).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "pivot", "lo", "hi", "ids", "labels", "vectors"])

    return run


def _asked(shared, begin: int, end: int):
    """Anchors ``(a, vec_id, label, v, squared, lows, highs, floors)`` -> the blocks that they have to see in this round.

    Each anchor has searches with a window of scores (``lows``, ``highs``) and the score that a
    row must reach to change it (``floors``: of its k-th so far, else the window's lower end).
    """

    def run(batches):
        space, numbers = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                m = _matrix(part.column("v"), space.width)
                most, least = space.bounds(m, part.column("squared").to_numpy())
                highs, floors = part.column("highs").to_pylist(), part.column("floors").to_pylist()
                order = np.argsort(-most, axis=1, kind="stable")[:, begin:end]
                of, seen = [], []
                for row in range(len(m)):
                    o = order[row]
                    wanted = np.zeros(len(o), bool)
                    for high, floor in zip(highs[row], floors[row]):
                        wanted |= (least[row, o] <= high) & (most[row, o] >= floor)
                    seen.append(numbers[o[wanted]])
                    of.append(np.full(len(seen[-1]), row))
                take = pa.array(np.concatenate(of))
                columns = [pa.array(np.concatenate(seen)), *(part.column(c).take(take) for c in ("a", "vec_id", "label", "v", "lows", "highs"))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "a", "vec_id", "label", "v", "lows", "highs"])

    return run


def _meet(shared, k: int, same_label: bool):
    """Best ``k`` rows of a block for each search of each anchor that asked for it."""

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        space = shared.value[0]
        kind = _kind(space.longest)
        ids, labels = (np.frombuffer(block.column(c)[0].as_py(), np.int64) for c in ("ids", "labels"))
        narrow = np.int16 if space.longest < 2**30 else np.int64
        right = np.frombuffer(block.column("vectors")[0].as_py(), narrow).reshape(len(ids), space.width).astype(kind)
        out = []
        own_ids, own_labels, lows, highs, a = (asked.column(c).to_pylist() for c in ("vec_id", "label", "lows", "highs", "a"))
        for at in range(0, asked.num_rows, 256):
            left = _matrix(asked.column("v").slice(at, 256), space.width).astype(kind)
            scores = (left @ right.T).astype(np.int64)
            for row, s in enumerate(scores, at):
                fit = ((labels == own_labels[row]) == same_label) & (ids != own_ids[row])
                for search, (low, high) in enumerate(zip(lows[row], highs[row])):
                    at_ = np.flatnonzero(fit & (s >= low) & (s <= high))
                    if len(at_) > k:
                        at_ = at_[s[at_] >= -np.partition(-s[at_], k - 1)[k - 1]]
                    at_ = at_[np.lexsort((ids[at_], -s[at_]))][:k]
                    out.extend((a[row], search, int(ids[i]), int(s[i])) for i in at_)
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("a", "search", "vec_id", "score"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})

    return run


def _search(searches: DataFrame, index: DataFrame, shared, n_blocks: int, k: int, same_label: bool) -> DataFrame:
    """``searches(a, vec_id, label, v, squared, lows, highs)`` -> ``(a, search, vec_id, score, place)``, the first ``k`` of each."""
    found, begin, end = None, 0, FIRST
    best = Window.partitionBy("a", "search").orderBy(F.desc("score"), "vec_id")
    while begin < n_blocks:
        if found is None:
            state = searches.withColumn("floors", F.col("lows"))
        else:
            full = found.groupBy("a", "search").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
            full = full.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("search", "s"))).alias("full"))
            floors = F.transform("lows", lambda low, i: F.coalesce(F.try_element_at("full", i), low))
            state = searches.join(full, "a", "left").withColumn("floors", floors).drop("full")
        asked = materialize(state.mapInArrow(_asked(shared, begin, end), "block long, a long, vec_id long, label long, v binary, lows array<long>, highs array<long>"))
        if asked.isEmpty():
            break
        salts = materialize(asked.groupBy("block").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("salts")))
        salts = F.broadcast(salts)  # a row for a block at most, of which there are no more than MOST_BLOCKS and the cuts
        left = asked.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
        right = index.join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("block", "salt", "ids", "labels", "vectors")
        rows = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(_guarded(_meet(shared, k, same_label)), "a long, search int, vec_id long, score long")
        rows = rows if found is None else rows.unionByName(found.select(*rows.columns))
        found = materialize(rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k))
        begin, end = end, end * GROWTH
    if found is None:
        return searches.sparkSession.createDataFrame([], "a long, search int, vec_id long, score long, place int")
    return found


def _guarded(meet):
    """A salt that no anchor drew has a block and no request."""
    empty = pa.table({"a": pa.array([], pa.int64()), "search": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        return meet(asked, block) if asked.num_rows and block.num_rows else empty

    return run


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """``vectors(vec_id, label, embedding)`` -> hard negatives of the rows that ``is_anchor`` picks by ``vec_id``.

    Components become ``floor(scale * x)``; scores are inner products, higher first, ties by the
    smaller ``vec_id``. An anchor's positives are its first rows of the same label and another
    ``vec_id``; for each, the first rows of other labels follow whose score lies from ``low`` to
    ``high`` percent of the positive's (of a negative score there is no such row).

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do
    those whose squared length after scaling is 2**56 or more, for which longs are too short.
    Shorter vectors are filled up with zeros, an empty one is all zeros. Equal rows count once;
    rows of one id that differ are rows of their own, all anchors if the id is one.
    Further columns are ignored. Without anchors or partners there are no rows.
    """
    spark = vectors.sparkSession
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
    rows = materialize(rows.mapInArrow(_quantise(scale), "vec_id long, label long, v binary, width int, squared long"))
    about = rows.agg(F.count("*").alias("n"), F.max("width").alias("width"), F.max("squared").alias("squared")).first()
    if not about["n"]:
        return spark.createDataFrame([], _RESULT)
    n, width, longest = about["n"], max(1, about["width"]), about["squared"]
    rows_each = max(BLOCK, -(-n // MOST_BLOCKS))
    sample = [bytes(r["v"]) for r in rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect()]
    space = _Space(width, longest, _fit_pivots(sample, width, longest, min(MOST_PIVOTS, -(-n // BLOCK))))
    fitted = spark.sparkContext.broadcast(space)
    keyed = rows.mapInArrow(_key_rows(fitted), "pivot int, key double, vec_id long, label long, v binary")
    order = ["pivot", "key", "vec_id"]
    dealt = keyed.repartitionByRange(max(1, min(4_096, -(-n // (4 * rows_each)))), *order).sortWithinPartitions(*order, "label", "v")
    index = materialize(dealt.mapInArrow(_blocks(fitted, rows_each), _BLOCKS))
    about_blocks = index.select("block", "pivot", "lo", "hi").orderBy("block").toPandas()
    space.block_pivot, space.lo, space.hi = (about_blocks[c].to_numpy() for c in ("pivot", "lo", "hi"))
    shared, n_blocks = spark.sparkContext.broadcast((space, about_blocks["block"].to_numpy())), len(about_blocks)

    anchors = materialize(rows.where(is_anchor).select("vec_id", "label", "v", "squared").distinct().withColumn("a", F.monotonically_increasing_id()))
    ends = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("lows", -(2**62)), ("highs", 2**62))]
    first = _search(anchors.select("*", *ends), index, shared, n_blocks, positives, True)
    first = first.select("a", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    ranged = first.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))
    whole = lambda x, up: (F.call_function("div", x, F.lit(100)) + (x % 100 > 0 if up else x % 100 < 0).cast("long") * (1 if up else -1))
    ranged = ranged.select(
        "a", F.transform("found", lambda x: whole(low * x["positive_score"], True)).alias("lows"), F.transform("found", lambda x: whole(high * x["positive_score"], False)).alias("highs"),
        F.transform("found", lambda x: x["positive_id"]).alias("positive_ids"), F.transform("found", lambda x: x["positive_score"]).alias("positive_scores"),
    )
    searches = materialize(anchors.join(ranged, "a"))
    second = _search(searches.select("a", "vec_id", "label", "v", "squared", "lows", "highs"), index, shared, n_blocks, negatives, False)
    named = second.withColumnRenamed("vec_id", "negative_id").join(searches.select("a", F.col("vec_id").alias("anchor_id"), "positive_ids", "positive_scores"), "a")
    return named.select("anchor_id", F.get("positive_ids", "search").alias("positive_id"), F.col("place").alias("rank"), "negative_id", F.get("positive_scores", "search").alias("positive_score"), F.col("score").alias("negative_score"))
