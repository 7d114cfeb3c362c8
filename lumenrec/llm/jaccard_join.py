"""Operator 5: n-gram Jaccard self-join by a size-aware heavy-light split.

Sets are the distinct five-word shingles of a text. Small sets meet by enumeration: each emits
the subsets of the size that a linked partner must share, so small-small pairs collide only if
they are links. Large sets meet through inverted lists: each posts the rarest part of its
shingles, long enough that a linked pair must share an entry, and the lists are scanned; sizes
and places in the order of rarity rule most pairs of a list out (``linking.Places``).

The boundary between small and large is chosen by cost, in rows that have to be handled: the
subsets of a set on the one hand, its postings and their meetings with half of their lists on
the other, summed over all sets of a size. List lengths come from one fixed-size table of
shingle counts over all documents (a hashed count table of ``SKETCH`` cells, whatever the
input's size, summed in segments on the cluster), which also gives rarity. Any order that all
sets share is correct; this one moves passages that many documents share to the end of every
set, where the lists do not reach them unless they are nearly the whole text.

Every candidate is verified on whole sets. Documents with one and the same set are one node.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import bucket_components, parity
from .storage import few, materialize, restrict
from .textops import mix, portions, shingle_set

SKETCH_BITS = 20
SEGMENTS = 64
#: Sizes for which enumeration is weighed; above, the subsets outnumber the elements by far.
LARGEST_SMALL = 30
#: Subsets of a size that no machine would list.
MOST_SUBSETS = 10_000
#: Bytes of text handled at a time.
PORTION = 1_000_000


def _need(s: int, t: int, percent: int) -> int:
    """Least intersection of linked sets of sizes s and t: 100 * i >= percent * (s + t - i)."""
    return -(-percent * (s + t) // (100 + percent))


def _partners(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def subset_keys(s: int, percent: int) -> int:
    """How many keys a set of s elements emits when enumerated."""
    return sum(math.comb(s, _need(s, t, percent)) for t in _partners(s, percent) if _need(s, t, percent) <= s)


def prefix_length(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1 if s else 0


def subset_sizes(s: int, percent: int, boundary: int) -> list[int]:
    """Sizes t of small partners of a small set of s elements."""
    return [t for t in _partners(s, percent) if t <= boundary and _need(s, t, percent) <= min(s, t)]


def choose_boundary(sets: dict[int, int], listed: dict[int, float], percent: int) -> int:
    """The largest size that is enumerated: the one of least cost.

    ``sets`` are the numbers of sets by size, ``listed`` the rows that their postings cost. Sets
    from ``percent`` of the boundary on also post, to meet larger partners.
    """
    best, boundary = None, 0
    for b in range(LARGEST_SMALL + 1):
        keys = {s: sum(math.comb(s, _need(s, t, percent)) for t in subset_sizes(s, percent, b)) for s in sets if s <= b}
        if max(keys.values(), default=0) > MOST_SUBSETS:
            break
        cost = sum(sets[s] * k for s, k in keys.items()) + sum(c for s, c in listed.items() if s >= -(-percent * (b + 1) // 100))
        if best is None or cost < best:
            best, boundary = cost, b
    return boundary


def _profile(batches):
    """One row per document (size and 128-bit fingerprint of its set), then the task's counts in segments."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("small", pa.list_(pa.int64())), ("segment", pa.int32()), ("counts", pa.binary())])
    for ids, texts in portions(batches, PORTION):
        n, f1, f2, small, cells = [], [], [], [], []
        for s in map(shingle_set, texts):
            small.append(s.view(np.int64) if 0 < len(s) <= LARGEST_SMALL else None)
            cells.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
            n.append(len(s))
            f1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            f2.append(int(mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
        if cells:
            counts += np.bincount(np.concatenate(cells), minlength=1 << SKETCH_BITS).astype(np.uint32)
        k = len(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(small, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
    parts = _segments(counts)
    null = pa.nulls(SEGMENTS, pa.int64())
    yield pa.RecordBatch.from_arrays([null, null, null, null, pa.nulls(SEGMENTS, pa.list_(pa.int64())), pa.array(range(SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


def _segments(counts: np.ndarray) -> list[bytes]:
    return [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SEGMENTS, -1)]


def _sum_segment(part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64) for blob in part.column("counts").to_pylist())
    return pa.table({"segment": part.column("segment").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _counts(profile: DataFrame) -> np.ndarray:
    """Shingles in each cell: SKETCH cells always, so what reaches the driver and the workers has one size."""
    rows = profile.where("segment is not null").select("segment", "counts").groupBy("segment").applyInArrow(_sum_segment, "segment int, counts binary").collect()
    counts = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), np.float64)
    for row in rows:
        counts[row["segment"]] = np.frombuffer(row["counts"], np.uint64)
    return counts.ravel()


def _levels(counts: np.ndarray) -> np.ndarray:
    """Rarity level of each cell: 0 up to what chance puts there, then one for each quarter of a doubling."""
    base = counts.mean() + 6 * math.sqrt(counts.mean()) + 2
    return np.where(counts <= base, 0, 1 + np.floor(np.log2(np.maximum(counts / base, 1)) * 4)).astype(np.uint8)


def _posted(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The rarest elements, of which a linked partner has one: by level, then by the hash (s is sorted)."""
    order = np.argsort(levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return s[order[: prefix_length(len(s), percent)]]


def _list_costs(shared, percent: int):
    """Rows that the postings of small sets cost, by size: each posting, and half of what its list holds above chance."""

    def run(batches):
        levels, lengths = shared.value
        sets, cost = np.zeros(LARGEST_SMALL + 1, np.int64), np.zeros(LARGEST_SMALL + 1)
        for batch in batches:
            for items in batch.column("small").to_pylist():
                s = np.array(items, np.int64).view(np.uint64)
                cells = (_posted(s, levels, percent) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                sets[len(s)] += 1
                cost[len(s)] += len(cells) + lengths[cells].sum() / 2
        some = np.flatnonzero(sets)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sets[some]), pa.array(cost[some])], names=["n", "sets", "cost"])

    return run


def _postings(shared, boundary: int, percent: int):
    lists_from = -(-percent * (boundary + 1) // 100)

    def run(batches):
        levels = shared.value[0]
        for ids, texts in portions(batches, PORTION):
            keys, own, sizes, placed, whole = [], [], [], [], []
            for doc_id, text in zip(ids.tolist(), texts):
                s = shingle_set(text)
                if not len(s):
                    continue
                out = [_posted(s, levels, percent) if len(s) >= lists_from else s[:0]]
                placed.append(len(out[0]))
                if len(s) <= boundary:
                    for t in subset_sizes(len(s), percent, boundary):
                        salt = np.uint64(1_000_003 * min(len(s), t) + max(len(s), t))
                        chosen = np.array(list(itertools.combinations(s.tolist(), _need(len(s), t, percent))), np.uint64)
                        out.append(mix(mix(chosen ^ salt).sum(axis=1, dtype=np.uint64) + salt))
                keys.append(np.concatenate(out))
                own.append(doc_id)
                sizes.append(len(s))
                whole.append(s)
            if keys:
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64)))
                bits = _bits(np.concatenate(whole), np.array(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sizes, pa.int64()), values, pa.array(placed, pa.int32()), bits], names=_MEMBERS)

    return run


_MEMBERS = ["id", "n", "keys", "placed", "bits"]
_MEMBER_TYPES = "id long, n long, keys array<long>, placed int, bits array<long>"


def _bits(items: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """``parity`` of many sets, some at a time."""
    ends = np.cumsum(sizes)
    parts = [parity(items[ends[i] - sizes[i] : ends[min(i + 2000, len(sizes)) - 1]], sizes[i : i + 2000]) for i in range(0, len(sizes), 2000)]
    rows = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _sets(batches):
    for ids, texts in portions(batches, PORTION):
        sets = [shingle_set(t).view(np.int64) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["id", "items"])


def listed(rows: DataFrame, to_sets, percent: int) -> DataFrame:
    """Sets as members of inverted lists, for ``bucket_components``: every link among them shares an entry.

    ``to_sets`` turns the rows' Arrow batches into batches ``(id, items)`` of sorted distinct
    64-bit hashes, in a task, so that whole sets never leave it. Elements are ordered by how
    frequent they are among these sets.
    """

    def count(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in to_sets(batches):
            cells = batch.column("items").flatten().to_numpy().view(np.uint64) >> np.uint64(64 - SKETCH_BITS)
            counts += np.bincount(cells.astype(np.int32), minlength=1 << SKETCH_BITS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(_segments(counts), pa.binary())], names=["segment", "counts"])

    shared = rows.sparkSession.sparkContext.broadcast(_levels(_counts(materialize(rows.mapInArrow(count, "segment int, counts binary")))))

    def post(batches):
        for batch in to_sets(batches):
            items = batch.column("items")
            flat, sizes = items.flatten().to_numpy().view(np.uint64), items.value_lengths().to_numpy().astype(np.int64)
            keys = [_posted(flat[a : a + n], shared.value, percent) for a, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist())]
            placed = np.array([len(k) for k in keys], np.int32)
            if len(keys):
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(placed)]).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), values, pa.array(placed), _bits(flat, sizes)], names=_MEMBERS)

    return rows.mapInArrow(post, _MEMBER_TYPES)


_PROFILE = "doc_id long, n long, f1 long, f2 long, small array<long>, segment int, counts binary"


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Connected components of the links ``100 * |x & y| >= percent * |x | y|``.

    ``docs(doc_id, text)`` may have further columns of any name; they are ignored. Returns
    ``doc_id, n_shingles, component_id, set_id`` with a row per input row; ``set_id`` is the
    smallest doc_id with the same set. Null, empty and blank texts have an empty set and stay
    alone. Rows with a null doc_id link with nothing and have no component. Several rows with
    one doc_id are taken as they are; a doc_id whose rows differ is linked by each of its texts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless = texts.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text")
    texts = texts.where("doc_id is not null")
    profile = materialize(texts.mapInArrow(_profile, _PROFILE))
    counts = _counts(profile)
    above = np.maximum(counts - counts.mean() - 6 * math.sqrt(counts.mean()) - 2, 0).astype(np.float32)
    shared = spark.sparkContext.broadcast((_levels(counts), above))
    sized = profile.where("doc_id is not null").select("doc_id", "n", "f1", "f2")
    same = sized.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("set_id"), F.max("doc_id").alias("last")).where("set_id < last").drop("last")
    # most sets occur once: those that repeat are few enough to be sent to the rows, or are joined by a shuffle
    named = materialize(sized.join(few(same), ["n", "f1", "f2"], "left").select("doc_id", "n", F.coalesce("set_id", "doc_id").alias("set_id")))

    small = profile.where("small is not null").select("small").mapInArrow(_list_costs(shared, percent), "n long, sets long, cost double")
    by_size = small.groupBy("n").agg(F.sum("sets").alias("sets"), F.sum("cost").alias("cost")).collect()
    boundary = choose_boundary({r["n"]: r["sets"] for r in by_size}, {r["n"]: r["cost"] for r in by_size}, percent)
    copies = named.where("doc_id <> set_id").select("doc_id").distinct()
    originals = restrict(texts.where("text is not null"), copies, "doc_id", "left_anti")
    members = originals.mapInArrow(_postings(shared, boundary, percent), _MEMBER_TYPES)

    def verify(pairs: DataFrame) -> DataFrame:
        ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        sets = materialize(restrict(texts.where("text is not null"), ids, "doc_id").mapInArrow(_sets, "id long, items array<long>"))
        x = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        both = F.size(F.array_intersect("x", "y"))
        return x.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()

    labels = bucket_components(members, verify, percent)
    out = named.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "set_id").alias("component_id"), "set_id")
    none = F.lit(None).cast("long")
    unnamed = nameless.mapInArrow(_profile, _PROFILE).where("doc_id is not null")
    return out.unionByName(unnamed.select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id"), none.alias("set_id")))
