"""Operator 10: exact substring dedup with suffixes sorted deep-shallow.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier. Suffixes
are compared only as far as that, and they are dealt out by a minimizer: the smallest hash of
the ``GRAM``-byte strings inside a suffix's first ``LENGTH`` bytes, which equal strings share
wherever they stand. Neighbouring suffixes mostly have one minimizer and travel as one run of
bytes.

1. Minimizers are counted. One that stands in one place has no repeated string; a Bloom filter
   of the others, of bounded size, is broadcast (false hits only cost time).
2. Every task sorts the suffixes of its own texts that pass the filter. A string that repeats
   within the task is settled there, so a passage that a third of all texts share leaves a task
   once. The rest go to the task of their minimizer and are sorted again.
3. Removed ranges are put together by document.

Sorting is deep-shallow, all groups at once in numpy. Shallow: a multikey sort whose characters
are words of eight bytes; at each depth up to ``SHALLOW`` the members of a group are ordered by
their next word, which parts a group as three-way partitioning by a pivot does, but by all
values in one step. Deep: a blind trie for every group that still agrees. Its earliest suffix is
the path from the root to a leaf; the others compare with the path, which finds the depth at
which each branches off and the word there, the two labels a blind trie keeps. Members with the
same depth and word are one subtree and treated alike. Suffixes that stay on the path to depth
``LENGTH`` repeat it. The order among subtrees has no influence on which strings are equal, so
it is not kept, and groups of one are dropped as they appear.

Texts that occur several times are handled as wholes: the first takes part, the others lose
everything if they have ``LENGTH`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import in_order
from .storage import few, materialize, restrict
from .textops import mix

LENGTH, GRAM, SHALLOW = 100, 48, 24
MAX_FILTER_BITS, PROBES, SEGMENTS_LOG2 = 1 << 28, 4, 6
#: Bytes of text, or suffixes, that a task sorts at a time.
PORTION = 1_500_000
_WORD_AT = [*range(0, LENGTH - 8, 8), LENGTH - 8]
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers that sort like the bytes."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    w = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    w = w[:-8] * _A + w[8:] * _B
    w ^= w >> np.uint64(29)
    n = len(data) - GRAM + 1
    return mix(w[:n] * _A + w[16 : n + 16] * _B + w[32 : n + 32] * _C)


def _sliding(pick, values: np.ndarray) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of as many values as LENGTH bytes have grams."""
    reach, span = LENGTH - GRAM + 1, 1
    while 2 * span <= reach:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = reach - span
    return pick(values[:-rest], values[rest:]) if rest else values


def minimizers(data: np.ndarray) -> np.ndarray:
    """For each place the smallest hash of the grams inside the LENGTH bytes from there on."""
    return _sliding(np.minimum, grams(data))


def places_of_minima(data: np.ndarray) -> np.ndarray:
    """The hashes that are the smallest of some place, once for each gram that has them."""
    g = grams(data)
    low = _sliding(np.minimum, g)
    pad = np.zeros(LENGTH - GRAM, np.uint64)
    return g[g == _sliding(np.maximum, np.concatenate([pad, low, pad]))]


def repeats(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each string ``data[s:s + LENGTH]`` the index of the first equal one in ``starts``; -1 if that is itself."""
    words = _words(data)
    out = np.full(len(starts), -1)
    at = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for depth in range(0, SHALLOW, 8):
        key = words[starts[at] + depth].astype(np.uint64)
        order = np.argsort(key, kind="stable") if not depth else np.lexsort((key, group))
        at, key, group = at[order], key[order], group[order]
        at, group = _groups(at, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
    while len(at):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        path = at[np.repeat(first, np.diff(np.append(first, len(at))))]
        branch, value = np.full(len(at), -1), np.zeros(len(at), np.uint64)
        for depth in _WORD_AT[::-1]:
            if depth >= SHALLOW:
                own = words[starts[at] + depth].astype(np.uint64)
                differs = own != words[starts[path] + depth]
                branch[differs], value[differs] = depth, own[differs]
        again = (branch < 0) & (at != path)
        out[at[again]] = path[again]
        off = branch >= 0
        at, group, branch, value = at[off], group[off], branch[off], value[off]
        order = np.lexsort((value, branch, group))
        at, group, branch, value = at[order], group[order], branch[order], value[order]
        at, group = _groups(at, (group[1:] != group[:-1]) | (branch[1:] != branch[:-1]) | (value[1:] != value[:-1]))
    return out


def _groups(at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and numbers of the groups of two and more."""
    if len(at) < 2:
        return at[:0], at[:0]
    new = np.concatenate([[True], breaks])
    alone = new & np.concatenate([new[1:], [True]])
    number = np.cumsum(new)
    return at[~alone], number[~alone]


def _runs(texts: list[bytes]):
    """Concatenated texts; runs of places with one minimizer: first, last, minimizer, text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - np.array([len(t) for t in texts])
    if len(data) < LENGTH:
        none = np.empty(0, np.int64)
        return data, begins, none, none, np.empty(0, np.uint64), none
    low = minimizers(data)
    text = np.repeat(np.arange(len(texts)), ends - begins)[: len(low)]
    valid = np.arange(len(low)) + LENGTH <= ends[text]
    change = np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(change & valid)
    last = np.append(np.flatnonzero(change), len(low))[1:] - 1
    last = last[np.flatnonzero(np.isin(np.flatnonzero(change), first, assume_unique=True))]
    last = np.minimum(last, ends[text[first]] - LENGTH)
    return data, begins, first, last, low[first], text[first]


def _portions(batches):
    """Documents of a task in portions of bounded size (one document at least), by doc_id."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            if len(raw) < LENGTH:
                continue
            ids.append(doc_id)
            texts.append(raw)
            size += len(raw)
            if size >= PORTION:
                yield ids, texts
                ids, texts, size = [], [], 0
        if texts:
            yield ids, texts


def _count(batches):
    for _, texts in _portions(batches):
        data, _, first, last, low, _ = _runs(texts)
        minima = places_of_minima(data) if len(low) else low
        key, at = np.unique(np.concatenate([minima, low]), return_inverse=True)
        n = np.bincount(at[: len(minima)], minlength=len(key))
        size = np.bincount(at[len(minima) :], (last - first + 1).astype(float), len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(size)], names=["key", "n", "size"])


class _Filter:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(key: np.ndarray, size: int):
        h = mix(key ^ _B)
        stride = (h >> np.uint64(17)) | np.uint64(1)
        base = (key >> np.uint64(64 - SEGMENTS_LOG2)) * np.uint64(size >> SEGMENTS_LOG2)
        for _ in range(PROBES):
            yield (base + (h & np.uint64((size >> SEGMENTS_LOG2) - 1))).astype(np.int64)
            h = h + stride

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for at in self.places(key, len(self.bits) * 8):
            out &= ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return out


def _filter_bits(size: int):
    def run(batches):
        part, bits = size >> SEGMENTS_LOG2, {}
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            for at in _Filter.places(key, size):
                for s in np.unique(at // part).tolist():
                    own = bits.setdefault(s, np.zeros(part // 8, np.uint8))
                    place = at[at // part == s] - s * part
                    np.bitwise_or.at(own, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        for s, own in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["segment", "bits"])

    return run


_RESULT = "key long, doc_id long, first long, last long, context binary"


def _emit(key, doc, first, last, context):
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(context, pa.binary())], names=["key", "doc_id", "first", "last", "context"])


def _settle(data: np.ndarray, begin: np.ndarray, doc: np.ndarray, place: np.ndarray, sizes: np.ndarray):
    """Sorts the suffixes of the runs, which come by (doc, place).

    ``begin`` is where a run's first suffix starts in ``data``, ``place`` where in its document.
    Returns the parts of the runs that repeat and the parts that do not: run, offset of the
    first suffix, number of suffixes. A place does not repeat itself if its row comes twice.
    """
    ends = np.cumsum(sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(run)) - np.repeat(ends - sizes, sizes)
    earlier = repeats(data, begin[run] + offset)
    spot = place[run] + offset
    again = (earlier >= 0) & ((doc[run] != doc[run[earlier]]) | (spot != spot[earlier]))
    change = np.concatenate([[True], (run[1:] != run[:-1]) | (again[1:] != again[:-1])]) if len(run) else np.empty(0, bool)
    part = np.flatnonzero(change)
    length = np.diff(np.append(part, len(run)))
    return run[part], offset[part], length, again[part]


def _local(shared):
    def run(batches):
        known = _Filter(shared.value)
        for ids, texts in _portions(batches):
            order = sorted(range(len(ids)), key=ids.__getitem__)
            ids, texts = np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]
            data, begins, first, last, low, text = _runs(texts)
            hit = known.has(low)
            first, last, low, text = first[hit], last[hit], low[hit], text[hit]
            part, offset, length, again = _settle(data, first, ids[text], first - begins[text], last - first + 1)
            start = first[part] + offset
            raw = data.tobytes()
            context = [None if a else raw[s : s + n - 1 + LENGTH] for s, n, a in zip(start.tolist(), length.tolist(), again.tolist())]
            place = start - begins[text[part]]
            yield _emit(low[part].view(np.int64), ids[text[part]], place, place + length - 1, context)

    return run


def _global(batches):
    """Sorts what is left of the runs of this partition's minimizers; the settled parts pass through."""
    waiting = []
    for batch in batches:
        settled = batch.column("context").is_null()
        yield batch.filter(settled)
        waiting.append(batch.filter(batch.column("context").is_valid()))
    table = pa.Table.from_batches(waiting) if waiting else None
    if table is None or not table.num_rows:
        return
    key, doc, first, last = (table.column(c).to_numpy() for c in ("key", "doc_id", "first", "last"))
    context = table.column("context").to_pylist()
    order = np.argsort(key, kind="stable")
    sizes = np.cumsum((last - first + 1)[order])
    cuts = [0]
    for i in np.flatnonzero(np.diff(key[order])) + 1:  # portions of whole groups
        if sizes[i - 1] - (sizes[cuts[-1] - 1] if cuts[-1] else 0) >= PORTION // 3:
            cuts.append(int(i))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        rows = order[a:b]
        rows = rows[np.lexsort((first[rows], doc[rows]))]
        raw = [context[i] for i in rows.tolist()]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in raw])[:-1]])
        part, offset, length, again = _settle(np.frombuffer(b"".join(raw), np.uint8), begin, doc[rows], first[rows], (last - first + 1)[rows])
        part, offset, length = rows[part[again]], offset[again], length[again]
        yield _emit(key[part], doc[part], first[part] + offset, first[part] + offset + length - 1, [None] * len(part))


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> ranges ``doc_id, spans`` (sorted ``start, end`` in bytes) and the later copies' ``doc_id``.

    Later copies of a whole text are listed on their own, not as ranges.
    """
    spark = docs.sparkSession
    marked = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", F.sha2("text", 256).alias("digest"))
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = materialize(marked.join(few(first.select("digest", "low")), "digest").where("doc_id > low").select("doc_id").distinct())
    texts = restrict(docs.where(F.octet_length("text") >= LENGTH), copies, "doc_id", "left_anti")

    counted = texts.mapInArrow(_count, "key long, n long, size long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    shared = materialize(counted.where("n > 1").select("key", "size"))
    total = shared.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    size = min(MAX_FILTER_BITS, 1 << max(16, (16 * total["n"]).bit_length()))
    bits = np.zeros((1 << SEGMENTS_LOG2, (size >> SEGMENTS_LOG2) // 8), np.uint8)
    by_segment = shared.select("key").repartition(1 << SEGMENTS_LOG2, F.shiftrightunsigned("key", 64 - SEGMENTS_LOG2))
    for row in by_segment.mapInArrow(_filter_bits(size), "segment int, bits binary").toLocalIterator():
        bits[row["segment"]] |= np.frombuffer(row["bits"], np.uint8)
    known = spark.sparkContext.broadcast(bits.ravel())

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["size"] // PORTION + 1)
    left = texts.mapInArrow(_local(known), _RESULT).repartition(parts, "key")
    ranges = left.mapInArrow(_global, _RESULT).select("doc_id", F.struct(F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")).alias("r"))
    spans = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_set("r")).alias("spans"))
    return materialize(spans), copies


def _cut(batches):
    for batch in batches:
        sizes, gone, n, kept = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw, at, out, removed, runs = text.as_py().encode("utf-8", "surrogatepass"), 0, [], 0, 0
            for s in spans:
                a, b = max(at, s["start"]), s["end"]
                if s["start"] > at or not runs:
                    runs += 1
                    out.append(raw[at:a])
                if b > a:
                    removed += b - a
                    at = b
            out.append(raw[at:])
            sizes.append(len(raw))
            gone.append(removed)
            n.append(runs)
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes).

    One row per input row; a null text counts as empty, further columns are ignored. Rows with
    a null doc_id stay as they are and shape nothing. Equal rows with one doc_id are one place:
    neither makes the other a repetition. Rows of one doc_id with different texts are documents
    of their own, in the order of their texts' digests, after those of smaller ids. Texts with
    fewer than LENGTH bytes lose nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = materialize(texts.where("doc_id is not null").select("doc_id", F.sha2("text", 256).alias("digest")).distinct())
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _removed(texts)
    numbers = in_order(ids, "doc_id", "digest")
    named = texts.withColumn("digest", F.sha2("text", 256)).join(numbers, ["doc_id", "digest"], "left").select(F.col("row").alias("doc_id"), "text")
    out = _removed(materialize(named)).join(numbers.select("row", F.col("doc_id").alias("_own")), F.col("doc_id") == F.col("row"), "left")
    return out.select(F.col("_own").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def _removed(texts: DataFrame) -> DataFrame:
    """``remove_repeats`` where a doc_id has one text."""
    spans, copies = repeated_ranges(texts.where("doc_id is not null"))
    whole = F.octet_length("text") >= LENGTH
    later = copies.withColumn("later", F.lit(True))
    few = later.limit(1_000_001).count() <= 1_000_000
    marked = texts.join(F.broadcast(later) if few else later, "doc_id", "left").withColumn("later", F.coalesce("later", F.lit(False)) & whole)
    n_bytes = F.octet_length("text").cast("long")
    gone = F.when(F.col("later"), n_bytes).otherwise(F.lit(0).cast("long"))
    kept = F.when(F.col("later"), F.lit(b"")).otherwise(F.col("text").cast("binary"))
    touched = spans.select("doc_id")
    rest = restrict(marked, touched, "doc_id", "left_anti").select("doc_id", n_bytes.alias("n_bytes"), gone.alias("n_removed"), F.col("later").cast("long").alias("n_spans"), kept.alias("kept"))
    cut = restrict(texts, touched, "doc_id").join(spans, "doc_id").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return rest.unionByName(cut)
