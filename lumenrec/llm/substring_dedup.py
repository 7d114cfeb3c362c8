"""Operator 1: substring dedup by paragraph MinHash banding.

Passages repeat inside other texts, where no line break marks them, so a paragraph here is a
piece of the text's word sequence, line breaks ignored: it is cut where the hash of two
neighbouring words is the smallest among ``REACH`` places on either side, alike wherever a
passage stands (about 17 words a piece, never under 9 but at a text's ends). Pieces are sets of
five-word shingles. Banded signatures (``BANDS`` of ``ROWS``) bring pieces of similarity 0.8
together with probability 0.972, of 0.9 with 0.9988, equal ones always; exact Jaccard similarity
verifies them, and every connected component keeps its first piece.

Neighbouring removals of a document are one span. A passage rarely starts with a piece, so a
span is extended by the words, up to ``EXTEND`` on either side, that it shares with the first
copy; spans from ``LEAST_WORDS`` words on are reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import Parts, named, numbered
from .jaccard_join import listed
from .linking import bucket_components
from .minhash import one_permutation
from .storage import materialize, restrict
from .textops import SHINGLE, hash_words, mix, places, portions, windows, words_of

BANDS, ROWS, PERCENT = 5, 3, 80
REACH, EXTEND = 8, 16
#: Pieces below this many words, which only a text's ends have, are not compared; spans below the other are not reported.
LEAST_PIECE, LEAST_WORDS = 8, 25
#: Characters of text handled at a time.
PORTION = 1_000_000
_G = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def cut(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Word hashes of all texts in a row; where each text begins among them; and the pieces: first word, end, text, number in the text."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = hash_words([w for own in words for w in own])
    begins = np.cumsum(sizes) - sizes
    if not len(h):
        none = np.empty(0, np.int64)
        return h, begins, none, none, none, none
    text = np.repeat(np.arange(len(texts)), sizes)
    pair = mix(np.concatenate([h[:-1] * _G[0] + h[1:], h[-1:]]))
    low = np.ones(len(h), bool)
    for d in range(1, min(REACH, len(h) - 1) + 1):
        other = text[d:] != text[:-d]
        low[d:] &= other | (pair[d:] < pair[:-d])
        low[:-d] &= other | (pair[:-d] <= pair[d:])
    low[begins[sizes > 0]] = True
    starts = np.flatnonzero(low)
    of = text[starts]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    number = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return h, begins, starts, np.append(starts[1:], len(h)), of, number


def _compared(texts: list[str | None]):
    h, begins, starts, ends, of, number = cut(texts)
    keep = ends - starts >= LEAST_PIECE
    return h, begins, starts[keep], ends[keep], of[keep], number[keep]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _buckets(parts: Parts):
    def run(batches):
        for ids, texts in portions(batches, PORTION):
            h, _, starts, ends, of, number = _compared(texts)
            if not len(starts):
                continue
            sizes = ends - starts
            items = windows(h)[places(starts, sizes - SHINGLE + 1)]
            keys = one_permutation(items, sizes - SHINGLE + 1, BANDS, ROWS)
            inside = places(starts, sizes)
            terms = mix(h[inside] * _G[1] + (places(np.zeros(len(sizes), np.int64), sizes) + 1).astype(np.uint64) * _G[0])
            exact = mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
            lists = _lists(keys.ravel().view(np.int64), np.full(len(sizes), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(parts.pack(ids[of], number)), pa.array(exact.view(np.int64)), lists], names=["id", "same", "keys"])

    return run


def _sets(parts: Parts):
    """Shingles of the pieces that are wanted."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
                h, _, starts, ends, _, number = _compared([text.as_py()])
                if not len(starts):
                    continue
                w = windows(h)
                for k in np.flatnonzero(np.isin(number, wanted)):
                    ids.append(int(parts.pack(np.int64(doc_id), number[k])))
                    out.append(np.unique(w[starts[k] : ends[k] - SHINGLE + 1]).view(np.int64))
            values = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(values, np.array([len(x) for x in out], np.int64))], names=["id", "items"])

    return run


_SPAN = "doc_id long, start_word long, n_words long, firsts array<long>, root_left long, root_right long, left array<int>, right array<int>, id long"
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]


def _spans(parts: Parts):
    """Spans of neighbouring removals with the words around them, and the words around the pieces that are asked for (``id``)."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, gone, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "gone", "asked"))):
                h, _, starts, ends, _, number = _compared([text])
                near = h.view(np.int64).astype(np.int32)
                before = lambda at: near[max(0, at - EXTEND) : at][::-1].tolist()
                after = lambda at: near[at : at + EXTEND].tolist()
                place = {int(k): i for i, k in enumerate(number)}
                for k in asked or ():
                    if k in place:
                        i = place[k]
                        rows.append((None, None, None, None, None, None, before(starts[i]), after(ends[i]), int(parts.pack(np.int64(doc_id), k))))
                removed = sorted((x["part"], x["root"]) for x in gone or () if x["part"] in place)
                for at, (k, root) in enumerate(removed):
                    i = place[k]
                    if at and starts[i] == end:
                        end, last = ends[i], root
                        firsts.add(root)
                    else:
                        if at:
                            rows.append((doc_id, int(begin), int(end - begin), sorted(firsts), first, last, before(begin), after(end), None))
                        begin, end, first, last, firsts = starts[i], ends[i], root, root, {root}
                if removed:
                    rows.append((doc_id, int(begin), int(end - begin), sorted(firsts), first, last, before(begin), after(end), None))
            columns = list(zip(*rows)) or [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ARROW)], names=[x.split()[0] for x in _SPAN.split(", ")])

    return run


def _common(own: str, other: str):
    """How many words from the first on are equal in two lists of words around."""
    same = F.zip_with(own, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.coalesce(F.when(stop > 0, stop - 1).otherwise(F.size(same)), F.lit(0)).cast("long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, start_word, n_words, first_doc_ids``: what to remove.

    Words are counted from 0 over the whole text; a span ``[start_word, start_word + n_words)``
    repeats passages whose first copies stand in the documents ``first_doc_ids`` (which may be
    the same document, earlier on). Null and empty texts give no rows, nor do rows with a null
    doc_id, which have no name to report; other columns are ignored. Rows that share a doc_id
    are one document with the pieces of each: equal ones do not repeat one another, and a span
    of either is reported once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts, numbers, parts = numbered(texts)
    members = texts.mapInArrow(_buckets(parts), "id long, same long, keys array<long>")

    def touched(ids: DataFrame) -> DataFrame:
        wanted = materialize(ids.groupBy(parts.doc_of(F.col("id")).alias("doc_id")).agg(F.collect_set(parts.part_of(F.col("id"))).alias("wanted")))
        return restrict(texts, wanted.select("doc_id"), "doc_id").join(wanted, "doc_id")

    def verify(pairs: DataFrame) -> DataFrame:
        equal, other = pairs.where("same_a = same_b").select("a", "b"), pairs.where("same_a <> same_b").select("a", "b")
        sets = materialize(touched(other.select(F.col("a").alias("id")).union(other.select("b"))).mapInArrow(_sets(parts), "id long, items array<long>").dropDuplicates(["id"]))
        x = other.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return equal.unionByName(x.where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("a", "b"))

    removed = materialize(bucket_components(members, verify, PERCENT, lambda ids: listed(touched(ids), _sets(parts), PERCENT)).where("id <> component"))
    part = lambda c: parts.part_of(F.col(c)).alias("part")
    gone = removed.groupBy(parts.doc_of(F.col("id")).alias("doc_id")).agg(F.collect_list(F.struct(part("id"), F.col("component").alias("root"))).alias("gone"))
    roots = removed.select("component").distinct()
    asked = roots.groupBy(parts.doc_of(F.col("component")).alias("doc_id")).agg(F.collect_list(part("component")).alias("asked"))
    wanted = materialize(gone.join(asked, "doc_id", "full"))
    found = materialize(restrict(texts, wanted.select("doc_id"), "doc_id").join(wanted, "doc_id").mapInArrow(_spans(parts), _SPAN))

    spans = found.where("id is null").select("doc_id", "start_word", "n_words", "firsts", "root_left", "root_right", F.col("left").alias("own_left"), F.col("right").alias("own_right"))
    around = found.where("id is not null").select("id", "left", "right").dropDuplicates(["id"])
    spans = spans.join(around.select(F.col("id").alias("root_left"), "left"), "root_left", "left").join(around.select(F.col("id").alias("root_right"), "right"), "root_right", "left")
    left, right = _common("own_left", "left"), _common("own_right", "right")
    spans = spans.select("doc_id", (F.col("start_word") - left).alias("start"), (F.col("start_word") + F.col("n_words") + right).alias("end"), "firsts")
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    fresh = F.coalesce((F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    merged = spans.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order)).groupBy("doc_id", "span")
    merged = merged.agg(F.min("start").alias("start_word"), (F.max("end") - F.min("start")).alias("n_words"), F.array_distinct(F.flatten(F.collect_list("firsts"))).alias("firsts"))
    merged = merged.where(F.col("n_words") >= LEAST_WORDS)
    firsts = F.transform("firsts", parts.doc_of) if numbers is None else None
    if firsts is None:  # documents under other numbers
        flat = merged.withColumn("first", F.explode("firsts")).select("doc_id", "start_word", "n_words", parts.doc_of(F.col("first")).alias("first"))
        flat = named(flat, numbers, "doc_id", "first")
        return flat.groupBy("doc_id", "start_word", "n_words").agg(F.array_sort(F.collect_set("first")).alias("first_doc_ids"))
    return merged.select("doc_id", "start_word", "n_words", F.array_sort(F.array_distinct(firsts)).alias("first_doc_ids"))
