"""Operator 9: fuzzy line dedup by MinHash.

A line's set is its distinct runs of ``SHINGLE_CHARS`` characters (leading and trailing white
space apart). Signatures take one hash for each run: the runs are dealt into ``BANDS * ROWS``
bins by it, and each bin keeps its minimum (one-permutation MinHash; an empty bin borrows from
a bin drawn by a hash). Bands bring lines of similarity 0.8 together with probability 0.958,
of 0.9 with 0.998; candidates are verified on their whole sets by exact Jaccard similarity, and
of every connected component the first line, by (doc_id, number), is kept. Lines with equal text
have equal buckets and need no verification; a line shorter than a run matches only those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import Parts, named, numbered
from .jaccard_join import listed
from .linking import bucket_components
from .minhash import one_permutation
from .storage import materialize, restrict
from .textops import mix, places, portions

SHINGLE_CHARS, BANDS, ROWS, PERCENT = 8, 6, 4, 80
_G = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Bytes of text handled at a time: the arrays then stay in the processor's cache.
PORTION = 400_000
#: What is stripped from a line, and what splits lines.
SPACES, NEWLINE = " \t\x0b\x0c\r", 10


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Number and stripped text of the lines that are not blank."""
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if (s := x.strip(SPACES))]


def shingles(line: str) -> set[str]:
    k = SHINGLE_CHARS
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def similar(a: str, b: str, percent: int = PERCENT) -> bool:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _located(texts: list[str]):
    """Characters of all texts, and of each line that is not blank: first, end, text, number in the text."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(chars == NEWLINE)
    starts, ends = np.concatenate([[0], breaks + 1]), np.append(breaks, len(chars))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(sizes) - sizes
    text = np.searchsorted(begins, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, begins[text])
    solid = np.flatnonzero(~np.isin(chars, [NEWLINE, *map(ord, SPACES)]))
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    keep = lo < hi
    lo, hi = solid[lo[keep]], solid[hi[keep] - 1] + 1
    return chars, lo, hi, text[keep], number[keep]


def _runs(chars: np.ndarray) -> np.ndarray:
    """A hash of the SHINGLE_CHARS characters from each place on."""
    h = np.concatenate([chars, np.zeros(SHINGLE_CHARS, np.uint32)]).astype(np.uint64)
    for i, width in enumerate((1, 2, 4)):
        h = h[:-width] * _G[i] + h[width:]
    return mix(h[: len(chars)])


def _exact(chars: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line: a sum of its characters, each hashed with its place."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    terms = mix(chars[place + np.repeat(lo, sizes)].astype(np.uint64) * _G[1] + (place + 1).astype(np.uint64) * _G[0])
    return mix(np.add.reduceat(terms, ends - sizes) + sizes.astype(np.uint64))


def _buckets(parts: Parts):
    def run(batches):
        for ids, texts in portions(batches, PORTION):
            chars, lo, hi, text, number = _located(texts)
            if not len(lo):
                continue
            exact = _exact(chars, lo, hi)
            whole = hi - lo >= SHINGLE_CHARS
            sizes = np.where(whole, BANDS, 1)
            keys = np.repeat(mix(exact), sizes)
            if whole.any():
                runs = (hi - lo - SHINGLE_CHARS + 1)[whole]
                keys[np.repeat(whole, sizes)] = one_permutation(_runs(chars)[places(lo[whole], runs)], runs, BANDS, ROWS).ravel()
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(parts.pack(ids[text], number)), pa.array(exact.view(np.int64)), values], names=["id", "same", "keys"])

    return run


def _picked(batch, parts: Parts):
    """Ids and stripped text of the lines that are wanted."""
    ids, lines = [], []
    for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
        own = text.as_py().split("\n")
        for i in wanted:
            if i < len(own):
                ids.append(int(parts.pack(np.int64(doc_id), i)))
                lines.append(own[i].strip(SPACES))
    return ids, lines


def _wanted(parts: Parts):
    def run(batches):
        for batch in batches:
            ids, lines = _picked(batch, parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], names=["id", "line"])

    return run


def _sets(parts: Parts):
    """Hashes of the runs of the lines that are wanted."""

    def run(batches):
        for batch in batches:
            ids, lines = _picked(batch, parts)
            for at in range(0, len(ids), 500):
                part = lines[at : at + 500]
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                runs, starts = np.maximum(sizes - SHINGLE_CHARS + 1, 1), np.cumsum(sizes) - sizes
                items = _runs(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32))[places(starts, runs)]
                ends = np.cumsum(runs)
                sets = [np.unique(items[a:b]) for a, b in zip((ends - runs).tolist(), ends.tolist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 500], pa.int64()), values], names=["id", "items"])

    return run


def _verify_pairs(batches):
    for batch in batches:
        keep = [similar(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def line_components(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, line_no, class_doc_id, class_line_no, kept`` of lines with a near copy.

    Line numbers count from 0 over the text split at newlines. Lines that are blank or unlike
    all others give no row. Null texts have no lines; rows with a null doc_id have no name and
    take no part; other columns are ignored. Where several rows share a doc_id, their lines of
    one number are one, with the text of either.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts, numbers, parts = numbered(texts)
    members = texts.mapInArrow(_buckets(parts), "id long, same long, keys array<long>")

    def touched(ids: DataFrame) -> DataFrame:
        wanted = materialize(ids.groupBy(parts.doc_of(F.col("id")).alias("doc_id")).agg(F.collect_set(parts.part_of(F.col("id"))).alias("wanted")))
        return restrict(texts, wanted.select("doc_id"), "doc_id").join(wanted, "doc_id")

    def verify(pairs: DataFrame) -> DataFrame:
        equal, other = pairs.where("same_a = same_b").select("a", "b"), pairs.where("same_a <> same_b").select("a", "b")
        lines = touched(other.select(F.col("a").alias("id")).union(other.select("b"))).mapInArrow(_wanted(parts), "id long, line string")
        lines = materialize(lines.groupBy("id").agg(F.max("line").alias("line")))
        x = other.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        return equal.unionByName(x.mapInArrow(_verify_pairs, "a long, b long"))

    labels = bucket_components(members, verify, PERCENT, lambda ids: listed(touched(ids), _sets(parts), PERCENT))
    out = labels.select(
        parts.doc_of(F.col("id")).alias("doc_id"), parts.part_of(F.col("id")).alias("line_no"), parts.doc_of(F.col("component")).alias("class_doc_id"),
        parts.part_of(F.col("component")).alias("class_line_no"), (F.col("id") == F.col("component")).alias("kept"),
    )
    return named(out, numbers, "doc_id", "class_doc_id")


def remove_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` without the lines that are not kept; ``n_chars``, if there, follows the text.

    Documents that lose all their words are left out; those that had none, or lost none, stay
    as they are. Column names of ``docs`` other than these are free.
    """
    gone = classes.where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    joined = docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left")
    rest = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    out = joined.withColumn("text", text).where("_gone is null or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
