"""Operator 12: how far the sources of a language lie apart in their words.

Every group (language, source) gives each of the language's kept terms an integer share ``p``;
the divergence of two groups is the sum of ``|p - q|`` over all kept terms. Most terms stand in
few groups, a few in nearly all, so the sum is split:

* a term that a group lacks has there the share ``p0`` of a zero count, one number for a group.
  ``V * |p0 - q0|`` is the sum as if all counts were zero; the rest are corrections;
* heavy terms, present in many groups, meet in dense numpy tiles: a matrix of groups by terms,
  filled with ``p0`` and the postings, all pairs of rows at a time;
* light terms are corrected from their postings alone. A posting changes the sum against every
  group without the term, which the sorted shares of a group answer with prefix sums and one
  search for all others; a pair of postings of one term then gets what is missing.

All terms are integers, so the partial sums add up exactly in any order. A term is heavy if the
square of its groups, times ``pair_cost`` (what a posting pair costs in cells of a tile), exceeds
the square of the language's groups.

Postings are dealt out by tiles of about ``tile`` postings and by pairs of blocks of ``block``
groups, so neither a frequent term nor a language with most of the rows is one task. Words are
counted inside the reading tasks, first the documents of each term, then the kept terms by group;
only counts are shuffled. Numbering a language's groups and ranking them is one window over its
groups, of which the result holds all pairs.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import few, materialize

#: Documents of a language that a kept term stands in, and what is added to its count.
LEAST_DOCS, PRIOR = 30, 5
SCALE = 1_000_000_000
TOP_TERMS = 50


@dataclass(frozen=True)
class Sizes:
    """How the work is cut; none of these changes the result."""

    #: Cells of a dense tile that one posting pair costs.
    pair_cost: int = 16
    #: Postings of a tile, and groups of a block.
    tile: int = 200_000
    block: int = 256
    #: Kept terms that are handed to every task.
    known_terms: int = 250_000
    #: Entries that a task counts before it hands its counts on.
    entries: int = 200_000
    #: Terms of a dense tile, and posting pairs, at a time.
    dense: int = 512
    pairs: int = 1_000_000


#: Bytes of a term in lower case, all others as spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _words(terms) -> pa.Array:
    return pa.array([t.decode("utf-8", "surrogatepass") for t in terms], pa.string())


def _count_docs(entries: int):
    """Documents of each term of a language, handed on whenever ``entries`` are held."""

    def run(batches):
        held: dict[str, Counter] = {}
        size = 0

        def rows():
            for lang, docs in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(docs), pa.string()), _words(docs), pa.array(docs.values(), pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                docs = held.setdefault(lang, Counter())
                before = len(docs)
                docs.update(set(terms_of(text.as_py())))
                size += len(docs) - before
                if size >= entries:
                    yield from rows()
                    size = 0
        yield from rows()

    return run


def _count(kept, entries: int):
    """Occurrences of each term of a group, of those in ``kept`` (None: of all), and a row without term that names the group."""

    def run(batches):
        held: dict[tuple[str, str], Counter] = {}
        size = 0

        def rows():
            for (lang, source), n in held.items():
                terms = pa.concat_arrays([pa.nulls(1, pa.string()), _words(n)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), terms, pa.array([0, *n.values()], pa.int64())], names=["lang", "source", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                n = held.setdefault((lang, source), Counter())
                before = len(n)
                words = terms_of(text.as_py())
                n.update(words if kept is None else filter(kept.value.get(lang, frozenset()).__contains__, words))
                size += len(n) - before
                if size >= entries:
                    yield from rows()
                    size = 0
        yield from rows()

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms))`` in longs, three digits at a time; exact while the divisor is below 9e15."""
    whole = lambda a, b: F.call_function("div", a, b)
    divisor, rest = total + PRIOR * terms, count + PRIOR
    out = whole(rest, divisor) * SCALE
    for scale in (1_000_000, 1_000, 1):
        rest = rest % divisor * 1000
        out = out + whole(rest, divisor) * scale
    return out + 1


def kept_terms(texts: DataFrame, least_docs: int = LEAST_DOCS, sizes: Sizes = Sizes()) -> DataFrame:
    """``texts(lang, source, text)`` -> stored ``(lang, term)`` that stand in ``least_docs`` documents of the language or more."""
    docs = texts.select("lang", "text").mapInArrow(_count_docs(sizes.entries), "lang string, term string, docs long")
    return materialize(docs.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"))


def term_counts(texts: DataFrame, kept: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``texts(lang, source, text)`` -> stored ``(lang, source, term, n)`` of kept terms; a row with a null term for each group.

    Up to ``known_terms`` kept terms go to the counting tasks, so that others are never shuffled;
    with more, all terms are counted and joined with the kept ones.
    """
    schema, known = "lang string, source string, term string, n long", None
    if kept.limit(sizes.known_terms + 1).count() <= sizes.known_terms:
        by_lang: dict[str, set[bytes]] = {}
        for row in kept.collect():
            by_lang.setdefault(row["lang"], set()).add(row["term"].encode("utf-8", "surrogatepass"))
        known = texts.sparkSession.sparkContext.broadcast(by_lang)
    counts = texts.mapInArrow(_count(known, sizes.entries), schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    if known is None:
        counts = materialize(counts)
        counts = counts.where("term is null").unionByName(counts.join(kept, ["lang", "term"], "left_semi"))
    return materialize(counts)


# --- tiles -------------------------------------------------------------------------------------


def _distances(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Sum of ``|v - x|`` over ``values`` for each x in ``to``."""
    v = np.sort(values)
    sums = np.concatenate([[0], np.cumsum(v)])
    k = np.searchsorted(v, to)
    return to * k - sums[k] + (sums[-1] - sums[k]) - to * (len(v) - k)


def _dense(codes, of, p, base, a, b, sizes: Sizes) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int64)
    floor = np.abs(base[a][:, None] - base[b][None, :])
    order = np.argsort(codes, kind="stable")
    codes, of, p = codes[order], of[order], p[order]
    n_terms = int(codes[-1]) + 1 if len(codes) else 0
    for at in range(0, n_terms, sizes.dense):
        width = min(sizes.dense, n_terms - at)
        i, j = np.searchsorted(codes, [at, at + width])
        m = np.repeat(base[:, None], width, axis=1)
        m[of[i:j], codes[i:j] - at] = p[i:j]
        right = m[b]
        for row, g in enumerate(a):
            out[row] += np.abs(right - m[g]).sum(axis=1)
        out -= width * floor
    return out


def _sparse(codes, of, p, base, a, b, sizes: Sizes) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int64)
    floor = np.abs(base[a][:, None] - base[b][None, :])
    at = np.full(len(base), -1)
    sides = []
    for own, other, axis in ((a, b, 0), (b, a, 1)):
        at[:] = -1
        at[own] = np.arange(len(own))
        place = at[of]
        mine = place >= 0
        order = np.lexsort((place[mine], codes[mine]))
        sides.append((codes[mine][order], place[mine][order], p[mine][order]))
        by_group = np.argsort(place[mine], kind="stable")
        groups, starts = np.unique(place[mine][by_group], return_index=True)
        for g, values in zip(groups, np.split(p[mine][by_group], starts[1:])):
            change = _distances(values, base[other]) - len(values) * (floor[g] if axis == 0 else floor[:, g])
            if axis == 0:
                out[g] += change
            else:
                out[:, g] += change
    (ca, ga, pa_), (cb, gb, pb) = sides
    first, last = np.searchsorted(cb, ca), np.searchsorted(cb, ca, side="right")
    counts = last - first
    cuts = np.searchsorted(np.cumsum(counts), np.arange(sizes.pairs, int(counts.sum()) + sizes.pairs, sizes.pairs))
    begin = 0
    for end in (*(int(c) + 1 for c in cuts[:-1]), len(ca)):
        c = counts[begin:end]
        x = np.repeat(np.arange(begin, end), c)
        y = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[begin:end], c)
        i, j = ga[x], gb[y]
        extra = np.abs(pa_[x] - pb[y]) - np.abs(pa_[x] - base[b][j]) - np.abs(base[a][i] - pb[y]) + floor[i, j]
        np.add.at(out, (i, j), extra)
        begin = end
    return out


def _tile(sizes: Sizes):
    def run(table: pa.Table) -> pa.Table:
        """Corrections of all pairs of groups of two blocks by the terms of one tile. Rows without a term hold ``p0`` of each group."""
        lang, heavy, low, high = (table.column(c)[0].as_py() for c in ("lang", "heavy", "low", "high"))
        term, group, p = table.column("term").combine_chunks(), table.column("group").to_numpy().astype(np.int64), table.column("p").to_numpy()
        bare = np.asarray(term.is_null())
        order = np.argsort(group[bare])
        groups, base = group[bare][order], p[bare][order]
        codes = term.dictionary_encode().indices.filter(pa.array(~bare)).to_numpy().astype(np.int64)
        if len(codes):
            codes = np.unique(codes, return_inverse=True)[1]
        of = np.searchsorted(groups, group[~bare])
        a, b = (np.flatnonzero(groups // sizes.block == side) for side in (low, high))
        change = (_dense if heavy else _sparse)(codes, of, p[~bare], base, a, b, sizes)
        i, j = np.nonzero((groups[a][:, None] < groups[b][None, :]) & (change != 0))
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "i": groups[a][i].astype(np.int32), "j": groups[b][j].astype(np.int32), "change": change[i, j]})

    return run


def _corrections(postings: DataFrame, groups: DataFrame, by_lang: DataFrame, sizes: Sizes) -> DataFrame:
    """``(lang, i, j, change)`` with i < j: what the kept terms add to the sum of zero counts."""
    heavy = F.col("spread") * F.col("spread") * sizes.pair_cost > F.col("groups") * F.col("groups")
    marked = postings.join(by_lang, "lang").withColumn("heavy", heavy)
    tiles = few(marked.groupBy("lang", "heavy").agg(F.count("*").alias("m"), F.first("groups").alias("groups")).select("lang", "heavy", F.ceil(F.col("m") / sizes.tile).cast("long").alias("tiles"), F.ceil(F.col("groups") / sizes.block).cast("int").alias("blocks")))
    columns = ["lang", "heavy", "tile", "term", "group", "p", "blocks"]
    dealt = marked.select("lang", "heavy", "term", "group", "p").join(tiles, ["lang", "heavy"]).withColumn("tile", F.pmod(F.xxhash64("term"), "tiles")).select(columns)
    bare = groups.select("lang", "group", F.col("p0").alias("p")).join(tiles, "lang").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = dealt.unionByName(bare.withColumn("term", F.lit(None).cast("string")).select(columns))
    own = F.floor(F.col("group") / sizes.block).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", "heavy", "tile", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "term", "group", "p")
    changes = rows.groupBy("lang", "heavy", "tile", "low", "high").applyInArrow(_tile(sizes), "lang string, i int, j int, change long")
    return changes.groupBy("lang", "i", "j").agg(F.sum("change").alias("change"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, sizes: Sizes = Sizes()) -> DataFrame:
    """``docs(text, lang, source)`` -> ``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language and the divergence from it. Part ``term``:
    the ``top_terms`` terms that a group uses more than its language does, and by how much.
    Ranks count from 1 for each group and part, by value descending, then item in the order of
    its UTF-8 bytes. Null texts, languages and sources are empty strings; a group whose
    documents hold no kept term takes part with zero counts; repeated rows are documents of
    their own; further columns are ignored; no rows give no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(text("lang"), text("source"), text("text"))
    counts = term_counts(texts, kept_terms(texts, least_docs, sizes), sizes)
    named = counts.where("term is not null")
    kept = materialize(named.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.count("*").alias("spread")))
    used = materialize(named.join(kept, ["lang", "term"]))
    of_group = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = few(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total")))
    groups = counts.where("term is null").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = F.lit(0).cast("long")
    filled = [F.coalesce(c, zero).alias(c) for c in ("total", "terms", "all_total")]
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = few(groups.select("lang", "source", *filled).withColumn("group", number).withColumn("p0", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero)))
    by_lang = few(groups.groupBy("lang").agg(F.count("*").alias("groups")))

    shared = used.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("all_n"), F.col("all_total"), F.col("terms")))
    postings = materialize(shared.select("lang", "source", "term", "group", "spread", "p", "q"))
    changes = _corrections(postings.select("lang", "term", "group", "spread", "p"), groups, by_lang, sizes)

    a = groups.select("lang", "source", F.col("group").alias("g"), F.col("p0").alias("p"), "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("group").alias("h"), F.col("p0").alias("q"))
    pairs = a.join(b, "lang").where("g <> h").withColumn("i", F.least("g", "h")).withColumn("j", F.greatest("g", "h")).join(changes, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("terms") * F.abs(F.col("p") - F.col("q")) + F.coalesce("change", zero)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
