"""Operator 7: language-model scores from a log-frequency Bloom filter.

Unigrams and bigrams of the training texts are counted by a shuffle. A count c is kept as the
level q = 1 + floor(log2 c): the keys (n-gram, 1) .. (n-gram, q) go into one Bloom filter, and a
count is read back by probing level after level until one is missing, which can only
overestimate, and rarely. The filter is broadcast: it never exceeds ``MAX_FILTER_BITS``. Where not
all n-grams fit, it holds the frequent ones; the others are asked from the count table, so that
every n-gram counts at every size. The filter is built in segments of a fixed size from rows that
lie by segment, so no task's memory grows with the corpus.

What is shuffled are sorted keys in blocks, as gaps: about 6 bytes for an n-gram that is counted.
A portion of documents asks each segment of the count table once for the distinct n-grams that
the filter lacks, and keeps for its documents which of them they hold; the answers come back as
levels in the order asked. Bigrams are asked by as many leading bits of their keys as tell them
apart but for one of 65,000 that no text holds (``SPARE_BITS``); words are asked by whole keys.

A word's probability after another is smoothed with a Dirichlet prior of weight ``PRIOR`` that
follows the smoothed unigram distribution.

The exact unigram baseline takes the counts of the ``HEAD`` most frequent words from a broadcast
table; rarer words are asked from the count table too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import expand, pack, squeeze, unpack
from .textops import hash_words, mix, words_of

#: 32 MB, on every worker.
MAX_FILTER_BITS = 1 << 28
BITS_PER_KEY, PROBES = 10, 6
SEGMENT_BITS_LOG2, MOST_LEVELS = 8, 40
#: Levels, of which the last two mark the start of a text, and words that the filter may lack.
LEVELS, STARTS, UNKNOWN = 64, 62, 63
HEAD = 1 << 17
#: Tokens that a task counts, and scores, at a time.
COUNT_TOKENS, SCORE_TOKENS = 1 << 21, 1 << 18
#: Counts are added up in this many parts of each segment.
PART_BITS_LOG2 = 4
#: Bits of an asked bigram's key beyond those that number the bigrams in the count table.
SPARE_BITS = 16
PRIOR = 300.0
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _tokens(text: str | None) -> np.ndarray:
    return np.concatenate([hash_words(words_of(text)), [END]])


def _bigrams(tokens: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], tokens[:-1]])
    return mix(before * _GOLDEN + tokens)


def _portions(batch, most: int):
    """Rows of a batch as token arrays, in portions of about ``most`` tokens: first row, arrays."""
    first, each, size = 0, [], 0
    for i, text in enumerate(batch.column("text")):
        each.append(_tokens(text.as_py()))
        size += len(each[-1])
        if size >= most:
            yield first, each
            first, each, size = i + 1, [], 0
    if each:
        yield first, each


def _count(batches):
    """Counts within a portion, a row for each part of a segment: part, order, the sorted keys and their counts, packed."""
    for each in (e for batch in batches for _, e in _portions(batch, COUNT_TOKENS)):
        for order, keys in ((1, np.concatenate(each)), (2, np.concatenate([_bigrams(x) for x in each]))):
            key, n = np.unique(keys, return_counts=True)
            part = (key >> np.uint64(64 - SEGMENT_BITS_LOG2 - PART_BITS_LOG2)).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[starts[1:], len(key)]
            rows = [(pack(key[a:b]), squeeze(n[a:b].astype(np.uint64))) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.full(len(starts), order, np.int32)), *(pa.array(x, pa.binary()) for x in zip(*rows))], names=["part", "order", "keys", "ns"])


def _add_up(batches):
    """Rows of ``_count`` that come part by part: segment, order, key, n."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    done: list[tuple[np.ndarray, ...]] = []
    at = None

    def total():
        keys, ns = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, ns = keys[order], ns[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        same = lambda x: np.full(len(starts), x, np.int32)
        done.append((same(at[0] >> PART_BITS_LOG2), same(at[1]), keys[starts].view(np.int64), np.add.reduceat(ns, starts).astype(np.int64)))

    def rows():
        columns = [np.concatenate(x) for x in zip(*done)]
        done.clear()
        for first in range(0, len(columns[0]), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[first : first + (1 << 18)]) for x in columns], names=["segment", "order", "key", "n"])

    for batch in batches:
        for part, order, keys, ns in zip(*(batch.column(c).to_pylist() for c in ("part", "order", "keys", "ns"))):
            if at != (part, order):
                if held:
                    total()
                at, held = (part, order), []
            if len(done) >= 256 or (done and len(done[-1][0]) >= 1 << 16):
                yield from rows()
            held.append((unpack(keys), expand(ns)))
    if held:
        total()
    if done:
        yield from rows()


def _segment(key: np.ndarray) -> np.ndarray:
    """A key is a hash: its first bits are its part of the filter."""
    return key >> np.uint64(64 - SEGMENT_BITS_LOG2)


def _places(key: np.ndarray, order, level, segment_bits: int):
    """A key's first bit within its segment and the stride to the next ones."""
    h = mix((key ^ np.uint64(level * int(_GOLDEN) & (1 << 64) - 1)) + np.uint64(order))
    mask = np.uint64(segment_bits - 1)
    return h & mask, (h >> np.uint64(32)) | np.uint64(1), mask


class Filter:
    """``bits`` (segments, bytes) as broadcast; counts come back as levels."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.segment_bits = bits.reshape(-1), bits.shape[1] * 8

    def contains(self, key, order, level):
        base = _segment(key) * np.uint64(self.segment_bits)
        at, stride, mask = _places(key, order, level, self.segment_bits)
        alive = np.arange(len(key))
        for _ in range(PROBES):
            bit = base + at
            hit = (self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
            keep = np.flatnonzero(hit)
            if len(keep) < len(alive):
                alive, base, at, stride = alive[keep], base[keep], at[keep], stride[keep]
            at = (at + stride) & mask
        return alive

    def levels(self, key: np.ndarray, order: int) -> np.ndarray:
        out, alive, level = np.zeros(len(key), np.int64), np.arange(len(key)), 0
        while len(alive) and level < MOST_LEVELS:
            level += 1
            alive = alive[self.contains(key[alive], order, level)]
            out[alive] = level
        return out


#: The mean of the counts that share a level.
LEVEL_VALUE = np.array([0.0] + [(2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, MOST_LEVELS + 1)] + [0.0] * (LEVELS - 1 - MOST_LEVELS))


def _build(segment_bits):
    def run(batches):
        filters = {}
        for batch in batches:
            segment, order = batch.column("segment").to_numpy(), batch.column("order").to_numpy()
            key, q = batch.column("key").to_numpy().view(np.uint64), batch.column("q").to_numpy()
            for s in np.unique(segment).tolist():
                if s not in filters:
                    filters[s] = np.zeros(segment_bits // 8, np.uint8)
                for o in (1, 2):
                    at = np.flatnonzero((segment == s) & (order == o))
                    for level in range(1, int(q[at].max(initial=0)) + 1):
                        place, stride, mask = _places(key[at[q[at] >= level]], o, level, segment_bits)
                        for _ in range(PROBES):
                            np.bitwise_or.at(filters[s], (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
                            place = (place + stride) & mask
        for s, bits in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``docs(text)`` -> ``segment, order, key, n``: all unigrams and bigrams, those of a segment together and sorted.

    The rows are combined within a portion, then dealt by segment; one frequent n-gram gives one
    entry a portion. ``segment``, the first bits of the n-gram's key, is its part of the filter.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "part int, order int, keys binary, ns binary")
    dealt = rows.repartition(F.shiftright("part", PART_BITS_LOG2)).sortWithinPartitions("part", "order")
    return dealt.mapInArrow(_add_up, "segment int, order int, key long, n long")


class LanguageModel:
    """What scoring needs: the filter, the totals, and the counts of the most frequent words.

    The filter holds the n-grams from level ``lowest[order]`` on; ``starts`` is the value of the
    number of training texts. Bigrams of the count table are asked by their keys without the last ``dropped`` bits.
    """

    def __init__(self, bits, tokens, types, quantised, head_keys, head_counts, lowest, starts, dropped):
        self.bits, self.tokens, self.types, self.quantised = bits, tokens, types, quantised
        self.head_keys, self.head_counts, self.lowest, self.starts, self.dropped = head_keys, head_counts, lowest, starts, dropped


def _level(n: Column) -> Column:
    return (1 + F.floor(F.log2(n.cast("double")))).cast("int")


def fit(counts: DataFrame, max_bits: int = MAX_FILTER_BITS, head: int = HEAD) -> LanguageModel:
    """Builds the model from ``count_ngrams``' materialised rows."""
    q = _level(F.col("n"))
    value = (F.pow(F.lit(2.0), q - 1) + F.pow(F.lit(2.0), q) - 1) / 2
    by_level = counts.groupBy("order", q.alias("q")).agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.sum(value).alias("value")).collect()
    unigrams = [r for r in by_level if r["order"] == 1]
    tokens, types, quantised = (sum(r[c] for r in unigrams) or 0 for c in ("n", "types", "value"))

    def keys(lowest: dict[int, int]) -> int:
        return sum(r["types"] * r["q"] for r in by_level if r["q"] >= lowest[r["order"]])

    lowest = {1: 1, 2: 1}
    while keys(lowest) * BITS_PER_KEY > max_bits:
        lowest[2 if lowest[2] < lowest[1] + 6 else 1] += 1
    size = min(max_bits, 1 << max(16, math.ceil(math.log2(max(1, keys(lowest) * BITS_PER_KEY)))))
    segments = 1 << SEGMENT_BITS_LOG2
    stored = counts.withColumn("q", q).where(((F.col("order") == 1) & (F.col("q") >= lowest[1])) | ((F.col("order") == 2) & (F.col("q") >= lowest[2])))
    # a segment's rows lie together: a task builds a few, and what two tasks built of one is put together here
    bits = np.zeros((segments, size // segments // 8), np.uint8)
    for row in stored.mapInArrow(_build(size // segments), "segment int, bits binary").toLocalIterator():
        bits[row["segment"]] |= np.frombuffer(row["bits"], np.uint8)
    top = counts.where("order = 1").orderBy(F.desc("n"), "key").select("key", "n").limit(head).toArrow().sort_by("key")
    end = int(END.view(np.int64))
    n_texts = counts.where((F.col("order") == 1) & (F.col("key") == end)).agg(F.sum("n")).first()[0] or 0
    starts = float(LEVEL_VALUE[n_texts.bit_length()])
    rare = sum(r["types"] for r in by_level if r["order"] == 2 and r["q"] < lowest[2])
    dropped = max(0, 64 - SPARE_BITS - rare.bit_length())
    return LanguageModel(bits, tokens, types, quantised, top.column("key").to_numpy(), top.column("n").to_numpy(), lowest, starts, dropped)


_ASKED = "portion long, segment int, order int, data array<binary>"


def _rows(portion, segment, order, data) -> pa.Table:
    arrays = [pa.array(portion, pa.int64()), pa.array(segment, pa.int32()), pa.array(order, pa.int32()), pa.array(data, pa.list_(pa.binary()))]
    return pa.table(arrays, names=["portion", "segment", "order", "data"])


def _by_segment(keys: np.ndarray, bits: int):
    """Sorted keys of ``bits`` bits: each segment that has some, and where they lie."""
    own = (keys >> np.uint64(bits - SEGMENT_BITS_LOG2)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])[: len(own)]
    return zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)])


def _gaps(doc: np.ndarray, place: np.ndarray, docs: int) -> list[bytes]:
    """Places that are sorted within each document: how many a document has, and the gaps between them."""
    gaps = np.diff(place, prepend=0)
    first = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
    gaps[first] = place[first]
    return [squeeze(np.bincount(doc, minlength=docs).astype(np.uint64)), squeeze(gaps.astype(np.uint64))]


def _placed(counts: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts, sums = expand(counts).astype(np.int64), np.cumsum(expand(gaps).astype(np.int64))
    begins = np.cumsum(counts) - counts
    before = np.r_[0, sums][begins]
    return np.repeat(np.arange(len(counts)), counts), sums - np.repeat(before, counts)


def _level_of(n: np.ndarray) -> np.ndarray:
    """Levels of counts; 0 for none."""
    return np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(np.int64)


def _probability(pairs, uni, before, floor_q: float):
    return (np.minimum(pairs, np.minimum(uni, before)) + PRIOR * (uni + 0.5) / floor_q) / (before + PRIOR)


def _score(shared):
    """A row of order 0 for each portion, with what its documents have so far, and what it asks of each segment."""

    def run(batches):
        bits, tokens, types, quantised, head_keys, head_counts, lowest, starts, dropped = shared.value
        model = Filter(bits)
        floor = tokens + 0.5 * (types + 1)
        floor_q = quantised + 0.5 * (types + 1)
        number = TaskContext.get().partitionId() << 32
        for doc_ids, each in ((batch.column("doc_id").slice(first, len(e)), e) for batch in batches for first, e in _portions(batch, SCORE_TOKENS)):
            sizes = np.array([len(x) for x in each])
            flat, ends = np.concatenate(each), np.cumsum(sizes)
            begins = ends - sizes
            doc = np.repeat(np.arange(len(each)), sizes)
            # words repeat: each is looked up once a portion
            words, at = np.unique(flat, return_inverse=True)
            place = np.minimum(np.searchsorted(head_keys, words.view(np.int64)), max(0, len(head_keys) - 1))
            known = head_keys[place] == words.view(np.int64) if len(head_keys) else np.zeros(len(words), bool)
            c = np.where(known, head_counts[place], 0) if len(head_keys) else np.zeros(len(words))
            found, exact = known[at], np.where(known, np.log10((c + 0.5) / floor), 0.0)[at]
            q = model.levels(words, 1)
            # a level below the lowest stored one is none: the count table has the n-gram, if it exists
            q = np.where((q < lowest[1]) & (lowest[1] > 1), np.where(known, _level_of(c), UNKNOWN), q)[at]
            q_before = np.concatenate([[0], q[:-1]])
            uni, before = LEVEL_VALUE[q], LEVEL_VALUE[q_before]
            before[begins], q_before[begins] = starts, STARTS
            pair = np.concatenate([_bigrams(x) for x in each])
            q_pair = model.levels(pair, 2)
            open_ = ((q_pair < lowest[2]) & (lowest[2] > 1)) | (q == UNKNOWN) | (q_before == UNKNOWN)
            score = np.add.reduceat(np.where(open_, 0.0, np.log10(_probability(LEVEL_VALUE[q_pair], uni, before, floor_q))), begins)
            # words that the head lacks, and bigrams that the filter lacks, as places among those that the portion asks for
            tail, rank = words[~known], np.cumsum(~known) - 1
            rank_before = np.concatenate([[0], rank[at][:-1]])
            of_tail = np.flatnonzero(~found)
            of_tail = of_tail[np.lexsort((rank[at][of_tail], doc[of_tail]))]
            where = np.flatnonzero(open_)
            wanted, place = np.unique(pair[where] >> np.uint64(dropped), return_inverse=True)
            order = np.lexsort((place, doc[where]))
            where, place = where[order], place[order]
            lacking, lacking_before = where[q[where] == UNKNOWN], where[q_before[where] == UNKNOWN]
            whole = lambda x: x.astype("<i8").tobytes()
            real = lambda x: x.astype("<f8").tobytes()
            small = lambda x: squeeze(x.astype(np.uint64))
            record = [
                whole(doc_ids.fill_null(0).to_numpy()), small(doc_ids.is_null().to_numpy(zero_copy_only=False)), small(sizes), small(np.add.reduceat(found.astype(np.int64), begins)),
                real(np.add.reduceat(exact, begins)), real(score), *_gaps(doc[of_tail], rank[at][of_tail], len(each)), *_gaps(doc[where], place, len(each)),
                small(q[where]), small(q_before[where]), small(rank[at][lacking]), small(rank_before[lacking_before]),
            ]
            rows = [(number % (1 << SEGMENT_BITS_LOG2), 0, record)]
            rows += [(s, 1, [pack(tail[a:b])]) for s, a, b in _by_segment(tail, 64)]
            rows += [(s, 2, [pack(wanted[a:b])]) for s, a, b in _by_segment(wanted, 64 - dropped)]
            yield from _rows([number] * len(rows), *zip(*rows)).to_batches()
            number += 1

    return run


def _held(lowest: dict[int, int], dropped: int):
    """Rows of the count table as blocks of sorted keys with their counts, or levels of the bigrams."""

    def run(batches):
        for batch in batches:
            segment, order = batch.column("segment").to_numpy(), batch.column("order").to_numpy()
            key, n = batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            rows = []
            for s, o in sorted(set(zip(segment.tolist(), order.tolist()))):
                own = np.flatnonzero((segment == s) & (order == o))
                own = own[np.argsort(key[own], kind="stable")]
                keys, values = (key[own], n[own]) if o == 1 else (key[own] >> np.uint64(dropped), _level_of(n[own]))
                rows.append((s, o, [pack(keys), squeeze(values.astype(np.uint64))]))
            if rows:
                yield from _rows([0] * len(rows), *zip(*rows)).to_batches()

    return run


def _answer(asked: pa.Table, held: pa.Table) -> pa.Table:
    """What a segment holds of the keys asked for, in the order asked; portions' own rows pass."""
    if not asked.num_rows or asked.column("order")[0].as_py() == 0:
        return asked
    blocks = held.column("data").to_pylist()
    keys, values = (np.concatenate(x) for x in zip(*((unpack(k), expand(v)) for k, v in blocks))) if blocks else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    # keys that are alike without their last bits have the largest level: the last of its run
    order = np.lexsort((values, keys))
    keys, values = np.r_[np.uint64(0), keys[order]], np.r_[np.uint64(0), values[order]]

    def found(packed: bytes) -> bytes:
        wanted = unpack(packed)
        at = np.searchsorted(keys[1:], wanted, side="right")
        return squeeze(np.where((at > 0) & (keys[at] == wanted), values[at], np.uint64(0)))

    return _rows(asked.column("portion"), asked.column("segment"), asked.column("order"), [[found(x[0])] for x in asked.column("data").to_pylist()])


def _finish(shared):
    """A portion's documents with the answers to what it asked."""

    def run(table: pa.Table) -> pa.Table:
        _, tokens, types, quantised, _, _, _, starts, _ = shared.value
        floor = tokens + 0.5 * (types + 1)
        floor_q = quantised + 0.5 * (types + 1)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("order", "segment", "data"))), key=lambda r: r[:2])
        answers = {o: np.concatenate([np.zeros(0, np.uint64), *(expand(data[0]) for order, _, data in rows if order == o)]).astype(np.int64) for o in (1, 2)}
        ids, nulls, sizes, known, base, score, tail, tail_gaps, open_, open_gaps, q, q_before, lacking, lacking_before = rows[0][2]
        ids, base, score = np.frombuffer(ids, "<i8"), np.frombuffer(base, "<f8"), np.frombuffer(score, "<f8")
        known = expand(known).astype(np.int64)
        doc, place = _placed(tail, tail_gaps)
        n = answers[1][place]
        total = lambda doc, x: np.bincount(doc, x, len(ids))
        base = base + total(doc, np.log10((n + 0.5) / floor))
        known = known + total(doc, n > 0).astype(np.int64)
        doc, place = _placed(open_, open_gaps)
        q, q_before = expand(q).astype(np.int64), expand(q_before).astype(np.int64)
        at_start = q_before == STARTS
        for levels, ranks in ((q, lacking), (q_before, lacking_before)):
            levels[levels == UNKNOWN] = _level_of(answers[1][expand(ranks).astype(np.int64)])
        before = np.where(at_start, starts, LEVEL_VALUE[q_before])
        score = score + total(doc, np.log10(_probability(LEVEL_VALUE[answers[2][place]], LEVEL_VALUE[q], before, floor_q)))
        out = [pa.array(ids, mask=expand(nulls).astype(bool)), pa.array(expand(sizes).astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)]
        return pa.table(out, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: LanguageModel, counts: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    One row per input row; a null or blank text is its end token alone. ``base_score`` uses exact
    counts, ``score`` those rounded to levels. With an empty training set all counts are 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bits, model.tokens, model.types, model.quantised, model.head_keys, model.head_counts, model.lowest, model.starts, model.dropped))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = texts.mapInArrow(_score(shared), _ASKED)
    rare = counts.where((F.col("order") == 1) | (F.col("n") < 2 ** (model.lowest[2] - 1)))
    held = rare.mapInArrow(_held(model.lowest, model.dropped), _ASKED)
    answered = asked.groupBy("segment", "order").cogroup(held.groupBy("segment", "order")).applyInArrow(_answer, _ASKED)
    out = answered.groupBy("portion").applyInArrow(_finish(shared), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
