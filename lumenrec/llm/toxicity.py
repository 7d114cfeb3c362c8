"""Operator 6: toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and of itself, each hashed to a row of one embedding
table; the vectors of a passage's words are averaged and a linear softmax gives the passage's
probabilities. Table and softmax are trained jointly in numpy, by gradient descent on documents:
a document is as toxic as its most toxic passage, so a few insults in a long text are not
averaged away, and the gradient goes to that passage (for clean documents, to their worst one).

The fit uses a bounded number of labelled rows (``max_rows``, those with the smallest hash of
doc_id), so the driver holds no more than that; scoring covers all rows, whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import places

#: Words averaged together.
PASSAGE_WORDS = 5
#: Words that stand for a text, drawn anew each time, while it is the average of all its words.
BAG_WORDS = 256
#: Words handled at a time, and documents for which the margins of words that choose passages stay as they are.
VOCABULARY_PORTION, REFRESH = 20_000, 250
#: Rows from which distinct ones are found by a count over the table, not by sorting.
DENSE_FROM = 4_096
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BOUNDARY = np.uint32(1)


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that are fitted; the rest shape the model.

    ``shares`` are tried for the share of a toxic document's passages that count as toxic before
    training: on ``tune_rows`` of the fitted rows, two thirds to fit and the rest to compare.
    """

    max_rows: int = 4_000
    shares: tuple[float, ...] = (0.4, 0.2, 0.1)
    tune_rows: int = 900
    buckets_log2: int = 17
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    epochs: int = 6
    rate: float = 0.4
    seed: int = 7


@cache
def _in_word() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of all words, word after word, and the number of them of each word.

    Words are runs of letters and digits in lower case. An n-gram may take in the boundary on
    either side of its word; the whole word with both is one more feature. Every word has one.
    """
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _in_word()[chars]
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # one boundary before each word and one at the end
    keep = inside.copy()
    keep[:-1] |= inside[1:]
    seq = np.where(inside, chars, _BOUNDARY)[keep]
    if inside[0]:
        seq = np.concatenate([[_BOUNDARY], seq])
    seq = np.concatenate([seq, [_BOUNDARY]]).astype(np.uint64)
    edge = seq == _BOUNDARY
    word = np.cumsum(edge) - 1
    starts = np.flatnonzero(edge)[:-1]
    place = np.arange(len(seq)) - starts[np.minimum(word, len(starts) - 1)]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, _PRIME))
        whole = np.add.reduceat((seq * powers[place])[:-1], starts)
        found, owner = [whole], [np.arange(len(starts))]
        h, open_ = seq.copy(), np.ones(len(seq), bool)
        for n in range(2, s.longest + 1):
            m = len(seq) - n + 1
            if m <= 0:
                break
            if n > 2:
                open_ = open_[:m] & ~edge[n - 2 : n - 2 + m]
            h = h[:m] * _PRIME + seq[n - 1 :]
            if n >= s.shortest:
                at = np.flatnonzero(open_[:m])
                found.append(h[at] * np.uint64(2 * n + 1))
                owner.append(word[at])
        flat, owner = np.concatenate(found), np.concatenate(owner)
        rows = ((flat ^ (flat >> np.uint64(29))) * _PRIME >> np.uint64(64 - s.buckets_log2)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(starts))


def _passage_means(values: np.ndarray) -> np.ndarray:
    """Means of all runs of PASSAGE_WORDS words (of all words, if fewer)."""
    width = min(PASSAGE_WORDS, len(values))
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return (total[width:] - total[:-width]) / width


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


class Model:
    """``table`` (rows, dim) and the softmax's ``weights`` (dim, 2) and ``bias`` (2)."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: np.ndarray, settings: Settings):
        self.table, self.weights, self.bias, self.settings = table, weights, bias, settings
        #: what each row adds to the difference of the two logits
        self.margins = table.astype(np.float64) @ (weights[:, 1] - weights[:, 0])

    def passage_margin(self, rows: np.ndarray, sizes: np.ndarray) -> float:
        """Difference of the logits of the most toxic passage of a text given by its words' table rows."""
        base = self.bias[1] - self.bias[0]
        if not len(sizes):
            return base
        words = np.add.reduceat(self.margins[rows], np.cumsum(sizes) - sizes) / sizes
        return _passage_means(words).max() + base

    def score(self, text: str | None) -> float:
        """Probability of label 1 of the most toxic passage; of the bias alone without words."""
        return _sigmoid(self.passage_margin(*subwords(text, self.settings)))


class _Vocabulary:
    """Words by number, with the table rows of each kept once."""

    def __init__(self, settings: Settings):
        self.settings, self.numbers = settings, {}

    def numbers_of(self, text: str | None) -> np.ndarray:
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return np.fromiter((self.numbers.setdefault(w, len(self.numbers)) for w in words), np.int32, len(words))

    def close(self) -> None:
        words, rows, sizes = list(self.numbers), [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), VOCABULARY_PORTION):
            part, size = subwords(" ".join(words[at : at + VOCABULARY_PORTION]), self.settings)
            rows.append(part.astype(np.int32))
            sizes.append(size)
        self.rows, self.sizes = np.concatenate(rows), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def means(self, by_row: np.ndarray) -> np.ndarray:
        """Mean of a number of the table's rows for each word."""
        out = [np.empty(0)]
        for at in range(0, len(self.sizes), VOCABULARY_PORTION):
            size = self.sizes[at : at + VOCABULARY_PORTION]
            first = self.starts[at]
            out.append(np.add.reduceat(by_row[self.rows[first : first + size.sum()]], np.cumsum(size) - size) / size)
        return np.concatenate(out)

    def rows_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[words]
        return self.rows[places(self.starts[words], sizes)], sizes


def fit(rows: list[tuple[str | None, int]], settings: Settings = Settings()) -> Model:
    """Joint training of table and softmax by Adagrad, one document a step.

    In the first two passes over the rows a document is the average of its words (of
    ``BAG_WORDS`` drawn ones, if it is longer); then
    its most toxic passages stand for it.
    """
    vocabulary, data = _Vocabulary(settings), []
    for text, label in rows:
        if label is not None:
            words = vocabulary.numbers_of(text)
            if len(words):
                data.append((words, int(label)))
    vocabulary.close()
    if len({label for _, label in data}) < 2:
        return _trained(data, vocabulary, settings, settings.shares[0])
    few = [data[i] for i in np.random.default_rng(settings.seed).permutation(len(data))[: settings.tune_rows]]
    kept, compared = few[: 2 * len(few) // 3], few[2 * len(few) // 3 :]
    losses = {}
    for share in settings.shares:
        model = _trained(kept, vocabulary, settings, share)
        p = np.clip([_sigmoid(model.passage_margin(*vocabulary.rows_of(words))) for words, _ in compared], 1e-4, 1 - 1e-4)
        y = np.array([label for _, label in compared])
        losses[share] = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    return _trained(data, vocabulary, settings, min(losses, key=losses.get))


def _trained(data: list[tuple[np.ndarray, int]], vocabulary: _Vocabulary, settings: Settings, share: float) -> Model:
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-0.5, 0.5, (1 << settings.buckets_log2, settings.dim)) / settings.dim
    weights, bias = rng.uniform(-1, 1, (settings.dim, 2)), np.zeros(2)
    seen_t, seen_w = np.full(len(table), 1e-4), 1e-1
    # the prior of a passage, not of a document: most passages of toxic documents are clean
    prior = np.clip(share * np.mean([label for _, label in data]) if data else 0.5, 0.01, 0.98)
    bias[:] = np.log([1 - prior, prior])
    for epoch in range(settings.epochs if data else 0):
        rate = settings.rate * (1 - epoch / settings.epochs)
        for at, i in enumerate(rng.permutation(len(data))):
            if epoch >= 2 and at % REFRESH == 0:
                margins = vocabulary.means(table @ (weights[:, 1] - weights[:, 0]))
            words, label = data[i]
            if epoch < 2:
                spans = [words if len(words) <= BAG_WORDS else words[rng.integers(0, len(words), BAG_WORDS)]]
            else:
                means = _passage_means(margins[words])
                spans = [words[j : j + PASSAGE_WORDS] for j in np.argsort(-means)[: 3 if label else 2].tolist()]
            for span in spans:
                part, size = vocabulary.rows_of(span)
                share_of = 1.0 / (np.repeat(size, size) * float(len(span)))
                mean = share_of @ table[part]
                p = _sigmoid(mean @ (weights[:, 1] - weights[:, 0]) + bias[1] - bias[0])
                if abs(p - label) < 0.01:
                    continue
                error = np.array([label - p, p - label])  # the loss's gradient in the two logits
                pull = weights @ error
                grad_w = np.outer(mean, error)
                if len(part) > DENSE_FROM:
                    force = np.bincount(part, share_of)
                    own = np.flatnonzero(force)
                    force = force[own]
                else:
                    own, back = np.unique(part, return_inverse=True)
                    force = np.bincount(back, share_of)
                step = force[:, None] * pull
                seen_t[own] += (step**2).mean(axis=1)
                table[own] -= rate * step / np.sqrt(seen_t[own])[:, None]
                seen_w += float((grad_w**2).mean())
                weights -= 0.1 * rate * grad_w / np.sqrt(seen_w)
                bias -= 0.01 * rate * error
    return Model(table.astype(np.float32), weights, bias, settings)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> list[tuple[str | None, int]]:
    """At most ``settings.max_rows`` labelled texts, those with the smallest hash of doc_id.

    The ids are chosen first, from the labels alone; only the chosen texts are read further.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id", F.lit(settings.seed)), F.col("doc_id")]
    # up to a third of the bound for label 1, which is rare
    chosen = marks.where("y = 1").orderBy(*order).limit(settings.max_rows // 3).unionByName(marks.where("y = 0").orderBy(*order).limit(settings.max_rows - settings.max_rows // 3))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return [(r["text"], r["y"]) for r in rows.select("doc_id", "text", "y").orderBy("doc_id", "text").toLocalIterator()]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1). A column ``score`` of the input is replaced.

    Null, empty and blank texts get the model's bias alone. The model's size is set by its
    settings (2^17 rows of 8 numbers: 4 MB), not by the data.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.table, model.weights, model.bias, model.settings))
    docs = docs.drop("score")

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, score double")
