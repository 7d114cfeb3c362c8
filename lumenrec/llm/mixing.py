"""Operator 8 [native]: mixing sources to target weights by soft membership.

The documents that occur in the labelled table, with their source as domain, train a multinomial
naive Bayes classifier on hashed words; it predicts every document's posteriors over the
domains, tempered by the text's length so that they stay soft; a document of a domain without
labelled rows, of which the classifier knows nothing, belongs to its own domain. The posteriors
are calibrated so that their token totals are those of the domains themselves.

Then rates of all documents are fitted by projected gradient least squares, so that the expected
tokens of each domain, sum of rate * tokens * posterior, match the target. The gradient is one
number for each domain, which an aggregation over all documents gives, and is preconditioned by
the domains' Gram matrix (one number for each two domains); the steps so far are replayed inside
the next aggregation, so nothing but the posteriors is stored. No rate falls below ``floor``:
with 1, the default, every document stays and the corpus grows until the domain that has most
beyond its share fits, so that ``copies``, which are rates rounded at random, have the rates as
expectation.

Posteriors are one array for each document and all sums are vectors, so domains are not limited
by the number of columns; their names and totals pass through the driver. Only DataFrame and
spark.ml functions, no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import few, materialize

SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that the classifier is fitted on.

    ``flatten`` makes default targets: shares of tokens to this power, so that large domains
    shrink and small ones grow. At most ``steps`` gradient steps are made, fewer once every
    domain's share of tokens is within ``tolerance`` of its target. ``calibrations`` is the
    number of rounds that fit the posteriors' token totals to the domains' own. A text counts
    in its posteriors as ``sharpness`` words at most. No rate falls below ``floor``; with 0
    documents may go, and the total of tokens stays.
    """

    max_rows: int = 20_000
    features: int = 1024
    sharpness: float = 100.0
    flatten: float = 0.7
    steps: int = 20
    tolerance: float = 1e-4
    calibrations: int = 8
    floor: float = 1.0


def _words() -> Column:
    text = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1))


def _numbers(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


#: Steps of the rate fit between stored rates.
STORED_STEPS = 5
#: Domains up to which sums over them are spelled out, which keeps them in generated code.
SPELLED = 64


def _flat(k: int) -> bool:
    return k <= SPELLED


def _held(p: DataFrame, k: int) -> DataFrame:
    """``p`` as a column for each domain, which are read far faster than arrays; as it is where domains are many."""
    return p.select("doc_id", "n", "own", *(F.get("p", F.lit(i)).alias(f"p{i}") for i in range(k))) if _flat(k) else p


def _columns(k: int) -> list[str]:
    return [f"p{i}" for i in range(k)] if _flat(k) else ["p"]


def _dot(values) -> Column:
    """Sum of a row's posteriors times given numbers."""
    if _flat(len(values)):
        return F.expr(" + ".join(["0.0D", *(f"p{i} * {float(x)!r}D" for i, x in enumerate(values))]))
    return F.aggregate(F.zip_with("p", _numbers(values), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _totals(rows: DataFrame, weight: Column, k: int) -> np.ndarray:
    """Sum of weight * posterior of each domain over all rows."""
    rows = rows.select(*_columns(k), weight.cast("double").alias("_w")).where("_w > 0")
    if _flat(k):
        row = rows.agg(*(F.expr(f"sum(p{i} * _w)") for i in range(k))).first()
        return np.array([x or 0.0 for x in row], np.float64)
    row = rows.select(array_to_vector("p").alias("v"), "_w").agg(Summarizer.metrics("sum", "count").summary(F.col("v"), F.col("_w")).alias("s")).select("s.sum", "s.count").first()
    return row["sum"].toArray() if row["count"] else np.zeros(k)


def _posteriors(docs: DataFrame, labels: DataFrame, domain: str, s: Settings) -> tuple[DataFrame, list[str]]:
    """Rows ``doc_id, n, own, p``: own domain's number and the posteriors by number; the domains' names."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(domain).cast("string"), F.lit("")).alias("domain"), "text")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_rows)
    # texts are split in words after the join: only the sample's
    train = base.join(F.broadcast(marked), "doc_id").select("domain", _words().alias("words")).where(F.size("words") > 0)
    train = materialize(train)
    seen = {r["domain"] for r in train.select("domain").distinct().collect()}
    # the classifier numbers its classes by those that occur: a domain may have no labelled rows
    names = sorted(seen) + sorted(r["domain"] for r in base.select("domain").distinct().collect() if r["domain"] not in seen)
    k = len(names)
    numbers = few(docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "domain string, own int"))

    tf = HashingTF(inputCol="words", outputCol="features", numFeatures=s.features)
    counted = base.join(numbers, "domain").select("doc_id", "own", _words().alias("words")).withColumn("n", F.size("words").cast("long"))
    alone = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("own")).cast("double")) if k else F.array().cast("array<double>")
    if len(seen) < 2:
        # nothing to tell apart: every document belongs to its own source
        return materialize(counted.select("doc_id", "n", "own", alone.alias("p"))), names
    model = NaiveBayes(smoothing=1.0).fit(tf.transform(train.join(numbers, "domain").select(F.col("own").cast("double").alias("label"), "words")))
    raw = model.transform(tf.transform(counted)).select("doc_id", "n", "own", vector_to_array("rawPrediction").alias("raw"))
    top, weight = F.array_max("raw"), F.least(F.lit(1.0), s.sharpness / F.greatest(F.col("n"), F.lit(1)))
    soft = raw.select("doc_id", "n", "own", F.transform("raw", lambda x: F.exp((x - top) * weight)).alias("e"))
    soft = soft.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    judged = F.concat(F.transform("e", lambda x: x / F.col("z")), F.array_repeat(F.lit(0.0), k - len(seen)))
    return materialize(soft.select("doc_id", "n", "own", F.when(F.col("own") < len(seen), judged).otherwise(alone).alias("p"))), names


def _calibrated(p: DataFrame, own: np.ndarray, rounds: int) -> DataFrame:
    """Posteriors reweighted by domain until their token totals are those of the documents' own domains.

    A classifier fitted on few rows favours the domains that it knows best, all the more in long
    texts. Each round is one aggregation; the weights are one number for each domain.
    """
    k = len(own)
    weights = np.ones(k)

    def reweighted() -> DataFrame:
        if _flat(k):
            scaled = p.withColumn("z", _dot(weights))
            return scaled.select("doc_id", "n", "own", *(F.expr(f"if(z > 0, p{i} * {float(x)!r}D / z, p{i})").alias(f"p{i}") for i, x in enumerate(weights)))
        scaled = p.select("doc_id", "n", "own", "p", F.zip_with("p", _numbers(weights), lambda a, b: a * b).alias("q"))
        scaled = scaled.withColumn("z", F.aggregate("q", F.lit(0.0), lambda a, x: a + x))
        return scaled.select("doc_id", "n", "own", F.when(F.col("z") > 0, F.transform("q", lambda x: x / F.col("z"))).otherwise(F.col("p")).alias("p"))

    for _ in range(rounds if k > 1 else 0):
        sums = _totals(reweighted(), F.col("n"), k)
        weights *= np.where((sums > 0) & (own > 0), own / np.where(sums > 0, sums, 1), 1.0)
    return materialize(reweighted())


def fit_rates(docs: DataFrame, labels: DataFrame, domain: str = "source", targets: dict[str, float] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text, <domain>)`` -> ``doc_id, n_tokens, rate, copies, gap, copies_gap``.

    ``targets`` gives weights by domain (missing ones count as 0); default: the domains' token
    shares flattened. One row per input row; a null domain is a domain of its own (the empty
    string), a null or empty text has no tokens and rate 1. ``copies`` is ``rate`` rounded at
    random by a hash of doc_id. ``gap`` and ``copies_gap``, the same in all rows, are the largest
    differences between a domain's target share and its expected share of tokens, under the
    rates and under the copies.
    """
    p, names = _posteriors(docs, labels, domain, settings)
    k = len(names)
    own = np.zeros(k)
    for row in p.groupBy("own").agg(F.sum("n").alias("n")).collect():
        own[row["own"]] = row["n"]
    tokens = float(own.sum())
    none = [F.lit(0.0).alias("gap"), F.lit(0.0).alias("copies_gap")]
    if not tokens:
        return p.select("doc_id", F.col("n").alias("n_tokens"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), *none)
    p = _calibrated(materialize(_held(p, k)), own, settings.calibrations)
    weights = np.array([max(0.0, targets.get(x, 0.0)) for x in names]) if targets else (own / tokens) ** settings.flatten
    goal = weights / (weights.sum() or 1.0)

    reached = _totals(p, F.col("n"), k) / tokens
    # with a floor no domain shrinks below it: the others grow until the shares are right
    total = max([1.0, *(settings.floor * reached[i] / goal[i] for i in range(k) if goal[i] > 0 and settings.floor > 0)])
    # the Gram matrix of the domains bounds the curvature, whichever rates are held at the floor: a full step is safe
    gram = np.zeros((k, k))
    if _flat(k):
        spread = p.where("n > 0").select(*_columns(k), "n", F.posexplode(F.array(*_columns(k))).alias("i", "x")).where("x > 0")
        for row in spread.groupBy("i").agg(*(F.expr(f"sum(p{j} * n * x)") for j in range(k))).collect():
            gram[row["i"]] = np.array(row[1:], np.float64) / tokens
    else:
        spread = p.where("n > 0").select(F.posexplode("p").alias("i", "x"), "p", "n").where("x > 0")
        for row in spread.groupBy("i").agg(Summarizer.metrics("sum").summary(array_to_vector("p"), F.col("n") * F.col("x")).alias("s")).select("i", "s.sum").collect():
            gram[row["i"]] = row["sum"].toArray() / tokens
    inverse = np.linalg.pinv((gram + gram.T) / 2, rcond=1e-6, hermitian=True)
    # rates are stored after every few steps, so no step is taken again and again
    rated, taken = p.withColumn("rate", F.lit(1.0)), []

    def after(rows: DataFrame, steps: list[np.ndarray]) -> DataFrame:
        for step in steps:
            down = F.greatest(F.lit(settings.floor), F.col("rate") - _dot(step))
            rows = rows.withColumn("rate", F.when(F.col("n") > 0, down).otherwise(F.lit(1.0)))
        return rows

    steps, best, gap = 0, rated, np.inf
    while True:
        now = float(np.abs(reached / (reached.sum() or 1.0) - goal).max())
        if now < gap:
            best, gap = after(rated, taken), now
        if gap < settings.tolerance or steps == settings.steps:
            break
        if len(taken) == STORED_STEPS:
            rated, taken = materialize(after(rated, taken)), []
        taken = [*taken, inverse @ (reached - total * goal)]
        steps += 1
        reached = _totals(after(rated, taken), F.col("n") * F.col("rate"), k) / tokens
    chance = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    rated = materialize(best.select("doc_id", "n", *_columns(k), "rate").withColumn("copies", F.floor(F.col("rate") + chance)))
    copied = _totals(rated, F.col("n") * F.col("copies"), k)
    copies_gap = float(np.abs(copied / (copied.sum() or 1.0) - goal).max())
    return rated.select("doc_id", F.col("n").alias("n_tokens"), "rate", "copies", F.lit(gap).alias("gap"), F.lit(copies_gap).alias("copies_gap"))


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with every row ``copies`` times; rows with a null doc_id stay once.

    Rates of several rows with one doc_id: the largest number of copies counts for all.
    """
    by_id = rates.where("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("_copies")).withColumnRenamed("doc_id", "_rated_id")
    joined = docs.join(by_id, F.col("doc_id") == F.col("_rated_id"), "left")
    times = F.sequence(F.lit(1), F.greatest(F.coalesce("_copies", F.lit(1)), F.lit(1)).cast("int"))
    return joined.where("_copies is null or _copies > 0").withColumn("_copy", F.explode(times)).select(*docs.columns)
