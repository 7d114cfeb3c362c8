"""Offline metrics of ranked lists, and losses on given vectors.

``lists(user_id, item_id, rank)`` are unique per user, rank from 1; ``truth(user_id, item_id)``
is distinct. Users without truth are left out of the means.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import SMALL_ROWS, meet_all, meet_best
from ..functions.vectors import dot


def _user_metrics(lists: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """All metrics at all ``ks`` of each user with truth, in one pass: ``user_id, mrr, m_k`` as structs.

    A user's truth meets the list as one row, by the user alone, so the lists are shuffled once for all that follows.
    """
    known = truth.groupBy("user_id").agg(F.count("*").alias("g"), F.collect_list("item_id").alias("liked"))
    hit = F.coalesce(F.array_contains("liked", F.col("item_id")), F.lit(False)).cast("int")
    # a user with truth and without a list stays as one row without a rank
    hits = lists.join(known, "user_id", "right").select("user_id", "g", "rank", hit.alias("hit"))
    so_far = F.sum("hit").over(Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("found", so_far)
    sums = [F.max("g").alias("g"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")]
    for k in ks:
        inside = (F.col("rank") <= k).cast("int")
        sums += [
            F.sum(F.col("hit") * inside / F.log2(F.col("rank") + 1.0)).alias(f"dcg_{k}"), F.sum(F.col("hit") * inside * F.col("found") / F.col("rank")).alias(f"precisions_{k}"),
            F.sum(F.col("hit") * inside).alias(f"n_hits_{k}"), F.sum(inside).alias(f"n_list_{k}"),
        ]
    both = hits.groupBy("user_id").agg(*sums).fillna(0, [f"{c}_{k}" for k in ks for c in ("dcg", "precisions", "n_hits", "n_list")])
    out = []
    for k in ks:
        c = {name: F.col(f"{name}_{k}") for name in ("dcg", "precisions", "n_hits", "n_list")}
        top = F.least(F.col("g"), F.lit(k))
        ideal = F.aggregate(F.sequence(F.lit(1), top.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
        precision = F.when(c["n_list"] > 0, c["n_hits"] / c["n_list"]).otherwise(0.0)
        out.append(F.struct((c["dcg"] / ideal).alias("ndcg"), (c["precisions"] / top).alias("map"), (c["n_hits"] / F.col("g")).alias("recall"), precision.alias("precision"), (c["n_hits"] > 0).cast("double").alias("hit_rate")).alias(f"m_{k}"))
    return both.select("user_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), *out)


def per_user(lists: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """NDCG, average precision, recall, precision, hit rate at ``k`` and reciprocal rank of each user with truth."""
    return _user_metrics(lists, truth, (k,)).select("user_id", f"m_{k}.*", "mrr")


def evaluate(lists: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """Long form ``metric, k, value``: means over users with truth, all from one pass over the lists."""
    names = ["ndcg", "map", "recall", "precision", "hit_rate"]
    means = _user_metrics(lists, truth, ks).agg(F.avg("mrr").alias("mrr"), *(F.avg(f"m_{k}.{c}").alias(f"{c}_{k}") for k in ks for c in names))
    row = lambda c, k, value: F.struct(F.lit(c).alias("metric"), F.lit(k).cast("long").alias("k"), F.col(value).alias("value"))
    rows = [row("mrr", ks[0], "mrr"), *(row(c, k, f"{c}_{k}") for k in ks for c in names)]
    return means.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def coverage(lists: DataFrame, n_items: int) -> DataFrame:
    return lists.agg((F.countDistinct("item_id") / F.lit(float(n_items))).alias("coverage"))


def intra_list_diversity(lists: DataFrame, vectors: DataFrame, top: int = 20) -> DataFrame:
    """Mean over pairs of 1 - cosine, by user; 0 for fewer than two items."""
    shown = lists.where(F.col("rank") <= top).join(vectors, "item_id")
    a, b = shown.select("user_id", F.col("rank").alias("i"), F.col("v").alias("a")), shown.select("user_id", F.col("rank").alias("j"), F.col("v").alias("b"))
    pairs = a.join(b, "user_id").where("i < j").groupBy("user_id").agg(F.avg(1 - dot("a", "b")).alias("ild"))
    return lists.select("user_id").distinct().join(pairs, "user_id", "left").select("user_id", F.coalesce("ild", F.lit(0.0)).alias("ild"))


def novelty(lists: DataFrame, rows: DataFrame, top: int = 20, unknown: float = 1e-6) -> DataFrame:
    """Mean -log2 of an item's share of the interactions, by user."""
    total = rows.agg(F.count("*").alias("n"))
    share = rows.groupBy("item_id").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("item_id", (F.col("c") / F.col("n")).alias("p"))
    shown = lists.where(F.col("rank") <= top).join(share, "item_id", "left")
    return shown.groupBy("user_id").agg(F.avg(-F.log2(F.coalesce("p", F.lit(unknown)) + 1e-10)).alias("novelty"))


def micro_recall(lists: DataFrame, truth: DataFrame, k: int, users: int | None = None) -> DataFrame:
    """Hits over truth, summed over all users, or over the first ``users`` users by id."""
    t = truth if users is None else truth.join(truth.select("user_id").distinct().orderBy("user_id").limit(users), "user_id", "left_semi")
    hits = t.join(lists.where(F.col("rank") <= k), ["user_id", "item_id"], "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(t.agg(F.count("*").alias("truth"))).select((F.col("hits") / F.greatest(F.col("truth"), F.lit(1))).alias("recall"))


def _negatives(temperature: float):
    """Of a batch in blocks: own logit, maximum, and sum of exponentials of the others beneath it."""

    def meet(ids, x, items, y):
        s = x @ y.T / temperature
        own = ids[:, None] == items[None, :]
        logit = np.where(own.any(axis=1), np.where(own, s, 0).sum(axis=1), np.nan)
        s[own] = -np.inf
        top = np.maximum(s.max(axis=1), np.nan_to_num(logit, nan=-np.inf))
        return {"id": ids, "own": logit, "top": top, "total": np.exp(s - top[:, None]).sum(axis=1)}

    return meet


def info_nce(batch: DataFrame, temperature: float = 0.07, small: int = SMALL_ROWS) -> DataFrame:
    """``id, u, v``: mean of log-sum-exp over the batch minus the own logit.

    Blocks of the batch meet two by two; of each only a maximum and a sum is kept for every id.
    """
    q, i = batch.select("id", F.col("u").alias("v")), batch.select(F.col("id").alias("item_id"), "v")
    parts = meet_all(q, i, "id", _negatives(temperature), "id long, own double, top double, total double", small)
    parts = parts.withColumn("own", F.nanvl("own", F.lit(None)))
    top = F.max("top").over(Window.partitionBy("id"))
    per = parts.withColumn("m", top).groupBy("id").agg(F.max("m").alias("m"), F.max("own").alias("own"), F.sum(F.col("total") * F.exp(F.col("top") - F.col("m"))).alias("s"))
    return per.agg(F.avg(F.col("m") + F.log(F.col("s") + F.exp(F.col("own") - F.col("m"))) - F.col("own")).alias("loss"))


def in_batch_hard_negatives(batch: DataFrame, hardest: int = 10, margin: float = 0.2, small: int = SMALL_ROWS) -> DataFrame:
    """``id, u, v``: mean over the ``hardest`` other items of the batch of max(0, margin + their similarity - the own)."""
    q, i = batch.select("id", F.col("u").alias("v")), batch.select(F.col("id").alias("item_id"), "v")
    own = batch.select("id", dot("u", "v").alias("own")).where("own is not null")
    others = meet_best(q, i, "id", hardest, drop_self=True, small=small, slack=0.0).withColumnRenamed("score", "s")
    others = others.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s")))).where(F.col("r") <= hardest)
    return others.join(own, "id").agg(F.avg(F.greatest(F.lit(0.0), margin + F.col("s") - F.col("own"))).alias("loss"))


def bpr(triples: DataFrame) -> DataFrame:
    """``u, p, n`` vectors: mean of -ln sigmoid(u.p - u.n)."""
    return triples.agg(F.avg(F.log1p(F.exp(-(dot("u", "p") - dot("u", "n"))))).alias("loss"))


def sampled_softmax(triples: DataFrame, temperature: float = 0.07) -> DataFrame:
    """``id, u, p, n``, a row for each sampled negative: mean over ids of -ln softmax of the positive among all of its rows."""
    d = (dot("u", "n") - dot("u", "p")) / temperature
    return triples.groupBy("id").agg(F.log1p(F.sum(F.exp(d))).alias("l")).agg(F.avg("l").alias("loss"))


def hard_negative(triples: DataFrame, margin: float = 0.2) -> DataFrame:
    return triples.agg(F.avg(F.greatest(F.lit(0.0), margin + dot("u", "n") - dot("u", "p"))).alias("loss"))


def with_hard_negatives(batch: DataFrame, triples: DataFrame, weight: float = 0.5, margin: float = 0.0, temperature: float = 0.07) -> DataFrame:
    """In-batch loss plus ``weight`` times the margin loss over given hard negatives."""
    both = info_nce(batch, temperature).withColumnRenamed("loss", "base").crossJoin(hard_negative(triples, margin))
    return both.select((F.col("base") + weight * F.col("loss")).alias("loss"))


#: Losses by name: those of a batch (``id, u, v``) and those of triples (``id, u, p, n``).
LOSSES = {"infonce": info_nce, "in_batch_hard_negative": in_batch_hard_negatives, "bpr": bpr, "sampled_softmax": sampled_softmax, "hard_negative": hard_negative}


def loss(name: str, rows: DataFrame, **settings) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"no loss is called {name}; there are {', '.join(LOSSES)}")
    return LOSSES[name](rows, **settings)


def stop_early(values: list[float], patience: int = 5, least_gain: float = 0.001) -> int | None:
    """The place (from 0) of a series at which training stops: ``patience`` values in all without a rise of more than ``least_gain``, counted anew after each rise."""
    best, waited = None, 0
    for i, x in enumerate(values):
        if best is None or x > best + least_gain:
            best, waited = x, 0
        else:
            waited += 1
            if waited >= patience:
                return i
    return None


def early_stopping(series: DataFrame, patience: int = 5, least_gain: float = 0.001, mode: str = "max") -> DataFrame:
    """The rule of ``stop_early`` for a table of series: ``series, step, value`` -> ``series, steps, stopped_at, best``.

    Each series is folded in the order of its steps, with the best value and the steps waited as
    state; after the stop the state stays. ``stopped_at`` is null where no step stops. Null values
    are left out. With ``mode`` "min" a fall is a gain.
    """
    sign = {"max": 1.0, "min": -1.0}[mode]
    ordered = F.array_sort(F.collect_list(F.struct("step", (sign * F.col("value")).alias("value"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("waited"), F.lit(None).cast("long").alias("stopped"))

    def step(acc, x):
        gain = acc["best"].isNull() | (x["value"] > acc["best"] + least_gain)
        waited = F.when(gain, 0).otherwise(acc["waited"] + 1)
        stopped = F.when(waited >= patience, x["step"].cast("long"))
        after = F.struct(F.when(gain, x["value"]).otherwise(acc["best"]).alias("best"), waited.cast("int").alias("waited"), stopped.alias("stopped"))
        return F.when(acc["stopped"].isNotNull(), acc).otherwise(after)

    folded = series.where("value is not null").groupBy("series").agg(F.count("*").alias("steps"), ordered.alias("all"))
    end = folded.select("series", "steps", F.aggregate("all", start, step).alias("end"))
    return end.select("series", "steps", F.col("end.stopped").alias("stopped_at"), (sign * F.col("end.best")).alias("best"))


def mined_triples(batch: DataFrame, found: DataFrame, items: DataFrame, positives: DataFrame, each: int = 5) -> DataFrame:
    """``id, u, p, n``: the first ``each`` of ``found(id, item_id, rank)`` that are no positives of the id, with their vectors.

    ``batch(id, u, v)`` has the ids' own vectors and positives; ``positives(id, item_id)`` all that count as right.
    """
    left = found.join(positives.select("id", "item_id").distinct(), ["id", "item_id"], "left_anti")
    hard = left.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where(F.col("r") <= each).select("id", "item_id")
    vectors = items.select("item_id", F.col("v").alias("n"))
    return hard.join(vectors, "item_id").join(batch.select("id", "u", F.col("v").alias("p")), "id").select("id", "u", "p", "n")


def learning_rate(step: Column, steps: Column, warmup: int, base: float, least: float = 0.0) -> Column:
    """A linear rise over ``warmup`` steps, then half a cosine down to ``least`` at ``steps``."""
    down = least + (base - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / F.greatest(F.lit(1), steps - warmup)))
    return F.when(step < warmup, base * (step + 1) / max(1, warmup)).otherwise(down)
