"""Re-ranking of candidate lists: rules, quotas, freshness, diversity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top_k

PROMOTED_SCORE = 999.0


def business_rules(candidates: DataFrame, watched: DataFrame, promoted: list[int]) -> DataFrame:
    """Drops watched items, then puts promoted ones first, in the order given, with a fixed score.

    Promotion looks at the unfiltered list: a watched item that is promoted comes back.
    """
    seen = watched.select("user_id", "item_id").distinct().withColumn("_seen", F.lit(True))
    place = F.array_position(F.array(*(F.lit(i).cast("long") for i in promoted)), F.col("item_id").cast("long")) if promoted else F.lit(0).cast("long")
    both = candidates.join(seen, ["user_id", "item_id"], "left").withColumn("_place", place)
    both = both.where((F.col("_place") > 0) | F.col("_seen").isNull()).drop("_seen")
    both = both.withColumn("score", F.when(F.col("_place") > 0, F.lit(PROMOTED_SCORE)).otherwise(F.col("score")))
    first = F.when(F.col("_place") > 0, F.col("_place"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last(first), F.desc("score"), "item_id"))
    return both.withColumn("rank", rank.cast("long")).drop("_place")


def category_quota(candidates: DataFrame, quotas: dict[str, int], default: int) -> DataFrame:
    """At most so many items of a category in a user's list."""
    quota = F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in quotas.items()), F.lit(default))
    place = F.row_number().over(Window.partitionBy("user_id", "category").orderBy(F.desc("score"), "item_id"))
    return candidates.withColumn("place", place).where(F.col("place") <= quota).drop("place")


def freshness(score: Column, age_days: Column, decay_days: float = 90.0, boost: float = 0.2) -> Column:
    return score + F.least(F.greatest(boost * F.exp(-age_days / decay_days), F.lit(0.0)), F.lit(boost))


def min_max(score: str, by: str) -> Column:
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return (F.col(score) - lo) / (hi - lo + 1e-8)


def _greedy(k: int, weight: float):
    def run(table: pa.Table) -> pa.Table:
        user, item, score = (table.column(c).to_numpy() for c in ("user_id", "item_id", "s"))
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(user), -1)
        out = []
        order = np.lexsort((item, -score, user))
        for at in np.split(order, np.flatnonzero(np.diff(user[order])) + 1):
            near, left = np.full(len(at), -np.inf), np.ones(len(at), bool)
            for place in range(1, min(k, len(at)) + 1):
                value = weight * score[at] - (1 - weight) * np.where(np.isinf(near), 0.0, near)
                pick = int(np.argmax(np.where(left, value, -np.inf)))  # the first of equals: better score, then smaller id
                out.append((user[at[pick]], place, item[at[pick]]))
                left[pick] = False
                near = np.maximum(near, v[at] @ v[at[pick]])
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(("user_id", "rank", "item_id"), columns)})

    return run


def mmr(candidates: DataFrame, k: int, weight: float = 0.7, groups: int = 1_024) -> DataFrame:
    """Maximal marginal relevance: ``user_id, item_id, score, v`` -> ``user_id, rank, item_id``.

    Greedy: ``weight`` times the scaled score minus the rest times the largest similarity to what
    is chosen; ties go to the better score, then the smaller id. Users are dealt into ``groups``;
    what stands together in a task are the candidate lists of one group's users.
    """
    scaled = candidates.select("user_id", "item_id", min_max("score", "user_id").alias("s"), "v")
    return scaled.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("g")).applyInArrow(_greedy(k, weight), "user_id long, rank long, item_id long")


def rerank(candidates: DataFrame, watched: DataFrame, promoted: list[int], k: int) -> DataFrame:
    """Rules, then freshness by ``age_days``, then the best ``k``."""
    ruled = business_rules(candidates, watched, promoted)
    return top_k(ruled.select("user_id", "item_id", F.round(freshness(F.col("score"), F.col("age_days")), 6).alias("score")), "user_id", k)
