"""A ranker trained for the order of lists: boosted trees on pairwise gradients (LambdaRank).

Features are cut into bins once, and every user's list is stored once, as one row of labels and
bins. In each round a list gives each of its rows a gradient: for each pair of rows of different
labels, how far the model puts them in the wrong order, times what swapping them would change in
the list's NDCG. A tree is grown level by level from histograms (sums of gradients by node, feature
and bin). A task scores its lists by the trees so far, takes their gradients and gives its sums:
no row is shuffled or written again, and only the histograms, whose size is that of a tree level,
come to the driver. The model is a table of nodes and is applied as an expression, so scoring
stays inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .metrics import stop_early

_NODES = "tree int, node int, feature int, threshold double, value double"


@dataclass(frozen=True)
class Settings:
    trees: int = 10
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    least_rows: int = 20
    shrink: float = 1.0
    #: Pairs count if one of the two is among so many first of the list.
    truncate: int = 30
    at: int = 10
    #: Rounds without a better NDCG on the users held out, after which training stops.
    patience: int = 5


@dataclass
class Ranker:
    """Trees over ``features``; a node has children 2 n + 1 (up to the threshold) and 2 n + 2."""

    features: list[str]
    trees: list[dict[int, tuple]] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)
    history: list[float] = field(default_factory=list)

    def score(self) -> Column:
        return sum((_apply(t, self.features) for t in self.trees), F.lit(0.0))

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", self.score())

    def importances(self, spark: SparkSession) -> DataFrame:
        total = sum(self.gains.values()) or 1.0
        return spark.createDataFrame([(f, self.gains.get(f, 0.0) / total) for f in self.features], "feature string, gain double")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, n, x[0], float(x[1]), None) if len(x) == 2 else (i, n, None, None, float(x[0])) for i, t in enumerate(self.trees) for n, x in t.items()]
        spark.createDataFrame(rows, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(f, float(self.gains.get(f, 0.0)), i) for i, f in enumerate(self.features)], "feature string, gain double, place int").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ranker:
        named = spark.read.parquet(f"{path}/features").orderBy("place").collect()
        out = Ranker([r["feature"] for r in named], gains={r["feature"]: r["gain"] for r in named})
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            while len(out.trees) <= r["tree"]:
                out.trees.append({})
            out.trees[r["tree"]][r["node"]] = (r["value"],) if r["feature"] is None else (r["feature"], r["threshold"])
        return out


def _apply(tree: dict[int, tuple], features: list[str], node: int = 0) -> Column:
    """A tree as nested conditions. Nulls go to the first child."""
    x = tree[node]
    if len(x) == 1:
        return F.lit(x[0])
    below = [_apply(tree, features, 2 * node + i) for i in (1, 2)]
    return F.when(F.col(features[x[0]]) > x[1], below[1]).otherwise(below[0])


def _pushes(lists, label: np.ndarray, score: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each row; ``lists`` are the places of each user's rows, best score first."""
    grad, hess = np.zeros(len(label)), np.zeros(len(label))
    for at in lists:
        gain, s = 2.0 ** label[at] - 1, score[at]
        discount = 1 / np.log2(np.arange(len(at)) + 2)
        ideal = (np.sort(gain)[::-1] * discount)[: settings.at].sum()
        if ideal <= 0:
            continue
        t = min(settings.truncate, len(at))
        # rows: the first t places, columns: all places below
        higher = gain[:t, None] - gain[None, :]
        delta = np.abs(higher * (discount[:t, None] - discount[None, :])) / ideal
        delta[np.tril_indices(t, 0, len(at))] = 0
        sign = np.sign(higher)
        rho = 1 / (1 + np.exp(np.clip(sign * (s[:t, None] - s[None, :]), -50, 50)))
        push = sign * rho * delta
        curve = rho * (1 - rho) * delta * (sign != 0)
        grad[at[:t]] += push.sum(axis=1)
        grad[at] -= push.sum(axis=0)
        hess[at[:t]] += curve.sum(axis=1)
        hess[at] += curve.sum(axis=0)
    return grad, hess


def _gradients(settings: Settings):
    def run(table: pa.Table) -> pa.Table:
        user, label, score = (table.column(c).to_numpy() for c in ("user_id", "label", "score"))
        order = np.lexsort((table.column("item_id").to_numpy(), -score, user))
        grad, hess = _pushes(np.split(order, np.flatnonzero(np.diff(user[order])) + 1), label, score, settings)
        return table.append_column("grad", pa.array(grad)).append_column("hess", pa.array(hess))

    return run


def _lists(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """Stored, one row for each user: its labels by item_id, and the bins of each feature in the same order."""
    # the bin of a value is the number of edges below it
    bins = [F.coalesce(sum(((F.col(f) > e).cast("int") for e in edges[i]), F.lit(0)), F.lit(0)).cast("short").alias(f"b{i}") for i, f in enumerate(features)]
    each = F.struct(F.col("item_id"), F.col("label").cast("double").alias("label"), *bins)
    # a number of its own: short lists would else be few tasks, and each round is a pass over them
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")
    lists = dealt.groupBy("user_id").agg(F.sort_array(F.collect_list(each)).alias("l"))
    return stored(lists.select(F.col("l.label").alias("label"), *(F.col(f"l.b{i}").alias(f"b{i}") for i in range(len(features)))))


def _nodes(tree: dict[int, tuple], bins: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """The leaf of each row; a value is above an edge where its bin is beyond the edge's number."""
    at = np.zeros(len(bins[0]), np.int64)
    for node, x in sorted(tree.items()):  # parents come before their children
        if len(x) == 2:
            own = np.flatnonzero(at == node)
            at[own] = 2 * node + 1 + (bins[x[0]][own] > edges[x[0]].index(x[1]))
    return at


def _ranked(batch: pa.RecordBatch, trees: list[dict[int, tuple]], edges: list[list[float]]):
    """A batch of lists by the trees so far: labels, bins, scores, and each list's rows, best score first."""
    sizes = np.diff(batch.column("label").offsets.to_numpy())
    label = batch.column("label").flatten().to_numpy(zero_copy_only=False)
    bins = [batch.column(f"b{i}").flatten().to_numpy() for i in range(len(edges))]
    score = np.zeros(len(label))
    for tree in trees:
        value = np.zeros(max(tree) + 1)
        for node, x in tree.items():
            value[node] = x[0]
        score += value[_nodes(tree, bins, edges)]
    order = np.lexsort((-score, np.repeat(np.arange(len(sizes)), sizes)))  # rows come by item_id, which breaks ties
    return label, bins, score, np.split(order, np.cumsum(sizes)[:-1])


def _histograms(trees: list[dict[int, tuple]], tree: dict[int, tuple], nodes: list[int], edges: list[list[float]], settings: Settings):
    """A task's sums of gradients for the nodes of a level of ``tree``."""

    def run(batches):
        width = settings.bins
        sums = np.zeros((3, len(nodes), len(edges), width))
        for batch in batches:
            if not batch.num_rows:
                continue
            label, bins, score, lists = _ranked(batch, trees, edges)
            grad, hess = _pushes(lists, label, score, settings)
            at = _nodes(tree, bins, edges)
            for k, node in enumerate(nodes):
                own = np.flatnonzero(at == node)
                for f in range(len(edges)):
                    b = bins[f][own]
                    for i, weights in enumerate((grad[own], hess[own], None)):
                        sums[i, k, f] += np.bincount(b, weights, width)
        k, f, b = np.nonzero(sums[2])
        g, h, n = sums[:, k, f, b]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes)[k], pa.int32()), pa.array(f, pa.int32()), pa.array(b, pa.int32()), pa.array(g), pa.array(h), pa.array(n.astype(np.int64))], names=["node", "feature", "bin", "g", "h", "n"])

    return run


def _list_ndcg(trees: list[dict[int, tuple]], edges: list[list[float]], at: int):
    """A task's sum of the NDCG of its lists, and the number of lists with a positive label."""

    def run(batches):
        total, count = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            label, _, _, lists = _ranked(batch, trees, edges)
            for rows in lists:
                gain = 2.0 ** label[rows] - 1
                discount = 1 / np.log2(np.arange(min(at, len(rows))) + 2)
                ideal = (np.sort(gain)[::-1][:at] * discount).sum()
                if ideal > 0:
                    total, count = total + (gain[:at] * discount).sum() / ideal, count + 1
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([count])], names=["total", "n"])

    return run


def _split(cells: dict, n_features: int, edges: list[list[float]], settings: Settings):
    """Best split of a node from its histogram ``{feature: [(bin, grad, hess, n)]}``, or None."""
    best = None
    for f in range(n_features):
        rows = sorted(cells.get(f, ()))
        total = np.array([x[1:] for x in rows]).sum(axis=0) if rows else np.zeros(3)
        left = np.zeros(3)
        for b, *sums in rows[:-1]:
            left = left + sums
            right = total - left
            if min(left[2], right[2]) < settings.least_rows or b >= len(edges[f]):
                continue
            gain = sum(x[0] ** 2 / (x[1] + settings.shrink) for x in (left, right)) - total[0] ** 2 / (total[1] + settings.shrink)
            if best is None or gain > best[0]:
                best = (gain, f, edges[f][b])
    return best if best and best[0] > 1e-12 else None


def ndcg(rows: DataFrame, score: str, at: int = 10) -> DataFrame:
    """``user_id, ndcg`` of graded labels, gains 2 ** label - 1; users without a positive label give no row."""
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    discount = lambda place: 1 / F.log2(place + 1.0)
    place = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order, "item_id"))
    ranked = rows.withColumn("_p", place(F.desc(score))).withColumn("_i", place(F.desc("label")))
    sums = ranked.groupBy("user_id").agg(*(F.sum(F.when(F.col(c) <= at, gain * discount(F.col(c))).otherwise(0.0)).alias(n) for c, n in (("_p", "dcg"), ("_i", "ideal"))))
    return sums.where("ideal > 0").select("user_id", (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def train(rows: DataFrame, features: list[str], held_out: DataFrame | None = None, settings: Settings = Settings()) -> Ranker:
    """``rows(user_id, item_id, label, <features>)`` -> ranker.

    With ``held_out`` rows of other users, training stops when their NDCG has not risen for
    ``patience`` rounds, and the trees up to the best round are kept. A user's list is one group
    of a task, so lists should be candidate lists, not whole catalogs.
    """
    quantiles = [i / settings.bins for i in range(1, settings.bins)]
    found = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), quantiles).alias(f"q{i}") for i, f in enumerate(features))).first()
    edges = [sorted(set(q or [])) for q in found]
    data = _lists(rows, features, edges)
    held = None if held_out is None else _lists(held_out, features, edges)
    model = Ranker(list(features))
    curve: list[float] = []
    for _ in range(settings.trees):
        tree: dict[int, tuple] = {0: (0.0,)}
        for level in range(settings.depth + 1):
            nodes = [n for n, x in tree.items() if len(x) == 1 and n >= 2**level - 1]
            if not nodes:
                break
            parts = data.mapInArrow(_histograms(list(model.trees), dict(tree), nodes, edges, settings), "node int, feature int, bin int, g double, h double, n long")
            cells = parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
            by_node: dict[int, dict[int, list]] = {}
            for r in cells.collect():  # nodes of a level times features times bins
                by_node.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"], r["n"]))
            for n in nodes:
                own = by_node.get(n, {})
                g, h = (sum(x[i] for x in own.get(0, ())) for i in (1, 2))
                found = _split(own, len(features), edges, settings) if level < settings.depth else None
                if found:
                    model.gains[features[found[1]]] = model.gains.get(features[found[1]], 0.0) + float(found[0])
                    tree |= {n: (found[1], found[2]), 2 * n + 1: (0.0,), 2 * n + 2: (0.0,)}
                else:
                    tree[n] = (settings.rate * g / (h + settings.shrink),)
        model.trees.append(tree)
        if held is not None:
            sums = held.mapInArrow(_list_ndcg(list(model.trees), edges, settings.at), "total double, n long").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
            curve.append(sums["total"] / sums["n"] if sums["n"] else 0.0)
            if stop_early(curve, settings.patience, 0.0) is not None:
                break
    model.history = curve
    if curve:
        model.trees = model.trees[: int(np.argmax(curve)) + 1]
    return model


def split_users(rows: DataFrame, parts: int = 5, held: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows of the users to learn from, and of those held out, by a portable hash of the user."""
    fold = F.pmod(F.crc32(F.col("user_id").cast("string").cast("binary")), F.lit(parts))
    return rows.where(fold != held), rows.where(fold == held)

