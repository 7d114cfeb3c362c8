"""Nearest neighbours: exact, by cells, by product codes, by scalar codes, by projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import SMALL_BYTES, SMALL_ROWS, best, dealt_meet, matrix, meet_all, meet_best
from ..functions.vectors import dot, mean_vector, normalise
from ..sources.store import small_side, stored
from .preprocess import dense_index


#: Vectors of a cell that meet queries in one task.
CELL_ROWS = 16_384


#: Vectors that go to all rows of their items by a broadcast.
USED_ROWS = 10_000


def few_vectors(rows: DataFrame, key: str):
    """``key`` and vectors of ``rows(key, v)`` by key, to be broadcast, if they are at most ``SMALL_ROWS`` of ``SMALL_BYTES``; else None."""
    rows = rows.select(F.col(key).cast("long").alias(key), "v").where(f"{key} is not null and v is not null")
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if about["n"] > SMALL_ROWS or about["n"] * (about["width"] or 0) * 8 > SMALL_BYTES:
        return None
    table = rows.toArrow().sort_by(key)
    return table.column(key).to_numpy(), matrix(table.column("v"))


#: Pairs whose vectors are multiplied at a time.
PAIRS = 16_384


def pair_products(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``left`` of ``x`` with the rows ``right`` of ``y``, pair by pair."""
    parts = [np.einsum("ij,ij->i", x[left[at : at + PAIRS]], y[right[at : at + PAIRS]]) for at in range(0, len(left), PAIRS)]
    return np.concatenate([np.zeros(0), *parts])


def exact_scores(pairs: DataFrame, queries: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """``pairs(by, item_id)`` with their inner products to six places; vectors meet in numpy, row by row of a batch.

    Few vectors of items go to the tasks, and those of queries if they are few too: then only ids
    pass. Otherwise pairs meet the items first; a moderate number of queries is then broadcast, and
    no vector is shuffled with a pair.
    """
    schema = f"{by} long, item_id long, score double"
    held = few_vectors(items, "item_id")
    asked = held and few_vectors(queries, by)
    if asked:
        shared = pairs.sparkSession.sparkContext.broadcast((asked, held))

        def gathered(batches):
            (names, x), (ids, y) = shared.value
            for batch in batches:
                left, right = batch.column(by).to_numpy(), batch.column("item_id").to_numpy()
                if not (len(left) and len(names) and len(ids)):
                    continue
                at, on = (np.minimum(np.searchsorted(known, wanted), len(known) - 1) for known, wanted in ((names, left), (ids, right)))
                both = (names[at] == left) & (ids[on] == right)
                out = left[both], right[both], pair_products(x, y, at[both], on[both])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[by, "item_id", "score"])

        given = pairs.select(F.col(by).cast("long").alias(by), F.col("item_id").cast("long").alias("item_id")).where(f"{by} is not null and item_id is not null")
        return given.mapInArrow(gathered, schema).withColumn("score", F.round("score", 6))

    asked = small_side(queries.select(by, F.col("v").alias("qv")), SMALL_ROWS)
    both = pairs.select(by, "item_id").join(items.select("item_id", "v"), "item_id").join(asked, by)

    def product(batches):
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", matrix(batch.column("qv")), matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("item_id"), pa.array(s)], names=[by, "item_id", "score"])

    return both.select(by, "item_id", "qv", "v").mapInArrow(product, schema).withColumn("score", F.round("score", 6))


def user_vectors(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``user_id, v``: normalised mean of the vectors of a user's items; vectors of few different items are not shuffled to the rows.

    Rows are dealt out by user before they get their vectors, so the sums of a user's components
    are made where its rows are: what is shuffled are pairs of ids.
    """
    rows = rows.select("user_id", "item_id")
    named = stored(rows.select("item_id").distinct())  # the rows are read once for it
    used = small_side(items.join(small_side(named, SMALL_ROWS), "item_id", "left_semi"), USED_ROWS)
    mean = mean_vector(rows.repartition("user_id").join(used, "item_id"), "user_id", "v")
    return mean.select("user_id", normalise("v").alias("v"))


def top_k(scored: DataFrame, by: str, k: int, score: str = "score", tie: str = "item_id") -> DataFrame:
    """Best ``k`` rows of each ``by`` with ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def knn(queries: DataFrame, items: DataFrame, by: str, k: int, drop_self: bool = False, small: int = SMALL_ROWS) -> DataFrame:
    """Exact inner-product neighbours of ``queries(by, v)`` among ``items(item_id, v)``, scores to six places.

    Items pass by blocks of queries in matrix products; only the best ``k`` of a query leave a
    task. For catalogs where all pairs are too many there is ``ivf_search``.
    """
    found = meet_best(queries, items, by, k, drop_self, small)
    return top_k(found.select(by, "item_id", F.round("score", 6).alias("score")), by, k)


def similar_items(items: DataFrame, k: int) -> DataFrame:
    return knn(items.select(F.col("item_id").alias("query_id"), "v"), items, "query_id", k, drop_self=True)


def similar_in_catalog(items: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Over-fetches max(50, 5 k), then keeps what the catalog knows."""
    wide = similar_items(items, max(50, 5 * k)).drop("rank")
    return top_k(wide.join(catalog.select("item_id"), "item_id", "left_semi"), "query_id", k)


def recommend(users: DataFrame, items: DataFrame, seen: DataFrame | None, k: int, retrieve: int = 100) -> DataFrame:
    """Retrieves ``retrieve`` items a user, drops seen ones, returns the best ``k`` and the number retrieved."""
    found = knn(users, items, "user_id", retrieve).withColumn("num_candidates", F.count("*").over(Window.partitionBy("user_id")))
    if seen is not None:
        found = found.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    return top_k(found.drop("rank"), "user_id", k).select("user_id", "item_id", "score", "rank", "num_candidates")


def recommend_for(asked: DataFrame, users: DataFrame, items: DataFrame, seen: DataFrame | None, k: int, retrieve: int = 100) -> DataFrame:
    """Recommendations for the users of ``asked(user_id)``; one who is not known gets a row that says so."""
    asked = asked.select("user_id").distinct()
    found = recommend(users.join(asked, "user_id", "left_semi"), items, seen, k, retrieve).drop("num_candidates")
    known = asked.join(users.select("user_id", F.lit(True).alias("known")), "user_id", "left")
    out = known.join(found, "user_id", "left")
    return out.select("user_id", "item_id", "score", "rank", F.when(F.col("known"), F.lit(None).cast("string")).otherwise(F.lit("User not found")).alias("error"))


def sq8_codes(items: DataFrame) -> DataFrame:
    """Each dimension scaled between its extremes and rounded to 0..255, and read back."""
    long = items.select("item_id", F.posexplode("v").alias("i", "x"))
    ends = long.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / 255
    code = F.when(step == 0, F.lit(0)).otherwise(F.floor((F.col("x") - F.col("lo")) / step + 0.5)).cast("long")
    return long.join(F.broadcast(ends), "i").select("item_id", "i", code.alias("code"), (F.col("lo") + code * step).alias("x"))


def sq8_search(queries: DataFrame, items: DataFrame, by: str, k: int) -> DataFrame:
    """All items by their codes: a byte a dimension is packed, shuffled and broadcast, and read back in the tasks."""
    ends = items.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()  # a row for each dimension
    low, step = np.array([r["lo"] for r in ends]), np.array([(r["hi"] - r["lo"]) / 255 for r in ends])

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                scaled = (matrix(batch.column("v")) - low) / np.where(step == 0, 1, step)
                codes = np.where(step == 0, 0, np.floor(scaled + 0.5)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["item_id", "code"])

    n = max(1, -(-items.count() // CELL_ROWS))
    coded = items.select("item_id", "v").mapInArrow(encode, "item_id long, code binary").select(F.lit(0).alias("whole"), F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("block"), "item_id", "code")
    first = best(by, k)

    def meet(left, right):
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        return first(left.column(by).to_numpy(), matrix(left.column("v")), right.column("item_id").to_numpy(), low + codes * step)

    found = dealt_meet(queries.select(by, "v", F.lit(0).alias("whole")), coded, ["whole"], by, meet, f"{by} long, item_id long, score double")
    return top_k(found.select(by, "item_id", F.round("score", 6).alias("score")), by, k)


def ivf_fit(items: DataFrame, cells: int, seed: int = 3, sample: int = 100_000):
    """Centroids from at most ``sample`` vectors."""
    train = items.orderBy(F.xxhash64("item_id")).limit(sample) if items.limit(sample + 1).count() > sample else items
    return KMeans(k=cells, seed=seed, maxIter=15, featuresCol="f", predictionCol="cell_id").fit(train.select(array_to_vector("v").alias("f")))


class IvfIndex:
    """``placed(item_id, v, cell_id)``: every item in its cell; ``centres(cell_id, c)``."""

    def __init__(self, placed: DataFrame, centres: DataFrame):
        self.placed, self.centres = placed, centres

    def save(self, path: str) -> None:
        """Items by cell, so that a search for few cells reads few folders, and the centroids beside them."""
        self.placed.repartition("cell_id").write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/placed")
        self.centres.write.mode("overwrite").parquet(f"{path}/centres")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IvfIndex:
        placed = spark.read.schema("item_id long, v array<double>, cell_id int").parquet(f"{path}/placed")
        return IvfIndex(placed, spark.read.parquet(f"{path}/centres"))


def ivf_build(items: DataFrame, cells: int, seed: int = 3) -> IvfIndex:
    """Every item goes to the cell of its nearest centroid."""
    model = ivf_fit(items, cells, seed)
    centres = items.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell_id int, c array<double>")
    placed = model.transform(items.withColumn("f", array_to_vector("v"))).select("item_id", "v", "cell_id")
    return IvfIndex(stored(placed), stored(centres))


def ivf_around(items: DataFrame, centres: DataFrame) -> IvfIndex:
    """Cells around given centroids ``centres(cell_id, c)``: an item goes to the nearest, of equal ones to the smallest number."""
    # the nearest centroid has the largest product less half its squared length, which one more component adds
    longer = lambda v, x: F.concat(F.col(v), F.array(x))
    asked = items.select("item_id", longer("v", F.lit(1.0)).alias("v")).withColumnRenamed("item_id", "query_id")
    among = centres.select(F.col("cell_id").cast("long").alias("item_id"), longer("c", -dot("c", "c") / 2).alias("v"))
    near = meet_all(asked, among, "query_id", best("query_id", 1, slack=0.0), "query_id long, item_id long, score double")
    own = near.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("cell"))).alias("x"))
    placed = items.join(own.select(F.col("query_id").alias("item_id"), (-F.col("x.cell")).cast("int").alias("cell_id")), "item_id")
    return IvfIndex(stored(placed.select("item_id", "v", "cell_id")), stored(centres.select("cell_id", "c")))


def probed(centres: DataFrame, queries: DataFrame, by: str, probes: int) -> DataFrame:
    """The cells of each query's nearest centroids, in order: ``by, cell_id, r``."""
    centres = centres.select(F.col("cell_id").alias("item_id"), F.col("c").alias("v"))
    near = meet_all(queries, centres, by, best(by, probes), f"{by} long, item_id long, score double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "item_id")))
    return near.where(F.col("r") <= probes).select(by, F.col("item_id").cast("int").alias("cell_id"), "r")


def ivf_search(index: IvfIndex, queries: DataFrame, by: str, k: int, probes: int) -> DataFrame:
    """Neighbours among the cells of the ``probes`` centroids nearest to the query: an equi-join on the cell, in matrix products.

    Where all cells are probed every query meets every item of the index: the items pass by the
    queries, which are not repeated for each cell.
    """
    if probes >= index.centres.count():
        return knn(queries.select(by, "v"), index.placed.select("item_id", "v"), by, k)
    asked = probed(index.centres, queries, by, probes).select(by, "cell_id").join(queries.select(by, "v"), by)
    sizes = index.placed.groupBy("cell_id").agg(F.ceil(F.count("*") / CELL_ROWS).cast("long").alias("of"))
    held = index.placed.join(sizes, "cell_id").withColumn("block", F.pmod(F.xxhash64("item_id"), "of")).select("cell_id", "block", "item_id", "v")
    first = best(by, k)

    def meet(left, right):
        return first(left.column(by).to_numpy(), matrix(left.column("v")), right.column("item_id").to_numpy(), matrix(right.column("v")))

    found = dealt_meet(asked, held, ["cell_id"], by, meet, f"{by} long, item_id long, score double")
    return top_k(found.select(by, "item_id", F.round("score", 6).alias("score")), by, k)


def ivf_tune(index: IvfIndex, queries: DataFrame, items: DataFrame, by: str, k: int, recall: float = 0.95) -> tuple[int, DataFrame]:
    """The fewest probes with the wanted recall at ``k`` on ``queries``, and the recall by number of probes.

    One exact search gives the true neighbours. The place of a neighbour's cell among the
    query's centroids is the number of probes that finds it, so all numbers are judged at once.
    """
    cells = index.centres.count()
    exact = knn(queries, items, by, k).join(index.placed.select("item_id", "cell_id"), "item_id")
    found = exact.join(probed(index.centres, queries, by, cells), [by, "cell_id"]).groupBy(F.col("r").alias("probes")).agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("probes")) / F.sum("n").over(Window.partitionBy())
    curve = stored(found.withColumn("recall", share).select("probes", "recall"))  # a row for each number of probes
    row = curve.where(F.col("recall") >= recall).agg(F.min("probes")).first()
    return (row[0] or cells), curve


def lsh_search(queries: DataFrame, items: DataFrame, by: str, k: int, width: float = 1.0, tables: int = 6, seed: int = 3) -> DataFrame:
    """Best among the items that share a bucket of random projections; buckets meet in blocks, and only a block's best leave a task."""
    lsh = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed)
    model = lsh.fit(items.select(array_to_vector("v").alias("f")))
    hashed = lambda df, key: model.transform(df.withColumn("f", array_to_vector("v"))).select(key, F.posexplode(F.expr("h")).alias("t", "hv")).select(key, "t", vector_to_array("hv")[0].alias("b"))
    asked = hashed(queries, by).join(queries.select(by, "v"), by)
    held = hashed(items, "item_id").join(items.select("item_id", "v"), "item_id")
    held = stored(held.select("t", "b", "item_id", "v"))
    sizes = held.groupBy("t", "b").agg(F.ceil(F.count("*") / CELL_ROWS).cast("long").alias("of"))
    held = held.join(sizes, ["t", "b"]).withColumn("block", F.pmod(F.xxhash64("item_id"), "of")).select("t", "b", "block", "item_id", "v")
    first = best(by, k)

    def meet(left, right):
        return first(left.column(by).to_numpy(), matrix(left.column("v")), right.column("item_id").to_numpy(), matrix(right.column("v")))

    # a pair may share buckets of several tables
    found = dealt_meet(asked, held, ["t", "b"], by, meet, f"{by} long, item_id long, score double")
    found = found.groupBy(by, "item_id").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(found, by, k)


def recall_at_k(approximate: DataFrame, exact: DataFrame, by: str, k: int) -> DataFrame:
    """Mean share of the exact top ``k`` that the approximate top ``k`` holds."""
    a = approximate.where(F.col("rank") <= k).select(by, "item_id", F.lit(1.0).alias("hit"))
    e = exact.where(F.col("rank") <= k)
    per = e.join(a, [by, "item_id"], "left").groupBy(by).agg((F.sum(F.coalesce("hit", F.lit(0.0))) / F.count("*")).alias("r"))
    return per.agg(F.avg("r").alias("recall"), F.count("*").alias("queries"))


def index_config(sizes: DataFrame) -> DataFrame:
    """``n`` -> index kind, nlist, nprobe, m by the size of the catalog."""
    n = F.col("n")
    kind = F.when(n < 10_000, "flat").when(n < 100_000, "ivf_flat").otherwise("ivf_pq")
    return sizes.select(
        n.cast("long").alias("n"), kind.alias("kind"), F.floor(F.sqrt(n.cast("double"))).cast("long").alias("nlist"),
        F.when(n < 1_000_000, 32).otherwise(64).cast("long").alias("nprobe"), F.when(n < 1_000_000, 8).otherwise(16).cast("long").alias("m"),
    )


def index_memory(sizes: DataFrame, dim: int = 64, m: int = 8, nbits: int = 8) -> DataFrame:
    n = F.col("n").cast("double")
    return sizes.select(F.col("n").cast("long").alias("n"), (n * dim * 4 / 1e6).alias("flat_mb"), (n * m * nbits / 8 / 1e6).alias("pq_mb"))


def select_best(results: DataFrame, least_recall: float = 0.95) -> DataFrame:
    """Fastest index with enough recall, then the one of most recall; any, if none has enough."""
    enough = (F.col("recall") >= least_recall).cast("int")
    return results.orderBy(F.desc(enough), "latency_ms", F.desc("recall"), "name").limit(1)


def auto_cells(n: int) -> int:
    return max(1, math.isqrt(n))


def batched(ids: DataFrame, vectors: DataFrame, rows: int = 1024) -> DataFrame:
    """Vectors as they are exported: ``batch, place, item_id, v`` in the order of the ids' dense index."""
    index = dense_index(ids, "item_id", "idx").join(vectors, "item_id")
    return index.select(F.floor(F.col("idx") / rows).cast("long").alias("batch"), (F.col("idx") % rows).cast("long").alias("place"), "item_id", "v")


def training_subset(items: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows by a portable hash of the id."""
    return items.orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(most)
