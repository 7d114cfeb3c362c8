"""From bucket memberships to verified links and components, without all pairs of a bucket.

Three operators find candidates by bucket (inverted lists, bands of signatures). A bucket may
hold thousands of near copies, so pairs are made in rounds:

1. every member is paired with its bucket's smallest id. Of these pairs each member's first is
   verified, then those that still lie across components. A group of k copies costs about k
   pairs, not k * k. Buckets of two are settled by their one pair and are not looked at again;
2. in buckets of three and more whose members lie in several components, and as long as their
   pairs across components are many, one further member of each bucket, drawn by a hash, is
   paired with the members of the other components;
3. what is left of the pairs across components is verified too. Pairs within a component need
   no test: they cannot change the components.

Together they give the exact components of the graph of all verified bucket pairs.

Near copies that differ too much from one another are many in a large group, and share most of
their bands. Operators whose buckets are bands therefore hand the members that stay unsettled
after round 1 over to inverted lists (``jaccard_join.listed``), which find every link among
them, so bucket pairs are not made at all. Inverted lists know the places of their entries
(``Places``): by sizes and places alone most members of a list cannot be linked. Round 3 deals
a list out by ranges of sizes and drops the members whose place is too late for a range, before
any pair is made. Texts that share a passage share a run of entries one after another; such a
pair is made at the first entry of the run only. Pairs are then held against parity bitmaps of
their sets (``parity``), 64 bytes a set, before any longer list or whole set is fetched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize, restrict
from .textops import mix

Verify = Callable[[DataFrame], DataFrame]
#: Further pivots are drawn while the pairs across components outnumber the members by this factor, at most so often.
MANY_PAIRS, PIVOT_ROUNDS = 256, 4
#: Ratio of the largest size of a range to its smallest.
SIZE_RANGE = 1.05
PARITY_BITS = 512


def parity(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of ``PARITY_BITS`` bits, as longs, for each set of hashes: whether an odd number of its elements falls on a bit.

    ``items`` holds the distinct elements of all sets one after another. An element that two
    sets do not share flips one bit, so their rows differ in no more bits than the sets in
    elements.
    """
    bit = (mix(items ^ np.uint64(0xB17)) % np.uint64(PARITY_BITS)).astype(np.int64)
    cells = np.repeat(np.arange(len(sizes)), sizes) * PARITY_BITS + bit
    odd = np.bincount(cells, minlength=len(sizes) * PARITY_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sizes), PARITY_BITS), axis=1).view(np.int64)


class Places:
    """Which members of a list can be linked, by sizes and 1-based places in one order of all elements (0: no place).

    Sets of sizes n and m are linked if they share ``percent * (n + m) / (100 + percent)``
    elements, so their first common element leaves room for the others behind it in both.
    """

    def __init__(self, percent: int):
        self.percent = percent

    def _room(self, n: Column, place: Column) -> Column:
        return n - place + (place > 0).cast("int")

    def need(self, n: Column, m: Column) -> Column:
        return F.ceil(self.percent * (n + m) / (100 + self.percent))

    def differing(self, n: Column, m: Column) -> Column:
        """The most elements that linked sets do not share."""
        return n + m - 2 * self.need(n, m)

    def possible(self) -> Column:
        n, m = F.col("n_a"), F.col("n_b")
        fits = 100 * F.least(n, m) >= self.percent * F.greatest(n, m)
        return fits & (F.least(self._room(n, F.col("place_a")), self._room(m, F.col("place_b"))) >= self.need(n, m))

    def dealt(self, members: DataFrame, smaller: bool) -> DataFrame:
        """``members`` as the smaller (or larger) of a pair: once for each pair of ranges ``lo``, ``hi`` where a link is possible."""
        reach = math.ceil(math.log(100 / self.percent) / math.log(SIZE_RANGE)) + 1
        n, step = F.col("n"), F.col("step") if smaller else -F.col("step")
        own = F.floor(F.log(n.cast("double")) / math.log(SIZE_RANGE)).cast("int")
        spread = members.withColumn("own", own).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(reach)))).withColumn("other", F.col("own") + step)
        # the smallest partner in the range asks for the fewest common elements
        least = F.greatest(F.floor(F.pow(F.lit(SIZE_RANGE), F.col("other")) * (1 - 1e-9)), n if smaller else F.ceil(self.percent * n / 100))
        spread = spread.where(self._room(n, F.col("place")) >= self.need(n, least))
        lo, hi = ("own", "other") if smaller else ("other", "own")
        return spread.select("key", F.col(lo).alias("lo"), F.col(hi).alias("hi"), *_side(members, "a" if smaller else "b"))


def _side(rows: DataFrame, side: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{side}") for c in rows.columns if c in ("id", "n", "place", "before", "same", "component")]


def _by_id(pairs: DataFrame, kept: list[str]) -> DataFrame:
    """Distinct pairs ``a < b`` with what is kept of them."""
    first = F.col("id_a") < F.col("id_b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    sides = [pick(f"{c}_{x}", f"{c}_{y}", f"{c}_{x}") for c in kept for x, y in ("ab", "ba")]
    pairs = pairs.where("id_a <> id_b").select(pick("id_a", "id_b", "a"), pick("id_b", "id_a", "b"), *sides)
    return pairs.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in pairs.columns[2:]))


def bucket_components(members: DataFrame, verify: Verify, percent: int, lists: Verify | None = None) -> DataFrame:
    """``members(id, n, keys array<long>, ..)`` -> ``(id, component)`` of ids with at least one link.

    ``keys`` are an id's distinct buckets. Further columns: ``placed int``, where ``n`` is the
    size of the set and the first ``placed`` keys stand at places 1, 2 .. of it, with ``bits
    array<long>``, its ``parity``; ``same``, equal for members that are linked without a look. ``verify`` gets ``(a, b)`` with ``n_a, n_b`` or
    ``same_a, same_b`` and returns the ``(a, b)`` that are links. ``lists`` gets the ``id`` that
    stay unsettled after the first round and returns them as members of inverted lists, to be
    linked by the same ``verify``. Buckets are counted with partial sums before their shuffle,
    and adaptive execution splits the joins with them where one key is hot.
    """
    members = materialize(members)
    placed = "placed" in members.columns
    kept = ["same"] if "same" in members.columns else ["n"]
    carried = [*kept, *(["place"] if placed else [])]
    rows = members.select("id", *(c for c in ("n", "placed", "same") if c in members.columns), F.posexplode("keys").alias("at", "key"))
    if placed:
        rows = rows.withColumn("place", F.when(F.col("at") < F.col("placed"), F.col("at") + 1).otherwise(0).cast("int"))
    rows = rows.select("key", "id", *carried)
    places = Places(percent) if placed else None
    possible = places.possible() if placed else F.lit(True)

    ends = [f("id").alias(f"id_{s}") for f, s in ((F.min, "a"), (F.max, "b"))]
    ends += [f(c, "id").alias(f"{c}_{s}") for f, s in ((F.min_by, "a"), (F.max_by, "b")) for c in carried]
    buckets = materialize(rows.groupBy("key").agg(F.count("*").alias("members"), *ends).where("id_a < id_b"))
    shared = materialize(restrict(rows, buckets.where("members > 2").select("key"), "key"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that share enough of their placed keys: what is shared up to the first of the two last ones is shared by both."""
        if not placed:
            return pairs
        bits = members.select("id", "bits").dropDuplicates(["id", "bits"])
        near = pairs.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
        differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
        pairs = materialize(near.where(differ <= places.differing(F.col("n_a"), F.col("n_b"))).select(*pairs.columns).dropDuplicates(["a", "b"]))
        ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        own = materialize(restrict(members, ids, "id").select("id", F.slice("keys", 1, F.col("placed")).alias("keys")))
        both = pairs.join(own.select(F.col("id").alias("a"), F.col("keys").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("keys").alias("y")), "b")
        behind = F.greatest(*(F.ceil(percent * F.col(n) / 100) - 1 for n in ("n_a", "n_b")))
        enough = F.size(F.array_intersect("x", "y")) >= places.need(F.col("n_a"), F.col("n_b")) - behind
        return both.where((F.size("x") == 0) | (F.size("y") == 0) | enough).select(*pairs.columns).dropDuplicates(["a", "b"])

    pivots = buckets.where("members > 2").select("key", *(f"{c}_a" for c in ["id", *carried]))
    star = pivots.join(shared.select("key", *_side(shared, "b")), "key").where("id_a <> id_b")
    pairs = buckets.where("members = 2").select(*star.columns).unionByName(star)
    tested = materialize(likely(materialize(_by_id(pairs.where(possible), kept))))
    # a member's first pair settles most members; of its other pairs those are left that still lie across components
    first = materialize(tested.groupBy("b").agg(F.min("a").alias("a"), *(F.min_by(c, "a").alias(c) for c in tested.columns[2:])).select(*tested.columns))
    labels = materialize(connected_components(materialize(verify(first))))

    def stars() -> DataFrame:
        return labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))

    side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))
    rest = tested.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b"))
    rest = materialize(rest.select(*tested.columns).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    links = materialize(verify(rest))
    if not links.isEmpty():
        labels = materialize(connected_components(stars().unionByName(links.select("a", "b"))))

    def unsettled() -> DataFrame:
        """Members of the buckets with several components."""
        named = shared.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        torn = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return materialize(named.join(torn, "key", "left_semi"))

    if lists:
        # of those that are the same, and so in one component already, one will do
        ids = unsettled()
        ids = materialize((ids.groupBy("same").agg(F.min("id").alias("id")) if "same" in kept else ids).select("id").distinct())
        if ids.isEmpty():
            return labels
        apart = [F.lit(i).cast("long").alias(f"same_{s}") for i, s in enumerate("ab")]
        found = bucket_components(lists(ids), lambda pairs: verify(pairs.select("a", "b", *apart)), percent)
        return connected_components(stars().unionByName(found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))))

    def fresh(pairs: DataFrame) -> DataFrame:
        return materialize(likely(materialize(_by_id(pairs, kept).join(tested.select("a", "b"), ["a", "b"], "left_anti"))))

    for attempt in range(PIVOT_ROUNDS + 1):
        torn = unsettled()
        sums = torn.groupBy("key", "component").count().groupBy("key").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("q"))
        size = sums.agg(F.sum("m").alias("members"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs")).first()
        if not size["members"]:
            return labels
        if attempt == PIVOT_ROUNDS or size["pairs"] <= MANY_PAIRS * size["members"]:
            break
        drawn = torn.groupBy("key").agg(F.min_by(F.struct(*_side(torn, "a")), F.xxhash64("component", F.lit(attempt))).alias("pivot"))
        across = drawn.select("key", "pivot.*").join(torn.select("key", *_side(torn, "b")), "key").where((F.col("component_a") != F.col("component_b")) & possible)
        more = fresh(across)
        tested = tested.unionByName(more)
        links = materialize(verify(more))
        if not links.isEmpty():
            labels = materialize(connected_components(stars().unionByName(links.select("a", "b"))))

    if placed:
        # the entry of the same set one place before; a run of common entries makes its pair at the first
        earlier = Window.partitionBy("id", "n").orderBy("place")
        next_to = (F.col("place") > 1) & (F.lag("place").over(earlier) == F.col("place") - 1)
        torn = materialize(torn.withColumn("before", F.when(next_to, F.lag("key").over(earlier))))
        left, right, on = places.dealt(torn, True), places.dealt(torn, False), ["key", "lo", "hi"]
        once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
        once &= F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
    else:
        left, right, on = torn.select("key", *_side(torn, "a")), torn.select("key", *_side(torn, "b")), ["key"]
        once = F.col("id_a") < F.col("id_b")
    across = left.join(right, on).where(once & (F.col("component_a") != F.col("component_b")) & possible)
    links = materialize(verify(fresh(across)))
    if links.isEmpty():
        return labels
    return connected_components(stars().unionByName(links.select("a", "b")))
