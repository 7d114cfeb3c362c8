import random

import brute
import numpy as np
import pytest
from lumenrec.llm import linking
from lumenrec.llm.jaccard_join import listed
from lumenrec.llm.textops import mix
from pyspark.sql import functions as F


@pytest.mark.parametrize("many", [0, 1e9])
@pytest.mark.parametrize("kind", ["plain", "placed", "listed"])
def test_components_of_all_bucket_pairs(spark, tmp_path, monkeypatch, many, kind):
    """With as many pivots as allowed, or none beyond the first, all links within buckets count."""
    monkeypatch.setattr(linking, "MANY_PAIRS", many)
    rng = random.Random(2)
    sets = {}
    for k in range(300):
        core = set(range(40)) if k < 200 else set(range(1000 + k % 9 * 50, 1040 + k % 9 * 50))
        sets[k] = (core - set(rng.sample(sorted(core), rng.randint(0, 7)))) | {rng.randrange(10_000, 10_300) for _ in range(rng.randint(0, 5))}
    order = lambda s: sorted(s, key=lambda x: -x)
    prefix = lambda s: order(s)[: len(s) - -(-80 * len(s) // 100) + 1]
    plain = lambda k, s: (k, len(s), prefix(s) if kind == "placed" else sorted(s))
    more = {"plain": lambda s: (), "placed": lambda s: (len(prefix(s)), bits(s)), "listed": lambda s: ()}[kind]
    columns = ", placed int, bits array<long>" * (kind == "placed")
    bits = lambda s: linking.parity(np.array(sorted(s), np.uint64), np.array([len(s)]))[0].tolist()
    hashed = lambda s: np.sort(mix(np.array(sorted(s), np.uint64))).view(np.int64).tolist()
    whole = brute.stored(spark, tmp_path, [(k, hashed(s)) for k, s in sets.items()], "id long, items array<long>")
    members = brute.stored(spark, tmp_path, [plain(k, s) + more(s) for k, s in sets.items()], "id long, n long, keys array<long>" + columns)
    items = brute.stored(spark, tmp_path, [(k, sorted(s)) for k, s in sets.items()], "id long, items array<int>")

    def verify(pairs):
        x = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return x.where(100 * both >= 80 * (F.size("x") + F.size("y") - both)).select("a", "b")

    got = {r["id"]: r["component"] for r in linking.bucket_components(members, verify, 80, (lambda ids: listed(whole.join(ids, "id", "left_semi"), lambda x: x, 80)) if kind == "listed" else None).collect()}
    want = brute.components(sets, brute.jaccard_links(sets))
    assert {k: got.get(k, k) for k in sets} == want
    assert len(set(want.values())) > 20


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(3)
    for size in (0, 1, 30, 400, 5000):
        base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for extra in (0, 1, 20, 300):
            other = np.union1d(base[extra // 2 :], rng.integers(0, 1 << 63, extra).astype(np.uint64))
            rows = linking.parity(np.concatenate([base, other]), np.array([len(base), len(other)]))
            differ = sum(int(x).bit_count() for x in (rows[0] ^ rows[1]).view(np.uint64))
            assert rows.shape == (2, linking.PARITY_BITS // 64) and differ <= len(np.setxor1d(base, other))
            assert differ > 0 or not len(np.setxor1d(base, other))
