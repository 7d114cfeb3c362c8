import random
import re
from collections import Counter

import pytest
from brute import lower, stored

from lumenrec.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top):
    docs = [((r[1] or ""), (r[2] or ""), TERM.findall(lower(r[0] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: B023
        total = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(sum(abs(share(c, t) - share(counts[o], t)) for t in kept), o) for o in counts if o != s]
            terms = [(share(c, t) - share(total, t), t) for t in kept if c[t] and share(c, t) > share(total, t)]
            for part, values, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n=400, sources=9):
    rng = random.Random(seed)
    common, rare = [f"w{chr(97 + i)}" for i in range(12)], [f"é{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = []
    for i in range(n):
        s = rng.randrange(sources) if rng.random() < 0.7 else 0
        words = [rng.choice(common) for _ in range(rng.randrange(20))] + [rare[(s * 9 + rng.randrange(12)) % len(rare)].upper() for _ in range(rng.randrange(8))]
        rows.append((" ".join(words) + " 12 x_y", rng.choice(["en", "de", None]), f"s{s}" if s else None, "clash"))
    return rows + [(None, "en", "bare", "x"), ("", "fr", "alone", "y"), ("", "fr", "other", "y"), rows[0], rows[0]]


@pytest.mark.parametrize("block,cost", [(256, 16), (4, 16), (4, 10**9), (256, 0)])
def test_equals_plain_sums(spark, tmp_path, block, cost):
    """All terms dense, all sparse, and both; one block of groups and several."""
    sizes = D.Sizes(pair_cost=cost, tile=40, block=block, dense=3, pairs=100)
    rows = corpus(3)
    got = D.audit(stored(spark, tmp_path, rows, "text string, lang string, source string, term string"), 5, 4, sizes)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 4)


def test_many_kept_terms_and_no_rows(spark, tmp_path):
    rows = corpus(4, 150)
    got = D.audit(stored(spark, tmp_path, rows, "text string, lang string, source string, term string"), 5, 4, D.Sizes(known_terms=3, entries=20))
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 4)
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (0, 10**14, 7), (10**14, 10**14, 1), (12345678, 98765432109, 54321), (7, 7, 1)]
    got = spark.createDataFrame(cases, "n long, t long, v long")
    from pyspark.sql import functions as F

    assert [r[0] for r in got.select(D.share(F.col("n"), F.col("t"), F.col("v"))).collect()] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]
