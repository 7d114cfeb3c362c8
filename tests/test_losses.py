import numpy as np
import pytest

from lumenrec.functions import blocks
from lumenrec.operators import metrics as M


def test_hardest_of_a_batch_without_a_sort_of_all(spark, monkeypatch):
    """Against numpy, through the stream of items; a whole row of products is never sorted."""
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(2, 400, 6))
    batch = spark.createDataFrame([(i, u[i].tolist(), v[i].tolist()) for i in range(400)], "id long, u array<double>, v array<double>")
    s = u @ v.T
    own = np.diag(s).copy()
    np.fill_diagonal(s, -np.inf)
    hard = -np.sort(-s, axis=1)[:, :10]
    wanted = np.maximum(0.0, 0.2 + hard - own[:, None]).mean()
    calls = []
    once = M.meet_best
    monkeypatch.setattr(M, "meet_best", lambda *a, **k: calls.append(1) or once(*a, **k))
    for small in (0, blocks.SMALL_ROWS):
        assert M.in_batch_hard_negatives(batch, small=small).first()["loss"] == pytest.approx(wanted, abs=1e-9)
    assert len(calls) == 2
