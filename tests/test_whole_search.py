from test_vectors import asked, stored_items  # noqa: F401

from lumenrec.operators import compressed as Z
from lumenrec.operators import retrieval as R


def rows(df):
    return {(r["user_id"], r["item_id"], r["score"], r["rank"]) for r in df.collect()}


def refuse(*_args, **_kw):
    raise AssertionError("a request for each query and cell")


def test_all_cells_make_no_requests(stored_items, monkeypatch):  # noqa: F811
    index = R.ivf_build(stored_items, 12)
    want = rows(R.knn(asked(stored_items), stored_items, "user_id", 10))
    monkeypatch.setattr(R, "dealt_meet", refuse)
    assert rows(R.ivf_search(index, asked(stored_items), "user_id", 10, 12)) == want


def test_all_candidates_make_no_pairs(stored_items, monkeypatch):  # noqa: F811
    index = Z.build(stored_items, 12)
    want = rows(R.knn(asked(stored_items), stored_items, "user_id", 10))
    some = rows(R.ivf_search(R.IvfIndex(stored_items.join(index.members(), "item_id"), index.centres), asked(stored_items), "user_id", 10, 3))
    monkeypatch.setattr(Z, "candidates", refuse)
    assert rows(Z.search(index, asked(stored_items), stored_items, "user_id", 10, 12, 700)) == want
    assert rows(Z.search(index, asked(stored_items), stored_items, "user_id", 10, 3, 700)) == some
