"""The forest at depth, in dense groups, and against all pairs."""

import numpy as np
import pytest

from ledgerlark.llm import rp_forest


def _links(x):
    x = x.astype(np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    return x @ x.T >= rp_forest.THRESHOLD


def _components(near):
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(1)
        if (least == label).all():
            return label
        label = least


@pytest.mark.parametrize("fit_rows", [200, 65_536])
def test_buckets_are_dealt_again_to_any_depth(spark, monkeypatch, fit_rows):
    for name, value in (("BUCKET_AIM", 60), ("BUCKET_ROWS", 120), ("LEAF_ROWS", 40), ("FIT_ROWS", fit_rows), ("_FEW", 20)):
        monkeypatch.setattr(rp_forest, name, value)
    r = np.random.default_rng(5)
    base = r.normal(size=(120, 24))
    x = np.concatenate([b + r.normal(size=(10, 24)) * s for b, s in zip(base, np.linspace(0.05, 0.4, 120))] + [r.normal(size=(600, 24))]).astype(np.float32)
    got = {g["vec_id"]: g for g in rp_forest.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), trees=12).collect()}
    near = _links(x)
    n, found = near.sum(1) - 1, np.array([got[i]["n_links"] for i in range(len(x))])
    assert len(got) == len(x) and (found <= n).all() and found.sum() >= 0.95 * n.sum() > 0
    wrong = sum(got[i]["component_id"] != c for i, c in enumerate(_components(near)))
    assert wrong <= 0.03 * len(x)


def test_a_length_of_one_bucket_equals_all_pairs(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([np.repeat(r.normal(size=(30, 8)), 20, axis=0) + r.normal(size=(600, 8)) * 0.2, r.normal(size=(200, 8))]).astype(np.float32)
    got = {g["vec_id"]: g for g in rp_forest.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    near = _links(x)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == list(zip((near.sum(1) - 1).tolist(), _components(near).tolist()))


def test_a_dense_bucket_gives_a_row_for_each_vector_and_little_memory():
    """Of 6,000 vectors that all link, 18 million pairs stay inside blocks."""
    import tracemalloc

    r = np.random.default_rng(3)
    x = np.ones((6_000, 16)) + r.normal(size=(6_000, 16)) * 0.05
    x /= np.sqrt((x * x).sum(1))[:, None]
    own = np.arange(len(x))
    tracemalloc.start()
    far, least = rp_forest.compare(x, np.ones(len(x), np.int64), [(8, own)], np.full(len(x), 8), np.arange(len(x) + 1))
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert (far == len(x) - 1).all() and not least.any()


def test_a_pair_is_counted_in_its_first_common_leaf_only():
    x = np.array([[1.0, 0.0], [1.0, 0.01], [1.0, 0.02]])
    held = [[3, 5], [3, 5], [5]]
    ids, at = np.array(sum(held, [])), np.array([0, 2, 4, 5])
    m = np.array([1, 2, 4])
    first = rp_forest.compare(x, m, [(3, np.array([0, 1]))], ids, at)[0]
    then = rp_forest.compare(x, m, [(5, np.array([0, 1, 2]))], ids, at)[0]
    assert first.tolist() == [2, 1, 0] and then.tolist() == [4, 4, 3] and (first + then).tolist() == [6, 5, 3]


def test_a_dense_group_larger_than_a_leaf_is_counted_whole(spark, monkeypatch):
    for name, value in (("BUCKET_AIM", 700), ("BUCKET_ROWS", 1400), ("LEAF_ROWS", 60)):
        monkeypatch.setattr(rp_forest, name, value)
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=32) + r.normal(size=(500, 32)) * 0.15, r.normal(size=(1500, 32))]).astype(np.float32)
    got = {g["vec_id"]: g["n_links"] for g in rp_forest.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    n = _links(x).sum(1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum() and n[:500].mean() > 300
