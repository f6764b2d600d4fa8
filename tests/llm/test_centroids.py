"""Centroid clustering against Python's integers, row by row."""

import hashlib
import math

import numpy as np
import pyarrow as pa

from ledgerlark.llm import centroids as C
from ledgerlark.llm import queries as q


def plain(rows, k=16, rounds=3, dims=64):
    """{place of the row: (cluster, distance)}, centroids."""
    kept = [(i, [int(x) * 64 if abs(x) >= 2**53 else math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), n in zip(kept, own) if n == c] for c in range(len(at))]
        at = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, at)]
    return sorted(((i if i is not None else -1), *near(v)[::-1]) for i, v in kept), at


def seen(got):
    return sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["cluster"], r["distance"]) for r in got)


def test_op13_equals_the_plain_version(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, at = plain(rows)
    got = q.op13(spark, sf).collect()
    assert seen(got) == want
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    assert all(r["centroid_sha256"] == digest[r["cluster"]] for r in got)
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}
    assert all(r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) for r in got)


def test_screening_meets_ties_and_close_calls():
    rng = np.random.default_rng(5)
    # distances differ by units where float32 products are off by thousands
    base = rng.integers(-(2**24), 2**24, 64)
    cents = [list(map(int, base + np.eye(64, dtype=np.int64)[i % 4] * (i // 4))) for i in range(24)]
    c = C.Centroids(cents)
    x = base + rng.integers(-3, 4, (500, 64))
    best, far = c.nearest(x)
    for row, b, d in zip(x.tolist(), best.tolist(), far.tolist()):
        assert (d, b) == min((sum((p - q) ** 2 for p, q in zip(row, k)), i) for i, k in enumerate(cents))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    one = [0.5] * 64
    rows = [(1, one), (1, one), (2, None), (3, []), (4, [0.1] * 63), (5, [nan, *one[1:]]), (6, [inf, *one[1:]]), (7, [None, *one[1:]]), (8, [-0.01] * 64), (None, [0.3] * 64), (9, [1e30, *one[1:]]), (10, [-1e7] * 64)]
    df = spark.createDataFrame([(i, v, "x", 7, 1) for i, v in rows], "vec_id long, embedding array<float>, id string, cluster long, v int")
    import struct

    single = [(i, v and [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    want, _ = plain(single)
    got = C.cluster_vectors(df).collect()
    assert seen([r for r in got if r["vec_id"] != 9]) == [w for w in want if w[0] != 9]
    assert len(got) == 6  # the long ones too
    assert C.cluster_vectors(df.limit(0)).collect() == []
    assert C.cluster_vectors(df.where("vec_id in (2, 3, 4)")).collect() == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**40 * (i % 3) + i)] * 64) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = C.cluster_vectors(df, k=3).collect()
    want, _ = plain(rows, k=3)
    assert [(i, c) for i, c, _ in seen([dict(r.asDict(), distance=0) for r in got])] == [(i, c) for i, c, _ in want]
    assert all(r["distance"] == d for r, (_, _, d) in zip(sorted(got, key=lambda r: r["vec_id"]), want) if d < 2**63)
    huge = spark.createDataFrame([(i, [1e300 * (i + 1)] * 64) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r["distance"] for r in C.cluster_vectors(huge, k=2).collect()} <= {None, 0}


def test_sums_of_limbs():
    (batch,) = C._sums(iter([pa.RecordBatch.from_arrays([pa.array([[1.5, -2.0**50], [-0.25, 3.0], [2.0**45, -7.5]])], names=["v"])]), C.Centroids([[0, 0]]), 64, 2)
    total = {}
    for r in batch.to_pylist():
        total[r["position"]] = total.get(r["position"], 0) + (r["part"] << (40 * r["limb"]))
    assert total == {-1: 3, 0: 96 - 16 + 2**51, 1: -(2**56) + 192 - 480}
