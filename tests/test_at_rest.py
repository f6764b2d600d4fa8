"""Vectors in cells and boxes along a curve: the same rows as a full scan, from a part of the table."""

import random

import numpy as np
import pytest

from ledgerlark.operators import curve
from ledgerlark.operators.cells import CellIndex
from ledgerlark.operators.curve import BoxTable


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 4_000)] + rng.normal(size=(4_000, 16)) * 0.2
    return np.concatenate([x, x[:5]])


def test_cells_equal_a_scan_and_read_few(spark, tmp_path, matrix):
    rows = [(i, v.tolist(), "x", 3) for i, v in enumerate(matrix)] + [(-1, None, "x", 3), (-2, [1.0], "x", 3), (-3, [float("nan")] * 16, "x", 3)]
    CellIndex.build(spark.createDataFrame(rows, "id long, e array<double>, v string, cell int"), "id", "e", f"file://{tmp_path}/m", 16)
    index = CellIndex(spark, f"file://{tmp_path}/m")
    for q in (matrix[7], matrix[3_999] * 10, np.ones(16), np.zeros(16), -matrix[0]):
        want = sorted(((float(s), i) for i, s in enumerate(matrix @ q)), key=lambda r: (-r[0], r[1]))[:25]
        got = [(r["similarity"], r["key"]) for r in index.top(q.tolist(), 25).collect()]
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]
        assert {k for _, k in got} >= {k for s, k in want if s > want[-1][0] + 1e-9}
    q = matrix[7].tolist()
    assert len(index.needed(q, 25)) < len(index.bounds(q)) / 4
    assert len(index.top(q, 10**6).collect()) == len(matrix)
    plan = index._scored(index.needed(q, 25), q)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(cell" in plan


def test_cells_of_an_empty_table(spark, tmp_path):
    CellIndex.build(spark.createDataFrame([], "id long, e array<float>"), "id", "e", f"file://{tmp_path}/m", 4)
    assert CellIndex(spark, f"file://{tmp_path}/m").top([1.0, 0.0, 0.0, 0.0]).collect() == []


def test_window_ranges_cover_windows():
    rng = random.Random(1)
    z = lambda x, y: sum(((x >> i & 1) << (2 * i)) | ((y >> i & 1) << (2 * i + 1)) for i in range(6))
    for _ in range(200):
        xs, ys = sorted(rng.choices(range(64), k=2)), sorted(rng.choices(range(64), k=2))
        ranges = curve.window_ranges(tuple(xs), tuple(ys), 6, 5)
        assert len(ranges) <= 5 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        assert all(any(lo <= z(x, y) <= hi for lo, hi in ranges) for x in range(xs[0], xs[1] + 1) for y in range(ys[0], ys[1] + 1))


def test_boxes_equal_a_scan_and_skip_files(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(6_000):
        w, s = rng.uniform(-180, 175), rng.uniform(-90, 85)
        size = rng.choice((0.0, 1e-6, 0.01, 0.5, 5.0, 200.0))
        rows.append((i, w, s, w + size * rng.random(), s + size * rng.random(), 1, "x"))
    rows += [(9_001, None, 0.0, 1.0, 1.0, 1, "x"), (9_002, 5.0, 5.0, 4.0, 6.0, 1, "x"), (9_003, float("nan"), 0.0, 1.0, 1.0, 1, "x"), (9_004, -500.0, -500.0, 500.0, 500.0, 1, "x"), (9_005, 10.0, 10.0, 10.0, 10.0, 1, "x")]
    table = BoxTable(spark, f"file://{tmp_path}/b", (-180.0, -90.0, 180.0, 90.0))
    table.write(spark.createDataFrame(rows, "id long, w double, s double, e double, n double, kind int, key string"), "id", 300)
    fine = [r for r in rows if r[1] is not None and r[1] == r[1] and r[1] <= r[3] and r[2] <= r[4]]
    for q in [(10.0, 10.0, 10.0, 10.0), (-3.5, 50.1, -3.4, 50.2), (-180.0, -90.0, 180.0, 90.0), (170.0, 80.0, 400.0, 95.0), (0.0, 0.0, 0.0, 0.0), *[(r[1], r[2], r[1] + 0.3, r[2] + 0.2) for r in rows[:6]]]:
        want = sorted(i for i, w, s, e, n, *_ in fine if w <= q[2] and e >= q[0] and s <= q[3] and n >= q[1])
        assert sorted(r["key"] for r in table.meeting(*q).collect()) == want
    df = table.holding(10.0, 10.0)
    assert 9_005 in {r["key"] for r in df.collect()}
    scans = [s for s in df._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in s]
    assert scans and "Or(" in scans[0]
    assert table.boxes().count() == len(fine)
    # wide boxes are near to everything; of the small ones few are read
    small = table.boxes().where("kind < 14")
    assert small.where(table.near(10.0, 10.0, 10.1, 10.1)).count() < small.count() / 20
