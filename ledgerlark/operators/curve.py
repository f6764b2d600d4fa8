"""Boxes and points at rest along a space-filling curve (J-3, Q-5, P-6).

A box is stored under its class (the power of two of cells that its longer side
spans) and the Morton number of its middle, in that order.  A box of a class
that holds a point has its middle within that class's reach of the point, so a
point, or a query box, is a window for each class; the window is cut into a few
ranges of Morton numbers, which reach the scan as filters that skip files and
row groups.  The exact test follows.  A point at rest is a box of no size.

A table without rows gives none; boxes with a null or non-finite side, or whose
east or north lies before its west or south, hold nothing and are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.logic import any_of

#: Bits of a coordinate; classes are 0 to BITS.
BITS = 20
#: Ranges into which the windows of all classes are cut.
RANGES = 64
PAGE_ROWS = 4_096
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def morton(x: Column, y: Column) -> Column:
    """The bits of two whole numbers (up to 31 bits) in turn, those of y above."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for by, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def window_ranges(x: tuple[int, int], y: tuple[int, int], bits: int = BITS, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of Morton numbers (ends included) that cover a window of cells; with more than ``most`` of them the nearest are joined."""
    out: list[tuple[int, int]] = []

    def cut(z: int, level: int, qx: int, qy: int) -> None:
        side = 1 << level
        if qx > x[1] or qx + side - 1 < x[0] or qy > y[1] or qy + side - 1 < y[0]:
            return
        inside = qx >= x[0] and qx + side - 1 <= x[1] and qy >= y[0] and qy + side - 1 <= y[1]
        if inside or level <= floor:
            lo, hi = z << (2 * level), ((z + 1) << (2 * level)) - 1
            if out and out[-1][1] == lo - 1:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
            return
        for i in range(4):
            cut(z * 4 + i, level - 1, qx + (i & 1) * side // 2, qy + (i >> 1) * side // 2)

    # Squares smaller than a sixteenth of the window's longer side are not cut further.
    floor = max(0, max(x[1] - x[0], y[1] - y[0], 1).bit_length() - 5)
    cut(0, bits, 0, 0)
    while len(out) > most:
        i = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[i : i + 2] = [(out[i][0], out[i + 1][1])]
    return out


@dataclass
class BoxTable:
    """A written table; ``bounds``: west, south, east, north of the space (what lies outside counts as its edge)."""

    spark: SparkSession
    path: str
    bounds: tuple[float, float, float, float]

    def _cell(self, v: Column, axis: int) -> Column:
        lo, hi = self.bounds[axis], self.bounds[axis + 2]
        return F.least(F.greatest(F.floor((v - lo) / (hi - lo) * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")

    def _whole(self, v: float, axis: int) -> int:
        lo, hi = self.bounds[axis], self.bounds[axis + 2]
        return min(max(math.floor((v - lo) / (hi - lo) * (1 << BITS)), 0), (1 << BITS) - 1)

    def write(self, boxes: DataFrame, key: str, rows_of_file: int = 1_000_000) -> None:
        """``boxes``: the key and w, s, e, n."""
        sides = [F.col(c).cast("double").alias(c) for c in "wsen"]
        fine = F.forall(F.array(*"wsen"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        x = boxes.select(F.col(key).alias("key"), *sides).where(fine).where("w <= e and s <= n")
        wide = F.greatest(self._cell(F.col("e"), 0) - self._cell(F.col("w"), 0), self._cell(F.col("n"), 1) - self._cell(F.col("s"), 1))
        # A class reaches as far as its widest box: 0, 1, 2, 4, ... cells.
        kind = F.when(wide == 0, 0).otherwise(F.ceil(F.log2(wide.cast("double"))) + 1).cast("int")
        middle = [F.shiftright(self._cell(F.col(a), i) + self._cell(F.col(b), i), 1) for i, (a, b) in enumerate((("w", "e"), ("s", "n")))]
        x = x.withColumn("kind", kind).withColumn("at", F.shiftleft(F.col("kind").cast("long"), 2 * BITS) + morton(*middle))
        n = x.count()
        placed = x.repartitionByRange(max(1, -(-n // rows_of_file)), "at").sortWithinPartitions("at")
        placed.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/boxes")
        self.boxes().select("kind").distinct().coalesce(1).write.parquet(f"{self.path}/kinds")

    def boxes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/boxes")

    def near(self, w: float, s: float, e: float, n: float) -> Column:
        """A filter on places: what it leaves out shares no point with a query box."""
        kinds = [r["kind"] for r in self.spark.read.parquet(f"{self.path}/kinds").collect()]  # at most BITS + 2
        x, y = (self._whole(w, 0), self._whole(e, 0)), (self._whole(s, 1), self._whole(n, 1))
        last = (1 << BITS) - 1
        ranges = []
        for k in kinds:
            reach = (1 << (k - 1)) // 2 + 1 if k else 0
            spans = [(max(0, lo - reach), min(last, hi + reach)) for lo, hi in (x, y)]
            base = k << (2 * BITS)
            ranges += [(base + lo, base + hi) for lo, hi in window_ranges(*spans, most=max(1, RANGES // len(kinds)))]
        return any_of(F.col("at").between(lo, hi) for lo, hi in ranges)

    def meeting(self, w: float, s: float, e: float, n: float) -> DataFrame:
        """key, w, s, e, n of the boxes that share a point with a query box, edges included."""
        hit = (F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s)
        return self.boxes().where(self.near(w, s, e, n)).where(hit).select("key", "w", "s", "e", "n")

    def holding(self, x: float, y: float) -> DataFrame:
        """P-6: the boxes that hold a point."""
        return self.meeting(x, y, x, y)
