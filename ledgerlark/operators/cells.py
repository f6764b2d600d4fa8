"""The nearest vectors of a stored matrix, exactly, from few of its cells (O-1, S-18, Q-2).

Vectors are dealt to the nearest of a set of centres and written in order of
their cell, with each cell's radius.  No vector of a cell has a dot product with
a query beyond the centre's plus the radius times the query's length.  A query
reads the cells of the highest bounds until they hold enough vectors; what these
score is a bound, and only cells that can reach it are read after that, as a
filter on the cell that files and row groups are skipped by.

Centres are fitted on a sample of at most ``SAMPLE`` rows and there are at most
``MOST_CELLS`` of them, so what the driver holds is bounded; every vector is
stored and the answer is that of a full scan.  Vectors that are null, of another
length, or hold null or non-finite components are left out; repeated keys are
vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.functions.logic import any_of
from ledgerlark.operators.retrieval import cosine

SAMPLE, MOST_CELLS, ROUNDS = 1 << 16, 1 << 14, 6
#: Rows of a parquet page.
PAGE_ROWS = 1_024
#: Runs of cells that are filters of their own; more are listed.
MOST_RUNS = 100


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by a few rounds of means, from a fixed choice of rows."""
    centres = sample[np.random.default_rng(0).choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(sample, centres)
        n = np.bincount(near, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([(half - x[i : i + step] @ centres.T).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _place(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    centres = sent.value
    for batch in batches:
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centres.shape[1])
        cell = _nearest(x, centres)
        away = np.sqrt(((x - centres[cell]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(away, pa.float64())], names=["key", "v", "cell", "away"])


@dataclass
class CellIndex:
    """A written matrix: ``vectors`` (key, v, cell) and ``cells`` (cell, n, radius, centre)."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(vectors: DataFrame, key: str, vector: str, path: str, dims: int, cells: int | None = None) -> None:
        spark = vectors.sparkSession
        kind = dict(vectors.dtypes)[key]
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == dims) & fine)
        n = rows.count()
        share = min(1.0, SAMPLE / max(n, 1))
        sample = (rows if share == 1.0 else rows.sample(share * 0.9, seed=0)).select("v").limit(SAMPLE).collect()
        count = min(MOST_CELLS, max(1, cells or math.isqrt(n)), max(1, len(sample)))
        centres = _fit(np.array([r["v"] for r in sample]), count) if sample else np.zeros((1, dims))
        sent = spark.sparkContext.broadcast(centres)
        placed = rows.mapInArrow(partial(_place, sent=sent), f"key {kind}, v array<double>, cell int, away double")
        files = max(1, n // 1_000_000)
        placed.repartitionByRange(files, "cell").sortWithinPartitions("cell").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/vectors")
        seen = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        about = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        seen.join(F.broadcast(about), "cell").coalesce(1).write.parquet(f"{path}/cells")  # at most MOST_CELLS rows

    def bounds(self, query: Sequence[float]) -> list[tuple[float, int, int]]:
        """(the most that a vector of the cell can score, cell, vectors), the best first."""
        length = math.sqrt(sum(float(x) ** 2 for x in query))
        at = cosine(F.col("centre"), query)
        # Sums of d products are off by their rounding at most.
        slack = 1e-12 * (1 + F.abs(at) + F.col("radius") * length)
        rows = self.spark.read.parquet(f"{self.path}/cells").select((at + F.col("radius") * length + slack).alias("most"), "cell", "n").collect()
        return sorted(((r["most"], r["cell"], r["n"]) for r in rows), key=lambda r: (-r[0], r[1]))

    def _scored(self, cells: Sequence[int], query: Sequence[float]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/vectors").where(_in_ranges(cells))
        return rows.select("key", cosine(F.col("v"), query).alias("similarity"))

    def needed(self, query: Sequence[float], rows: int) -> list[int]:
        """The cells that can hold any of the best ``rows``."""
        bounds = self.bounds(query)
        first, held = [], 0
        for _, cell, n in bounds:
            if held >= rows:
                break
            first.append(cell)
            held += n
        best = [r["similarity"] for r in self._scored(first, query).orderBy(F.desc("similarity")).limit(rows).collect()]
        if len(best) < rows:
            return [cell for _, cell, _ in bounds]
        return [cell for most, cell, _ in bounds if most >= best[-1]]

    def top(self, query: Sequence[float], rows: int = V.ARM_ROWS) -> DataFrame:
        """key, similarity of the best by dot product, ties by key."""
        return self._scored(self.needed(query, rows), query).orderBy(F.desc("similarity"), "key").limit(rows)


def _in_ranges(cells: Sequence[int]):  # noqa: ANN202
    """A filter that scans can use: cells next to each other as one range."""
    runs: list[list[int]] = []
    for c in sorted(cells):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    found = [F.col("cell").between(lo, hi) for lo, hi in runs[:MOST_RUNS]]
    rest = [c for lo, hi in runs[MOST_RUNS:] for c in range(lo, hi + 1)]
    return any_of([*found, F.col("cell").isin(rest)] if rest else found)
