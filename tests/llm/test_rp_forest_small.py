"""Few rows are searched as many rows are."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from ledgerlark.llm import rp_forest as R


def test_few_rows_go_down_all_trees():
    x = np.random.default_rng(3).standard_normal((20, 8)).astype("<f4")
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([8] * 20, pa.int64())], names=["rep", "v", "dim"])
    dealt = pa.Table.from_batches(list(R._deal(iter([batch]), SimpleNamespace(value={}), False, R.TREES)))
    assert sorted(dealt.column("tree").to_pylist()) == [t for t in range(R.TREES) for _ in range(20)]
