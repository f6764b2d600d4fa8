"""Components kept up to date equal a full run; written tables go."""

import random

from ledgerlark import session
from ledgerlark.operators.entity import components, update_components


def least(edges, nodes):
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {n: root(n) for n in at}


def test_three_batches_of_changes_equal_full_runs(spark):
    rng = random.Random(5)
    nodes = list(range(120))
    frame = lambda e: spark.createDataFrame(sorted(e), "a long, b long")
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)}
    labels = components(frame(edges), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: r["component"] for r in labels.collect()} == least(edges, nodes)
    for step in range(3):
        gone = set(rng.sample(sorted(edges), 8))
        new = {(rng.choice(nodes), rng.choice([*nodes, 200 + step, 300 + step])) for _ in range(12)} - gone
        edges = (edges - gone) | new
        nodes = sorted({*nodes, *(n for e in new for n in e)})
        # what is added comes after what is removed is settled, so the held edges are those without the new ones
        labels = update_components(labels, frame(edges - new), removed=frame(gone))
        labels = update_components(labels, frame(edges), added=frame(new))
        assert {r["node"]: r["component"] for r in labels.collect()} == least(edges, nodes)
    both = update_components(labels, frame(edges), added=frame({(5, 5), (0, 1)}), removed=None)
    assert {r["node"]: r["component"] for r in both.collect()} == least(edges | {(0, 1)}, nodes)


def test_no_written_table_is_left(spark):
    before = set(session._CUTS)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    out = components(edges, spark.range(41).toDF("node"))
    assert {r["component"] for r in out.collect()} == {0}
    assert len(set(session._CUTS) - before) == 1  # the one that the result reads
    session.drop_cut(out)
    assert set(session._CUTS) == before
    session.drop_all_cuts()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(session.shared_folder(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not [s for s in fs.listStatus(root) if s.getPath().getName().startswith("cut-")]
