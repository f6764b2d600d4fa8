"""Embedding near-duplicates by a forest of random-projection trees with spill.

Every tree splits the rows by a random projection near its median, again and
again; rows inside the band around the split go to both sides, so close pairs
are seldom parted, and many trees make a miss in all of them rare.  Splits are
fitted on samples of at most ``FIT_ROWS`` rows and deal every row into buckets;
a bucket still larger than ``BUCKET_ROWS`` is fitted and dealt again, to any
depth, and inside a bucket numpy goes on down to leaves: nodes of few rows, or
of rows that mostly link with each other.  All rows of a leaf are compared in
double precision, in blocks.  All lengths go down all trees, however few rows
they have.

A row carries the list of its leaves, and a pair is counted only in the first
leaf that both rows are in.  So a bucket gives one row for each vector in it:
how many links were counted there, and the least vector that they lead to.  No
pair leaves its task.

Equal vectors are one class from the start: copies are counted, never compared.

Cases: vectors that are null, empty, zero, or hold null or non-finite values
link with nothing; vectors of different lengths never link; repeated rows are
copies; rows sharing a vec_id are one node; equal projections are parted by a
hash of the vec_id; a null vec_id keeps its row with no links and null
component; very long vectors make smaller buckets; other columns, ``label``
among them, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.components import connected_components, forest
from ledgerlark.llm.scratch import Scratch
from ledgerlark.llm.skew import join_uneven
from ledgerlark.llm.wordhash import mix, tidy

THRESHOLD = 0.9
TREES = 8
#: Half the share of a node's rows that go to both sides.
SPILL = 0.06
LEAF_ROWS = 384
#: Share of linked pairs from which a node of a bucket is one leaf.
DENSE = 0.3
#: Rows a bucket is meant to have, and the most it is searched with; both shrink for vectors beyond 1,024 components.
BUCKET_AIM, BUCKET_ROWS = 6_000, 12_000
_BUCKET_BYTES = 6_000 * 1_024 * 8
#: At most about so many rows fit the splits of a tree or of an oversized bucket.
FIT_ROWS = 65_536
_FEW = 48
_BLOCK = 1_024


def bucket_aim(dim: int) -> int:
    return min(BUCKET_AIM, max(2 * LEAF_ROWS, _BUCKET_BYTES // (8 * dim)))


def _project(x: np.ndarray, rep: np.ndarray, seed: list[int]) -> np.ndarray:
    """Projections on the direction of a seed; equal ones are parted by a hash of the row's id."""
    p = x @ np.random.default_rng([7, *seed, x.shape[1]]).standard_normal(x.shape[1])
    return p + (mix(rep.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * (1e-9 / (1 << 53))


def _fit(x: np.ndarray, rep: np.ndarray, total: float, tree: int, first: int) -> list[tuple[int, float, float]]:
    """Bounds (node, low, high) of the splits below node ``first``; 2n and 2n + 1 are the sides of n."""
    nodes = []
    todo = [(first, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if len(own) < _FEW or total * len(own) / len(x) <= bucket_aim(x.shape[1]):
            continue
        p = _project(x[own], rep[own], [tree, node.bit_length()])
        low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        nodes.append((node, float(low), float(high)))
        todo += [(2 * node, own[p <= high]), (2 * node + 1, own[p >= low])]
    return nodes


def _drop_down(x: np.ndarray, rep: np.ndarray, tree: int, first: int, inner: dict[int, tuple[float, float]]) -> Iterator[tuple[int, np.ndarray]]:
    """The nodes below ``first`` without a split of their own, and which rows they get."""
    todo = [(first, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node not in inner:
            yield node, own
            continue
        p, (low, high) = _project(x[own], rep[own], [tree, node.bit_length()]), inner[node]
        todo += [(2 * node, own[p <= high]), (2 * node + 1, own[p >= low])]


def _matrix(column: pa.Array, dim: int, wide: bool) -> np.ndarray:
    """Unit vectors."""
    data = b"".join(x.as_py() for x in column)
    x = np.frombuffer(data, "<f8" if wide else "<f4").reshape(len(column), dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@tidy
def _to_bytes(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; those that can't be compared are marked by a null."""
    kind = np.dtype("<f8" if wide else "<f4")
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            ok = v is not None and len(v) > 0 and None not in v
            x = np.array(v, dtype=kind) if ok else None
            if ok:
                with np.errstate(over="ignore"):
                    norm = float((x.astype(np.float64) ** 2).sum())
                ok = np.isfinite(norm) and norm > 0
            out.append((x + kind.type(0)).tobytes() if ok else None)  # -0.0 becomes 0.0
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "v"])


_DEALT = "dim long, tree long, node long, rep long, v binary"


def _dealt(part: pa.Table | pa.RecordBatch, dim: int, shares: list[tuple[int, int, np.ndarray]]) -> list[pa.Array]:
    """Columns of _DEALT for (tree, node, rows) shares of a part."""
    rows = pa.array(np.concatenate([own for _, _, own in shares])) if shares else pa.array([], pa.int64())
    trees, nodes = (np.concatenate([np.full(len(s[2]), s[i]) for s in shares]).astype(np.int64) if shares else np.zeros(0, np.int64) for i in (0, 1))
    return [pa.array(np.full(len(rows), dim, np.int64)), pa.array(trees), pa.array(nodes), part.column("rep").take(rows), part.column("v").take(rows)]


@tidy
def _deal(batches: Iterator[pa.RecordBatch], sent: object, wide: bool, trees: int) -> Iterator[pa.RecordBatch]:
    """Every row once for each bucket of the first splits: (dim, tree, node)."""
    fitted = sent.value
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.take(pa.array(np.flatnonzero(dims == dim)))
            x, rep = _matrix(part.column("v"), dim, wide), part.column("rep").to_numpy()
            shares = [(tree, node, own) for tree in range(trees) for node, own in _drop_down(x, rep, tree, 1, fitted.get((dim, tree), {}))]
            yield pa.RecordBatch.from_arrays(_dealt(part, dim, shares), names=["dim", "tree", "node", "rep", "v"])


def _leaves(x: np.ndarray, rep: np.ndarray, tree: int, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves of the rest of a tree over the rows of bucket ``first``."""
    todo = [(first, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if len(own) <= LEAF_ROWS or _dense(x[own], rep[own]):
            yield node, own
            continue
        p = _project(x[own], rep[own], [tree, node.bit_length(), node])
        low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        todo += [(2 * node, own[p <= high]), (2 * node + 1, own[p >= low])]


def _dense(x: np.ndarray, rep: np.ndarray) -> bool:
    """Whether many pairs of a node link, by some of its rows: a split would part them."""
    some = x[np.argsort(mix(rep.astype(np.uint64)))[:64]]
    return bool((some @ some.T >= THRESHOLD).mean() >= DENSE)


def compare(x: np.ndarray, m: np.ndarray, leaf_of: list[tuple[int, np.ndarray]], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many vectors it links with in pairs whose first common leaf is among these, and the least row so reached.

    ``ids[at[i] : at[i + 1]]`` are the leaves of row i, ``m`` how many vectors each row stands for.
    """
    far, ends = np.zeros(len(x), np.int64), [np.zeros((2, 0), np.int64)]
    for leaf, own in leaf_of:
        bits = None
        for i in range(0, len(own), _BLOCK):
            for j in range(i, len(own), _BLOCK):
                u, v = np.nonzero(x[own[i : i + _BLOCK]] @ x[own[j : j + _BLOCK]].T >= THRESHOLD)
                u, v = u + i, v + j
                u, v = u[u < v], v[u < v]
                if not len(u):
                    continue
                if bits is None:
                    bits = _earlier(leaf, own, ids, at)
                new = ~(bits[u] & bits[v]).any(axis=1)
                u, v = own[u[new]], own[v[new]]
                far += np.bincount(u, m[v], len(x)).astype(np.int64) + np.bincount(v, m[u], len(x)).astype(np.int64)
                node, root = forest(u, v)
                ends.append(np.stack([node, root]))
    ends = np.concatenate(ends, axis=1)
    least = np.arange(len(x))
    node, root = forest(ends[0], ends[1])
    least[node] = root
    return far, least


def _earlier(leaf: int, own: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row of a leaf a bit set of the lower leaves that it shares with any other row of the leaf."""
    n = at[own + 1] - at[own]
    row = np.repeat(np.arange(len(own)), n)
    mine = ids[np.repeat(at[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    low = mine < leaf
    row, mine = row[low], mine[low]
    kinds, place, count = np.unique(mine, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    table = np.zeros((len(own), 8 * (1 + (len(kinds) // 8))), bool)
    table[row[shared], column[place[shared]]] = True
    return np.packbits(table, axis=1)


def near_duplicates(embeddings: DataFrame, trees: int = TREES) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "rp-forest")
    wide = dict(embeddings.dtypes)["embedding"] == "array<double>"
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    rows = kept.mapInArrow(partial(_to_bytes, wide=wide), "vec_id long, v binary").withColumn("k", F.sha2("v", 256))
    rows = scratch.save(rows, "rows")
    classes = rows.where("v is not null and vec_id is not null").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    classes = scratch.save(classes.withColumn("dim", F.expr(f"cast(octet_length(v) div {8 if wide else 4} as long)")), "classes")

    def fitted(part: DataFrame) -> DataFrame:
        """(dim, tree, node, total, rep, v) of sampled rows to the splits below each node."""

        def fit(key, table):  # noqa: ANN001, ANN202
            dim, tree, node, total = (k.as_py() for k in key)
            got = _fit(_matrix(table.column("v").combine_chunks(), dim, wide), table.column("rep").to_numpy(), total, tree, node)
            cols = list(zip(*got)) or [(), (), ()]
            return pa.table({"dim": pa.array([dim] * len(got), pa.int64()), "tree": pa.array([tree] * len(got), pa.int64()), "node": pa.array([node] * len(got), pa.int64()), "inner": pa.array(cols[0], pa.int64()), "low": pa.array(cols[1], pa.float64()), "high": pa.array(cols[2], pa.float64())})

        return part.select("dim", "tree", "node", "total", "rep", "v").groupBy("dim", "tree", "node", "total").applyInArrow(fit, "dim long, tree long, node long, inner long, low double, high double")

    pick = F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1 << 30)) < F.expr(f"cast(least(1, {FIT_ROWS} / total) * {1 << 30} as long)")
    lengths = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("total")).where(f"total > {BUCKET_AIM} or total > {_BUCKET_BYTES} div (8 * dim)")
    first = classes.select("rep", "v", "dim").join(lengths, "dim").where(pick).withColumn("tree", F.explode(F.expr(f"sequence(0L, {trees - 1}L)"))).withColumn("node", F.lit(1).cast("long"))
    forest_nodes: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
    for r in fitted(first).collect():  # a few splits for every FIT_ROWS / _FEW rows of the sample, for lengths of more rows than a bucket
        forest_nodes.setdefault((r["dim"], r["tree"]), {})[r["inner"]] = (r["low"], r["high"])
    sent = spark.sparkContext.broadcast(forest_nodes)
    dealt = scratch.save(classes.select("rep", "v", "dim").mapInArrow(partial(_deal, sent=sent, wide=wide, trees=trees), _DEALT), "dealt")

    # Buckets that the sample was too small to part are fitted and dealt again, in salted pieces.
    key, level = ["dim", "tree", "node"], 0
    while True:
        big = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("total")).where(f"total > least({BUCKET_ROWS}, greatest({4 * LEAF_ROWS}, {2 * _BUCKET_BYTES} div (8 * dim)))")
        big = scratch.save(big, f"big-{level}")
        if not big.limit(1).count():
            break
        held = dealt.join(big, key)
        splits = scratch.save(fitted(held.where(pick)), f"splits-{level}")
        pieces = F.expr(f"cast(ceil(total / {BUCKET_ROWS}) as int)")
        chunk = held.withColumn("piece", F.pmod(F.xxhash64("rep"), pieces).cast("int")).select(*key, "piece", "rep", "v").groupBy(*key, "piece")
        rules = splits.join(big.select(*key, F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")), key).groupBy(*key, "piece")

        def again(k, part, rule):  # noqa: ANN001, ANN202
            dim, tree, node, _ = (x.as_py() for x in k)
            x, rep = _matrix(part.column("v").combine_chunks(), dim, wide), part.column("rep").to_numpy()
            inner = dict(zip(rule.column("inner").to_pylist(), zip(rule.column("low").to_pylist(), rule.column("high").to_pylist())))
            return pa.table(_dealt(part, dim, [(tree, n, own) for n, own in _drop_down(x, rep, tree, node, inner)]), names=["dim", "tree", "node", "rep", "v"])

        more = chunk.cogroup(rules).applyInArrow(again, _DEALT)
        dealt = scratch.save(dealt.join(big.select(*key), key, "left_anti").select("dim", "tree", "node", "rep", "v").unionByName(more), f"dealt-{level}")
        level += 1

    def leaves(k, table):  # noqa: ANN001, ANN202
        dim, tree, node = (x.as_py() for x in k)
        rep = table.column("rep").to_numpy()
        got = list(_leaves(_matrix(table.column("v").combine_chunks(), dim, wide), rep, tree, node))
        leaf = np.concatenate([np.full(len(own), n * trees + tree) for n, own in got])
        return pa.table({"rep": pa.array(rep[np.concatenate([own for _, own in got])]), "tree": pa.array(np.full(len(leaf), tree)), "node": pa.array(np.full(len(leaf), node)), "leaf": pa.array(leaf)})

    placed = dealt.groupBy(*key).applyInArrow(leaves, "rep long, tree long, node long, leaf long")
    # As many as a row has leaves: a few for each tree.
    lists = placed.groupBy("rep").agg(F.collect_list(F.struct("tree", "node", "leaf")).alias("held"))
    lists = scratch.save(lists, "lists")
    whole = classes.select("rep", "dim", "m", "v").join(lists, "rep")
    weight = F.sum("m").alias("m")  # rows that share a vec_id but not the vector are one node of several rows
    at = whole.select("dim", "rep", "m", "v", F.transform("held", lambda h: h["leaf"]).alias("leaves"), F.explode(F.array_distinct(F.transform("held", lambda h: F.struct(h["tree"].alias("tree"), h["node"].alias("node"), F.array_sort(F.transform(F.filter("held", lambda g: (g["tree"] == h["tree"]) & (g["node"] == h["node"])), lambda g: g["leaf"])).alias("own"))))).alias("b")).select("dim", "b.tree", "b.node", "b.own", "rep", "m", "v", "leaves")

    def search(k, table):  # noqa: ANN001, ANN202
        dim = k[0].as_py()
        x, rep, m = _matrix(table.column("v").combine_chunks(), dim, wide), table.column("rep").to_numpy(), table.column("m").to_numpy()
        own, held = table.column("own").combine_chunks(), table.column("leaves").combine_chunks()
        leaf, row = own.flatten().to_numpy(), np.repeat(np.arange(len(x)), np.diff(own.offsets.to_numpy()))
        order = np.argsort(leaf, kind="stable")
        leaf, row = leaf[order], row[order]
        cut = np.flatnonzero(np.diff(leaf)) + 1
        groups = [(int(leaf[lo]), row[lo:hi]) for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(leaf)])]
        far, least = compare(x, m, groups, held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py())
        # the vec_id of the least row of each group of rows, not its place in the table
        low = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(low, least, rep)
        some = np.flatnonzero(far)
        return pa.table({"rep": pa.array(rep[some]), "far": pa.array(far[some]), "root": pa.array(low[least[some]])})

    found = scratch.save(at.groupBy("dim", "tree", "node").applyInArrow(search, "rep long, far long, root long"), "found")
    for name in ["dealt", *(f"dealt-{i}" for i in range(level))]:
        scratch.drop(name)

    links = found.groupBy("rep").agg(F.sum("far").alias("far"))
    group = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct(), scratch).select(F.col("node").alias("rep"), "component")
    info = classes.select("k", "rep", "m").join(links, "rep", "left").join(group, "rep", "left")
    info = scratch.save(info.select("k", "m", (F.coalesce("far", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "info")
    scratch.keep("rows", "info")
    one = join_uneven(rows.where("v is not null and vec_id is not null").select("vec_id", "k"), info, ["k"], "m").select("vec_id", "n_links", "component_id")
    rest = rows.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return one.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
