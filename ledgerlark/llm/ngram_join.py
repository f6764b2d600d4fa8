"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Rows of the matrix are classes of documents with equal shingle sets, columns
are 64-bit shingle hashes.  Only columns that two similar rows must share are
multiplied: with columns in one global order (rare ones first), rows of
similarity 3/4 or more meet in the first ``n // 4 + 1`` columns of each.  The
columns are cut into blocks by hash range; a block's product is accumulated in
numpy and leaves as partial overlap counts, which are summed by pair.  A pair
goes when the sizes or the count so far show that it cannot reach the bound,
and the rest is settled on whole sets.

Columns with more than ``hot_df`` rows come last in the order, the commonest at
the very end, and are not multiplied at once: each is first compared with one
central row only (a star, linear in the column), and after the classes so linked
are merged, only pairs across components are left.  Of such a pair the shorter
row must have 6/7 of its columns hot, so rows meet by classes of length: pages
that share a frame but not enough to link never meet.  What does meet is made in
salted blocks.  No group is ever gathered in one task and no pair is dropped that
could link.

Cases: a null or empty text has an empty set and links with nothing; a null
doc_id keeps its row with a null component; repeated rows are equal sets and
so one class; rows that share a doc_id but not the text are one node; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.components import connected_components
from ledgerlark.llm.scratch import Scratch, blocks_for, text_bytes
from ledgerlark.llm.skew import join_uneven
from ledgerlark.llm.wordhash import mix, shingle_sets, slices, tidy

#: A shingle in more documents than this is hot.
HOT_DF = 128
#: Hot shingles up to this number (16 bytes each) are sent to the tasks; beyond it they are joined to the documents.
HOT_SENT = 1_000_000
#: Text bytes whose shingles make up a block.
BLOCK_TEXT = 16 << 20
#: Rows of a salted block of a hot column.
HOT_BLOCK = 1024
#: Ratio of the lengths in one class of a hot column's rows.
LENGTH_CLASS = 1.05
_LEAST_BLOCKS = 256
_KEY_BITS = 40
_SET_BYTES = 6


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each value, byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_planes(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(n, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :n] = planes.T
    return wide.view("<u8").ravel()


def _block_bits(blocks: int) -> int:
    return blocks.bit_length() - 1


def _cut_by_block(sorted_hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(block, from, to) of sorted hashes; a block is a range of the top ``bits``."""
    block = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(block)) + 1
    lo = np.concatenate([[0], edge])
    hi = np.concatenate([edge, [len(block)]])
    return [(int(block[a]), int(a), int(b)) for a, b in zip(lo, hi) if b > a]


def _key(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``bits`` of the block and the next 40: what counting and listing tell shingles apart by."""
    return hashes >> np.uint64(64 - bits - _KEY_BITS)


@tidy
def _count_blobs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        s = np.sort(np.concatenate(held))
        cuts = _cut_by_block(s, bits)
        key = _key(s, bits)
        return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int32()), pa.array([_low_bytes(key[a:b], _KEY_BITS // 8) for _, a, b in cuts], pa.binary())], names=["block", "blob"])

    for batch in batches:
        for part in slices(batch):
            sets = [s for s in shingle_sets(part.column("text")) if len(s)]
            held += sets
            size += sum(map(len, sets))
            if size >= 1 << 20:
                yield flush()
                held.clear()
                size = 0
    if size:
        yield flush()


def _hot_keys(key: tuple, table: pa.Table, hot_df: int) -> pa.Table:
    keys = np.sort(np.concatenate([_from_planes(x.as_py(), _KEY_BITS // 8) for x in table.column("blob")]))
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    df = np.diff(edge)
    hot = keys[edge[:-1]][df > hot_df].astype(np.int64) | (key[0].as_py() << _KEY_BITS)
    return pa.table({"key": pa.array(hot, pa.int64()), "df": pa.array(df[df > hot_df], pa.int64())})


def hot_shingles(documents: DataFrame, blocks: int, hot_df: int) -> DataFrame:
    """Keys of the shingles that more than ``hot_df`` documents hold, and how many do, counted exactly over all documents."""
    bits = _block_bits(blocks)
    blobs = documents.select("text").mapInArrow(partial(_count_blobs, bits=bits), "block int, blob binary")

    def block(key, table):  # noqa: ANN001, ANN202
        return _hot_keys(key, table, hot_df)

    return blobs.groupBy("block").applyInArrow(block, "key long, df long")


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int((mix(s ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).astype(np.int64))


def _listed(own: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles of one document and their counts, by shingle."""
    if not own.is_valid or not len(own.values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, df = (own.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.argsort(key.astype(np.uint64))
    return key.astype(np.uint64)[order], df[order]


@tidy
def _prefixes(batches: Iterator[pa.RecordBatch], bits: int, hot: object) -> Iterator[pa.RecordBatch]:
    """Of each document its set size, a 128-bit set signature and the columns of its prefix, cold and hot."""
    known = hot.value if hot is not None else None
    for batch in batches:
        for part in slices(batch):
            own = part.column("hot") if known is None else None
            n, s1, s2, cold, warm = [], [], [], [], []
            for i, s in enumerate(shingle_sets(part.column("text"))):
                listed, common = known if own is None else _listed(own[i])
                take = len(s) // 4 + 1 if len(s) else 0
                key = _key(s, bits)
                is_hot = np.zeros(len(s), bool)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, key), len(listed) - 1)
                    is_hot = listed[at] == key
                first = s[~is_hot][:take]
                last = s[is_hot]
                if len(first) < take:
                    last = last[np.argsort(common[at[is_hot]], kind="stable")]
                a, b = _signature(s)
                n.append(len(s))
                s1.append(a)
                s2.append(b)
                cold.append(first.tobytes())
                warm.append(last[: take - len(first)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(cold, pa.binary()), pa.array(warm, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "cold", "warm"],
            )


@tidy
def _entries(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The cold prefix columns of many rows as one blob for each block."""
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        reps = np.array([len(x[0]) for x in held])
        rep, n, k = (np.repeat(np.array(v, dtype=np.int64), reps) for v in ([x[1] for x in held], [x[2] for x in held], reps))
        order = np.argsort(h)
        h, rep, n, k = h[order], rep[order], n[order], k[order]
        cuts, key = _cut_by_block(h, bits), _key(h, bits)
        columns = [pa.array([c[0] for c in cuts], pa.int32())]
        columns += [pa.array([_low_bytes(x[a:b], w) for _, a, b in cuts], pa.binary()) for x, w in ((key, _KEY_BITS // 8), (rep, 8), (n, 4), (k, 4))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "key", "rep", "n", "k"])

    for batch in batches:
        for rep, n, cold in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("cold").to_pylist()):
            if cold:
                held.append((np.frombuffer(cold, np.uint64), rep, n))
                size += len(held[-1][0])
                if size >= 1 << 19:
                    yield flush()
                    held.clear()
                    size = 0
    if size:
        yield flush()


_PAIR = "a long, b long, na long, nb long, ka long, kb long, c long"


def _product(table: pa.Table) -> pa.Table:
    """The partial product of one block: pairs of rows and the number of its columns that both hold."""
    key, rep, n, k = (np.concatenate([_from_planes(x.as_py(), w) for x in table.column(name)]) for name, w in (("key", _KEY_BITS // 8), ("rep", 8), ("n", 4), ("k", 4)))
    order = np.lexsort((rep, key))
    key, rep, n, k = key[order], rep[order].astype(np.int64), n[order].astype(np.int64), k[order].astype(np.int64)
    found: list[np.ndarray] = []
    i = np.arange(max(0, len(key) - 1))
    step = 1
    while len(i):
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        j = i + step
        fits = (100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j])) & (rep[i] != rep[j])
        found.append(np.stack([i[fits], j[fits]]))
        step += 1
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    nodes, at = np.unique(rep, return_inverse=True)
    code, first, c = np.unique(at[pairs[0]] * len(nodes) + at[pairs[1]], return_index=True, return_counts=True)
    i, j = pairs[:, first]
    return pa.table({"a": rep[i], "b": rep[j], "na": n[i], "nb": n[j], "ka": k[i], "kb": k[j], "c": c.astype(np.int64)})


@tidy
def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [_low_bytes(s >> np.uint64(64 - 8 * _SET_BYTES), _SET_BYTES) for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "words"])


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose whole sets reach 100 * |intersection| >= 75 * |union|."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        good = []
        last, left = None, None
        for i, (x, y) in enumerate(zip(batch.column("wa"), batch.column("wb"))):
            if a[i] != last:
                last, left = a[i], _from_planes(x.as_py(), _SET_BYTES)
            right = _from_planes(y.as_py(), _SET_BYTES)
            both = np.concatenate([left, right])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= 75 * (len(both) - shared):
                good.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])


@tidy
def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, rep, n, k = [], [], [], []
        for r, m, cold, warm in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "n", "k", "warm"))):
            own = np.frombuffer(warm, np.int64)
            h.append(own)
            rep.append(np.full(len(own), r))
            n.append(np.full(len(own), m))
            k.append(np.full(len(own), cold))
        if h:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (h, rep, n, k)], names=["h", "rep", "n", "k"])


def jaccard_components(documents: DataFrame, hot_df: int = HOT_DF, hot_sent: int = HOT_SENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, class_id and whether it is the component's first.

    Documents link when 100 * |A & B| >= 75 * |A | B| over their sets of
    distinct 5-word shingles; component_id is the smallest doc_id reachable.
    class_id is the smallest doc_id with an equal set.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = blocks_for(text_bytes(docs), BLOCK_TEXT, _LEAST_BLOCKS)
    bits = _block_bits(blocks)

    hot = scratch.save(hot_shingles(docs, blocks, hot_df), "hot")
    if hot.count() <= hot_sent:
        few = hot.toPandas().sort_values("key")
        sent = spark.sparkContext.broadcast((few["key"].to_numpy().astype(np.uint64), few["df"].to_numpy()))
        source = docs
    else:
        sent = None
        rows = join_uneven(docs.mapInArrow(partial(_doc_keys, bits=bits), "doc_id long, key long"), hot, ["key"], "df")
        source = docs.join(rows.groupBy("doc_id").agg(F.collect_set(F.struct("key", "df")).alias("hot")), "doc_id", "left")
    schema = "doc_id long, n long, s1 long, s2 long, cold binary, warm binary"
    prefix = scratch.save(source.mapInArrow(partial(_prefixes, bits=bits, hot=sent), schema), "prefix")
    known = prefix.where("n > 0 and doc_id is not null")

    classes = scratch.save(known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")), "classes")
    rep = classes.select(F.col("rep").alias("doc_id"), "s1", "s2")
    rows = known.join(rep, ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    rows = scratch.save(rows.select("doc_id", "n", "cold", "warm", F.expr("octet_length(cold) div 8").alias("k")), "rows")

    blobs = rows.select("doc_id", "n", "cold").mapInArrow(partial(_entries, bits=bits), "block int, key binary, rep binary, n binary, k binary")
    part = blobs.groupBy("block").applyInArrow(_product, _PAIR)
    whole = part.groupBy("a", "b").agg(*(F.min(x).alias(x) for x in ("na", "nb", "ka", "kb")), F.sum("c").alias("c"))
    # Beyond the prefix that ends first, the pair can share only what that row has left.
    able = F.expr("7 * (c + greatest(na - ka, nb - kb)) >= 3 * (na + nb)")
    pairs = scratch.save(whole.where(able).select("a", "b", F.expr("c / least(na, nb)").alias("share")), "pairs")

    # Of hot columns first a star around the row with the fewest cold columns.
    warm = scratch.save(rows.where("octet_length(warm) > 0").select("doc_id", "n", "k", "warm").mapInArrow(_hot_rows, "h long, rep long, n long, k long"), "warm")
    pivot = warm.groupBy("h").agg(F.min(F.struct("k", "rep", "n")).alias("p"), F.count(F.lit(1)).alias("m"))
    pivot = scratch.save(pivot.select("h", "m", F.col("p.rep").alias("prep"), F.col("p.n").alias("pn"), F.col("p.k").alias("pk")), "pivot")
    # A row with hot prefix columns has all its cold ones there, so a pair that shares a cold one is among the pairs;
    # any other shares hot columns only, n - k at most.
    star = join_uneven(warm, pivot, ["h"], "m").where("rep <> prep and 7 * least(n - k, pn - pk) >= 3 * (n + pn)").select(F.least("rep", "prep").alias("a"), F.greatest("rep", "prep").alias("b"))

    # The most alike partner of each row, then what is left across components.
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b")).unionByName(pairs.groupBy("b").agg(F.max_by("a", F.struct("share", "a")).alias("a")).select("a", "b"))
    first = scratch.save(best.unionByName(star.select("a", "b")).distinct(), "first")
    sets = _sets_of(docs, first.select(F.col("a").alias("doc_id")).unionByName(first.select(F.col("b").alias("doc_id"))).unionByName(pairs.select(F.col("a").alias("doc_id"))).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), scratch, "sets")
    links = scratch.save(_linked(first, sets), "links1")
    label = connected_components(links, scratch, "cc1")
    label = scratch.save(label, "label")

    across = _across(pairs.select("a", "b"), label).unionByName(_hot_across(warm, label, scratch)).distinct().join(first, ["a", "b"], "left_anti")
    across = scratch.save(across, "across")
    more = _sets_of(docs, across.select(F.col("a").alias("doc_id")).unionByName(across.select(F.col("b").alias("doc_id"))).distinct().join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), scratch, "sets2")
    links2 = _linked(across, sets.unionByName(more))
    merged = scratch.save(links2.unionByName(label.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")), "links2")
    final = scratch.save(connected_components(merged, scratch, "cc2"), "final")

    named = scratch.save(classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", "m", "rep", F.coalesce("component", "rep").alias("component")), "named")
    scratch.keep("prefix", "named")
    held = join_uneven(prefix.where("n > 0").select("doc_id", "s1", "s2", "n"), named, ["s1", "s2", "n"], "m", "left")
    held = held.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("class_id"))
    bare = prefix.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return held.unionByName(bare)


@tidy
def _doc_keys(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column("text"))
            if n := sum(map(len, sets)):
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
                keys = _key(np.concatenate(sets), bits).astype(np.int64)
                for lo in range(0, n, 100_000):
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, 100_000), pa.array(keys[lo : lo + 100_000])], names=["doc_id", "key"])


def _sets_of(docs: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    text = docs.join(scratch.save(ids, f"{name}-ids"), "doc_id", "left_semi")
    return scratch.save(text.mapInArrow(_whole_sets, "rep long, words binary").dropDuplicates(["rep"]), name)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("rep").alias("a"), F.col("words").alias("wa"))
    b = sets.select(F.col("rep").alias("b"), F.col("words").alias("wb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "wa", "wb").mapInArrow(_verify, "a long, b long")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(la, "a", "left").join(lb, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _hot_across(warm: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs across components in hot columns.

    Of two rows that link by hot columns only, the shorter has at least 6/7 of
    its columns hot and at least 3/4 of the longer one's length; how many the
    longer has hot bounds it from above.  So the shorter stands in the class of
    its length and the longer in every class that its bounds allow.  In a class
    only rows outside the largest component (strays) need partners there.
    """
    own = warm.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h", "rep", "n", "k", F.coalesce("component", "rep").alias("comp"))
    length = lambda v: F.floor(F.log(v.cast("double")) / F.log(F.lit(LENGTH_CLASS))).cast("int")
    longest = F.least("n", F.floor(7 * (F.col("n") - F.col("k")) / 3).cast("long") - F.col("n"))
    least = F.ceil(3 * F.col("n") / 4).cast("long")
    short = own.where("7 * (n - k) >= 6 * n").select("*", length(F.col("n")).alias("c"), F.lit(False).alias("home"))
    long = own.where(longest >= least).select("*", F.explode(F.sequence(length(least), length(longest))).alias("c"), F.lit(True).alias("home"))
    cells = scratch.save(short.unionByName(long), "warm-own")
    size = cells.groupBy("h", "c", "comp").agg(F.count_if("home").alias("x"), F.count_if(~F.col("home")).alias("y"))
    most = F.max(F.struct((F.col("x") + F.col("y")).alias("z"), "x", "y", "comp"))
    mixed = size.groupBy("h", "c").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), most.alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1 and x > 0 and y > 0")
    blocks = lambda n: F.greatest(F.ceil(n / HOT_BLOCK), F.lit(1)).cast("int")
    # Stray long rows meet all short ones (round 0); long rows of the largest component meet stray short ones (round 1).
    mixed = mixed.select("h", "c", F.col("main.comp").alias("main"), (F.col("x") + F.col("y")).alias("m"), blocks(F.col("x") - F.col("main.x")).alias("x0"), blocks(F.col("y")).alias("y0"), blocks(F.col("main.x")).alias("x1"), blocks(F.col("y") - F.col("main.y")).alias("y1"))
    mixed = scratch.save(mixed, "warm-mixed")
    rows = join_uneven(cells, mixed, ["h", "c"], "m").withColumn("stray", F.col("comp") != F.col("main"))

    def side(home: bool, turn: int, where: Column) -> DataFrame:
        mine, other = (f"x{turn}", f"y{turn}") if home else (f"y{turn}", f"x{turn}")
        at, met = ("i", "j") if home else ("j", "i")
        kept = rows.where((F.col("home") == home) & where)
        dealt = kept.withColumn(at, F.expr(f"cast(pmod(xxhash64(rep), {mine}) as int)")).withColumn(met, F.explode(F.expr(f"sequence(0, {other} - 1)")))
        return dealt.select("h", "c", F.lit(turn).alias("turn"), "i", "j", "home", "rep", "n", "k", "comp")

    every = side(True, 0, F.col("stray")).unionByName(side(False, 0, F.lit(True))).unionByName(side(True, 1, ~F.col("stray"))).unionByName(side(False, 1, F.col("stray")))
    return every.groupBy("h", "c", "turn", "i", "j").applyInArrow(_cross, "a long, b long").distinct()


def _cross(table: pa.Table) -> pa.Table:
    home = table.column("home").to_numpy()
    rep, n, k, comp = (table.column(x).to_numpy() for x in ("rep", "n", "k", "comp"))
    x, y, hot = np.flatnonzero(home), np.flatnonzero(~home), n - k
    found = [np.zeros((2, 0), np.int64)]
    for lo in range(0, len(y), 256):
        z = y[lo : lo + 256]
        ok = (comp[x][:, None] != comp[z][None, :]) & (7 * np.minimum(hot[x][:, None], hot[z][None, :]) >= 3 * (n[x][:, None] + n[z][None, :]))
        u, v = np.nonzero(ok)
        found.append(np.stack([rep[x[u]], rep[z[v]]]))
    a, b = np.concatenate(found, axis=1)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
