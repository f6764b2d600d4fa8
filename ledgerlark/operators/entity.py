"""Entity resolution: blocking, pair rules, greedy clusters, components, canonical election."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.functions.normalise import name_key, who
from ledgerlark.session import cut_lineage, drop_cut


def salt_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """X-9: adds ``salted``: the key for the first row of it, with an ordinal for later ones."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("salted", F.when(rn == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("~n"), rn.cast("string"))))


def platform(publisher: Column) -> Column:
    """X-7: the sources that a publisher's name is a label for; empty if it is none."""
    table = F.create_map(*(x for name, sources in V.PLATFORM_SOURCES.items() for x in (F.lit(name), F.array(*map(F.lit, sources)))))
    return F.coalesce(F.try_element_at(table, name_key(publisher)), F.array().cast("array<string>"))


def mergeable(a: str, b: str, label: str = "source_label") -> Column:
    """X-2, J-15: whether records under the aliases ``a`` and ``b`` of one title may be one dataset.

    Records have source_id, publisher and the normalised name of their source.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    na, nb = name_key(c(a, "publisher")), name_key(c(b, "publisher"))
    shelf = (c(a, "source_id") == c(b, "source_id")) & (na == F.coalesce(c(a, label), F.lit("")))
    one_aggregates = (c(a, "source_id") == V.AGGREGATOR) != (c(b, "source_id") == V.AGGREGATOR)
    mirrored = F.array_contains(platform(c(a, "publisher")), c(b, "source_id")) | F.array_contains(platform(c(b, "publisher")), c(a, "source_id"))
    wa, wb = who(c(a, "publisher")), who(c(b, "publisher"))
    shared, least = F.size(F.array_intersect(wa, wb)), F.least(F.size(wa), F.size(wb))
    agree = (least > 0) & (shared == least) & ((F.size(wa) == F.size(wb)) | (least >= 2))
    return F.when(na == nb, ~shelf).otherwise(one_aggregates & (mirrored | agree))


def first_uuid(*columns: Column) -> Column:
    """X-4: the first UUID in the columns, in lower case; null without any."""
    found = [F.regexp_extract(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", 0) for c in columns]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found))


def cluster_titles(records: DataFrame) -> DataFrame:
    """X-3: key, cluster (its first key) by greedy agreement with every member.

    ``records``: key, title, source_id, publisher, source_label.  The order is
    platform labels last, then key.  Records that have all but the key in
    common agree with the same others, and with each other unless the publisher
    is the source's own label; so all but those go by their first key.  Pairs
    of these that may merge are found by a join; only titles with such pairs
    reach the grouped step, which so holds a row for each pair of publishers.
    """
    r = records.select("key", name_key(F.col("title")).alias("block"), "source_id", "publisher", "source_label")
    shelf = F.coalesce(name_key(F.col("publisher")) == F.coalesce("source_label", F.lit("")), F.lit(False))
    r = r.withColumn("kind", F.md5(F.to_json(F.struct("block", "source_id", "publisher", "source_label", F.when(shelf, F.col("key")).alias("own"))).cast("binary")))
    first = r.groupBy("kind", "block", "source_id", "publisher", "source_label").agg(F.min("key").alias("key")).withColumn("labelled", F.size(platform(F.col("publisher"))) > 0)
    pairs = first.alias("a").join(first.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.key") < F.col("b.key"))).where(mergeable("a", "b"))
    pairs = pairs.select(F.col("a.block").alias("block"), F.col("a.key").alias("x"), F.col("b.key").alias("y"), F.col("a.labelled").alias("lx"), F.col("b.labelled").alias("ly"))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        label: dict = {}
        near: dict = {}
        for x, y, lx, ly in zip(rows["x"], rows["y"], rows["lx"], rows["ly"]):
            label[x], label[y] = lx, ly
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        clusters: list[list] = []
        for k in sorted(label, key=lambda k: (label[k], k)):
            home = next((c for c in clusters if all(m in near[k] for m in c)), None)
            if home is None:
                clusters.append([k])
            else:
                home.append(k)
        return pd.DataFrame([(m, c[0]) for c in clusters for m in c], columns=["key", "cluster"])

    key_type = dict(records.dtypes)["key"]
    placed = pairs.groupBy("block").applyInPandas(greedy, f"key {key_type}, cluster {key_type}")
    by_kind = first.select("kind", "key").join(placed, "key", "left").select("kind", F.coalesce("cluster", "key").alias("cluster"))
    return r.select("key", "kind").join(by_kind, "kind").select("key", "cluster")


def elect(records: DataFrame, group: str) -> DataFrame:
    """X-6: the canonical key of each group: live, with files, not the aggregator's, most files, latest; then the least key."""
    rank = F.struct((~F.coalesce("retired", F.lit(False))).alias("live"), (F.coalesce("resource_count", F.lit(0)) > 0).alias("files"), (F.col("source_id") != V.AGGREGATOR).alias("own"), F.coalesce("resource_count", F.lit(0)).alias("n"), F.coalesce("modified", F.lit("")).alias("modified"))
    best = records.withColumn("elect_rank", rank).groupBy(group).agg(F.max("elect_rank").alias("best"))
    return records.withColumn("elect_rank", rank).join(best, group).where("elect_rank = best").groupBy(group).agg(F.min("key").alias("canonical"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """X-5: node, component (least node reachable) by min-label contraction; ``edges`` have a, b, ``nodes`` have node.

    Each round points nodes to their least neighbour, follows pointers to their
    roots and keeps only edges between roots, until none is left: every round
    at least halves the nodes of a component.  Lineage is cut by tables written
    to the session's shared folder.
    """
    flip = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edge = cut_lineage(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = nodes.select("node", F.col("node").alias("component"))
    while edge.limit(1).count():
        held = cut_lineage(flip(edge).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        point = held
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("up"))
            new = cut_lineage(point.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            drop_cut(held)
            held, point = new, new.select("node", "root")
            if not new.where("moved").limit(1).count():
                break
        ra, rb = point.select(F.col("node").alias("a"), F.col("root").alias("ra")), point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        fewer = cut_lineage(edge.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        up = point.select(F.col("node").alias("component"), F.col("root").alias("up"))
        told = cut_lineage(label.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        drop_cut(edge, held, label)
        edge, label = fewer, told
    drop_cut(edge)
    return label


def update_components(labels: DataFrame, edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """X-4, X-5: held labels (node, component) after edges (a, b) have come and gone, without all being contracted anew.

    ``edges`` are all that hold afterwards; they are read only for components
    that have lost one, which are worked out afresh.  New edges are contracted
    between the components that they touch; their own nodes may be new.  A
    component is named by its least node, as in a full run.
    """
    if removed is not None:
        ends = removed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        touched = labels.join(ends, "node", "left_semi").select("component").distinct()
        nodes = cut_lineage(labels.join(touched, "component", "left_semi").select("node"))
        inner = edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
        labels = cut_lineage(labels.join(touched, "component", "left_anti").select("node", "component").unionByName(components(inner, nodes)))
        drop_cut(nodes)
    if added is not None:
        fresh = added.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct().join(labels, "node", "left_anti")
        every = labels.select("node", "component").unionByName(fresh.select("node", F.col("node").alias("component")))
        of = lambda end: every.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
        between = cut_lineage(added.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("a_of <> b_of").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).distinct())
        met = components(between, between.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        moved = met.select(F.col("node").alias("component"), F.col("component").alias("joined"))
        labels = cut_lineage(every.join(moved, "component", "left").select("node", F.coalesce("joined", "component").alias("component")))
        drop_cut(between, met)
    return labels


def cross_file_duplicates(rows: DataFrame, file: str, order: str, keys: list[Column]) -> DataFrame:
    """X-8, J-12: adds is_dup: the same row stands in another file whose first row came before."""
    names = [f"dup_key_{i}" for i in range(len(keys))]
    keyed = reduce(lambda d, p: d.withColumn(*p), zip(names, keys), rows)
    first = keyed.groupBy(*names).agg(F.min_by(file, order).alias("dup_first"))
    return keyed.join(first, names, "left").withColumn("is_dup", F.coalesce(F.col(file) != F.col("dup_first"), F.lit(False)).cast("int")).drop(*names, "dup_first")
