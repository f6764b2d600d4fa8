"""Points, boxes and polygons: equal grid cells first, exact tests after."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.session import cut_lineage, drop_cut


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """N-35."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * V.EARTH_KM * F.asin(F.sqrt(a))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """N-36: from a point to a segment in the plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    share = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / F.nullif(length, F.lit(0.0)))))
    return F.hypot(x - ax - share * dx, y - ay - share * dy)


def grid_reference(ref: Column) -> Column:
    """N-33: two letters and an even number of digits to (easting, northing) at the square's centre; I is no letter."""
    r = F.upper(F.regexp_replace(ref, r"\s", ""))
    rank = lambda i: F.ascii(F.substring(r, i, 1)) - 65 - F.when(F.ascii(F.substring(r, i, 1)) > 73, 1).otherwise(0)
    a, b = rank(1), rank(2)
    e100 = ((a - 2) % 5) * 5 + b % 5
    n100 = 19 - F.floor(a / 5) * 5 - F.floor(b / 5)
    digits = F.regexp_extract(r, "^[A-HJ-Z]{2}([0-9]*)$", 1)
    half = F.floor(F.length(digits) / 2).cast("int")
    unit = F.pow(F.lit(10.0), 5 - half)
    part = lambda s: F.coalesce(s.try_cast("double"), F.lit(0.0)) * unit + unit / 2
    ok = r.rlike("^[A-HJ-Z]{2}([0-9]{2}){0,5}$")
    east = F.substring(digits, F.lit(1), half)
    north = F.substring(digits, half + 1, half)
    return F.when(ok, F.struct((e100 * 100_000 + part(east)).alias("e"), (n100 * 100_000 + part(north)).alias("n")))


def _cell(x: Column, cell: float) -> Column:
    return F.floor(x / cell).cast("long")


def _around(points: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each row in its own cell and the eight around it: cx, cy."""
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    every = points.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    return every.select(*points.columns, (_cell(F.col(x), radius) + F.col("dx")).alias("cx"), (_cell(F.col(y), radius) + F.col("dy")).alias("cy"))


def _near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """ax, ay, bx, by, distance of two tables' places (x, y; each once) at most ``radius`` apart.

    Cells are as wide as the radius; each place of ``b`` stands in its nine
    neighbouring cells, so the join is by equality.
    """
    pa = a.select(F.col("x").alias("ax"), F.col("y").alias("ay"), _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    pb = _around(b.select(F.col("x").alias("bx"), F.col("y").alias("by")), radius, "bx", "by")
    j = pa.join(pb, ["cx", "cy"]).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    return j.where(F.col("distance") <= radius).select("ax", "ay", "bx", "by", "distance")


def _places(points: DataFrame) -> DataFrame:
    return points.select("x", "y").distinct()


#: Points of a place that travel as one list, about; pairs of neighbouring cells for which there is a task; and distances that one task takes in a cell.
LIST_POINTS, TASK_PAIRS, CELL_TESTS = 1_024, 1 << 24, 1 << 26
#: Tasks of a result, however large.
MOST_TASKS = 20_000


def _lists(points: DataFrame, of: str, held: DataFrame) -> DataFrame:
    """x, y, part, ids: the points of each place (``held``: x, y, n) in lists of about ``LIST_POINTS``."""
    parts = F.ceil(F.col("n") / LIST_POINTS)
    dealt = points.select(of, "x", "y").join(held, ["x", "y"]).groupBy("x", "y", F.pmod(F.xxhash64(of), parts).alias("part"))
    none = F.array_repeat(F.lit(None).cast(points.schema[of].dataType), F.count_if(F.col(of).isNull()).cast("int"))  # lists take no nulls
    return dealt.agg(F.concat(F.collect_list(of), none).alias("ids"))


def _shares(a: DataFrame, b: DataFrame, radius: float) -> tuple[int, int]:
    """The tasks for the pairs of two tables of places (x, y, n), and those among which the lists of a cell are dealt."""
    sums = F.sum(F.col("n").cast("double")), F.sum(F.ceil(F.col("n") / LIST_POINTS).cast("double"))
    ca = a.groupBy(_cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy")).agg(sums[0].alias("na"), sums[1].alias("la"))
    cb = _around(b, radius).groupBy("cx", "cy").agg(sums[0].alias("nb"), sums[1].alias("lb"))
    row = ca.join(cb, ["cx", "cy"]).agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"), F.max(F.col("la") * F.col("lb")).alias("tests")).first()
    return min(MOST_TASKS, int((row["pairs"] or 0) // TASK_PAIRS) + 1), min(MOST_TASKS, int((row["tests"] or 0) // CELL_TESTS) + 1)


def within(a: DataFrame, a_id: str, b: DataFrame, b_id: str, radius: float) -> DataFrame:
    """Pairs of points (x, y) at most ``radius`` apart: a_id, b_id, distance.

    Distances are taken between places, whose points travel as lists.  Two near
    lists are dealt to one of as many tasks as the pairs need, and become
    pairs only there, so that no pair is shuffled.
    """
    held_a, held_b = (x.where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")) for x in (a, b))
    tasks, shares = _shares(held_a, held_b, radius)
    la = _lists(a, a_id, held_a).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("part").alias("ap"), F.col("ids").alias("ai"), _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    lb = _around(_lists(b, b_id, held_b).select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("part").alias("bp"), F.col("ids").alias("bi")), radius, "bx", "by")
    keys = ["cx", "cy"]
    if shares > 1:
        la = la.withColumn("share", F.pmod(F.xxhash64("ax", "ay", "ap"), F.lit(shares)).cast("int"))
        lb, keys = lb.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), [*keys, "share"]
    j = la.join(lb, keys).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where(F.col("distance") <= radius)
    j = j.select("ai", "bi", "distance", F.xxhash64("ax", "ay", "ap", "bx", "by", "bp").alias("deal"))
    if tasks > 1:
        j = j.repartition(tasks, "deal")
    return j.select(F.explode("ai").alias(a_id), "bi", "distance").select(a_id, F.explode("bi").alias(b_id), "distance")


#: Sites of the fullest cell of a first search, about, and how often its radius is halved for that.
CELL_SITES, HALVINGS = 64, 20


def _first_radius(sites: DataFrame, cell: float) -> float:
    """``cell``, or the largest of its halves whose cells hold few sites."""
    level = sites.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("level")).withColumn("w", cell / F.pow(F.lit(2.0), F.col("level")))
    held = level.groupBy("level", F.floor(F.col("x") / F.col("w")).alias("cx"), F.floor(F.col("y") / F.col("w")).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    most = dict(held.groupBy("level").agg(F.max("n")).collect())  # a row for each level
    return cell / 2 ** next((i for i in range(HALVINGS + 1) if most.get(i, 0) <= CELL_SITES), HALVINGS)


def nearest(a: DataFrame, a_id: str, b: DataFrame, b_id: str, cell: float) -> DataFrame:
    """The nearest point of ``b`` for each of ``a``: a_id, b_id, distance; ties by b_id.

    The search is between places, each once, of which those of ``b`` keep their
    least b_id.  Radii double until every place has a neighbour: within a radius
    the first one found is the nearest of all, so found places leave the search.
    Points without a place (null or not finite) are near to none; what has no
    neighbour, as when ``b`` has no point, gets null b_id and distance.
    """
    placed = "abs(x) < double('infinity') and abs(y) < double('infinity')"
    points = a.where(placed)
    sites = cut_lineage(b.where(placed).groupBy("x", "y").agg(F.min(F.struct(b_id)).alias("s")).select("x", "y", f"s.{b_id}"))
    left = cut_lineage(_places(points))
    parts: list[DataFrame] = []
    if sites.limit(1).count():
        radius = _first_radius(sites, cell)
        own = sites.select(F.col("x").alias("bx"), F.col("y").alias("by"), b_id)
        while left.limit(1).count():
            # Squares first: roots of equal sums may differ in their last place.
            square = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
            pairs = _near(left, sites, radius).join(own, ["bx", "by"])
            best = cut_lineage(pairs.groupBy("ax", "ay").agg(F.min(F.struct(square.alias("square"), "distance", b_id)).alias("m")).select(F.col("ax").alias("x"), F.col("ay").alias("y"), "m.square", "m.distance", f"m.{b_id}"))
            parts.append(best)
            rest = cut_lineage(left.join(best, ["x", "y"], "left_anti"))
            drop_cut(left)
            left, radius = rest, radius * 2
    drop_cut(left)
    done = a.select(a_id).limit(0).withColumn(b_id, F.lit(None).cast(b.schema[b_id].dataType)).withColumn("distance", F.lit(None).cast("double"))
    if parts:
        found = points.select(a_id, "x", "y").join(reduce(DataFrame.unionByName, parts), ["x", "y"])
        done = found.groupBy(a_id).agg(F.min(F.struct("square", "distance", b_id)).alias("m")).select(a_id, f"m.{b_id}", "m.distance")
    return done.unionByName(_without(a.select(a_id).distinct(), done, a_id), allowMissingColumns=True)


def _without(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows whose key, null among them, is not found."""
    found = found.select(F.col(key).alias("found"))
    return rows.join(found, rows[key].eqNullSafe(found["found"]), "left_anti")


def points_in_polygons(points: DataFrame, point_id: str, polygons: DataFrame, code: str, cell: float) -> DataFrame:
    """J-20: point_id, code for each point (x, y) inside a polygon (rings of [x, y]) by the even-odd rule.

    Polygons stand in the cells of their boxes, without their rings; a point
    meets the polygons of its cell, then their boxes.  What is left is grouped
    by polygon, in parts, and each part meets the rings once, in numpy.
    """
    near = _near_boxes(points, point_id, polygons, code, cell, 0.0)
    return _by_polygon(near, point_id, polygons, code, lambda xy, rings: np.where(even_odd(xy, rings), 0.0, np.nan)).select(point_id, code)


def polygon_distances(points: DataFrame, point_id: str, polygons: DataFrame, code: str, cell: float, radius: float, boundary: bool = False) -> DataFrame:
    """J-22, J-25, A-38: point_id, code, distance of the polygons at most ``radius`` from each point; 0 inside.

    With ``boundary`` the distance is that to the rings, inside too.
    """
    near = _near_boxes(points, point_id, polygons, code, cell, radius)

    def measure(xy: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
        far = ring_distance(xy, rings)
        if not boundary:
            far[even_odd(xy, rings)] = 0.0
        return np.where(far <= radius, far, np.nan)

    return _by_polygon(near, point_id, polygons, code, measure)


def _near_boxes(points: DataFrame, point_id: str, polygons: DataFrame, code: str, cell: float, margin: float) -> DataFrame:
    """point_id, code, x, y of points inside the polygons' boxes with a margin."""
    flat = F.flatten(F.col("rings"))
    xs, ys = F.transform(flat, lambda p: p[0]), F.transform(flat, lambda p: p[1])
    box = polygons.select(code, (F.array_min(xs) - margin).alias("w"), (F.array_max(xs) + margin).alias("e"), (F.array_min(ys) - margin).alias("s"), (F.array_max(ys) + margin).alias("n"))
    span = lambda lo, hi: F.sequence(_cell(F.col(lo), cell), _cell(F.col(hi), cell))
    cells = box.select("*", F.explode(span("w", "e")).alias("cx")).select("*", F.explode(span("s", "n")).alias("cy"))
    p = points.select(point_id, "x", "y", _cell(F.col("x"), cell).alias("cx"), _cell(F.col("y"), cell).alias("cy"))
    return p.join(cells, ["cx", "cy"]).where("x between w and e and y between s and n").select(point_id, code, "x", "y")


#: Parts into which a polygon's points are dealt.
POLYGON_PARTS = 32


def _by_polygon(near: DataFrame, point_id: str, polygons: DataFrame, code: str, measure: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """point_id, code, distance where ``measure`` of a polygon's points and rings gives a number."""
    kinds = dict(near.dtypes)
    near = cut_lineage(near.withColumn("part", F.pmod(F.xxhash64(point_id), F.lit(POLYGON_PARTS)).cast("int")))
    own = near.select(F.col(code).alias("ring_code"), F.col("part").alias("ring_part")).distinct()
    rings = own.join(polygons.select(F.col(code).alias("ring_code"), "rings"), "ring_code")

    def test(of: pd.DataFrame, polygon: pd.DataFrame) -> pd.DataFrame:
        out = []
        for shape in polygon["rings"] if len(of) else ():  # a code may stand for several
            got = measure(of[["x", "y"]].to_numpy(dtype=float), [np.array([list(v) for v in ring], dtype=float) for ring in shape])
            hit = ~np.isnan(got)
            out.append(of.loc[hit, [point_id, code]].assign(distance=got[hit]))
        return pd.concat(out) if out else pd.DataFrame({point_id: [], code: [], "distance": []})

    grouped = near.groupBy(code, "part").cogroup(rings.groupBy("ring_code", "ring_part")).applyInPandas(test, f"{point_id} {kinds[point_id]}, {code} {kinds[code]}, distance double")
    return grouped.groupBy(point_id, code).agg(F.min("distance").alias("distance"))


def _chunks(xy: np.ndarray, edges: int) -> Iterator[slice]:
    step = max(1, (1 << 21) // max(1, edges))
    return (slice(lo, lo + step) for lo in range(0, len(xy), step))


def even_odd(xy: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Whether a ray from each point crosses the rings an odd number of times."""
    odd = np.zeros(len(xy), bool)
    for ring in rings:
        (ax, ay), (bx, by) = ring.T, np.roll(ring, -1, axis=0).T
        for own in _chunks(xy, len(ring)):
            x, y = xy[own, 0, None], xy[own, 1, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                at = ax + (y - ay) * (bx - ax) / (by - ay)
            odd[own] ^= (((ay > y) != (by > y)) & (x < at)).sum(axis=1) % 2 == 1
    return odd


def ring_distance(xy: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """The distance from each point to the nearest edge of the rings."""
    best = np.full(len(xy), np.inf)
    for ring in rings:
        a, d = ring, np.roll(ring, -1, axis=0) - ring
        size = (d * d).sum(axis=1)
        for own in _chunks(xy, len(ring)):
            v = xy[own, None, :] - a
            share = np.clip(np.divide((v * d).sum(axis=2), size, out=np.zeros(v.shape[:2]), where=size > 0), 0, 1)
            best[own] = np.minimum(best[own], np.hypot(*np.moveaxis(v - share[..., None] * d, 2, 0)).min(axis=1))
    return best
