"""Merging of coverage geometries: spatial self-joins by grid cells, transitive fusing, and hulls in rounds.

A geometry is a row (owner, geom_type, coords, label); geom_type is point, line, polygon or box, coords an array of
(lon, lat). Distances and areas are in degrees, as in the coordinate plane."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.operators import geo
from ledgerloom.operators.graph import components
from ledgerloom.scratch import discard, materialize

#: Points of one group in a round of hulls.
GROUP = 4096
#: Points that a fused geometry has at most.
DIGEST = 15
#: Grid levels: cells of 360 / 2**level degrees.
LEVELS = 24
#: A cell, quartered ``split`` times.
CELL = ["owner", "level", "split", "x", "y"]
#: Times that a cell is quartered at most, and pairs for each place of a cell up to which it isn't.
SPLITS, MATES = 8, 16


def hulls(points: DataFrame, keys: list[str], group: int | None = None) -> DataFrame:
    """(*keys, hull): the convex hull of each key's points (``p``: lon, lat).

    Points are dealt to as many groups as a key's count asks for, each group keeps its hull's points, and so on until a key
    has one group. A key whose points are nearly all on its hull is gathered once rounds don't make it smaller: its hull is
    a row of that size anyway."""
    group = group or GROUP
    gathered = lambda rows, by: rows.groupBy(*by).agg(F.collect_list("p").alias("_ps")).withColumn("hull", geo.hull_of(F.transform("_ps", lambda p: p.lon), F.transform("_ps", lambda p: p.lat))).drop("_ps")
    rest = materialize(points.select(*keys, "p").distinct(), "points")
    before = None
    while True:
        counts = rest.groupBy(*keys).agg(F.count("*").alias("_n"))
        now = counts.where(F.col("_n") > group).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if not now or before is not None and now > 0.9 * before:
            return gathered(rest, keys)
        before = now
        dealt = rest.join(counts, keys).withColumn("_group", F.pmod(F.xxhash64("p", F.lit(now)), F.ceil(F.col("_n") / group)))
        smaller = materialize(gathered(dealt, [*keys, "_group"]).select(*keys, F.explode("hull").alias("p")), "points")
        discard(rest)
        rest = smaller


def _points(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(F.col("coords").cast(geo.POINT_LIST)).alias("p"))


def cluster_extents(rows: DataFrame, group: int | None = None) -> DataFrame:
    """(cluster, n_objects, dense, hull) of rows (cluster, id, coords): one distinct geometry is dense; the hull of all points."""
    kinds = rows.groupBy("cluster").agg(F.countDistinct("id").alias("n_objects"), (F.min(F.xxhash64("coords")) == F.max(F.xxhash64("coords"))).alias("dense"))
    return kinds.join(hulls(_points(rows, "cluster"), ["cluster"], group), "cluster")


def _closed(points: np.ndarray, kind: str) -> np.ndarray:
    """The outline as a polyline of two points at least."""
    if len(points) == 1:
        return np.repeat(points, 2, axis=0)
    return np.vstack((points, points[:1])) if kind in ("polygon", "box") and (points[0] != points[-1]).any() else points


def gap(a: np.ndarray, a_kind: str, b: np.ndarray, b_kind: str) -> float:
    """The least distance of two geometries, 0 if they touch or one is in the other."""
    a, b = _closed(a, a_kind), _closed(b, b_kind)
    area = lambda kind, ring: kind in ("polygon", "box") and len(ring) > 3
    if geo.segments_cross(a, b) or area(b_kind, b) and geo.contains_point(b, a[0]) or area(a_kind, a) and geo.contains_point(a, b[0]):
        return 0.0

    def to_segments(points: np.ndarray, line: np.ndarray) -> float:
        p, q = line[:-1], line[1:]
        d = q - p
        n = np.maximum((d * d).sum(1), 1e-300)
        at = np.clip(((points[:, None] - p) * d).sum(2) / n, 0, 1)
        return float(np.hypot(*np.moveaxis(points[:, None] - (p + at[..., None] * d), 2, 0)).min())

    return min(to_segments(a, b), to_segments(b, a))


@F.pandas_udf(T.DoubleType())
def gap_of(x: pd.Series, y: pd.Series, k: pd.Series, u: pd.Series, v: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([gap(np.column_stack((a, b)), c, np.column_stack((d, e)), f) for a, b, c, d, e, f in zip(x, y, k, u, v, m)], dtype=float)


def _gap(a: str, b: str) -> Column:
    side = lambda t, f: F.transform(f"{t}.coords", lambda p: p[f])
    return gap_of(side(a, "lon"), side(a, "lat"), F.col(f"{a}.geom_type"), side(b, "lon"), side(b, "lat"), F.col(f"{b}.geom_type"))


def centroid(points: np.ndarray, kind: str) -> tuple[float, float]:
    """Of an area if it has one, else of the line's length, else of the points."""
    line = _closed(points, kind)
    if kind in ("polygon", "box"):
        x, y = (line - line[0]).T
        cross = x[:-1] * y[1:] - x[1:] * y[:-1]
        if cross.sum():
            c = ((x[:-1] + x[1:]) * cross).sum() / (3 * cross.sum()), ((y[:-1] + y[1:]) * cross).sum() / (3 * cross.sum())
            return float(c[0] + line[0, 0]), float(c[1] + line[0, 1])
    length = np.hypot(*np.diff(line, axis=0).T)
    middle = (line[:-1] + line[1:]) / 2
    c = (middle * length[:, None]).sum(0) / length.sum() if length.sum() else points.mean(0)
    return float(c[0]), float(c[1])


@F.pandas_udf(geo.POINT_LIST.elementType)
def centroid_of(x: pd.Series, y: pd.Series, kind: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([centroid(np.column_stack((a, b)), k) for a, b, k in zip(x, y, kind)], columns=["lon", "lat"])


def _area(coords: Column) -> Column:
    """The area within a ring."""
    n = F.size(coords)
    term = lambda i: F.get(coords, i).lon * F.get(coords, (i + 1) % n).lat - F.get(coords, (i + 1) % n).lon * F.get(coords, i).lat
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i))) / 2


def _at(c: Column, low: int, level: Column) -> Column:
    """The number of the cell with coordinate c, from low, in the grid of a level."""
    return F.floor((c - low) / (F.lit(360.0) / F.pow(F.lit(2.0), level))).cast("long")


def _cells(rows: DataFrame, padding: Column) -> DataFrame:
    """Places (*CELL, home, g, x0, y0, x1, y1, solid): a geometry's home is the four cells at most that its padded envelope
    (x0 to y1) meets at the finest level whose cells are as large as it; it has places there and in the cells above them,
    where these are anyone's home level."""
    pad = F.coalesce(padding, F.lit(0.0))
    wide = rows.withColumns({"x0": F.col("min_lon") - pad, "y0": F.col("min_lat") - pad, "x1": F.col("max_lon") + pad, "y1": F.col("max_lat") + pad})
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    own = F.when(extent > 0, F.least(F.greatest(F.floor(F.log2(F.lit(360.0) / extent)), F.lit(0)), F.lit(LEVELS))).otherwise(LEVELS).cast("int")
    solid = F.when(F.col("geom_type") == "box", 2).when(F.col("geom_type") == "polygon", 1).otherwise(0)
    wide = materialize(wide.withColumns({"own": own, "solid": solid}).select("owner", "g", "x0", "y0", "x1", "y1", "own", "solid"), "envelopes")
    levels = sorted(r.own for r in wide.select("own").distinct().collect())  # LEVELS + 1 at most
    some = wide.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda at: at <= F.col("own"))))
    some = some.withColumn("x", F.explode(F.sequence(_at(F.col("x0"), -180, F.col("level")), _at(F.col("x1"), -180, F.col("level")))))
    some = some.withColumn("y", F.explode(F.sequence(_at(F.col("y0"), -90, F.col("level")), _at(F.col("y1"), -90, F.col("level")))))
    return some.select("owner", "level", F.lit(0).alias("split"), "x", "y", (F.col("level") == F.col("own")).alias("home"), "g", "x0", "y0", "x1", "y1", "solid")


def _quarters(places: DataFrame) -> DataFrame:
    """The places in the four quarters of each cell. Two geometries that are near in a cell are near in one of its quarters:
    both padded envelopes hold the place where they are."""
    level = F.col("level") + F.col("split") + 1
    part = lambda c, low, high, first: F.explode(F.sequence(F.greatest(2 * F.col(c), _at(F.col(low), first, level)), F.least(2 * F.col(c) + 1, _at(F.col(high), first, level))))
    return places.withColumn("x", part("x", "x0", "x1", -180)).withColumn("y", part("y", "y0", "y1", -90)).withColumn("split", F.col("split") + 1)


def _leaders(places: DataFrame) -> DataFrame:
    """(*CELL, a): the geometry at home in a cell that fills most of it; boxes before polygons before others."""
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level") + F.col("split"))
    length = lambda c, low, high, first: F.least(F.col(high), (F.col(c) + 1) * side + first) - F.greatest(F.col(low), F.col(c) * side + first)
    order = F.struct("solid", length("x", "x0", "x1", -180) * length("y", "y0", "y1", -90), -F.col("g"))
    return places.where("home").groupBy(*CELL).agg(F.max_by("g", order).alias("a"))


def _left(places: DataFrame) -> DataFrame:
    """(*CELL, n, pairs): cells with pairs of different classes ``c``, one of them at home there; their number, and the places."""
    by = places.groupBy(*CELL, "c").agg(F.count("*").alias("n"), F.count_if("home").alias("h"))
    return by.groupBy(*CELL).agg(F.sum("n").alias("n"), (F.sum("h") * F.sum("n") - F.sum(F.col("h") * F.col("n"))).alias("pairs")).where("pairs > 0")


def _classes(rows: DataFrame, distance: Column) -> DataFrame:
    """(g, component): geometries of an owner that are within ``distance`` (a column of rows) of others, under the least number
    of those they reach, directly or through others. Geometries without such others are left out.

    In each cell all are tested against one first. A cell that this leaves with no two components is done; others are
    quartered and tested again. What meets as pairs, of different components only, are cells with few pairs for their size and
    those whose quarters would have more than twice the pairs of the cell that was quartered first."""
    data = rows.select("g", "coords", "geom_type", "min_lon", "min_lat", "max_lon", "max_lat", distance.alias("d"))
    classes = materialize(rows.select("g", F.col("g").alias("c")), "classes")
    named = lambda df, g="g", c="c": df.join(classes.select(F.col("g").alias(g), F.col("c").alias(c)), g)

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(data.alias("p"), F.col("a") == F.col("p.g")).join(data.alias("q"), F.col("b") == F.col("q.g"))
        envelopes = F.lit(True)
        for low, high in (("min_lon", "max_lon"), ("min_lat", "max_lat")):
            envelopes = envelopes & (F.col(f"p.{low}") <= F.col(f"q.{high}") + F.col("q.d")) & (F.col(f"q.{low}") <= F.col(f"p.{high}") + F.col("p.d"))
        return both.where(envelopes).where(_gap("p", "q") <= F.col("p.d")).select("a", "b")

    def joined(pairs: DataFrame) -> DataFrame:
        """classes with those of near pairs (a, b) as one."""
        tested = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        links = materialize(named(named(near(tested), "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
        discard(tested)
        if links.isEmpty():
            discard(links)
            return classes
        moved = materialize(components(links), "moved")
        now = materialize(classes.join(moved, classes.c == moved.node, "left").select("g", F.coalesce("component", "c").alias("c")), "classes")
        discard(classes, links, moved)
        return now

    places, before, apart = materialize(_cells(rows, distance), "places"), None, []
    above = [*CELL[:2], (F.col("split") - 1).alias("split"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")]
    while True:
        classes = joined(named(named(places.join(_leaders(places), CELL)), "a", "ca").where("c <> ca").select("a", F.col("g").alias("b")))
        left = materialize(_left(named(places)).withColumn("most", F.col("pairs").cast("double")), "left")
        if before:
            parents = materialize(left.groupBy(*above).agg(F.sum("pairs").alias("now")).join(before[1].select(*CELL, "most"), CELL), "parents")
            apart.append(materialize(before[0].join(parents.where("now > 2 * most"), CELL, "left_semi"), "apart"))
            share = parents.where("now <= 2 * most").select("owner", "level", F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("most") / F.col("now")).alias("share"))
            left = left.withColumns({"_x": F.shiftright("x", 1), "_y": F.shiftright("y", 1)}).join(share, ["owner", "level", "_x", "_y"]).select(*CELL, "n", "pairs", (F.col("pairs") * F.col("share")).alias("most"))
            discard(*before)
        few = (F.col("pairs") <= MATES * F.col("n")) | (F.col("split") >= SPLITS)
        apart.append(materialize(places.join(left.where(few), CELL, "left_semi"), "apart"))
        many = materialize(left.where(~few), "many")
        if many.isEmpty():
            break
        before = materialize(places.join(many, CELL, "left_semi"), "places"), many
        discard(places)
        places = materialize(_quarters(before[0]), "places")
    rest = named(reduce(DataFrame.union, apart))
    one, two = (rest.select(*CELL, "home", F.col("g").alias(g), F.col("c").alias(f"c{g}"), *(F.col(c).alias(f"{c}{g}") for c in ("x0", "y0", "x1", "y1"))) for g in "ab")
    meet = "a <> b and ca <> cb and x0a <= x1b and x0b <= x1a and y0a <= y1b and y0b <= y1a"
    classes = joined(one.where("home").drop("home").join(two.drop("home"), CELL).where(meet).select("a", "b"))
    moved = classes.where("c <> g").select("g", F.col("c").alias("component"))
    return moved.union(moved.select(F.col("component").alias("g"), "component").distinct())


def _digest(rows: DataFrame) -> DataFrame:
    """Rings simplified to DIGEST points, the closing one counted."""
    ring = F.concat("coords", F.slice("coords", 1, 1))
    big = geo.simplify_to(rows.where(F.size("coords") >= DIGEST).withColumn("coords", ring), DIGEST)
    return rows.where(F.size("coords") < DIGEST).unionByName(big.withColumn("coords", F.slice("coords", F.lit(1), F.size("coords") - 1)))


def _fuse(rows: DataFrame, distance: Column, thin: bool) -> DataFrame:
    """rows with each component of near geometries as one: the hull of its points, simplified to DIGEST points. With ``thin``,
    the members of components of three at most whose hull is very thin stay as they are."""
    member = materialize(rows.join(_classes(rows, distance), "g", "left"), "members")
    joined = member.where("component is not null")
    shape = hulls(_points(joined, "component"), ["component"])
    labels = joined.select("component", F.explode_outer("labels").alias("label")).distinct().groupBy("component").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    sizes = joined.groupBy("component").agg(F.count("*").alias("n"), F.first("owner").alias("owner"), F.min("min_lon").alias("x0"), F.min("min_lat").alias("y0"), F.max("max_lon").alias("x1"), F.max("max_lat").alias("y1"))
    fused = sizes.join(shape, "component").join(labels, "component")
    diameter2 = F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)
    keep = (F.col("n") <= 3) & (_area(F.col("hull")) < 0.05 * diameter2) if thin else F.lit(False)
    fused = materialize(fused.withColumn("keep", keep), "fused")
    kind = F.when(F.size("hull") == 1, "point").when(F.size("hull") == 2, "line").otherwise("polygon")
    made = _digest(fused.where("not keep").select("owner", F.col("component").alias("g"), F.col("hull").alias("coords"), kind.alias("geom_type"), "labels"))
    alone = member.join(fused.where("not keep").select("component"), "component", "left_anti").select("owner", "g", "coords", "geom_type", "labels")
    return materialize(geo.with_envelope(made.unionByName(alone)), "geometries")


def merge_coverage(rows: DataFrame, most: int) -> DataFrame:
    """(owner, coords, geom_type, label, pin): the geometries of each owner with those that touch fused, transitively; where
    more than ``most`` are left, also those within 1 % of the owner's characteristic size.

    rows: owner, coords, geom_type, label. A fused geometry is the convex hull of its members, with DIGEST points at most (an
    exact union isn't built). Labels are merged as in geo.merge_labels, in text order. Small polygons have a pin, their
    centroid. Geometries without coords are left out; a null owner is one; equal geometries of an owner are one from the
    start, whatever their number."""
    owned = rows.where(F.size("coords") > 0).select("owner", F.col("coords").cast(geo.POINT_LIST).alias("coords"), "geom_type", "label")
    same = owned.groupBy("owner", "coords", "geom_type").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    one = materialize(geo.with_envelope(same.withColumn("g", F.monotonically_increasing_id())).withColumn("owner", F.struct("owner")), "geometries")
    fused = _fuse(one, F.lit(0.0), thin=False)
    size_of = lambda df: characteristic_sizes(df).select("owner", "size", "n")
    sizes = materialize(size_of(fused), "sizes")
    sized = fused.join(sizes, "owner")
    many = materialize(sized.where(F.col("n") > most), "many")
    close = _fuse(many, 0.01 * F.col("size"), thin=True)
    few = sized.where(F.col("n") <= most).select(close.columns)
    out = few.union(close).join(sizes.select("owner", "size"), "owner")
    diameter = F.sqrt(F.pow(F.col("max_lon") - F.col("min_lon"), 2) + F.pow(F.col("max_lat") - F.col("min_lat"), 2))
    small = F.col("geom_type").isin("polygon", "box") & (diameter < 0.04 * F.col("size"))
    return out.select("owner.owner", "coords", "geom_type", geo.merge_labels(F.col("labels")).alias("label"), F.when(small, _centre()).alias("pin"))


def _centre() -> Column:
    return centroid_of(F.transform("coords", lambda p: p["lon"]), F.transform("coords", lambda p: p["lat"]), "geom_type")


def characteristic_sizes(rows: DataFrame) -> DataFrame:
    """(owner, size, n): twice the mean distance of the geometries' centroids to their common one."""
    centres = rows.select("owner", _centre().alias("c")).select("owner", "c.lon", "c.lat")
    return geo.characteristic_size(centres, "owner").join(centres.groupBy("owner").agg(F.count("*").alias("n")), "owner")
