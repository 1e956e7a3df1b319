"""Space: envelopes, grid cells and formulas in SQL; exact polygon tests, hulls and simplification in small numpy helpers.

A geometry is an array of points (struct lon, lat) with geom_type point, line, polygon or box, and its envelope
min_lon, min_lat, max_lon, max_lat."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.scratch import materialize

METRES_PER_DEGREE = 111111.0
EARTH_RADIUS = 6371000.0


def with_envelope(geo: DataFrame, coords: str = "coords") -> DataFrame:
    side = lambda f, field: f(F.transform(coords, lambda p: p[field]))
    return geo.withColumns({"min_lon": side(F.array_min, "lon"), "min_lat": side(F.array_min, "lat"), "max_lon": side(F.array_max, "lon"), "max_lat": side(F.array_max, "lat")})


def object_geometries(objects: DataFrame, *sources: DataFrame) -> DataFrame:
    """(id, coords, geom_type) of the first source that has one. sources: id, coords, geom_type, best first."""
    out = objects.select("id")
    names = []
    for k, s in enumerate(sources):
        out = out.join(s.select("id", F.struct("coords", "geom_type").alias(f"g{k}")), "id", "left")
        names.append(f"g{k}")
    return out.select("id", F.coalesce(*names).alias("g")).where("g is not null").select("id", "g.coords", "g.geom_type")


def explode_collections(geo: DataFrame, parts: str = "parts") -> DataFrame:
    """One row for each part (struct coords, geom_type) of a collection."""
    return geo.select(*(c for c in geo.columns if c != parts), F.posexplode(parts).alias("part_nr", "part")).select("*", "part.coords", "part.geom_type").drop("part")


def cluster_id(station: Column, site: Column, is_time_series: Column, wkt: Column) -> Column:
    """The station of a station time series, the site of a site's coverage, else the geometry's digest."""
    return F.when(is_time_series & station.isNotNull(), station).when(site.isNotNull(), site).otherwise(F.md5(wkt))


def _geometry_json(coords: Column, kind: Column) -> Column:
    """GeoJSON text of a part; rings are closed."""
    pair = F.transform(coords, lambda p: F.array(p["lon"], p["lat"]))
    ring = F.when((F.size(pair) < 3) | (F.element_at(pair, 1) == F.element_at(pair, -1)), pair).otherwise(F.array_append(pair, F.element_at(pair, 1)))
    of = lambda name, c: F.to_json(F.struct(F.lit(name).alias("type"), c.alias("coordinates")))
    return F.when(kind.isin("point", "circle", "pin"), of("Point", F.element_at(pair, 1))).when(kind == "line", of("LineString", pair)).otherwise(of("Polygon", F.array(ring)))


def to_geojson(coords: str = "coords", geom_type: str = "geom_type") -> Column:
    """GeoJSON text of a geometry; rings are closed."""
    return _geometry_json(F.col(coords), F.col(geom_type))


def parts_to_geojson(parts: Column) -> Column:
    """GeoJSON text of parts (coords, geom_type, radius, pin, label): one part as itself, more as a GeometryCollection, or, where
    one has a label, a radius (metres, two decimals) or a pin, as a FeatureCollection."""
    featured = lambda p: p["label"].isNotNull() | p["radius"].isNotNull() | p["pin"].isNotNull()
    props = lambda p: F.to_json(F.struct(F.round(p["radius"], 2).alias("radius"), p["pin"].alias("pinkind"), p["label"].alias("label")))
    geometry = lambda p: _geometry_json(p["coords"], p["geom_type"])
    feature = lambda p: F.concat(F.lit('{"type":"Feature","geometry":'), geometry(p), F.lit(',"properties":'), props(p), F.lit("}"))
    joined = lambda c, head: F.concat(F.lit(head), F.array_join(c, ","), F.lit("]}"))
    many = F.when(F.exists(parts, featured), joined(F.transform(parts, feature), '{"type":"FeatureCollection","features":[')).otherwise(joined(F.transform(parts, geometry), '{"type":"GeometryCollection","geometries":['))
    one = F.when(F.exists(parts, featured), F.element_at(F.transform(parts, feature), 1)).otherwise(F.element_at(F.transform(parts, geometry), 1))
    return F.when(F.size(parts) == 1, one).otherwise(many)


def parse_geojson(rows: DataFrame, key: str, text: str = "geojson") -> DataFrame:
    """The simple parts of GeoJSON texts: (key, path, geom_type, coords, alt, radius, pin, labels, error).

    ``path`` has the part's places in the collections around it, from 0; ``labels`` those of the features around it, outermost
    first. geom_type is point, line, polygon, circle (a point whose feature has a radius) or pin (one with a pinkind); Multi
    geometries give their parts. Rings lose their last point, which repeats the first. A text or part that isn't one of these,
    or a polygon with holes, gives one row with an ``error`` and no coords. Texts are read as variants; collections are opened
    level by level, as deep as they go."""
    V = lambda path, kind: F.try_variant_get("v", path, kind)
    empty = F.array().cast("array<string>")
    level = rows.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), empty.alias("labels"), F.lit(None).cast("double").alias("radius"), F.lit(None).cast("string").alias("pin"), F.lit(False).alias("bad"), F.col(text).alias("json"))
    done = []
    while True:
        read = level.withColumn("v", F.try_parse_json("json")).withColumn("type", V("$.type", "string"))
        kind = F.col("type")
        many = F.when(kind == "GeometryCollection", V("$.geometries", "array<variant>")).when(kind == "FeatureCollection", V("$.features", "array<variant>")).otherwise(V("$.coordinates", "array<variant>"))
        opened = kind.isin("GeometryCollection", "FeatureCollection", "MultiPoint", "MultiLineString", "MultiPolygon") & many.isNotNull()
        is_feature = (kind == "Feature") & V("$.geometry", "variant").isNotNull()
        part = F.when(kind.startswith("Multi"), F.concat(F.lit('{"type":"'), F.substring(kind, F.lit(6), F.length(kind)), F.lit('","coordinates":'), F.to_json("item"), F.lit("}"))).otherwise(F.to_json("item"))
        inner = read.where(opened).select("*", F.posexplode(many).alias("at", "item")).select("key", F.array_append("path", F.col("at")).alias("path"), "labels", F.lit(None).cast("double").alias("radius"), F.lit(None).cast("string").alias("pin"), F.lit(False).alias("bad"), part.alias("json"))
        label = V("$.properties.label", "string")
        point = V("$.geometry.type", "string") == "Point"
        has = lambda name: point & V(f"$.properties.{name}", "variant").isNotNull()
        wrong = has("radius") & V("$.properties.radius", "double").isNull()
        features = read.where(is_feature).select(
            "key", "path", F.when(label.isNull(), F.col("labels")).otherwise(F.array_append("labels", label)).alias("labels"), F.when(has("radius"), V("$.properties.radius", "double")).alias("radius"),
            F.when(has("pinkind") & ~has("radius"), V("$.properties.pinkind", "string")).alias("pin"), F.coalesce(wrong, F.lit(False)).alias("bad"), F.to_json(V("$.geometry", "variant")).alias("json"),
        )
        done.append(read.where(~F.coalesce(opened | is_feature, F.lit(False))))
        level = materialize(inner.unionByName(features), "geojson")
        if level.isEmpty():
            break
    simple = reduce(DataFrame.unionByName, done)
    kind = F.col("type")
    whole = lambda p: F.size(p) >= 2
    raw = F.when(kind == "Point", F.array(V("$.coordinates", "array<double>"))).when(kind == "LineString", V("$.coordinates", "array<array<double>>"))
    rings = V("$.coordinates", "array<array<array<double>>>")
    ring = F.when((kind == "Polygon") & (F.size(rings) == 1) & (F.size(F.get(rings, F.lit(0))) >= 2), F.slice(F.get(rings, F.lit(0)), F.lit(1), F.size(F.get(rings, F.lit(0))) - 1))
    simple = simple.withColumn("raw", F.coalesce(raw, ring)).withColumn("fits", (F.size("raw") > 0) & F.forall("raw", lambda p: p.isNotNull() & whole(p)) & ~F.col("bad"))
    ok = F.coalesce("fits", F.lit(False))
    coords = F.transform("raw", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).cast(POINT_LIST)
    named = F.when((kind == "Point") & F.col("radius").isNotNull(), "circle").when((kind == "Point") & F.col("pin").isNotNull(), "pin").when(kind == "Point", "point").when(kind == "LineString", "line").when(kind == "Polygon", "polygon")
    return simple.select(
        F.col("key").alias(key), "path", F.when(ok, named).alias("geom_type"), F.when(ok, coords).alias("coords"), F.when(ok & (kind == "Point"), F.try_element_at(F.get("raw", F.lit(0)), F.lit(3))).alias("alt"),
        F.when(ok & (kind == "Point"), F.col("radius")).alias("radius"), F.when(ok & (kind == "Point"), F.col("pin")).alias("pin"), "labels", F.when(~ok, F.coalesce(F.concat(F.lit("not a geometry: "), kind), F.lit("not GeoJSON"))).alias("error"),
    )


def segments_cross(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two polylines (n, 2) touch."""
    p, q, r, s = a[:-1, None], a[1:, None], b[None, :-1], b[None, 1:]
    side = lambda o, u, v: np.sign((u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0]))
    d1, d2, d3, d4 = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
    on = lambda o, u, v: (np.minimum(o, u) <= v).all(-1) & (v <= np.maximum(o, u)).all(-1)
    cross = (d1 * d2 < 0) & (d3 * d4 < 0) | (d1 == 0) & on(p, q, r) | (d2 == 0) & on(p, q, s) | (d3 == 0) & on(r, s, p) | (d4 == 0) & on(r, s, q)
    return bool(cross.any())


def contains_point(ring: np.ndarray, point: np.ndarray) -> bool:
    """Ray casting in a closed ring."""
    a, b = ring[:-1], ring[1:]
    cross = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((cross & (point[0] < at)).sum() % 2)


def touches(coords: np.ndarray, kind: str, area: np.ndarray) -> bool:
    """Whether a geometry meets the closed ring ``area``."""
    if kind == "point" or len(coords) == 1:
        return contains_point(area, coords[0]) or segments_cross(np.repeat(coords[:1], 2, axis=0), area)
    line = np.vstack((coords, coords[:1])) if kind in ("polygon", "box") and (coords[0] != coords[-1]).any() else coords
    return contains_point(area, line[0]) or segments_cross(line, area) or kind in ("polygon", "box") and contains_point(line, area[0])


def intersecting(geo: DataFrame, area: list[tuple[float, float]]) -> DataFrame:
    """Geometries that meet a polygon: envelopes first (prunes files), the exact test for what isn't decided by them."""
    ring = np.array([*area, area[0]] if area[0] != area[-1] else area, dtype=float)
    (x0, y0), (x1, y1) = ring.min(axis=0), ring.max(axis=0)
    near = geo.where((F.col("min_lon") <= float(x1)) & (F.col("max_lon") >= float(x0)) & (F.col("min_lat") <= float(y1)) & (F.col("max_lat") >= float(y0)))
    corners = {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}
    if len(ring) == 5 and {tuple(p) for p in ring} == corners:
        inside = (F.col("geom_type") == "point") | (F.col("geom_type") == "box")
    else:
        inside = F.lit(False)

    @F.pandas_udf("boolean")
    def exact(lon: pd.Series, lat: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([touches(np.column_stack((x, y)), k, ring) for x, y, k in zip(lon, lat, kind)], dtype=bool)

    test = exact(F.transform("coords", lambda p: p["lon"]), F.transform("coords", lambda p: p["lat"]), "geom_type")
    return near.where(inside).union(near.where(~inside).where(test))


#: Levels of the layout's cells: 360 degrees over 2**level on each side; the finest has 16 by 8 cells.
LAYOUT_LEVELS = 4


def _layout_cell(level: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("_", level.cast("string"), x.cast("string"), y.cast("string"))


def write_layout(geo: DataFrame, path: str) -> None:
    """Geometries with envelopes, written for box queries: a folder for each cell, rows in order of their envelopes.

    A geometry lies in the cell of its envelope's centre at the finest level whose cells are as large as it, once; it reaches
    into neighbouring cells by half a cell at most. Rows are dealt to tasks by ranges of cell and place, so that a cell with
    many rows is written by several tasks."""
    extent = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    level = F.when(extent > 0, F.least(F.greatest(F.floor(F.log2(F.lit(360.0) / extent)), F.lit(0)), F.lit(LAYOUT_LEVELS))).otherwise(LAYOUT_LEVELS)
    at = lambda low, high, first: F.floor(((F.col(low) + F.col(high)) / 2 - first) / (F.lit(360.0) / F.pow(F.lit(2.0), level)))
    rows = geo.withColumn("cell", _layout_cell(level, at("min_lon", "max_lon", -180), at("min_lat", "max_lat", -90)))
    rows.repartitionByRange("cell", "min_lon", "min_lat").sortWithinPartitions("cell", "min_lon", "min_lat").write.partitionBy("cell").parquet(path)


def cells_of(box: tuple[float, float, float, float]) -> list[str]:
    """The layout's cells that can hold a geometry meeting a box (min_lon, min_lat, max_lon, max_lat)."""
    out = []
    for level in range(LAYOUT_LEVELS + 1):
        size = 360 / 2**level
        (x0, x1), (y0, y1) = ((int(np.floor((box[k] - size / 2 - first) / size)), int(np.floor((box[k + 2] + size / 2 - first) / size))) for k, first in ((0, -180), (1, -90)))
        out += [f"{level}_{x}_{y}" for x in range(max(x0, -1), min(x1, 2**level) + 1) for y in range(max(y0, -1), min(y1, 2**level) + 1)]
    return out


def read_layout(spark: SparkSession, path: str, area: list[tuple[float, float]] | None = None) -> DataFrame:
    """The geometries of a layout that meet a polygon (none: all): cells prune folders, envelopes prune row groups, and what these
    don't decide gets the exact test."""
    rows = spark.read.parquet(path)
    if area is None:
        return rows
    xs, ys = [float(p[0]) for p in area], [float(p[1]) for p in area]
    return intersecting(rows.where(F.col("cell").isin(cells_of((min(xs), min(ys), max(xs), max(ys))))), area)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain; counter-clockwise, not closed."""
    pts = np.unique(points, axis=0)
    if len(pts) <= 2:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    halves = []
    for order in (pts, pts[::-1]):
        half: list = []
        for p in order:
            while len(half) >= 2 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


POINT_LIST = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


@F.pandas_udf(POINT_LIST)
def hull_of(lon: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([[{"lon": float(p[0]), "lat": float(p[1])} for p in convex_hull(np.column_stack((x, y)))] for x, y in zip(lon, lat)])


def grid_cell(lon: Column, lat: Column) -> Column:
    """One of six cells of 120 by 90 degrees (column_row, from the south-west); the one from 60 W to 60 E north of the equator
    is cut into twelve of 30 by 30, named column_row_column_row. Outer edges belong to the last cell."""
    place = lambda c, low, size, most: F.least(F.floor((c - low) / size), F.lit(most))
    x, y = place(lon, -180, 120, 2), place(lat, -90, 90, 1)
    coarse = F.concat_ws("_", x.cast("string"), y.cast("string"))
    return F.when((x == 1) & (y == 1), F.concat_ws("_", coarse, place(lon, -60, 30, 3).cast("string"), place(lat, 0, 30, 2).cast("string"))).otherwise(coarse)


def bounding_box(geo: DataFrame, by: str) -> DataFrame:
    return geo.groupBy(by).agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def characteristic_size(centroids: DataFrame, by: str) -> DataFrame:
    """Twice the mean distance of centroids (lon, lat) to their common centroid; 0 for one."""
    centre = centroids.groupBy(by).agg(F.avg("lon").alias("clon"), F.avg("lat").alias("clat"))
    away = F.sqrt(F.pow(F.col("lon") - F.col("clon"), 2) + F.pow(F.col("lat") - F.col("clat"), 2))
    return centroids.join(centre, by).groupBy(by).agg((2 * F.avg(away)).alias("size"))


def merge_labels(labels: Column) -> Column:
    """One text from label texts: split on /, the indices of names with three or more become n (X_1_2_3: X_n_n_n), distinct;
    station codes (XX-Yyy) first, then three-letter codes, others, TA last; each in order of first appearance."""
    parts = F.filter(F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "/"))), lambda x: F.trim(x)), lambda x: x != "")
    named = F.array_distinct(F.transform(parts, lambda x: F.when(x.rlike("^.+_[0-9]+_[0-9]+_[0-9]+$"), F.regexp_replace(x, "_[0-9]+", "_n")).otherwise(x)))
    rank = lambda x: F.when(x == "TA", 3).when(x.rlike("^[A-Z]{2}-[A-Za-z][A-Za-z0-9]{2}$"), 0).when(x.rlike("^[A-Z]{3}$"), 1).otherwise(2)
    of = lambda r: F.filter(named, lambda x: rank(x) == r)
    return F.array_join(F.concat(of(0), of(1), of(2), of(3)), ", ")


def circle_to_box(lat: Column, lon: Column, radius: Column) -> Column:
    """struct<min_lon, min_lat, max_lon, max_lat> around a circle (metres)."""
    dlat = radius / METRES_PER_DEGREE
    dlon = dlat / F.cos(F.radians(lat))
    return F.struct((lon - dlon).alias("min_lon"), (lat - dlat).alias("min_lat"), (lon + dlon).alias("max_lon"), (lat + dlat).alias("max_lat"))


def box_to_polygon(box: str = "box") -> Column:
    p = lambda x, y: F.struct(F.col(f"{box}.{x}").alias("lon"), F.col(f"{box}.{y}").alias("lat"))
    return F.array(p("min_lon", "min_lat"), p("max_lon", "min_lat"), p("max_lon", "max_lat"), p("min_lon", "max_lat"), p("min_lon", "min_lat"))


def position_from_offsets(lat: Column, lon: Column, north: Column, east: Column, own_lat: Column, own_lon: Column) -> Column:
    """struct<lat, lon>: own coordinates, else the station's moved by metres north and east."""
    moved_lat = lat + F.degrees(north / EARTH_RADIUS)
    moved_lon = lon + F.degrees(east / (EARTH_RADIUS * F.cos(F.radians(lat))))
    return F.struct(F.coalesce(own_lat, moved_lat).alias("lat"), F.coalesce(own_lon, moved_lon).alias("lon"))


def average_position(positions: DataFrame, by: str) -> DataFrame:
    return positions.groupBy(by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("alt").alias("alt"))


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with an explicit stack; which points stay."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        base, rel = points[b] - points[a], points[a + 1 : b] - points[a]
        n = np.hypot(*base)
        far = np.abs(base[0] * rel[:, 1] - base[1] * rel[:, 0]) / n if n else np.hypot(rel[:, 0], rel[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify_to(geo: DataFrame, n: int = 15) -> DataFrame:
    """coords simplified to at most n points, by bisection on the tolerance."""

    @F.pandas_udf(POINT_LIST)
    def run(lon: pd.Series, lat: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(lon, lat):
            pts = np.column_stack((x, y))
            low, high, best = 0.0, float(np.ptp(pts, axis=0).max()) or 1.0, np.ones(len(pts), dtype=bool)
            while len(pts) > n and high - low > 1e-9:
                mid = (low + high) / 2
                now = simplify(pts, mid)
                low, high = (mid, high) if now.sum() > n else (low, mid)
                if now.sum() <= n:
                    best = now
            out.append([{"lon": float(p[0]), "lat": float(p[1])} for p in pts[best if best.sum() <= n else simplify(pts, high)]])
        return pd.Series(out)

    return geo.withColumn("coords", run(F.transform("coords", lambda p: p["lon"]), F.transform("coords", lambda p: p["lat"])))


def snap_positions(positions: DataFrame, metres: float) -> DataFrame:
    """Per object, positions (nr, lat, lon, label) nearer than ``metres`` to an earlier one take its place; labels of one place join as a / b."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: list[list] = []
        for r in pdf.sort_values("nr").itertuples():
            for s in seen:
                dy = (r.lat - s[1]) * METRES_PER_DEGREE
                dx = (r.lon - s[2]) * METRES_PER_DEGREE * np.cos(np.radians(s[1]))
                if np.hypot(dx, dy) <= metres:
                    s[3] += [r.label] if r.label not in s[3] else []
                    break
            else:
                seen.append([r.id, r.lat, r.lon, [r.label]])
        return pd.DataFrame([(i, a, o, " / ".join(map(str, n))) for i, a, o, n in seen], columns=["id", "lat", "lon", "label"])

    return positions.groupBy("id").applyInPandas(lambda pdf: run(pdf), "id string, lat double, lon double, label string")


def object_coverage(coverage: DataFrame, pins: DataFrame) -> DataFrame:
    """(id, parts): an object's coverage and its sensors' pins as one collection. coverage: id, coords, geom_type; pins: id, lon, lat."""
    own = coverage.select("id", F.struct(F.col("coords").cast(POINT_LIST).alias("coords"), "geom_type").alias("part"))
    pin = pins.select("id", F.struct(F.array(F.struct("lon", "lat")).cast(POINT_LIST).alias("coords"), F.lit("point").alias("geom_type")).alias("part"))
    return own.union(pin).groupBy("id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
