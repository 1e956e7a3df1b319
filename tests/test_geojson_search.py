"""GeoJSON of every kind, layouts that prune, and filters that need other tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import geo, search

TEXTS = {
    "point": {"type": "Point", "coordinates": [1, 2, 30.5]},
    "line": {"type": "LineString", "coordinates": [[0, 0], [1.5, 2]]},
    "polygon": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
    "circle": {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": {"radius": 12.5, "label": "C"}},
    "pin": {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": {"pinkind": "Sensor"}},
    "labelled": {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {"label": "L", "radius": 3}},
    "no_properties": {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": None},
    "multi_point": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]},
    "multi_line": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]},
    "multi_polygon": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
    "nested": {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"label": "outer"}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "GeometryCollection", "geometries": [{"type": "MultiPoint", "coordinates": [[7, 8]]}]}]}},
            {"type": "Feature", "properties": {"radius": 2, "label": "x"}, "geometry": {"type": "Point", "coordinates": [9, 9]}},
        ],
    },
    "empty_collection": {"type": "GeometryCollection", "geometries": []},
    "holes": {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]},
    "unknown": {"type": "Curve", "coordinates": [1, 2]},
    "bad_radius": {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": {"radius": "wide"}},
    "short": {"type": "Point", "coordinates": [1]},
    "no_geometry": {"type": "Feature", "properties": {}},
}


def test_geojson_of_every_kind(spark):
    rows = [(k, json.dumps(v)) for k, v in TEXTS.items()] + [("broken", "{"), ("null", None), ("number", "3")]
    found = {}
    for r in geo.parse_geojson(spark.createDataFrame(rows, "id string, geojson string"), "id").collect():
        found.setdefault(r.id, []).append((list(r.path), r.geom_type, r.coords and [tuple(p) for p in r.coords], r.alt, r.radius, r.pin, list(r.labels), r.error))
    for v in found.values():
        v.sort(key=lambda x: x[0])
    one = lambda kind, coords, alt=None, radius=None, pin=None, labels=(), path=(): (list(path), kind, [tuple(map(float, c)) for c in coords], alt, radius, pin, list(labels), None)
    bad = lambda what: [([], None, None, None, None, None, [], what)]
    assert found == {
        "point": [one("point", [(1, 2)], 30.5)], "line": [one("line", [(0, 0), (1.5, 2)])], "polygon": [one("polygon", [(0, 0), (1, 0), (1, 1)])],
        "circle": [one("circle", [(5, 6)], radius=12.5, labels=["C"])], "pin": [one("pin", [(5, 6)], pin="Sensor")], "labelled": [one("line", [(0, 0), (1, 1)], labels=["L"])], "no_properties": [one("point", [(5, 6)])],
        "multi_point": [one("point", [(1, 2)], path=[0]), one("point", [(3, 4)], path=[1])], "multi_line": [one("line", [(0, 0), (1, 1)], path=[0]), one("line", [(2, 2), (3, 3), (4, 4)], path=[1])],
        "multi_polygon": [one("polygon", [(0, 0), (1, 0), (1, 1)], path=[0]), one("polygon", [(5, 5), (6, 5), (6, 6)], path=[1])],
        "nested": [one("point", [(1, 1)], labels=["outer"], path=[0, 0]), one("point", [(7, 8)], labels=["outer"], path=[0, 1, 0, 0]), one("circle", [(9, 9)], radius=2.0, labels=["x"], path=[1])],
        "holes": bad("not a geometry: Polygon"), "unknown": bad("not a geometry: Curve"), "bad_radius": bad("not a geometry: Point"), "short": bad("not a geometry: Point"), "no_geometry": bad("not a geometry: Feature"),
        "broken": bad("not GeoJSON"), "null": bad("not GeoJSON"), "number": bad("not GeoJSON"),
    }
    assert geo.parse_geojson(spark.createDataFrame([], "id string, geojson string"), "id").count() == 0


def test_geojson_round_trip(spark):
    kept = [k for k in TEXTS if k in ("point", "line", "polygon", "circle", "pin", "labelled", "multi_point", "nested")]
    parts = geo.parse_geojson(spark.createDataFrame([(k, json.dumps(TEXTS[k])) for k in kept], "id string, geojson string"), "id")
    part = F.struct("coords", "geom_type", "radius", "pin", F.try_element_at("labels", F.lit(-1)).alias("label"))
    rows = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", part.alias("part")))).alias("ps")).select("id", geo.parts_to_geojson(F.transform("ps", lambda p: p.part)).alias("geojson"))
    texts = {r.id: json.loads(r.geojson) for r in rows.collect()}
    assert texts["polygon"] == TEXTS["polygon"] and texts["circle"] == TEXTS["circle"] and texts["pin"] == TEXTS["pin"]
    assert texts["multi_point"]["type"] == "GeometryCollection" and texts["nested"]["type"] == "FeatureCollection"
    again = geo.parse_geojson(rows, "id")
    strip = lambda df: sorted((r.id, r.geom_type, [tuple(p) for p in r.coords], r.radius, r.pin) for r in df.collect())
    assert strip(again) == strip(parts)


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        x, y, w = float(rng.uniform(-180, 170)), float(rng.uniform(-90, 80)), float(rng.choice([0, 0.5, 9, 60]))
        coords = [(x, y)] if not w else [(x, y), (x + w, y), (x + w, y + w / 2), (x, y + w / 2)]
        rows.append((str(i % 700), coords, "box" if w else "point"))
    return geo.with_envelope(spark.createDataFrame(rows, "id string, coords array<struct<lon: double, lat: double>>, geom_type string")).cache()


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if "numFiles" in node.metrics().keys().mkString(","):
            found += node.metrics().apply("numFiles").value()
        stack += [node.children().apply(k) for k in range(node.children().size())]
    return found


@pytest.mark.parametrize("area", [[(10, 10), (20, 10), (20, 18), (10, 18)], [(-170, -80), (-100, -60), (-150, 0)], [(-180, -90), (180, -90), (180, 90), (-180, 90)], [(179.5, 89), (180, 89), (180, 90)]])
def test_layout_prunes_and_finds_the_same(spark, places, tmp_path, area):
    path = str(tmp_path / "layout")
    geo.write_layout(places, path)
    key = lambda df: sorted((r.id, tuple(tuple(p) for p in r.coords)) for r in df.select("id", "coords").collect())
    found = geo.read_layout(spark, path, area)
    assert key(found) == key(geo.intersecting(places, area)) and key(geo.read_layout(spark, path)) == key(places)
    scans = 2 if len(area) == 4 else 1  # decided by envelopes, and by the exact test
    every, some = files_read(geo.read_layout(spark, path)), files_read(found)
    assert some <= 0.2 * scans * every or area[0] == (-180, -90) or len(area) == 3 and some <= 0.6 * 2 * every


def test_filters_with_other_tables_combine(spark, places):
    objects = spark.createDataFrame([(str(i), i % 5, i % 3, i % 11 * 1.0, None if i % 4 == 0 else i % 7) for i in range(700)], "id string, spec int, submitter int, height double, station int")
    area = [(0, 0), (60, 0), (60, 50), (0, 50)]
    inside = {r.id for r in geo.intersecting(places, area).select("id").collect()}
    bridge = spark.createDataFrame([(str(i), f"k{i % 6}") for i in range(700)] + [(str(i), "k0") for i in range(0, 700, 9)], "id string, keyword string")
    keyed = {str(i) for i in range(700) if i % 6 == 0 or i % 9 == 0}
    stations = spark.createDataFrame([(2,), (5,), (5,), (None,)], "station int")
    geo_filter, key_filter, high = search.intersects(places, area), search.has_keyword(bridge, ["k0"]), search.compare("height", ">=", 6)
    rows = {r.id: r for r in objects.collect()}
    tests = {
        "and": (geo_filter & key_filter & high, lambda i, r: i in inside and i in keyed and r.height >= 6),
        "or": (geo_filter | (key_filter & high), lambda i, r: i in inside or i in keyed and r.height >= 6),
        "not": (~geo_filter & ~search.any_of("station", stations), lambda i, r: i not in inside and r.station not in (2, 5)),
        "twice": (geo_filter | (geo_filter & key_filter), lambda i, r: i in inside),
        "in": (search.any_of("station", stations), lambda i, r: r.station in (2, 5)),
        "none": (search.intersects(places.limit(0), area), lambda i, r: False),
    }
    for name, (condition, test) in tests.items():
        found = search.fetch_objects(objects, condition)
        assert found.columns == objects.columns, name
        assert sorted(r.id for r in found.collect()) == sorted(i for i, r in rows.items() if test(i, r)), name
    stats = {(r.spec, r.submitter): 0 for r in rows.values()}
    for r in search.object_stats(objects, geo_filter, by_site=False).collect():
        stats[r.spec, r.submitter] += r.n
    assert sum(stats.values()) == sum(i in inside for i in rows)
    plan = search.fetch_objects(objects, geo_filter & high)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
