"""More registered queries: statements of nested and overlaid graphs, reports, validation, reconciliation, exports and space."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import terms
from ledgerloom.operators import coverage, export, geo, intervals, reconcile, reports, search, statements as st, validate
from ledgerloom.plans import bridge
from ledgerloom.plans.catalog import flagged, packages, query
from ledgerloom.scratch import dealt, shared_dir
from ledgerloom.streaming import log_streams


def _statements(rows, subj, pred, obj, kind=1, graph="objects"):
    return rows.select(F.lit(graph).alias("graph"), subj.cast("string").alias("subj"), F.lit(pred).alias("pred"), obj.cast("string").alias("obj"), F.lit(kind).alias("obj_kind"), F.lit("xsd:string" if kind else None).cast("string").alias("lit_attr"))


def _key(c="id"):
    return F.col(c).cast("bigint")


# Statements


@query("SELECT id subj, 'hasName' pred, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'over_' || file_name ELSE file_name END obj FROM objects WHERE CAST(id AS BIGINT) % 3 <> 0 OR CAST(id AS BIGINT) % 4 = 0")
def b10_overlay(s, d):
    o = bridge.objects(s, d)
    base, over = o.where("cast(id as bigint) % 3 <> 0"), o.where("cast(id as bigint) % 4 = 0")
    rows = _statements(base, F.col("id"), "hasName", F.col("file_name"), graph="base").union(_statements(over, F.col("id"), "hasName", F.concat(F.lit("over_"), "file_name"), graph="over"))
    return st.overlay(rows, "base", "over", ["hasName"])


@query("SELECT id subj, false assertion FROM objects WHERE CAST(id AS BIGINT) % 3 = 0 AND CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT id, true FROM objects WHERE CAST(id AS BIGINT) % 3 = 1 AND CAST(id AS BIGINT) % 2 = 1")
def b15_effective_only(s, d):
    """Of names that are there for even ids: retractions for ids divisible by 3, assertions for those with remainder 1."""
    names = st.match(st.objects_to_statements(bridge.objects(s, d)), p="hasName")
    updates = names.where(_key("subj") % 3 != 2).withColumn("assertion", _key("subj") % 3 == 1)
    return st.effective_only(updates, names.where(_key("subj") % 2 == 0)).select("subj", "assertion")


@query(""", r AS (SELECT id subj, 'hasName' pred, file_name obj FROM objects UNION ALL SELECT new, 'isNextVersionOf', old FROM edges UNION ALL SELECT id, 'wasAcquiredBy', id || '00000000' FROM objects UNION ALL SELECT id || '00000000', 'hasStartTime', CAST(spec AS VARCHAR) FROM objects),
  p AS (SELECT id FROM objects WHERE spec = 7) SELECT DISTINCT * FROM r WHERE subj IN (SELECT id FROM p) OR obj IN (SELECT id FROM p) OR subj IN (SELECT id || '00000000' FROM p)""")
def b19_purge_closure(s, d):
    o, e = bridge.objects(s, d), bridge.edges(s, d)
    acq = F.concat("id", F.lit("00000000"))
    rows = _statements(o, F.col("id"), "hasName", F.col("file_name")).union(_statements(e, F.col("new"), "isNextVersionOf", F.col("old"), 0))
    rows = rows.union(_statements(o, F.col("id"), "wasAcquiredBy", acq, 0)).union(_statements(o, acq, "hasStartTime", F.col("spec")))
    return st.purge_closure(rows, o.where("spec = 7").select(F.col("id").alias("subj"))).select("subj", "pred", "obj")


@query("""WITH r AS (SELECT id subj, 'hasName' pred, file_name obj FROM objects UNION ALL SELECT id, 'wasAcquiredBy', id || '00000000' FROM objects UNION ALL SELECT id || '00000000', 'hasStartTime', CAST(spec AS VARCHAR) FROM objects UNION ALL SELECT id, 'isNextVersionOf', CAST(CAST(id AS BIGINT) + 1 AS VARCHAR) FROM objects WHERE spec = 1
  UNION ALL SELECT '77770000' || old, 'isNextVersionOf', old FROM edges UNION ALL SELECT '77770000' || old, 'rdf:type', 'PlainCollection' FROM edges UNION ALL SELECT '77770000' || old, 'dcterms:hasPart', new FROM edges UNION ALL SELECT '77770000' || old, 'dcterms:hasPart', old || '9' FROM edges JOIN objects ON old = id WHERE spec % 2 = 0),
  sole AS (SELECT subj FROM r WHERE pred = 'dcterms:hasPart' GROUP BY subj HAVING count(DISTINCT obj) = 1), o AS (SELECT id FROM objects WHERE spec < 6)
  SELECT DISTINCT id AS of_, subj, pred, obj FROM o JOIN r ON r.subj = id UNION SELECT id, r.subj, r.pred, r.obj FROM o JOIN r ON r.subj = id || '00000000' UNION SELECT o.id, c.subj, c.pred, c.obj FROM o JOIN r h ON h.pred = 'dcterms:hasPart' AND h.obj = o.id JOIN r c ON c.subj = h.subj WHERE h.subj IN (SELECT subj FROM sole) OR c.pred = 'dcterms:hasPart' AND c.obj = o.id""".replace("WITH r", ", r", 1))
def b22_current_object_statements(s, d):
    """Objects in plain collections, alone or with another, with acquisition nodes."""
    o, e = bridge.objects(s, d), bridge.edges(s, d)
    acq, coll = F.concat("id", F.lit("00000000")), F.concat(F.lit("77770000"), "old")
    rows = _statements(o, F.col("id"), "hasName", F.col("file_name")).union(_statements(o, F.col("id"), "wasAcquiredBy", acq, 0)).union(_statements(o, acq, "hasStartTime", F.col("spec")))
    rows = rows.union(_statements(o.where("spec = 1"), F.col("id"), "isNextVersionOf", _key() + 1, 0)).union(_statements(e, coll, "isNextVersionOf", F.col("old"), 0)).union(_statements(e, coll, st.TYPE, F.lit("PlainCollection"), 0))
    even = e.join(o.where("spec % 2 = 0").select(F.col("id").alias("old")), "old", "left_semi")
    rows = rows.union(_statements(e, coll, "dcterms:hasPart", F.col("new"), 0)).union(_statements(even, coll, "dcterms:hasPart", F.concat("old", F.lit("9")), 0))
    return st.current_object_statements(rows, o.where("spec < 6").select(F.col("id").alias("subj"))).select(F.col("of").alias("of_"), "subj", "pred", "obj")


@query("SELECT CAST(coll AS VARCHAR) subj, string_agg(member, ',' ORDER BY CASE WHEN CAST(member AS BIGINT) % 2 = 0 THEN CAST(member AS BIGINT) ELSE 2147483647 END, member) members FROM members GROUP BY coll")
def b23_ordered_members(s, d):
    """Even members by an index, the others by name."""
    m = bridge.members(s, d)
    pred = F.when(_key("member") % 2 == 0, F.concat(F.lit("rdf:_"), "member")).otherwise("rdf:member")
    return st.ordered_members(m.select(F.col("coll").cast("string").alias("subj"), pred.alias("pred"), F.col("member").alias("obj"))).select("subj", F.array_join("members", ",").alias("members"))


@query("SELECT new subj, old obj, file_name obj_label FROM edges JOIN objects ON old = id WHERE CAST(new AS BIGINT) % 8 = 0")
def b26_resource_view(s, d):
    o, e = bridge.objects(s, d), bridge.edges(s, d)
    names = o.select(F.col("id").alias("subj"), F.col("file_name").alias("label"))
    return st.resource_view(_statements(e, F.col("new"), "isNextVersionOf", F.col("old"), 0), o.where(_key() % 8 == 0).select(F.col("id").alias("subj")), names).select("subj", "obj", "obj_label")


@query("SELECT new subj, old obj, file_name subj_label FROM edges JOIN objects ON new = id WHERE CAST(old AS BIGINT) % 3 = 0")
def b26_resource_usages(s, d):
    o, e = bridge.objects(s, d), bridge.edges(s, d)
    names = o.select(F.col("id").alias("subj"), F.col("file_name").alias("label"))
    return st.resource_usages(_statements(e, F.col("new"), "isNextVersionOf", F.col("old"), 0), o.where(_key() % 3 == 0).select(F.col("id").alias("subj")), names).select("subj", "obj", "subj_label")


# The log


@query(""", m AS (SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) k, sum(value) c FROM events GROUP BY ALL)
  SELECT a.user_id client, a.k AS minute, round(a.c, 4) minute_cost, round(sum(b.c), 4) hour_cost, a.c > 900 OR sum(b.c) > 1500 over_quota FROM m a JOIN m b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 59 AND a.k GROUP BY a.user_id, a.k, a.c""")
def l10_windowed_cost(s, d):
    runs = bridge.table(s, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("value").alias("cost"))
    found = log_streams.stream_cost(runs, 900, 1500)
    return found.select("client", (F.floor(F.unix_seconds(F.col("until").cast("timestamp")) / 60) - 1).alias("minute"), F.round("minute_cost", 4).alias("minute_cost"), F.round("hour_cost", 4).alias("hour_cost"), "over_quota")


# Search


def _places(s, d):
    """Stations as points, or as boxes for every third."""
    x = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    big = F.col("station") % 3 == 0
    rows = bridge.stations(s, d).select("station", F.when(big, F.array(x(0, 0), x(9, 0), x(9, 6), x(0, 6))).otherwise(F.array(x(0, 0))).alias("coords"), F.when(big, "box").otherwise("point").alias("geom_type"))
    return geo.with_envelope(rows)


_INSIDE = "(SELECT station FROM stations WHERE lon <= 60 AND lon + CASE WHEN station % 3 = 0 THEN 9 ELSE 0 END >= -60 AND lat <= 50 AND lat + CASE WHEN station % 3 = 0 THEN 6 ELSE 0 END >= -30)"


@query(f"SELECT id FROM objects WHERE coalesce(station IN {_INSIDE}, false) AND height >= 50 OR NOT coalesce(station IN {_INSIDE}, false) AND spec = 3")
def o11_intersects(s, d):
    """Through a layout of the stations' geometries, of which only the cells near the box are read."""
    path = f"{shared_dir(s)}/layout-{uuid.uuid4().hex}"
    geo.write_layout(_places(s, d), path)
    area = [(-60, -30), (60, -30), (60, 50), (-60, 50)]
    inside = search.intersects(geo.read_layout(s, path, area), area, "station")
    f = inside & search.compare("height", ">=", 50) | ~inside & search.compare("spec", "=", 3)
    return search.fetch_objects(bridge.objects(s, d), f).select("id")


# Reports


@query("""SELECT DISTINCT spec, name, value_type, coalesce(unit, '(not applicable)') unit FROM (SELECT spec, 'c' || (spec % 4) name, 'vt' || (spec % 3) value_type, CASE WHEN spec % 2 = 0 THEN 'ppm' END unit FROM specs
  UNION ALL SELECT CAST(p_size % 25 AS INT), 'v' || (p_partkey % 6), p_type, CASE WHEN p_partkey % 6 < 3 THEN p_type END FROM part) WHERE NOT (name = 'v1' OR name = 'c3')""")
def p02_spec_variables(s, d):
    sp, parts = bridge.specs(s, d), bridge.table(s, d, "part")
    columns = sp.select("spec", F.concat(F.lit("c"), F.col("spec") % 4).alias("name"), F.concat(F.lit("vt"), F.col("spec") % 3).alias("value_type"), F.when(F.col("spec") % 2 == 0, "ppm").alias("unit"))
    n = F.col("p_partkey") % 6
    variables = parts.select((F.col("p_size") % 25).cast("int").alias("spec"), F.concat(F.lit("v"), n).alias("name"), F.col("p_type").alias("value_type"), F.when(n < 3, F.col("p_type")).alias("unit"))
    flags = columns.select("spec", "name").union(variables.select("spec", "name")).where("name in ('v1', 'c3')")
    return reports.spec_variables(columns, variables, flags)


@query("SELECT id subj, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN file_name ELSE 'label ' || id END AS label FROM objects WHERE spec % 5 <> 2")
def p05_labels(s, d):
    o = bridge.objects(s, d)
    rows = _statements(o.where(_key() % 2 == 0), F.col("id"), "hasName", F.col("file_name")).union(_statements(o, F.col("id"), "rdfs:label", F.concat(F.lit("label "), "id")))
    rows = rows.union(_statements(o, F.col("id"), st.TYPE, F.concat(F.lit("Class"), F.col("spec") % 5), 0))
    return reports.labels(rows, s.createDataFrame([("Class2",)], "obj string"))


def _people(s, d):
    return bridge.memberships(s, d).withColumn("last_name", F.col("person")).withColumn("email", F.concat(F.lit("P"), F.substring("person", 2, 9), F.lit("@Example.org")))


@query("SELECT station, name, string_agg(DISTINCT person, ';' ORDER BY person) pis FROM memberships JOIN stations USING (station) WHERE role = 'PI' AND stop IS NULL GROUP BY station, name")
def p07_stations_with_pis(s, d):
    return reports.stations_with_pis(bridge.stations(s, d).select("station", "name"), _people(s, d))


@query("SELECT DISTINCT o.spec, o.id, types.file_type FROM objects o JOIN (SELECT DISTINCT p_type file_type, CAST(p_size % 25 AS INT) spec FROM part) types USING (spec) WHERE file_type = (SELECT min(p_type) FROM part) AND data_start >= TIMESTAMP '1995-01-01'")
def p10_raw_files_by_type(s, d):
    parts = bridge.table(s, d, "part")
    types = parts.select(F.col("p_type").alias("file_type"), (F.col("p_size") % 25).cast("int").alias("spec")).distinct()
    first = parts.agg(F.min("p_type")).first()[0]
    return reports.raw_files_by_type(bridge.objects(s, d), types, first, since="1995-01-01").select("spec", F.trim("pid").alias("id"), F.lit(first).alias("file_type"))


@query("""SELECT spec, name, value_type, format, good_flags FROM (SELECT DISTINCT CAST(p_size % 25 AS INT) spec, 'v' || (p_partkey % 6) name, p_type value_type FROM part) LEFT JOIN
  (SELECT p_type value_type, min(p_size % 4) format FROM part GROUP BY 1) USING (value_type) LEFT JOIN (SELECT p_size % 4 format, string_agg(DISTINCT 'f' || (p_partkey % 5), ';' ORDER BY 'f' || (p_partkey % 5)) good_flags FROM part WHERE p_size % 4 < 2 GROUP BY 1) USING (format)""")
def p11_preview_schema(s, d):
    parts = bridge.table(s, d, "part").withColumn("format", F.col("p_size") % 4)
    columns = parts.select((F.col("p_size") % 25).cast("int").alias("spec"), F.concat(F.lit("v"), F.col("p_partkey") % 6).alias("name"), F.col("p_type").alias("value_type")).distinct()
    formats = parts.groupBy(F.col("p_type").alias("value_type")).agg(F.min("format").alias("format"))
    return reports.preview_schema(columns, formats, parts.where("format < 2").select("format", F.concat(F.lit("f"), F.col("p_partkey") % 5).alias("flag"))).select("spec", "name", "value_type", "format", "good_flags")


@query("SELECT DISTINCT station FROM memberships WHERE person = 'P7' AND stop IS NULL")
def p18_stations_of_pi(s, d):
    return reports.stations_of_pi(_people(s, d), "p7@EXAMPLE.ORG")


@query("""SELECT station, a.n n_a, b.n n_b, a.h h_a, b.h h_b FROM (SELECT station, count(*) n, max(height) h FROM objects WHERE cust % 2 = 0 GROUP BY 1) a JOIN (SELECT station, count(*) n, CASE WHEN count(*) % 2 = 0 THEN max(height) END h FROM objects WHERE cust % 2 = 1 GROUP BY 1) b USING (station)
  WHERE coalesce(a.n <> b.n, false) OR coalesce(a.h <> b.h, false)""")
def p24_station_discrepancies(s, d):
    o = bridge.objects(s, d).where("station is not null")
    one = o.where("cust % 2 = 0").groupBy("station").agg(F.count("*").alias("n"), F.max("height").alias("h"))
    two = o.where("cust % 2 = 1").groupBy("station").agg(F.count("*").alias("n"), F.when(F.count("*") % 2 == 0, F.max("height")).alias("h"))
    return reports.station_discrepancies(one, two, ["n", "h"])


@query("""SELECT station, CASE WHEN day IS NOT NULL THEN 'labelled ' || strftime(day, '%Y-%m-%d') WHEN station % 3 > 0 THEN 'step' || (station % 3) ELSE 'not started' END status
  FROM stations LEFT JOIN (SELECT station, min(data_start) AS day FROM objects WHERE spec = 1 GROUP BY 1) USING (station)""")
def p25_labelling_status(s, d):
    stations = bridge.stations(s, d).select("station")
    statuses = stations.where("station % 3 > 0").withColumn("status", F.concat(F.lit("step"), F.col("station") % 3))
    return reports.labelling_status(stations, statuses, bridge.objects(s, d).where("spec = 1").groupBy("station").agg(F.min("data_start").alias("labelled")))


@query("SELECT station FROM stations WHERE station NOT IN (SELECT station FROM memberships WHERE role = 'PI' AND stop IS NULL AND weight = 2)")
def p26_no_activity(s, d):
    return reports.no_activity(bridge.stations(s, d).select("station"), bridge.memberships(s, d).where("role = 'PI' and stop is null and weight = 2"))


@query("SELECT station, name, m.person, role, weight, m.start, m.stop FROM memberships m JOIN stations USING (station)")
def p27_station_roles(s, d):
    m = bridge.memberships(s, d)
    return reports.station_roles(m, m.select("person").distinct(), bridge.stations(s, d))


@query("SELECT site, station, name, 'cov' || site geo, point FROM (SELECT DISTINCT station, site FROM objects WHERE site IS NOT NULL AND station IS NOT NULL) JOIN stations USING (station) LEFT JOIN (SELECT DISTINCT site, height AS point FROM objects WHERE site % 2 = 0) USING (site)")
def p28_station_geography(s, d):
    o = bridge.objects(s, d)
    sites = o.where("site is not null and station is not null").select("station", "site", F.concat(F.lit("cov"), "site").alias("geo")).distinct()
    return reports.station_geography(bridge.stations(s, d), sites, o.where("site % 2 = 0").select("site", F.col("height").alias("point")).distinct())


@query("SELECT id, file_name, 'https://x/' || id AS link FROM objects JOIN specs USING (spec) WHERE format = 1 AND CAST(id AS BIGINT) % 4 = 0")
def p29_polygon_tracks(s, d):
    o = bridge.objects(s, d)
    shape = F.when(_key() % 4 == 0, '{"type":"Polygon"}').otherwise('{"type":"LineString"}')
    return reports.polygon_tracks(o.select("id", shape.alias("geojson")), o, 1, bridge.specs(s, d), "https://x/")


@query("""SELECT spec, level FROM specs WHERE theme = 1 AND level IN (1, 2) AND spec % 2 = 0 AND (project = 2 OR 'brand' || (spec % 5) LIKE '%brand1%' OR 'type' || project LIKE '%brand1%') AND spec IN (SELECT spec FROM objects)""")
def p14_products_per_domain(s, d):
    sp, (_, of_spec, of_project) = bridge.specs(s, d).withColumn("dataset", F.when(F.col("spec") % 2 == 0, "D")), bridge.keywords(s, d)
    words = of_spec.union(sp.join(of_project, "project").select("spec", "keyword"))
    return reports.products_per_domain(sp, words, bridge.objects(s, d), 1, "brand1", 2).select("spec", "level")


@query("SELECT 'collection' kind, 'c' || cust id FROM (SELECT DISTINCT cust FROM objects) WHERE cust % 3 = 0 AND cust NOT IN (SELECT cust FROM objects WHERE spec = 1) UNION ALL SELECT 'document', 'd' || id FROM objects WHERE spec = 2 AND id NOT IN (SELECT old FROM edges)")
def p31_sitemap_of_lists(s, d):
    o, e = bridge.objects(s, d), bridge.edges(s, d)
    colls = o.select(F.concat(F.lit("c"), "cust").alias("id"), F.when(F.col("cust") % 3 == 0, "doi").alias("doi")).distinct()
    old = o.where("spec = 1").select(F.lit("n").alias("new"), F.concat(F.lit("c"), "cust").alias("old")).union(e.select("new", F.concat(F.lit("d"), "old")))
    return reports.sitemap_of_lists(colls, o.where("spec = 2").select(F.concat(F.lit("d"), "id").alias("id")), old)


@query("SELECT spec FROM specs WHERE level IN (2, 3) AND project <> 5")
def p14_findable_specs(s, d):
    return reports.findable_specs(bridge.specs(s, d), s.range(5, 6).select(F.col("id").cast("int").alias("project")))


# Validation


@query("SELECT DISTINCT 'p' || id pkg_id, 'unknown reference s' || (spec + 20) message FROM objects WHERE spec + 20 >= (SELECT count(*) FROM supplier) OR spec > 17 AND spec + 20 < 10 UNION SELECT 'p' || id, 'unknown reference x' FROM objects WHERE CAST(id AS BIGINT) % 13 = 0")
def c02_references_resolve(s, d):
    p = packages(s, d).withColumn("references", F.array_compact(F.array(F.concat(F.lit("s"), F.col("submitter") * 0 + F.substring("pkg_id", 2, 20).cast("bigint") % 25 + 20), F.when(F.substring("pkg_id", 2, 20).cast("bigint") % 13 == 0, "x"))))
    return validate.references_resolve(p, bridge.stations(s, d).select(F.concat(F.lit("s"), "station").alias("ref"))).select("pkg_id", "message")


def _numbered(s, d):
    return packages(s, d).withColumn("key", F.substring("pkg_id", 2, 20).cast("bigint"))


@query("""SELECT 'p' || id pkg_id, 'level 0 has no production' message FROM objects WHERE CAST(id AS BIGINT) % 4 = 0 AND CAST(id AS BIGINT) % 3 = 0 UNION ALL SELECT 'p' || id, 'description is too long' FROM objects WHERE CAST(id AS BIGINT) % 17 = 0
  UNION ALL SELECT 'p' || id, 'extension doesn''t fit the format' FROM objects JOIN specs USING (spec) WHERE CAST(id AS BIGINT) % 50 <> 0 AND format = 2""")
def c05_sane_production(s, d):
    p = _numbered(s, d).withColumn("production", F.when(F.col("key") % 3 == 0, "made")).withColumn("description", F.repeat(F.lit("x"), F.when(F.col("key") % 17 == 0, 5001).otherwise(5000)))
    ext = bridge.specs(s, d).select("spec", F.when(F.col("format") == 2, "zip").otherwise("csv").alias("extension"))
    return validate.sane_production(p, ext).select("pkg_id", "message")


@query("SELECT 'p' || id pkg_id, 'submitter changed' message FROM objects WHERE CAST(id AS BIGINT) % 6 = 0 UNION ALL SELECT 'p' || id, 'format changed' FROM objects WHERE CAST(id AS BIGINT) % 50 = 0")
def c06_same_on_reupload(s, d):
    p = _numbered(s, d).withColumn("hash", F.col("key").cast("string")).withColumn("submitter", F.col("submitter") + F.when(F.col("key") % 6 == 0, 1).otherwise(0))
    return validate.same_on_reupload(p, bridge.objects(s, d)).select("pkg_id", "message")


@query("SELECT 'p' || new pkg_id FROM edges JOIN objects a ON new = a.id JOIN objects b ON old = b.id WHERE a.data_end - to_days(CAST(CAST(a.id AS BIGINT) % 600 AS INT)) <= b.data_end AND a.spec % 2 = 0")
def c08_growing_grows(s, d):
    e, o = bridge.edges(s, d), bridge.objects(s, d)
    p = o.join(e.select(F.col("new").alias("id"), F.col("old").alias("previous")), "id").select(F.concat(F.lit("p"), "id").alias("pkg_id"), "previous", F.timestamp_add("DAY", -(_key() % 600).cast("int"), "data_end").alias("data_end"), (F.col("spec") % 2 == 0).alias("is_growing"))
    return validate.growing_grows(p, o).select("pkg_id")


@query("""SELECT name, CASE WHEN name LIKE '% widget' AND name NOT LIKE 'cold%' AND name NOT LIKE 'small%' THEN 'widget' WHEN name LIKE 'cold%' THEN 'cold' WHEN name LIKE 'small%' THEN 'small' END var FROM (SELECT DISTINCT p_name AS name FROM part)
  WHERE name LIKE '% widget' OR name LIKE 'cold%' OR name LIKE 'small%'""")
def c09_resolve_variables(s, d):
    defs = [(1, "small", "small .*", True, False), (2, "cold", "cold [a-z]+.*", True, False), (3, "late", "cold .*", True, False), (4, "widget", ".* widget", True, True)]
    return validate.resolve_variables(bridge.table(s, d, "part").select(F.col("p_name").alias("name")), s.createDataFrame(defs, "nr int, var string, title string, is_pattern boolean, optional boolean"))


@query("SELECT 'p' || id pkg_id, 'embargo is over' message FROM objects WHERE CAST(id AS BIGINT) % 3 = 0 AND data_end <= TIMESTAMP '1996-01-01' UNION ALL SELECT 'p' || id, 'already published' FROM objects WHERE CAST(id AS BIGINT) % 3 = 0 AND size IS NOT NULL")
def c10_sane_embargo(s, d):
    p = bridge.objects(s, d).select(F.concat(F.lit("p"), "id").alias("pkg_id"), F.when(_key() % 3 == 0, F.col("data_end")).alias("embargo_until"), F.col("size").isNotNull().alias("is_published"))
    return validate.sane_embargo(p, "1996-01-01").select("pkg_id", "message")


@query("SELECT 'p' || id pkg_id FROM objects WHERE submitter >= 20 OR CAST(id AS BIGINT) % 5 NOT IN (submitter % 5, 2)")
def c11_submitter_may(s, d):
    allowed = s.range(20).select(F.col("id").cast("int").alias("submitter"), F.array((F.col("id") % 5).cast("int"), F.lit(2)).alias("themes"))
    return validate.submitter_may(packages(s, d), allowed).select("pkg_id")


# Space


@query(""", b AS (SELECT station % 4 AS owner, station, name, lon x0, lat y0, lon + 12 + station % 17 x1, lat + 9 + station % 11 y1 FROM stations),
  near AS (SELECT a.owner, a.station i, b.station j FROM b a JOIN b ON a.owner = b.owner AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
  reach AS (SELECT owner, i, j FROM near UNION SELECT reach.owner, reach.i, near.j FROM reach JOIN near ON reach.owner = near.owner AND reach.j = near.i)
  SELECT owner, string_agg(name, ', ' ORDER BY name) AS label FROM (SELECT owner, i, min(j) k FROM reach GROUP BY ALL) JOIN stations ON station = i GROUP BY owner, k""")
def g09_merge_coverage(s, d):
    """Boxes around stations, fused where they touch, directly or through others."""
    k = F.col("station")
    p = lambda dx, dy: F.struct((F.col("lon") + dx).cast("double").alias("lon"), (F.col("lat") + dy).cast("double").alias("lat"))
    w, h = 12 + k % 17, 9 + k % 11
    boxes = bridge.stations(s, d).select((k % 4).alias("owner"), F.lit("box").alias("geom_type"), F.array(p(0, 0), p(w, 0), p(w, h), p(0, h)).alias("coords"), F.col("name").alias("label"))
    return coverage.merge_coverage(boxes, 1_000_000).select("owner", "label")


@query("""SELECT country AS cluster, count(DISTINCT id) n_objects, count(DISTINCT station) = 1 dense, min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 FROM objects JOIN stations USING (station) GROUP BY country""")
def g06_cluster_extents(s, d):
    """The hulls' extents are those of the points; hulls themselves are tested against brute force."""
    rows = bridge.objects(s, d).join(bridge.stations(s, d), "station").select(F.col("country").alias("cluster"), "id", F.array(F.struct("lon", "lat")).alias("coords"))
    side = lambda f, c: f(F.transform("hull", lambda p: p[c]))
    return coverage.cluster_extents(rows).select("cluster", "n_objects", "dense", side(F.array_min, "lon").alias("x0"), side(F.array_min, "lat").alias("y0"), side(F.array_max, "lon").alias("x1"), side(F.array_max, "lat").alias("y1"))


@query("""SELECT station, path, geom_type, lon, lat, label FROM (
  SELECT station, '0' AS path, 'point' geom_type, lon, lat, name AS label FROM stations WHERE station % 4 = 0 UNION ALL SELECT station, '0', 'circle', lon, lat, name FROM stations WHERE station % 4 = 1
  UNION ALL SELECT station, '0,' || i, 'point', lon + i, lat, NULL FROM stations, range(2) r(i) WHERE station % 4 = 2 UNION ALL SELECT station, '1', 'pin', lon, lat, NULL FROM stations WHERE station % 4 IN (0, 1, 2)
  UNION ALL SELECT station, '', NULL, NULL, NULL, NULL FROM stations WHERE station % 4 = 3)""")
def g04_parse_geojson(s, d):
    """Feature collections with a labelled point, a circle or a multi point, and a pin; some texts that aren't GeoJSON."""
    k = F.col("station") % 4
    at = lambda dx: F.array(F.col("lon") + dx, F.col("lat"))
    text = lambda c: F.to_json(c)
    point = text(F.struct(F.lit("Point").alias("type"), at(0).alias("coordinates")))
    multi = text(F.struct(F.lit("MultiPoint").alias("type"), F.array(at(0), at(1)).alias("coordinates")))
    feature = lambda g, props: F.concat(F.lit('{"type":"Feature","geometry":'), g, F.lit(',"properties":'), props, F.lit("}"))
    first = F.when(k == 0, feature(point, text(F.struct(F.col("name").alias("label"))))).when(k == 1, feature(point, text(F.struct(F.lit(5.5).alias("radius"), F.col("name").alias("label"))))).otherwise(multi)
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), first, F.lit(","), feature(point, F.lit('{"pinkind":"Sensor"}')), F.lit("]}"))
    rows = bridge.stations(s, d).select("station", F.when(k == 3, "no json").otherwise(whole).alias("geojson"))
    p = F.get("coords", F.lit(0))
    return geo.parse_geojson(rows, "station").select("station", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "geom_type", p["lon"].alias("lon"), p["lat"].alias("lat"), F.try_element_at("labels", F.lit(-1)).alias("label"))


@query("SELECT id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'line' WHEN lon IS NOT NULL THEN 'point' END AS geom_type, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 0 ELSE lon END x FROM objects LEFT JOIN stations USING (station) WHERE CAST(id AS BIGINT) % 5 = 0 OR lon IS NOT NULL")
def g01_object_geometries(s, d):
    o = bridge.objects(s, d)
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("lon"), F.lit(y).cast("double").alias("lat"))
    own = o.where(_key() % 5 == 0).select("id", F.array(point(0, 0), point(1, 1)).alias("coords"), F.lit("line").alias("geom_type"))
    place = o.join(bridge.stations(s, d), "station").select("id", F.array(F.struct("lon", "lat")).alias("coords"), F.lit("point").alias("geom_type"))
    return geo.object_geometries(o, own, place).select("id", "geom_type", F.get("coords", F.lit(0))["lon"].alias("x"))


@query("SELECT country, i part_nr, lon + i AS x FROM stations, range(3) r(i) WHERE i < station % 4")
def g02_explode_collections(s, d):
    one = lambda i: F.struct(F.array(F.struct((F.col("lon") + i).alias("lon"), "lat")).alias("coords"), F.lit("point").alias("geom_type"))
    rows = bridge.stations(s, d).select("country", F.slice(F.array(one(0), one(1), one(2)), F.lit(1), F.col("station") % 4).alias("parts"))
    return geo.explode_collections(rows).select("country", "part_nr", F.get("coords", F.lit(0))["lon"].alias("x"))


@query("SELECT id, CASE WHEN spec % 2 = 0 AND station IS NOT NULL THEN 'st' || station WHEN site IS NOT NULL THEN 'site' || site ELSE md5('POINT ' || height) END AS cluster FROM objects")
def g03_cluster_id(s, d):
    wkt = F.concat(F.lit("POINT "), F.col("height").cast("string"))
    return bridge.objects(s, d).select("id", geo.cluster_id(F.concat(F.lit("st"), "station"), F.concat(F.lit("site"), "site"), F.col("spec") % 2 == 0, wkt).alias("cluster"))


# Reconciliation


@query("SELECT best_id, id FROM (SELECT coalesce('F' || spec || '_' || station, id) best_id, id, row_number() OVER (PARTITION BY coalesce('F' || spec || '_' || station, id) ORDER BY submitted, id) k FROM objects) WHERE k = 1")
def r03_dedupe_entities(s, d):
    rows = bridge.objects(s, d).select("id", F.col("id").alias("own_id"), F.concat(F.lit("F"), "spec", F.lit("_"), "station").alias("tc_id"), "submitted")
    return reconcile.dedupe_entities(rows, ["submitted", "id"]).select("best_id", "id")


@query(""", c AS (SELECT station, person, role, min(start) s, max(stop) e, 'c' || station || person || role AS id FROM memberships GROUP BY ALL), l AS (SELECT station, person, role, s, CASE WHEN station % 3 = 0 THEN TIMESTAMP '2001-01-01' ELSE e END e, 'l' || station || person || role AS id FROM c WHERE station % 5 <> 0)
  SELECT id, 'new' what, s AS start, e AS stop FROM l WHERE station % 2 = 0 UNION ALL SELECT c.id, 'changed', l.s, l.e FROM c JOIN l USING (station, person, role) WHERE station % 2 = 1 AND c.e IS DISTINCT FROM l.e""")
def r04_roles_diff(s, d):
    m = bridge.memberships(s, d).groupBy("station", "person", "role").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    named = lambda p: F.concat(F.lit(p), "station", "person", "role").alias("id")
    later = F.when(F.col("station") % 3 == 0, F.lit("2001-01-01").cast("timestamp")).otherwise(F.col("stop")).alias("stop")
    latest = m.where("station % 5 <> 0").select(named("l"), "station", "person", "role", "start", later)
    return reconcile.roles_diff(m.where("station % 2 = 1").select(named("c"), "station", "person", "role", "start", "stop"), latest, ["station", "person", "role"])


@query("SELECT id, CASE WHEN submitter % 2 = 0 THEN 'own' || submitter ELSE 'tc' || submitter END submitter, CASE WHEN spec % 2 = 0 AND spec < 25 THEN 'own' || spec ELSE 'tc' || spec END spec FROM objects")
def r05_preserve_ids(s, d):
    rows = bridge.objects(s, d).select("id", F.concat(F.lit("tc"), "submitter").alias("submitter"), F.concat(F.lit("tc"), "spec").alias("spec"))
    known = s.range(0, 60, 2).select(F.concat(F.lit("tc"), "id").alias("tc_id"), F.concat(F.lit("own"), "id").alias("cp_id"))
    return reconcile.preserve_ids(rows, known, ["submitter", "spec"])


@query("SELECT id subj, 'inNetwork' pred, CAST(station AS VARCHAR) obj, true assertion FROM objects WHERE station % 3 = 0 UNION ALL SELECT id, 'inNetwork', CAST(station AS VARCHAR), false FROM objects WHERE station IS NOT NULL AND spec = 1 UNION ALL SELECT id, 'hasName', file_name, true FROM objects")
def r06_drop_dangling(s, d):
    o = bridge.objects(s, d)
    up = lambda df, p, c, a: df.select(F.col("id").alias("subj"), F.lit(p).alias("pred"), F.col(c).cast("string").alias("obj"), F.lit(a).alias("assertion"))
    placed = o.where("station is not null")
    updates = up(placed, "inNetwork", "station", True).union(up(placed.where("spec = 1"), "inNetwork", "station", False)).union(up(o, "hasName", "file_name", True))
    return reconcile.drop_dangling(updates, bridge.stations(s, d).where("station % 3 = 0").select(F.col("station").cast("string").alias("subj")), "inNetwork").select("subj", "pred", "obj", "assertion")


@query("""SELECT user_id site, event_id idVar, 'GRP_' || event_type AS variable, CASE WHEN event_id % 3 = 0 THEN '2020' || event_id END date, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'A=' || event_id || ',' END || 'VALUE=' || event_type AS "values" FROM events""")
def r07_eav_to_entries(s, d):
    e = bridge.table(s, d, "events").withColumn("var", F.concat(F.lit("GRP_"), "event_type"))
    row = lambda q, v: e.select(F.col("user_id").alias("site"), F.col("event_id").alias("idVar"), F.col("var").alias("Variable"), q.alias("Qualifier"), v.alias("Value"))
    raw = row(F.concat("var", F.lit("_DATE")), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("2020"), "event_id")).otherwise("-9999"))
    raw = raw.union(row(F.concat("var", F.lit("_A")), F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).otherwise("-9999"))).union(row(F.lit("VALUE"), F.col("event_type")))
    spelled = F.array_join(F.transform("values", lambda x: F.concat(x.q, F.lit("="), x.v)), ",")
    return reconcile.eav_to_entries(raw).select("site", "idVar", "variable", "date", spelled.alias("values"))


@query("SELECT CAST(s_suppkey AS VARCHAR) id, CASE WHEN s_suppkey % 2 = 0 THEN 'Other ' || s_suppkey ELSE trim(s_name) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'O' || s_suppkey END AS label FROM supplier")
def r10_dedupe_orgs(s, d):
    sup = bridge.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("id"), F.trim("s_name").alias("name"))
    later = sup.where("k % 2 = 0").select("id", F.concat(F.lit("Other "), "id", F.lit(" (O"), "id", F.lit(")")).alias("name"))
    return reconcile.dedupe_orgs([sup.select("id", "name"), later])


# Exports


@query("""WITH c AS (SELECT objects.*, spec_label, name, theme, CASE WHEN spec % 2 = 0 THEN 'about ' || spec ELSE '' END AS note FROM objects JOIN specs USING (spec) JOIN stations USING (station) WHERE size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated))
  SELECT subj, pred, obj FROM (SELECT id subj, unnest(['rdf:type', 'dct:title', 'dct:description', 'dct:issued', 'dct:modified', 'prov:wasAttributedTo', 'dct:temporal', 'dcat:distribution', 'dcat:theme']) pred, unnest(['dcat:Dataset', file_name, spec_label || ', station ' || name || '. ' || note, strftime(submitted, '%Y-%m-%dT%H:%M:%SZ'),
    strftime(CASE WHEN CAST(id AS BIGINT) % 3 = 0 AND data_end < submitted THEN data_end ELSE submitted END, '%Y-%m-%dT%H:%M:%SZ'), CAST(station AS VARCHAR), id || '/period', id || '/distribution', 'theme' || theme]) obj FROM c
  UNION ALL SELECT id || '/period', unnest(['rdf:type', 'dcat:startDate', 'dcat:endDate']), unnest(['dct:PeriodOfTime', strftime(data_start, '%Y-%m-%dT%H:%M:%SZ'), strftime(data_end, '%Y-%m-%dT%H:%M:%SZ')]) FROM c
  UNION ALL SELECT id || '/distribution', unnest(['rdf:type', 'dcat:accessURL', 'dct:license', 'dcat:byteSize', 'dcat:downloadURL']), unnest(['dcat:Distribution', id, 'https://creativecommons.org/licenses/by/4.0/', CAST(size AS VARCHAR), 'data:' || id]) FROM c
  UNION ALL SELECT DISTINCT id, 'dcat:keyword', keyword FROM own_keywords WHERE id IN (SELECT id FROM c))""".replace("WITH c", ", c", 1))
def x01_dcat_export(s, d):
    o = flagged(s, d).withColumn("prod_end", F.when(_key() % 3 == 0, F.col("data_end")))
    specs = bridge.specs(s, d).select("spec", "spec_label", F.when(F.col("spec") % 2 == 0, F.concat(F.lit("about "), "spec")).alias("comment"), F.concat(F.lit("theme"), "theme").alias("theme_iri"))
    return export.dcat_export(o, specs, bridge.stations(s, d), bridge.keywords(s, d)[0]).select("subj", "pred", "obj")


@query("""SELECT station, name, pi, '{"type":"Point","coordinates":[' || printf('%.1f', lon) || ',' || printf('%.1f', lat) || ']}' geojson FROM stations LEFT JOIN (SELECT station, min(person) pi FROM memberships WHERE role = 'PI' GROUP BY 1) USING (station)""")
def x02_site_export(s, d):
    return export.site_export(bridge.stations(s, d), bridge.memberships(s, d).where("role = 'PI'"))


def _records(s, d):
    authors = bridge.memberships(s, d).groupBy("station").agg(F.array_sort(F.collect_set("person")).alias("authors"))
    rows = bridge.objects(s, d).join(bridge.specs(s, d), "spec").join(authors, "station", "left")
    return rows.select("id", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.when(F.col("spec") % 4 != 0, F.col("spec_label")).alias("title"), F.year("submitted").alias("year"), F.concat(F.lit("https://x/"), "id").alias("url"))


_RECORDS = "FROM objects JOIN specs USING (spec) LEFT JOIN (SELECT station, list_sort(list(DISTINCT person)) authors FROM memberships GROUP BY 1) USING (station)"


@query(f"""SELECT id, '@misc{{' || id || ',' || chr(10) || concat_ws(',' || chr(10), '  author = {{' || array_to_string(authors, ' and ') || '}}', CASE WHEN spec % 4 <> 0 THEN '  title = {{' || spec_label || '}}' END, '  year = {{' || year(submitted) || '}}', '  url = {{https://x/' || id || '}}') || chr(10) || '}}' bibtex {_RECORDS}""")
def x05_bibtex(s, d):
    return export.bibtex(_records(s, d))


@query(f"""SELECT id, concat_ws(chr(10), 'TY  - DATA', array_to_string(list_transform(authors, lambda a: 'AU  - ' || a), chr(10)), CASE WHEN spec % 4 <> 0 THEN 'TI  - ' || spec_label END, 'PY  - ' || year(submitted), 'UR  - https://x/' || id, 'ER  - ') ris {_RECORDS}""")
def x05_ris(s, d):
    return export.ris(_records(s, d))


@query("""SELECT user_id site, event_type species, CAST(year(ts) AS INT) "year", CAST(month(ts) AS INT) "month", CAST(day(ts) AS INT) "day", CAST(hour(ts) AS INT) "hour", CAST(minute(ts) AS INT) "minute",
  CASE WHEN event_id % 5 = 0 AND event_id % 7 <> 0 OR event_id % 3 = 0 THEN -999.999 ELSE round(value * CASE WHEN event_type = 'click' THEN 1e6 ELSE 1e9 END, 1) END AS value, CASE WHEN event_id % 5 <= 1 AND event_id % 7 <> 0 THEN -999.999 ELSE round(value * CASE WHEN event_type = 'click' THEN 1e6 ELSE 1e9 END, 1) END sd,
  CASE WHEN event_id % 7 = 0 THEN -9 ELSE event_id % 5 END n FROM events""")
def x08_measurement_table(s, d):
    k = F.col("event_id")
    series = bridge.table(s, d, "events").select(F.col("user_id").alias("site"), F.when(F.col("event_type") == "click", "co2").otherwise(F.col("event_type")).alias("species"), F.col("ts").alias("time"), F.when(k % 3 != 0, F.col("value")).alias("value"), F.col("value").alias("sd"), F.when(k % 7 != 0, k % 5).alias("n"))
    found = export.measurement_table(series).withColumn("value", F.round("value", 1)).withColumn("sd", F.round("sd", 1))
    fix = lambda c: F.when(F.col(c) == -1000.0, -999.999).otherwise(F.col(c)).alias(c)
    return found.select("site", F.when(F.col("species") == "co2", "click").otherwise(F.col("species")).alias("species"), "year", "month", "day", "hour", "minute", fix("value"), fix("sd"), "n")


@query("SELECT id, CASE WHEN spec < 20 AND coalesce(station, -1) >= 0 AND station % 2 = 0 THEN lpad(CAST(spec AS VARCHAR), 4, '0') || '-' || lpad('S' || station, 4, '0') ELSE '' END catalogue_id FROM objects")
def x09_catalogue_id(s, d):
    o = bridge.objects(s, d).select("id", F.concat(F.lit("sp"), "spec", F.lit("_st"), F.coalesce("station", F.lit(-1)), F.lit("_x.csv")).alias("file_name"))
    of_spec = s.range(20).select(F.concat(F.lit("sp"), "id").alias("key"), F.col("id").cast("string").alias("code"))
    of_station = bridge.stations(s, d).where("station % 2 = 0").select(F.concat(F.lit("st"), "station").alias("key"), F.concat(F.lit("S"), "station").alias("code"))
    return export.catalogue_id(o, {"spec": of_spec, "place": of_station}).select("id", "catalogue_id")


# Intervals


@query(""", r AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY time) run FROM (SELECT *, CASE WHEN instrument = lag(instrument) OVER (PARTITION BY series ORDER BY time) THEN 0 ELSE 1 END new FROM (SELECT l_suppkey series, l_shipdate AS time, min(CAST(floor(l_partkey / 12) AS BIGINT)) instrument FROM lineitem GROUP BY ALL))),
  sp AS (SELECT series, run, instrument, min(time) a, max(time) b, max(run) OVER (PARTITION BY series) last FROM r GROUP BY series, run, instrument) SELECT series, instrument, CASE WHEN run > 1 THEN a END AS start, CASE WHEN run < last THEN b END AS stop FROM sp WHERE last <= 1000000""")
def i06_instrument_history(s, d):
    items = bridge.table(s, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_shipdate").alias("time"), "l_partkey")
    rows = items.count()
    series = dealt(items, rows, "series", "time").groupBy("series", "time").agg(F.min(F.floor(F.col("l_partkey") / 12)).alias("instrument"))
    return intervals.instrument_history(series, 1_000_000, rows).select("series", "instrument", "start", F.col("end").alias("stop"))


@query("SELECT event_id id, ts - to_minutes(CAST(60 * (event_id % 5 - 2) AS INT)) AS instant FROM (SELECT event_id, date_trunc('minute', ts) ts FROM events)")
def i09_local_to_utc(s, d):
    e = bridge.table(s, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyyMMddHHmm").alias("t"), (F.col("event_id") % 5 - 2).alias("o"))
    return e.select("id", intervals.local_to_utc(F.col("t"), F.col("o")).alias("instant"))


@query("SELECT station, person, role FROM memberships WHERE (start IS NULL OR start <= TIMESTAMP '1995-01-01') AND (stop IS NULL OR stop > TIMESTAMP '1995-01-01')")
def i10_active(s, d):
    return intervals.active(bridge.memberships(s, d), "1995-01-01").select("station", "person", "role")


# Functions


@query("SELECT event_id id, 'k ' || (event_id % 3) AS name, 'a' || CASE WHEN event_id % 4 <> 0 THEN ';b' || (event_id % 4) ELSE '' END AS items FROM events")
def f02_terms(s, d):
    e = bridge.table(s, d, "events").select(F.col("event_id").alias("id"))
    iri = F.concat(F.lit("http://x.example/y#"), F.lit("k "), F.col("id") % 3)
    text = F.concat(F.lit(" a ,, "), F.when(F.col("id") % 4 != 0, F.concat(F.lit("b"), F.col("id") % 4)).otherwise(""))
    return e.select("id", terms.local_name(iri).alias("name"), F.array_join(terms.comma_list(text), ";").alias("items"))
