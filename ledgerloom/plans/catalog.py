"""Registered queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import terms
from ledgerloom.operators import export, geo, intervals, log as logs, reconcile, reports, search, statements as st, validate, versions
from ledgerloom.plans import bridge
from ledgerloom.scratch import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; its SQL sees the catalog's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {bridge.SQL}\n{sql}"
        return f

    return add


def flagged(s: SparkSession, d: str) -> DataFrame:
    return search.deprecation_flag(bridge.objects(s, d), bridge.edges(s, d))


def typed_objects(s: SparkSession, d: str) -> DataFrame:
    """Objects as statements, with a class of five by spec; Class1 is below Class0."""
    o = bridge.objects(s, d)
    row = lambda subj, pred, obj: [F.lit("objects").alias("graph"), subj.alias("subj"), F.lit(pred).alias("pred"), obj.alias("obj"), F.lit(0).alias("obj_kind"), F.lit(None).cast("string").alias("lit_attr")]
    classes = o.select(*row(F.col("id"), st.TYPE, F.concat(F.lit("Class"), F.col("spec") % 5)))
    below = s.range(1).select(*row(F.lit("Class1"), st.SUBCLASS, F.lit("Class0")))
    return st.objects_to_statements(o).unionByName(classes).unionByName(below)


# Statements


@query("SELECT id subj, CAST(spec AS VARCHAR) obj FROM objects")
def b01_match(s, d):
    return st.match(st.objects_to_statements(bridge.objects(s, d)), p="hasObjectSpec", graphs=["objects"]).select("subj", "obj")


@query("SELECT id subj, size AS value FROM objects WHERE size IS NOT NULL")
def b02_typed_values(s, d):
    return st.typed_values(st.objects_to_statements(bridge.objects(s, d)), "hasSizeInBytes", "xsd:long", "bigint")


@query("SELECT id subj, 'hasSizeInBytes: expected 1..1 values, found 0' error FROM objects WHERE size IS NULL")
def b03_check_cardinality(s, d):
    o = bridge.objects(s, d)
    return st.check_cardinality(st.objects_to_statements(o), o.select(F.col("id").alias("subj")), "hasSizeInBytes", "xsd:long", "bigint", 1, 1)[1]


@query("SELECT a.new start, c.old AS end_ FROM edges a JOIN edges c ON a.old = c.new")
def b04_follow_path(s, d):
    e = bridge.edges(s, d)
    links = e.select(F.col("new").alias("subj"), F.lit("isNextVersionOf").alias("pred"), F.col("old").alias("obj"))
    return st.follow_path(links, e.select(F.col("new").alias("node")).distinct(), ["isNextVersionOf", "isNextVersionOf"]).select("start", F.col("end").alias("end_"))


@query("SELECT id, CAST(station AS VARCHAR) AS place FROM objects WHERE station IS NOT NULL UNION ALL SELECT id, CAST(site AS VARCHAR) FROM objects WHERE site IS NOT NULL")
def b05_alt_path(s, d):
    o = bridge.objects(s, d)
    found = st.alt_path(st.objects_to_statements(o), o.select(F.col("id").alias("node")), [["wasAcquiredBy"], ["wasPerformedAt"]])
    return found.select(F.col("start").alias("id"), F.col("end").alias("place"))


@query("SELECT id, spec, submitter, station, site, size, file_name, height, data_start, data_end FROM objects")
def b06_build_objects(s, d):
    return st.build_objects(st.objects_to_statements(bridge.objects(s, d)))


@query("""SELECT p AS pred, count(*) AS n FROM (SELECT unnest(['hasObjectSpec', 'wasSubmittedBy', 'wasAcquiredBy', 'wasPerformedAt', 'hasSizeInBytes', 'hasName', 'hasSamplingHeight', 'hasStartTime', 'hasEndTime']) p,
  unnest([CAST(spec AS VARCHAR), CAST(submitter AS VARCHAR), CAST(station AS VARCHAR), CAST(site AS VARCHAR), CAST(size AS VARCHAR), file_name, CAST(height AS VARCHAR), CAST(data_start AS VARCHAR), CAST(data_end AS VARCHAR)]) v FROM objects) WHERE v IS NOT NULL GROUP BY p""")
def b07_unpivot(s, d):
    return st.objects_to_statements(bridge.objects(s, d)).groupBy("pred").agg(F.count("*").alias("n"))


def _snapshots(s, d):
    """The objects' statements before and after, by the numbers of the objects."""
    rows = st.objects_to_statements(bridge.objects(s, d)).where(F.col("pred").isin("hasName", "hasObjectSpec"))
    key = F.col("subj").cast("bigint")
    changed = rows.withColumn("obj", F.when((F.col("pred") == "hasName") & (key % 5 == 0), F.concat(F.lit("new_"), "obj")).otherwise(F.col("obj")))
    return rows.where(key % 10 != 0), changed.where(key % 11 != 0)


_SNAPSHOTS = """, r AS (SELECT id subj, 'hasName' pred, file_name obj FROM objects UNION ALL SELECT id, 'hasObjectSpec', CAST(spec AS VARCHAR) FROM objects),
o AS (SELECT * FROM r WHERE CAST(subj AS BIGINT) % 10 <> 0),
n AS (SELECT subj, pred, CASE WHEN pred = 'hasName' AND CAST(subj AS BIGINT) % 5 = 0 THEN 'new_' || obj ELSE obj END obj FROM r WHERE CAST(subj AS BIGINT) % 11 <> 0),
diff AS (SELECT *, false assertion FROM (FROM o EXCEPT FROM n) UNION ALL SELECT *, true FROM (FROM n EXCEPT FROM o))"""


@query(f"{_SNAPSHOTS} SELECT * FROM (FROM n EXCEPT FROM o)")
def b11_not_contained(s, d):
    old, new = _snapshots(s, d)
    return st.not_contained(new, old).select("subj", "pred", "obj")


@query(f"{_SNAPSHOTS} SELECT * FROM diff")
def b12_snapshot_diff(s, d):
    return st.snapshot_diff(*_snapshots(s, d)).select("subj", "pred", "obj", "assertion")


@query(f"""{_SNAPSHOTS} SELECT * FROM diff WHERE pred = 'hasName' AND EXISTS (SELECT 1 FROM n WHERE n.subj = diff.subj AND n.pred = diff.pred)
  OR pred = 'hasObjectSpec' AND NOT EXISTS (SELECT 1 FROM o WHERE o.subj = diff.subj AND o.pred = diff.pred)""")
def b13_diff_with_stability(s, d):
    return st.diff_with_stability(*_snapshots(s, d), {"hasName": "sticky", "hasObjectSpec": "fixed"}).select("subj", "pred", "obj", "assertion")


@query("""SELECT subj, pred, obj, arg_max(op, seq) = 'A' assertion FROM (SELECT *, max(CASE WHEN op = 'A' THEN seq END) OVER (PARTITION BY subj, pred) last FROM
  (SELECT event_id seq, CAST(user_id AS VARCHAR) subj, event_type pred, CAST(event_id % 7 AS VARCHAR) obj, CASE WHEN event_id % 4 = 0 THEN 'W' ELSE 'A' END op FROM events))
  WHERE op = 'A' OR last > seq GROUP BY ALL HAVING arg_max(op, seq) = 'A' OR list_last(list(op ORDER BY seq)) = 'W' AND (len(list(op)) = 1 OR list(op ORDER BY seq)[-2] = 'W')""")
def b14_materialize_updates(s, d):
    rows = bridge.log(s, d)
    return st.materialize_updates(rows.select(F.col("id").alias("seq"), "subj", "pred", "obj", F.when(F.col("assertion"), "A").otherwise("W").alias("op")))


@query(""", r AS (SELECT id subj, 'hasName' pred, file_name obj FROM objects UNION ALL SELECT new, 'isNextVersionOf', old FROM edges),
s AS (SELECT DISTINCT new FROM edges WHERE CAST(new AS BIGINT) % 3 = 0) SELECT DISTINCT * FROM r WHERE subj IN (SELECT new FROM s) OR subj IN (SELECT old FROM edges WHERE new IN (SELECT new FROM s))""")
def b24_extract_subset(s, d):
    e, names = bridge.edges(s, d), st.match(st.objects_to_statements(bridge.objects(s, d)), p="hasName")
    links = e.select(F.lit("objects").alias("graph"), F.col("new").alias("subj"), F.lit("isNextVersionOf").alias("pred"), F.col("old").alias("obj"), F.lit(0).alias("obj_kind"), F.lit(None).cast("string").alias("lit_attr"))
    return st.extract_subset(names.unionByName(links), e.select(F.col("new").alias("subj")).where("cast(subj as bigint) % 3 = 0"), ["isNextVersionOf"]).select("subj", "pred", "obj")


# The log


@query("SELECT subj, pred, obj FROM log GROUP BY ALL HAVING arg_max(assertion, id)")
def l01_replay(s, d):
    return logs.replay(bridge.log(s, d)).select("subj", "pred", "obj")


@query("SELECT subj, pred, obj FROM log WHERE tstamp <= TIMESTAMP '2024-01-15' GROUP BY ALL HAVING arg_max(assertion, id)")
def l02_as_of(s, d):
    return logs.as_of(bridge.log(s, d), "2024-01-15 00:00:00").select("subj", "pred", "obj")


@query("SELECT subj, tstamp, CASE obj WHEN '1' THEN 'one' WHEN '2' THEN 'two' ELSE obj END status, id FROM log WHERE pred = 'click' AND assertion")
def l07_status_history(s, d):
    rows = bridge.log(s, d)
    return logs.status_history(rows, rows.select("subj").distinct(), "click", {"1": "one", "2": "two"})


@query("SELECT subj, min(tstamp) first_seen, min(CASE WHEN assertion AND obj = '1' THEN tstamp END) submitted, max(CASE WHEN assertion AND obj = '3' THEN tstamp END) approved FROM log GROUP BY subj")
def l08_milestones(s, d):
    return logs.milestones(bridge.log(s, d), {"submitted": ("1", "first"), "approved": ("3", "last")})


@query("""SELECT subj, tstamp, id, before, "after" FROM (SELECT subj, tstamp, id, lag(obj) OVER (PARTITION BY subj ORDER BY tstamp, id) before, obj "after" FROM log WHERE assertion)
  WHERE before <> "after" AND NOT CAST("after" AS INT) = CAST(before AS INT) + 1""")
def l09_invalid_transitions(s, d):
    allowed = s.range(6).select(F.col("id").cast("string").alias("before"), (F.col("id") + 1).cast("string").alias("after"))
    return logs.invalid_transitions(bridge.log(s, d), allowed)


@query("""SELECT id, round(m, 4) minute_cost, round(h, 4) hour_cost, h > 500 over_quota FROM (SELECT event_id id, sum(value) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) m,
  sum(value) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) h FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) sec FROM events))""")
def l10_rolling_cost(s, d):
    runs = bridge.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), "ts", F.col("value").alias("cost"))
    return logs.rolling_cost(runs, 1e9, 500).select("id", F.round("minute_cost", 4).alias("minute_cost"), F.round("hour_cost", 4).alias("hour_cost"), "over_quota")


@query("SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL")
def l11_usage_counts(s, d):
    return logs.usage_counts(bridge.table(s, d, "events"), "user_id")


@query("""SELECT id, CASE WHEN tstamp < TIMESTAMP '2024-01-10' THEN coalesce(good, obj) ELSE obj END obj FROM log LEFT JOIN
  (SELECT subj, pred, arg_min(obj, (tstamp, id)) good FROM log WHERE tstamp >= TIMESTAMP '2024-01-10' AND NOT (tstamp >= TIMESTAMP '2024-01-20' AND tstamp < TIMESTAMP '2024-01-21') GROUP BY ALL) USING (subj, pred)
  WHERE NOT (tstamp >= TIMESTAMP '2024-01-20' AND tstamp < TIMESTAMP '2024-01-21')""")
def l12_patch_log(s, d):
    return logs.patch_log(bridge.log(s, d), drop=("2024-01-20 00:00:00", "2024-01-21 00:00:00"), repair_before="2024-01-10 00:00:00").select("id", "obj")


# Search


@query("SELECT id, data_start FROM objects WHERE size > 100000 AND spec IS NOT NULL AND data_start IS NOT NULL ORDER BY data_start DESC, id LIMIT 20 OFFSET 10")
def o01_fetch_objects(s, d):
    return search.fetch_objects(bridge.objects(s, d), search.compare("size", ">", 100000), "data_start", True, 10, 20).select("id", "data_start")


@query("SELECT id FROM objects WHERE NOT coalesce(size > 100000 OR station IN (1, 2, 3), false) AND NOT coalesce(site = 4, false)")
def o02_filter_algebra(s, d):
    f = ~(search.compare("size", ">", 100000) | search.one_of("station", [1, 2, 3])) & ~search.compare("site", "=", 4)
    return search.fetch_objects(bridge.objects(s, d), f).select("id")


@query("SELECT id FROM objects WHERE station IS NOT NULL AND site IS NOT NULL")
def o03_exists(s, d):
    return search.fetch_objects(bridge.objects(s, d), search.exists("station") & search.exists("site")).select("id")


@query("SELECT id FROM objects WHERE spec IN (3, 5, 7)")
def o04_in(s, d):
    return search.fetch_objects(bridge.objects(s, d), search.one_of("spec", [3, 5, 7])).select("id")


@query("SELECT id FROM objects WHERE regexp_full_match(file_name, 'F1[0-9]+.csv')")
def o05_matches(s, d):
    return search.fetch_objects(bridge.objects(s, d), search.matches("file_name", "F1[0-9]+.csv")).select("id")


@query("SELECT id FROM objects WHERE data_start BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND height >= 50 AND file_name < 'F3'")
def o06_ranges(s, d):
    t = lambda x: F.lit(x).cast("timestamp")
    f = search.between("data_start", t("1995-01-01"), t("1996-01-01")) & search.compare("height", ">=", 50) & search.compare("file_name", "<", "F3")
    return search.fetch_objects(bridge.objects(s, d), f).select("id")


#: Orders whose objects are looked up, by the 24-character ids of their hashes, by whole hashes and by IRIs.
_KNOWN = {"24": range(1, 60, 3), "whole": range(2, 60, 3), "iri": range(3, 60, 3)}


@query(f"""SELECT translate(substr(base64(unhex(sha256(id))), 1, 24), '+/', '-_') id, size FROM objects WHERE CAST(id AS BIGINT) BETWEEN 1 AND 59""")
def o07_by_id(s, d):
    whole = lambda k: base64.urlsafe_b64encode(hashlib.sha256(str(k).encode()).digest()).decode().rstrip("=")
    spelled = {"24": lambda k: whole(k)[:24], "whole": whole, "iri": lambda k: f"https://meta.example/objects/{whole(k)[:24]}"}
    wanted = [spelled[form](k) for form, keys in _KNOWN.items() for k in keys]
    o = bridge.objects(s, d).withColumn("id", terms.hash_id(F.sha2("id", 256)))
    return search.fetch_objects(o, search.by_id(wanted)).select("id", "size")


def _bridge(s, d):
    return search.object_keywords(*bridge.keywords(s, d), bridge.objects(s, d), bridge.specs(s, d))


@query("SELECT DISTINCT id FROM keywords WHERE keyword IN ('brand1', 'type3', 'blue')")
def o08_has_keyword(s, d):
    return search.with_keywords(bridge.objects(s, d), _bridge(s, d), ["brand1", "type3", "blue"]).select("id")


@query("SELECT id FROM objects WHERE spec % 3 = 1")
def o09_has_variable(s, d):
    rows = bridge.objects(s, d).withColumn("columns_json", F.to_json(F.array(F.concat(F.lit("v"), F.col("spec") % 3), F.concat(F.lit("w"), F.col("spec") % 4))))
    return search.with_variables(rows, search.object_variables(rows), ["v1"]).select("id")


@query("SELECT id, id IN (SELECT id FROM deprecated) deprecated FROM objects")
def o10_deprecation_flag(s, d):
    return flagged(s, d).select("id", "deprecated")


@query("SELECT spec, submitter, station, site, count(*) n FROM objects WHERE size IS NOT NULL GROUP BY ALL")
def o13_object_stats(s, d):
    return search.object_stats(bridge.objects(s, d), search.exists("size"))


@query("SELECT spec, submitter, station, site, count(*) n, grouping(site) = 0 with_site FROM objects GROUP BY GROUPING SETS ((spec, submitter, station, site), (spec, submitter, station))")
def o13_object_stats_rollup(s, d):
    return search.object_stats_rollup(bridge.objects(s, d))


@query("SELECT string_agg(DISTINCT keyword, ',' ORDER BY keyword) keywords FROM keywords JOIN objects USING (id) WHERE spec IN (1, 2)")
def o14_unique_keywords(s, d):
    return search.unique_keywords(bridge.objects(s, d), _bridge(s, d), search.one_of("spec", [1, 2]))


@query("SELECT id FROM objects WHERE spec IN (3, 5) OR station = 9")
def o15_union_search(s, d):
    return search.union_search(bridge.objects(s, d), [search.one_of("spec", [3, 5]), search.compare("station", "=", 9)]).select("id")


# Reports


@query("SELECT * FROM specs WHERE project <> 5")
def p01_spec_basics(s, d):
    return reports.spec_basics(bridge.specs(s, d), s.range(5, 6).select(F.col("id").cast("int").alias("project")))


@query("""SELECT o.spec, o.submitter, o.station, o.site, o.n, spec_label, name, country, CASE WHEN station % 4 <> 0 THEN 'eco' || (station % 3) END ecosystem,
  CASE WHEN name IS NULL THEN CASE WHEN station IS NOT NULL THEN 'Other' END WHEN station % 5 = 0 THEN 'Associated' WHEN station % 5 < 3 THEN 'ICOS' ELSE 'Other' END stationclass
  FROM (SELECT spec, submitter, station, site, count(*) n FROM objects WHERE size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated) GROUP BY ALL) o LEFT JOIN specs USING (spec) LEFT JOIN stations USING (station) WHERE coalesce(project, 0) <> 5""")
def p03_origin_stats(s, d):
    k = F.col("station")
    stations = bridge.stations(s, d).withColumn("ecosystem", F.when(k % 4 != 0, F.concat(F.lit("eco"), k % 3))).withColumn("station_class", F.when(k % 5 == 0, "Associated").when(k % 5 < 3, (k % 5).cast("string")))
    return reports.origin_stats(flagged(s, d), stations, bridge.specs(s, d), hidden=s.range(5, 6).select(F.col("id").cast("int").alias("project")))


@query("SELECT id, name station_name, dois FROM objects LEFT JOIN stations USING (station) LEFT JOIN (SELECT member id, string_agg(DISTINCT 'doi' || coll, ',' ORDER BY 'doi' || coll) dois FROM members WHERE coll % 3 = 0 GROUP BY 1) USING (id)")
def p04_object_details(s, d):
    dois = bridge.members(s, d).where("coll % 3 = 0").select("member", F.concat(F.lit("doi"), "coll").alias("doi"))
    return reports.object_details(bridge.objects(s, d), bridge.stations(s, d), dois).select("id", "station_name", "dois")


@query("SELECT spec, 'brand' || (spec % 5) || ',type' || project AS keywords FROM specs")
def p06_spec_keywords(s, d):
    _, of_spec, of_project = bridge.keywords(s, d)
    return reports.spec_keywords(of_spec, of_project, bridge.specs(s, d))


@query("SELECT id, submitted FROM objects WHERE size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated) AND spec = 4 ORDER BY submitted DESC, id LIMIT 50")
def p08_list_objects(s, d):
    return reports.list_objects(flagged(s, d), search.compare("spec", "=", 4), limit=50).select("id", "submitted")


@query("SELECT id, spec, station, height, data_start, data_end, name FROM objects JOIN stations USING (station) WHERE spec IN (1, 2, 3) AND id NOT IN (SELECT id FROM deprecated)")
def p09_product_availability(s, d):
    return reports.product_availability(flagged(s, d), bridge.stations(s, d), [1, 2, 3])


@query("SELECT id, id IN (SELECT old FROM edges) has_next, spec % 3 = 1 has_variables FROM objects WHERE CAST(id AS BIGINT) % 2 = 0")
def p12_known_objects(s, d):
    o = bridge.objects(s, d)
    found = reports.known_objects(o, o.where("cast(id as bigint) % 2 = 0").select("id"), bridge.edges(s, d), o.where("spec % 3 = 1").select("id"))
    return found.select("id", "has_next", "has_variables")


@query("SELECT spec, station, id FROM objects WHERE size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated) QUALIFY row_number() OVER (PARTITION BY spec, station ORDER BY data_end DESC, id) = 1")
def p13_latest_for(s, d):
    return reports.latest_for(flagged(s, d), ["spec", "station"]).select("spec", "station", "id")


@query("SELECT id, submitted FROM objects WHERE size IS NULL")
def p15_incomplete_uploads(s, d):
    return reports.incomplete_uploads(bridge.objects(s, d)).select("id", "submitted")


@query("SELECT coll, id, submitted FROM objects JOIN members ON id = member WHERE submitted >= TIMESTAMP '1995-01-01' AND submitted < TIMESTAMP '1995-07-01'")
def p16_objects_in_collections(s, d):
    return reports.objects_in_collections(bridge.objects(s, d), bridge.members(s, d), "1995-01-01", "1995-07-01")


@query("SELECT spec, spec_label, level, count(*) n FROM objects JOIN stations USING (station) JOIN specs USING (spec) WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 50 GROUP BY ALL")
def p17_geo_stats(s, d):
    points = geo.with_envelope(bridge.stations(s, d).select("station", F.array(F.struct("lon", "lat")).alias("coords"), F.lit("point").alias("geom_type")))
    inside = geo.intersecting(points, [(-60, -30), (60, -30), (60, 50), (-60, 50)]).select("station")
    o = bridge.objects(s, d)
    return reports.geo_stats(o, o.join(inside, "station", "left_semi"), bridge.specs(s, d))


@query("SELECT id, submitted, spec_label, level FROM (SELECT * FROM objects WHERE size IS NOT NULL ORDER BY submitted DESC, id LIMIT 100) JOIN specs USING (spec)")
def p19_last_objects(s, d):
    return reports.last_objects(bridge.objects(s, d), bridge.specs(s, d), 100)


@query("SELECT format, count(*) n FROM objects JOIN specs USING (spec) WHERE size IS NOT NULL AND format <> 2 GROUP BY ALL")
def p20_per_format_stats(s, d):
    return reports.per_format_stats(bridge.objects(s, d), bridge.specs(s, d), 2)


@query("""SELECT station, string_agg(DISTINCT v, ',' ORDER BY v) variables, string_agg(DISTINCT h, ',' ORDER BY h) heights, string_agg(DISTINCT v || '@' || h, ',' ORDER BY v || '@' || h) pairs
  FROM (SELECT station, 'v' || i v, CAST(CAST(height AS DECIMAL(9, 1)) AS VARCHAR) h FROM objects, range(3) r(i) WHERE station IS NOT NULL AND size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated) AND i >= spec % 3 AND (CAST(id AS BIGINT) % 2 = 0 OR i = 2)) GROUP BY station""")
def p21_species_and_heights(s, d):
    """Specs have the variables from their number modulo 3 up to v2; objects of odd ids list v2 only."""
    o = flagged(s, d).withColumn("variables", F.when(F.col("id").cast("bigint") % 2 == 1, F.array(F.lit("v2"))))
    variables = bridge.specs(s, d).select("spec", F.explode(F.sequence(F.col("spec") % 3, F.lit(2))).alias("i")).select("spec", F.concat(F.lit("v"), "i").alias("variable"))
    return reports.species_and_heights(o, variables)


@query("SELECT spec, station, height, count(*) n FROM objects WHERE size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated) GROUP BY ALL HAVING count(*) > 1")
def p22_duplicates(s, d):
    return reports.duplicates(flagged(s, d), ["spec", "station", "height"])


@query("""SELECT a.id, b.id later FROM objects a JOIN objects b ON a.file_name = b.file_name AND a.spec = b.spec AND (b.submitted > a.submitted OR b.submitted = a.submitted AND b.id > a.id)
  WHERE NOT EXISTS (SELECT 1 FROM edges WHERE old = a.id AND new = b.id)""")
def p23_resubmitted_files(s, d):
    return reports.resubmitted_files(bridge.objects(s, d), bridge.edges(s, d))


@query("SELECT id, CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN 'own' WHEN spec % 2 = 0 THEN 'spec' WHEN project = 1 THEN 'project' ELSE 'default' END licence FROM objects JOIN specs USING (spec)")
def p30_licence_of(s, d):
    o, sp = bridge.objects(s, d), bridge.specs(s, d)
    return reports.licence_of(o, o.where("cast(id as bigint) % 9 = 0").select("id", F.lit("own").alias("licence")), sp.where("spec % 2 = 0").select("spec", F.lit("spec").alias("licence")), sp.where("project = 1").select("project", F.lit("project").alias("licence")).distinct(), sp, "default")


@query("SELECT country, id FROM objects JOIN specs USING (spec) LEFT JOIN stations USING (station) WHERE level IN (2, 3) AND size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated)")
def p31_sitemap(s, d):
    return reports.sitemap(flagged(s, d), bridge.stations(s, d), bridge.specs(s, d))


@query("SELECT id FROM objects WHERE id NOT IN (SELECT id FROM deprecated) AND NOT starts_with(id, '1') AND NOT starts_with(id, '2')")
def p32_unlisted_hosts(s, d):
    return reports.unlisted_hosts(flagged(s, d), ["1", "2"]).select("id")


# Versions

_CHAINS = """, links AS (SELECT old id, new AS "at", 1 k FROM edges UNION SELECT id, new, k + 1 FROM links JOIN edges ON old = links."at"),
heads AS (SELECT id, "at" latest FROM links WHERE "at" NOT IN (SELECT old FROM edges))"""


@query("SELECT DISTINCT old id, new AS next FROM edges JOIN objects ON new = id WHERE size IS NOT NULL")
def v01_next_versions(s, d):
    return versions.next_versions(bridge.edges(s, d), bridge.objects(s, d))


@query(f"{_CHAINS} SELECT objects.id, coalesce(latest, objects.id) latest, false in_cycle FROM objects LEFT JOIN heads USING (id)")
def v03_latest_versions(s, d):
    return versions.latest_versions(bridge.edges(s, d), bridge.objects(s, d))


@query("SELECT new id, old previous FROM edges")
def v04_previous_versions(s, d):
    return versions.previous_versions(bridge.edges(s, d))


@query(f"""{_CHAINS}, every AS (SELECT old id FROM edges UNION SELECT new FROM edges), steps AS (SELECT every.id, coalesce(latest, every.id) chain, coalesce((SELECT max(k) FROM links WHERE links.id = every.id), 0) k FROM every LEFT JOIN heads USING (id))
  SELECT id, chain, CAST(max(k) OVER (PARTITION BY chain) - k + 1 AS INT) AS position, CAST(max(k) OVER (PARTITION BY chain) + 1 AS INT) length FROM steps""")
def v05_version_chains(s, d):
    return versions.version_chains(bridge.edges(s, d))


@query("SELECT old, count(DISTINCT new) n FROM (SELECT new, old FROM edges UNION ALL SELECT id || 'x', old FROM edges JOIN objects ON new = id WHERE spec % 2 = 0) GROUP BY old HAVING count(DISTINCT new) > 1")
def v07_multi_deprecated(s, d):
    e = bridge.edges(s, d)
    more = e.join(bridge.objects(s, d).where("spec % 2 = 0").select(F.col("id").alias("new")), "new", "left_semi").select(F.concat("new", F.lit("x")).alias("new"), "old")
    return versions.multi_deprecated(e.union(more))


@query("SELECT id new, old FROM (SELECT id, count(*) OVER (PARTITION BY file_name, spec) n, lag(id) OVER (PARTITION BY file_name, spec ORDER BY submitted, id) old FROM objects WHERE size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated)) WHERE n = 2 AND old IS NOT NULL")
def v08_chain_duplicates(s, d):
    return versions.chain_duplicates(flagged(s, d), ["file_name", "spec"])


@query("""SELECT b.id new, a.id old FROM objects a JOIN objects b ON a.station = b.station AND a.spec = b.spec AND a.id <> b.id AND b.data_start <= a.data_start AND b.data_end >= a.data_end
  AND abs(CAST(a.id AS BIGINT) % 4 - CAST(b.id AS BIGINT) % 4) < 2 AND a.size IS NOT NULL AND b.size IS NOT NULL AND a.id NOT IN (SELECT old FROM edges)""")
def v10_interval_deprecations(s, d):
    """Heights are whole metres here, so that some are exactly two apart."""
    o = bridge.objects(s, d).withColumn("height", (F.col("id").cast("bigint") % 4).cast("double"))
    old = bridge.edges(s, d).select(F.col("old").alias("id")).distinct().withColumn("deprecated", F.lit(True))
    return versions.interval_deprecations(o.join(old, "id", "left").withColumn("deprecated", F.coalesce("deprecated", F.lit(False))), o)


@query(f"{_CHAINS} SELECT heads.id, latest, CAST(floor((a.size - b.size) * 100 / a.size) AS BIGINT) loss FROM heads JOIN objects a ON heads.id = a.id JOIN objects b ON latest = b.id WHERE b.size < a.size")
def v11_shrunk_versions(s, d):
    return versions.shrunk_versions(bridge.edges(s, d), bridge.objects(s, d))


@query("SELECT file_name, id, CAST(row_number() OVER (PARTITION BY file_name ORDER BY submitted DESC, id DESC) AS INT) rank FROM objects QUALIFY rank <= 2")
def v12_same_name_latest(s, d):
    return versions.same_name_latest(bridge.objects(s, d)).select("file_name", "id", "rank")


_NESTED = """, inner_links AS (SELECT DISTINCT 's' || (coll % 7) AS upper_, 'c' || coll AS lower_ FROM members UNION SELECT DISTINCT 't' || (coll % 7 % 3), 's' || (coll % 7) FROM members UNION SELECT 's6', 't0'),
reach AS (SELECT upper_, lower_ FROM inner_links UNION SELECT reach.upper_, inner_links.lower_ FROM reach JOIN inner_links ON reach.lower_ = inner_links.upper_),
below AS (SELECT coll, id, submitter, spec, station FROM (SELECT upper_ coll, lower_ AS under FROM reach UNION SELECT 'c' || coll, 'c' || coll FROM members) JOIN (SELECT 'c' || coll AS under, member FROM members) USING (under) JOIN objects ON member = id)"""


@query(f"""{_NESTED} SELECT coll, count(DISTINCT id) n_objects, string_agg(DISTINCT 'P' || submitter, ',' ORDER BY 'P' || submitter) creators, coalesce(string_agg(DISTINCT country, ',' ORDER BY country), '') funders,
  string_agg(DISTINCT CAST(format AS VARCHAR), ',' ORDER BY CAST(format AS VARCHAR)) formats FROM below LEFT JOIN specs USING (spec) LEFT JOIN stations USING (station) GROUP BY coll""")
def v15_collection_rollup(s, d):
    """Collections of customers in collections s0 to s6, these in t0 to t2, and t0 in s6, which it holds: a cycle."""
    m, o = bridge.members(s, d), bridge.objects(s, d)
    name = lambda p, c: F.concat(F.lit(p), c)
    sub = F.col("coll") % 7
    nested = m.select(name("s", sub).alias("coll"), name("c", F.col("coll")).alias("member")).union(m.select(name("t", sub % 3), name("s", sub))).distinct().union(s.range(1).select(F.lit("s6"), F.lit("t0")))
    creators = o.select("id", F.concat(F.lit("P"), "submitter").alias("value"))
    funders = o.join(bridge.stations(s, d), "station").select("id", F.col("country").alias("value"))
    formats = o.join(bridge.specs(s, d), "spec").select("id", F.col("format").alias("value"))
    found = versions.collection_rollup(m.select(name("c", F.col("coll")).alias("coll"), "member").union(nested), o, creators=creators, funders=funders, formats=formats)
    return found.select("coll", "n_objects", *(F.array_join(c, ",").alias(c) for c in ("creators", "funders", "formats")))


@query("""SELECT station, members, previous FROM (SELECT station, string_agg(DISTINCT id, ',' ORDER BY id) members FROM objects WHERE spec = 3 AND submitted >= TIMESTAMP '1995-01-01' AND station IS NOT NULL AND size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated) GROUP BY station)
  LEFT JOIN (SELECT station, max(coll) previous FROM (SELECT cust coll, min(station) station FROM objects WHERE station IS NOT NULL AND spec < 5 GROUP BY cust HAVING count(DISTINCT station) = 1) GROUP BY station) USING (station)""")
def v19_release_collections(s, d):
    o = flagged(s, d)
    return versions.release_collections(o, 3, "1995-01-01", o.where("spec < 5").select(F.col("cust").alias("coll"), F.col("id").alias("member")))


# Validation


def packages(s, d):
    o = bridge.objects(s, d)
    key = F.col("id").cast("bigint")
    return o.select(
        F.concat(F.lit("p"), "id").alias("pkg_id"), F.concat(F.lit("n"), "id").alias("hash"), (F.col("spec") + F.when(key % 50 == 0, 100).otherwise(0)).alias("spec"), "submitter", "file_name", "data_start",
        F.when(key % 20 == 0, F.timestamp_add("DAY", F.lit(-100), "data_start")).otherwise(F.col("data_end")).alias("data_end"), F.when(key % 3 == 0, F.col("id")).alias("previous"), (key % 4).alias("level"), (key % 5).cast("int").alias("theme"),
    )


@query("SELECT 'p' || id pkg_id, 'C1' rule FROM objects WHERE CAST(id AS BIGINT) % 3 = 0 AND size IS NULL UNION ALL SELECT DISTINCT 'p' || old, 'C1' FROM edges JOIN objects ON new = id WHERE CAST(old AS BIGINT) % 3 = 0 AND size IS NOT NULL")
def c01_previous_exists(s, d):
    return validate.previous_exists(packages(s, d), bridge.objects(s, d), bridge.edges(s, d)).select("pkg_id", "rule")


@query("SELECT 'p' || a.id pkg_id FROM objects a WHERE EXISTS (SELECT 1 FROM objects b WHERE b.file_name = a.file_name AND b.size IS NOT NULL AND b.id NOT IN (SELECT id FROM deprecated) AND NOT (CAST(a.id AS BIGINT) % 3 = 0 AND b.id = a.id))")
def c03_name_is_free(s, d):
    return validate.name_is_free(packages(s, d), flagged(s, d)).select("pkg_id")


@query("SELECT 'p' || id pkg_id, 'C4' rule FROM objects WHERE CAST(id AS BIGINT) % 4 < 3 AND CAST(id AS BIGINT) % 20 <> 0 AND data_end > TIMESTAMP '1997-01-01' UNION ALL SELECT 'p' || id, 'C4' FROM objects WHERE CAST(id AS BIGINT) % 20 = 0 AND data_start - INTERVAL 100 DAY > TIMESTAMP '1997-01-01' UNION ALL SELECT 'p' || id, 'C4' FROM objects WHERE CAST(id AS BIGINT) % 20 = 0")
def c04_sane_interval(s, d):
    return validate.sane_interval(packages(s, d), "1997-01-01").select("pkg_id", "rule")


_RULES = """, k AS (SELECT 'p' || id pkg_id, CAST(id AS BIGINT) AS key, spec + CASE WHEN CAST(id AS BIGINT) % 50 = 0 THEN 100 ELSE 0 END spec FROM objects),
r AS (SELECT pkg_id, key, spec, key % 5 = 0 spatial_package, spec % 2 = 0 spatial, spec % 3 <> 0 has_dataset, spec % 4 format FROM k WHERE key % 50 <> 0)"""


@query(f"""{_RULES} SELECT pkg_id, 'unknown spec' message FROM k WHERE key % 50 = 0
  UNION ALL SELECT pkg_id, 'dataset must be spatiotemporal' FROM r WHERE spatial_package AND NOT spatial UNION ALL SELECT pkg_id, 'dataset must be a station''s time series' FROM r WHERE NOT spatial_package AND spatial
  UNION ALL SELECT pkg_id, 'interval is missing' FROM r WHERE NOT spatial_package AND NOT spatial AND NOT has_dataset AND key % 7 = 0 UNION ALL SELECT pkg_id, 'number of rows is missing' FROM r WHERE NOT spatial_package AND NOT spatial AND has_dataset AND key % 11 = 0 AND format <> 1
  UNION ALL SELECT pkg_id, 'spec has no dataset for variables' FROM r WHERE spatial_package AND spatial AND NOT has_dataset UNION ALL SELECT pkg_id, 'unknown variable v' || (key % 4) || '_1' FROM r WHERE spatial_package AND spatial AND has_dataset AND key % 4 > 2""")
def c07_spec_fits(s, d):
    key = F.substring("pkg_id", 2, 20).cast("bigint")
    p = packages(s, d).withColumn("is_spatial", key % 5 == 0).withColumn("data_start", F.when(key % 7 != 0, F.col("data_start"))).withColumn("n_rows", F.when(key % 11 != 0, key)).withColumn("variables", F.array(F.concat(F.lit("v"), key % 4, F.lit("_1"))))
    specs = bridge.specs(s, d).select("spec", (F.col("spec") % 2 == 0).alias("spatial"), F.when(F.col("spec") % 3 != 0, "D").alias("dataset"), (F.col("spec") % 4).alias("format"))
    defs = s.createDataFrame([("D", 1, "a", "v0_1", False, False), ("D", 2, "b", "v[12]_[0-9]", True, True)], "dataset string, nr int, var string, title string, is_pattern boolean, optional boolean")
    return validate.spec_fits(p, specs, defs, (1,)).select("pkg_id", "message")


# Intervals


_NAMED = "CASE WHEN variable < 6 THEN 'SWC_' || (variable % 3) || '_1_' || variable ELSE 'OUT_' || variable END"


@query(f"""SELECT station, variable, sensor, start, least(s1, lead(start) OVER (PARTITION BY sensor, CASE WHEN starts_with(variable, 'SWC') THEN 'SWC' ELSE variable END ORDER BY start, station, variable)) stop, CAST(row_number() OVER (PARTITION BY sensor ORDER BY start, station, variable) - 1 AS INT) nr FROM (
  SELECT *, lead(start) OVER (PARTITION BY station, variable ORDER BY run) s1 FROM (SELECT station, variable, run, sensor, min(start) start FROM (
  SELECT *, sum(new) OVER (PARTITION BY station, variable ORDER BY start, sensor) run FROM (SELECT *, CASE WHEN sensor = lag(sensor) OVER (PARTITION BY station, variable ORDER BY start, sensor) THEN 0 ELSE 1 END new FROM (SELECT DISTINCT station, {_NAMED} variable, sensor % 50 sensor, start FROM deployments))) GROUP BY ALL))""")
def i01_stitch_deployments(s, d):
    """Sensors with variables of one family at several places, so that the family's rule ends some runs."""
    v = F.col("variable")
    name = F.when(v < 6, F.concat(F.lit("SWC_"), v % 3, F.lit("_1_"), v)).otherwise(F.concat(F.lit("OUT_"), v))
    items = bridge.deployment_rows(s, d)
    n = items.count()
    rows = items.select("station", name.alias("variable"), (F.col("sensor") % 50).alias("sensor"), "start")
    rows = dealt(rows, n, *rows.columns).distinct().withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0))
    family = F.coalesce(intervals.variable_family(F.col("variable"), ["SWC"]), F.col("variable"))
    return intervals.stitch_deployments(rows, family, n).select("station", "variable", "sensor", "start", "stop", "nr")


@query("SELECT id, count(*) n FROM objects o JOIN deployments d ON o.station = d.station AND o.spec % 10 = d.variable AND d.start < data_end AND d.stop > data_start GROUP BY id")
def i02_deployments_for(s, d):
    o = bridge.objects(s, d).withColumn("variable", F.col("spec") % 10)
    return intervals.deployments_for(o, bridge.deployments(s, d), ["station", "variable"]).groupBy("id").agg(F.count("*").alias("n"))


#: The text of an interval from data_start to data_end.
_COVERAGE = """CASE WHEN epoch_us(data_end) - epoch_us(data_start) < 86424000000 THEN strftime(make_timestamp((epoch_us(data_start) + epoch_us(data_end)) // 2), '%Y-%m-%d')
  WHEN dayofyear(data_start) = 1 AND dayofyear(data_end) = 1 THEN CASE WHEN year(data_start) = year(data_end) - 1 THEN year(data_start)::VARCHAR ELSE year(data_start) || '–' || (year(data_end) - 1) END
  WHEN data_start = date_trunc('day', data_start) AND data_end = date_trunc('day', data_end) THEN strftime(data_start, '%Y-%m-%d') || '–' || strftime(data_end - INTERVAL 1 DAY, '%Y-%m-%d')
  ELSE strftime(data_start, '%Y-%m-%d') || '–' || strftime(data_end, '%Y-%m-%d') END"""


@query(f"SELECT id, {_COVERAGE} coverage FROM objects")
def i07_coverage_text(s, d):
    return bridge.objects(s, d).select("id", intervals.coverage_text(F.col("data_start"), F.col("data_end")).alias("coverage"))


@query("SELECT station, sensor, stop FROM deployments QUALIFY row_number() OVER (PARTITION BY station ORDER BY stop DESC, lpad(sensor::VARCHAR, 9, '0') || start::VARCHAR DESC, variable DESC) = 1")
def i08_latest_platform(s, d):
    rows = bridge.deployments(s, d).withColumn("id", F.concat(F.lpad(F.col("sensor").cast("string"), 9, "0"), F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "variable"))
    return intervals.latest_platform(rows).select("station", "sensor", "stop")


# Space


@query("""SELECT CASE WHEN lon >= 60 THEN 2 WHEN lon >= -60 THEN 1 ELSE 0 END || '_' || CASE WHEN lat >= 0 THEN 1 ELSE 0 END || CASE WHEN lon >= -60 AND lon < 60 AND lat >= 0
  THEN '_' || CASE WHEN lon >= 30 THEN 3 WHEN lon >= 0 THEN 2 WHEN lon >= -30 THEN 1 ELSE 0 END || '_' || CASE WHEN lat >= 60 THEN 2 WHEN lat >= 30 THEN 1 ELSE 0 END ELSE '' END cell, count(*) n FROM stations GROUP BY ALL""")
def g07_grid_cell(s, d):
    return bridge.stations(s, d).groupBy(geo.grid_cell(F.col("lon"), F.col("lat")).alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT country, min(lon) min_lon, min(lat) min_lat, max(lon) max_lon, max(lat) max_lat FROM stations GROUP BY country")
def g08_bounding_box(s, d):
    return geo.bounding_box(geo.with_envelope(bridge.stations(s, d).select("country", F.array(F.struct("lon", "lat")).alias("coords"))), "country")


@query("SELECT country, round(2 * avg(sqrt((lon - clon) ** 2 + (lat - clat) ** 2)), 6) size FROM stations JOIN (SELECT country, avg(lon) clon, avg(lat) clat FROM stations GROUP BY 1) USING (country) GROUP BY country")
def g11_characteristic_size(s, d):
    return geo.characteristic_size(bridge.stations(s, d), "country").select("country", F.round("size", 6).alias("size"))


# Exports


@query("SELECT id, spec_label || coalesce(' at ' || name, '') title, strftime(data_start, '%Y-%m-%d') AS \"begin\", strftime(data_end, '%Y-%m-%d') AS \"end\", CAST(year(submitted) AS VARCHAR) publication_year FROM objects JOIN specs USING (spec) LEFT JOIN stations USING (station) WHERE size IS NOT NULL AND id NOT IN (SELECT id FROM deprecated)")
def x03_b2find_export(s, d):
    return export.b2find_export(flagged(s, d), bridge.specs(s, d), bridge.stations(s, d))


@query(f"""SELECT id, coalesce(authors || ' ', '') || '(' || year(submitted) || '). ' || concat_ws(', ', spec_label, name, {_COVERAGE}) || ', ' || id citation
  FROM objects JOIN specs USING (spec) LEFT JOIN stations USING (station) LEFT JOIN (SELECT id, string_agg(person, ', ' ORDER BY coalesce(weight, 0) DESC, person) authors FROM
  (SELECT o.id, person, max(weight) weight FROM objects o JOIN memberships m ON o.station = m.station AND coalesce(m.start < data_end, true) AND coalesce(m.stop > data_start, true) GROUP BY ALL) GROUP BY id) USING (id)""")
def x04_citations(s, d):
    authors = intervals.authors_of(bridge.objects(s, d), bridge.memberships(s, d))
    return export.citations(bridge.objects(s, d), bridge.specs(s, d), bridge.stations(s, d), authors)


@query("SELECT spec, id FROM objects WHERE submitted BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY spec ORDER BY submitted DESC, id) = 1")
def x11_submission_window(s, d):
    return export.submission_window(bridge.objects(s, d), "1995-01-01", "1996-01-01", ["spec"]).select("spec", "id")


# Functions


@query("SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f', size / 1024) || ' KB' ELSE printf('%.1f', size / 1048576) || ' MB' END AS size_text FROM objects WHERE size IS NOT NULL")
def f01_format_bytes(s, d):
    return bridge.objects(s, d).where("size is not null").select("id", terms.format_bytes(F.col("size")).alias("size_text"))


# Further operators


@query("SELECT id subj FROM objects WHERE spec % 5 IN (0, 1)")
def b09_instances_of(s, d):
    return st.instances_of(typed_objects(s, d), "Class0", subclasses=True)


@query("SELECT 'g/bnode' || (row_number() OVER (ORDER BY '_:b' || id) - 1) subj, file_name obj FROM objects")
def b16_stabilize_bnodes(s, d):
    names = bridge.objects(s, d).select(F.lit("g").alias("graph"), F.concat(F.lit("_:b"), "id").alias("subj"), F.lit("hasName").alias("pred"), F.col("file_name").alias("obj"), F.lit(1).alias("obj_kind"), F.lit("xsd:string").alias("lit_attr"))
    return st.stabilize_bnodes(names, "g").select("subj", "obj")


@query("""SELECT new subj, old obj, false assertion FROM edges WHERE CAST(new AS BIGINT) % 10 = 0 OR CAST(old AS BIGINT) % 10 = 0
  UNION ALL SELECT CASE WHEN CAST(new AS BIGINT) % 10 = 0 THEN 'r' ELSE '' END || new, CASE WHEN CAST(old AS BIGINT) % 10 = 0 THEN 'r' ELSE '' END || old, true FROM edges WHERE CAST(new AS BIGINT) % 10 = 0 OR CAST(old AS BIGINT) % 10 = 0""")
def b17_rename_resource(s, d):
    links = bridge.edges(s, d).select(F.lit("objects").alias("graph"), F.col("new").alias("subj"), F.lit("isNextVersionOf").alias("pred"), F.col("old").alias("obj"), F.lit(0).alias("obj_kind"), F.lit(None).cast("string").alias("lit_attr"))
    mapping = bridge.objects(s, d).where("cast(id as bigint) % 10 = 0").select(F.col("id").alias("old"), F.concat(F.lit("r"), "id").alias("new"))
    return st.rename_resource(links, mapping).select("subj", "obj", "assertion")


@query("SELECT regexp_replace(id, '^1', 'one/') subj, file_name obj FROM objects WHERE file_name IS NOT NULL")
def b18_rewrite_iris(s, d):
    return st.rewrite_iris(st.match(st.objects_to_statements(bridge.objects(s, d)), p="hasName"), "^1", "one/").select("subj", "obj")


@query("SELECT id subj FROM objects WHERE spec % 5 = 0 AND site IS NULL")
def b20_orphans(s, d):
    return st.orphans(typed_objects(s, d), "Class0", required="wasPerformedAt").where(F.col("pred") == st.TYPE).select("subj")


@query("SELECT id subj FROM objects WHERE site IS NOT NULL")
def b21_move_by_predicate(s, d):
    return st.move_by_predicate(st.objects_to_statements(bridge.objects(s, d)), "wasPerformedAt", "objects").where("pred = 'hasName'").select("subj")


@query("SELECT id subj, 'wasPerformedAt' pred, 'nowhere' obj FROM objects WHERE spec % 5 = 0 AND site IS NULL")
def b25_add_missing_link(s, d):
    return st.add_missing_link(typed_objects(s, d), "Class0", "wasPerformedAt", "nowhere").select("subj", "pred", "obj")


@query("SELECT id, size IS NOT NULL complete FROM objects UNION ALL SELECT 'c' || coll, NOT plain OR bool_or(size IS NOT NULL) FROM members JOIN objects ON member = id GROUP BY coll, plain")
def v02_is_complete(s, d):
    m = bridge.members(s, d).withColumn("coll", F.concat(F.lit("c"), "coll"))
    return versions.is_complete(bridge.objects(s, d), m.select(F.col("coll").alias("id"), "plain").distinct(), m.where("plain"))


@query("""
, e AS (SELECT new, old FROM edges UNION ALL SELECT id || '00000000', old FROM edges JOIN objects ON new = id WHERE spec % 2 = 0), cnt AS (SELECT old, count(*) n FROM e GROUP BY old),
it AS (SELECT id, submitted, data_start, data_end FROM objects UNION ALL SELECT id || '00000000', submitted + INTERVAL 1 DAY, data_start, data_end FROM objects WHERE spec % 2 = 0),
nexts AS (SELECT e.old, e.new bad FROM e JOIN cnt USING (old) WHERE n = 2), walk AS (SELECT DISTINCT bad, bad id FROM nexts UNION SELECT walk.bad, e.new FROM walk JOIN e ON e.old = walk.id),
late AS (SELECT bad FROM nexts JOIN cnt ON cnt.old = bad AND n = 1 JOIN e d ON d.old = bad JOIN it a ON a.id = bad JOIN it b ON b.id = d.new WHERE epoch(b.submitted) - epoch(a.submitted) > 60 * 86400),
wide AS (SELECT bad FROM walk JOIN it USING (id) WHERE id NOT IN (SELECT old FROM e) AND epoch(data_end) - epoch(data_start) > 30 * 86400)
SELECT DISTINCT nexts.old, nexts.bad, walk.id FROM nexts JOIN walk USING (bad) WHERE bad IN (SELECT bad FROM late UNION SELECT bad FROM wide)""")
def v06_bad_branches(s, d):
    o, e = bridge.objects(s, d), bridge.edges(s, d)
    even, twin = o.where("spec % 2 = 0"), lambda c: F.concat(c, F.lit("00000000"))
    more = e.join(even.select(F.col("id").alias("new")), "new", "left_semi").select(twin("new").alias("new"), "old")
    items = o.select("id", "submitted", "data_start", "data_end").union(even.select(twin("id"), F.timestamp_add("DAY", F.lit(1), "submitted"), "data_start", "data_end"))
    return versions.bad_branches(e.union(more), items, span=30)


@query("SELECT b.id new, a.id old FROM objects a JOIN objects b ON a.cust = b.cust WHERE a.spec = 0 AND b.spec = 1 OR a.spec = 2 AND b.spec = 3")
def v09_deprecation_candidates(s, d):
    o = bridge.objects(s, d)
    return versions.deprecation_candidates(o, o, s.createDataFrame([(0, 1), (2, 3)], "old_spec int, new_spec int"), ["cust"])


@query("SELECT member, coll FROM members WHERE CAST(member AS BIGINT) % 2 <> 0 UNION ALL SELECT member, coll + 100 FROM members WHERE CAST(member AS BIGINT) % 2 = 0")
def v14_parent_collections(s, d):
    m = bridge.members(s, d).select("coll", "member")
    newer = m.where("cast(member as bigint) % 2 = 0").select((F.col("coll") + 100).alias("coll"), "member")
    return versions.parent_collections(m.union(newer), m.select(F.col("coll").alias("old"), (F.col("coll") + 100).alias("new")).distinct())


@query("SELECT CAST(coll AS VARCHAR) subj, member obj FROM members WHERE member IN (SELECT old FROM edges)")
def v17_superseded_references(s, d):
    links = bridge.members(s, d).select(F.col("coll").cast("string").alias("subj"), F.col("member").alias("obj"))
    return versions.superseded_references(links, bridge.edges(s, d)).select("subj", "obj")


@query("""SELECT row, base, CASE WHEN k = 0 THEN base ELSE base || '_' || (greatest(coalesce(most, 1), 1) + k) END id FROM (SELECT row, base, most, row_number() OVER (PARTITION BY base ORDER BY row) - CASE WHEN plain THEN 0 ELSE 1 END k FROM
  (SELECT CAST(id AS BIGINT) AS row, file_name base FROM objects WHERE CAST(id AS BIGINT) % 4 <> 0) LEFT JOIN (SELECT base, max(k) most, bool_or(k = 1) plain FROM
  (SELECT file_name base, 1 k FROM objects WHERE CAST(id AS BIGINT) % 16 = 0 UNION SELECT file_name, CAST(CAST(id AS BIGINT) % 5 + 2 AS INT) FROM objects WHERE CAST(id AS BIGINT) % 16 = 4) GROUP BY base) USING (base))""")
def r02_unique_ids(s, d):
    o = bridge.objects(s, d).select(F.col("id").cast("bigint").alias("row"), F.col("file_name").alias("base"))
    numbered = o.where("row % 16 = 4").select(F.concat("base", F.lit("_"), F.col("row") % 5 + 2).alias("base"))
    return reconcile.unique_ids(o.where("row % 4 <> 0"), o.where("row % 16 = 0").select("base").union(numbered))


@query("SELECT cust, row_number() OVER (ORDER BY min(CAST(id AS BIGINT)), cust) AS number FROM objects GROUP BY cust")
def x10_number_by_appearance(s, d):
    rows = bridge.objects(s, d).select("cust", F.col("id").cast("bigint").alias("seq"))
    return export.number_by_appearance(rows, "cust", "seq", "c").select("cust", "number")


from ledgerloom.plans import further  # noqa: E402,F401  registers its queries here
