"""Registered queries against DuckDB on the smallest tables, and operators on literal rows."""

import base64
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import terms
from ledgerloom.operators import geo, intervals, reconcile, reports, statements as st, validate, versions
from ledgerloom.plans import catalog
from ledgerloom.sources import tables
from ledgerloom.streaming import log_streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(df: pd.DataFrame) -> list:
    show = lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(catalog.ORACLES[name]).df())


def test_settling_updates(spark):
    cases = {"a": [("v1", "W"), ("v2", "A")], "b": [("v1", "W")], "c": [("v1", "W"), ("v1", "A")], "d": [("v", "A"), ("v", "R")], "e": [("v", "R"), ("v", "A")]}
    rows = [(k, s, "p", o, op) for s, ops in cases.items() for k, (o, op) in enumerate(ops)]
    got = {(r.subj, r.obj, r.assertion) for r in st.materialize_updates(spark.createDataFrame(rows, "seq int, subj string, pred string, obj string, op string")).collect()}
    assert got == {("a", "v1", False), ("a", "v2", True), ("c", "v1", True), ("e", "v", True)}


def test_latest_versions_with_branches_and_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")], "new string, old string")
    items = spark.createDataFrame([(i,) for i in "abcdxyz"], "id string")
    got = sorted((r.id, r.latest, r.in_cycle) for r in versions.latest_versions(edges, items).collect())
    assert got == [("a", "c", False), ("a", "d", False), ("b", "c", False), ("b", "d", False), ("c", "c", False), ("d", "d", False), ("x", "x", True), ("y", "y", True), ("z", "z", False)]


def test_hash_ids_and_orcids(spark):
    h = "00" * 17 + "ff" + "11" * 14
    rows = spark.createDataFrame([(h, "0000-0002-1825-0097"), (None, "0000-0002-1825-0098")], "h string, o string").select(terms.hash_id(F.col("h")).alias("i"), terms.orcid_valid(F.col("o")).alias("v")).collect()
    assert rows[0].i == "AAAAAAAAAAAAAAAAAAAAAAD_" and rows[0].v is True and rows[1].i is None and rows[1].v is False


def test_variable_families(spark):
    rows = spark.createDataFrame([("WS_2_10_1",), ("WS_2_100_1",), ("D_SNOW_1_1_1",), ("made_up_1_2_3",), ("WD",), ("WD_4_4",), (None,)], "n string")
    assert [r.f for r in rows.select(intervals.variable_family(F.col("n"), ["WS", "WD", "D_SNOW"]).alias("f")).collect()] == ["WS", None, "D_SNOW", None, None, None, None]


def test_merged_labels(spark):
    labels = ["TA_1_2_1 / TA_1_2_1 / TA_4_1_1", "RH_5_1_2", "XX-One", "AA-Two"]
    row = spark.createDataFrame([(labels,)], "l array<string>").select(geo.merge_labels(F.col("l")).alias("t")).first()
    assert row.t == "XX-One, AA-Two, TA_n_n_n, RH_n_n_n"


def test_characteristic_size(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("a", 3.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0)], "k string, lon double, lat double")
    assert {r.k: r["size"] for r in geo.characteristic_size(rows, "k").collect()} == {"a": 5.0, "b": 0.0}


def test_polygon_test_and_hull(spark):
    shapes = [(1, [(0.5, 0.5)], "point"), (2, [(5.0, 5.0)], "point"), (3, [(-1.0, 0.5), (2.0, 0.5)], "line"), (4, [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)], "polygon"), (5, [(0.9, 0.9)], "point")]
    rows = geo.with_envelope(spark.createDataFrame(shapes, "id int, coords array<struct<lon:double,lat:double>>, geom_type string"))
    assert sorted(r.id for r in geo.intersecting(rows, [(0, 0), (1, 0), (0, 1)]).collect() if r.id != 1) == [3, 4]
    assert sorted(r.id for r in geo.intersecting(rows, [(0, 0), (1, 0), (1, 1), (0, 1)]).collect()) == [1, 3, 4, 5]
    rng = np.random.default_rng(0)
    pts = rng.random((200, 2))
    hull = geo.convex_hull(pts)
    ring = np.vstack((hull, hull[:1]))
    assert all(geo.contains_point(ring, p) or (p == hull).all(1).any() for p in pts)


def test_stitching(spark):
    rows = [("Htm", "SWC_1", 1, m, 1.0, 2.0) for m in (1, 2, 3, 5)] + [("Htm", "SWC_1", 2, 4, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "station string, variable string, sensor int, start int, lat double, lon double")
    got = sorted((r.sensor, r.start, r.stop, r.nr) for r in intervals.stitch_deployments(d).collect())
    assert got == [(1, 1, 4, 0), (1, 5, None, 1), (2, 4, 5, 0)]


def test_resubmitted_pairs_are_not_shuffled(spark):
    """Links to objects of another name don't matter, nor do those of nobody; pairs meet no further join."""
    rows = [("a", "f", 1, 1), ("b", "f", 1, 2), ("c", "f", 1, 2), ("d", "f", 1, 3), ("e", "f", 2, 9), ("g", None, 1, 9), ("h", None, 1, 10), ("i", "f", None, 1), ("j", "f", None, 2)]
    objects = spark.createDataFrame(rows, "id string, file_name string, spec int, submitted int")
    edges = spark.createDataFrame([("b", "a"), ("d", "a"), ("e", "a"), ("a", "b"), ("d", "c"), ("d", "c"), ("x", "b"), ("b", None), (None, "b")], "new string, old string")
    found = reports.resubmitted_files(objects, edges)
    assert sorted((r.id, r.later) for r in found.collect()) == [("a", "c"), ("b", "c"), ("b", "d")]
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Join")
    assert "LeftAnti" not in top[1] and "file_name" in top[1]


def test_tasks_of_series_keep_their_size(spark, monkeypatch):
    """With 40 rows to a task: the same history, from more tasks."""
    rows = [(f"s{i % 7}", i * 37 % 1009, [i % 5, None][i % 11 == 0]) for i in range(900)]
    series = spark.createDataFrame(rows, "series string, time int, instrument int")
    want = sorted(map(str, intervals.instrument_history(series, 1000).collect()))
    monkeypatch.setattr("ledgerloom.scratch.TASK_ROWS", 40)
    found = intervals.instrument_history(series, 1000)
    assert sorted(map(str, found.collect())) == want and len(want) > 40
    assert "RepartitionByExpression [series" in found._jdf.queryExecution().logical().toString() and "], 23" in found._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_a_sensor_are_numbered_over_ranges(spark, monkeypatch):
    """With 40 rows to a task: the same runs, and one sensor's numbered over several ranges."""
    rows = [(f"s{i % 7}", f"v{i % 3}", [i % 5, None][i % 11 == 0], i * 37 % 1009, 1.0, 2.0) for i in range(900)]
    d = spark.createDataFrame(rows, "station string, variable string, sensor int, start int, lat double, lon double")
    want = sorted(map(str, intervals.stitch_deployments(d).collect()))
    monkeypatch.setattr("ledgerloom.scratch.TASK_ROWS", 40)
    found = intervals.stitch_deployments(d).collect()
    assert sorted(map(str, found)) == want
    numbers = {}
    for r in sorted(found, key=lambda r: (r.start, r.station, r.variable)):
        assert r.nr == numbers.get(r.sensor, 0)
        numbers[r.sensor] = r.nr + 1
    assert set(numbers) == {0, 1, 2, 3, 4, None} and min(numbers.values()) > 40


def test_tasks_of_purged_statements_keep_their_size(spark, monkeypatch):
    """With 3 rows to a task: own statements, those below, and usages, from more tasks than the session's."""
    monkeypatch.setattr("ledgerloom.scratch.TASK_ROWS", 3)
    rows = [(f"s{i}", "p", f"n{i}", 0, None) for i in range(20)] + [(f"n{i}", "q", "x", 1, "t") for i in range(20)] + [("s3", "isNextVersionOf", "s4", 0, None)]
    found = st.purge_closure(spark.createDataFrame(rows, "subj string, pred string, obj string, obj_kind int, lit_attr string"), spark.createDataFrame([("s4",), ("s5",), ("s5",)], "subj string"))
    assert sorted((r.subj, r.obj) for r in found.collect()) == [("n4", "x"), ("n5", "x"), ("s3", "s4"), ("s4", "n4"), ("s5", "n5")]
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("earlier, later", [(64, 256), (2, 4), (3, 2), (1, 1)])
def test_resubmitted_pairs_of_runs(spark, monkeypatch, earlier, later):
    """As by pairing every two: ties, equal rows, objects without a time, groups below and above a run's length."""
    monkeypatch.setattr(reports, "EARLIER_RUN", earlier, raising=False)
    monkeypatch.setattr(reports, "LATER_RUN", later, raising=False)
    rows = [(str(i), f"f{i % 7 % 3}", i % 2, None if i % 11 == 0 else i * 5 % 9) for i in range(90)] + [("1", "f1", 1, 5), ("1", "f1", 1, 8), ("1", "f1", 1, 5)]
    edges = [(str(i + 14), str(i)) for i in range(0, 70, 3)] + [("8", "1"), ("8", "1"), ("3", "1"), (None, "2"), ("2", None)]
    found = reports.resubmitted_files(spark.createDataFrame(rows, "id string, file_name string, spec int, submitted int"), spark.createDataFrame(edges, "new string, old string"))
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[1:3] == b[1:3] and None not in (a[3], b[3]) and (a[3], a[0]) < (b[3], b[0]) and (b[0], a[0]) not in edges]
    assert sorted((r.id, r.later) for r in found.collect()) == sorted(pairs)


def test_resubmitted_objects_are_shuffled_by_name_once(spark):
    """One shuffle by name and spec serves both sides of the pairs."""
    rows = spark.range(400).selectExpr("string(id) id", "concat('f', id % 5) file_name", "int(id % 3) spec", "id submitted")
    found = reports.resubmitted_files(rows, rows.selectExpr("string(id + 15) new", "id old").where("old % 4 = 0"))
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    own = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert sum("file_name" in line for line in own) == 1 and len(own) == 3


def test_matching_memberships(spark):
    c = spark.createDataFrame([("a1", "r", None, 2015), ("a2", "r", 2016, None)], "id string, role string, start int, stop int")
    n = spark.createDataFrame([("n1", "r", None, 2015), ("n2", "r", 2016, 2017)], "id string, role string, start int, stop int")
    got = {(r.cur_id, r.new_id) for r in reconcile.match_memberships(c, n, ["role"]).collect()}
    assert got == {("a1", "n1"), ("a2", "n2")}
    assert [(r.id, r.what, r.stop) for r in reconcile.roles_diff(c, n, ["role"]).collect()] == [("a2", "changed", 2017)]


def test_ntriples_and_delimited(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<s> <p> <o> .\n<s> <q> "x\\"y"@en .\n_:b <r> "1"^^<xsd:int> .\n# c\n<s> <q> "t" .\n')
    got = sorted((r.subj, r.pred, r.obj, r.obj_kind, r.lit_attr) for r in tables.read_ntriples(spark, str(tmp_path / "a.nt"), "g").collect())
    assert got == [("_:b", "r", "1", 1, "xsd:int"), ("s", "p", "o", 0, None), ("s", "q", "t", 1, "xsd:string"), ("s", "q", 'x"y', 2, "en")]
    (tmp_path / "a.csv").write_text('﻿a;b\n 1 ;"x ""y"""\n;z\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "a.csv"), ";").collect()] == [("1", 'x "y"'), (None, "z")]


def test_log_round_trip_and_stream_equals_batch(spark, tmp_path):
    updates = spark.createDataFrame([(k, k % 3 != 2, f"s{k % 4}", "p", f"v{k % 2}", 1, "xsd:string") for k in range(24)], "seq long, assertion boolean, subj string, pred string, obj string, obj_kind int, lit_attr string")
    path = str(tmp_path / "log")
    tables.append_update_log(updates.where("seq < 12"), path, 1)
    tables.append_update_log(updates.where("seq >= 12"), path, 1)
    log = tables.read_update_log(spark, path)
    want = {(r.subj, r.obj) for r in catalog.logs.replay(log).collect()}
    state = {}

    def publish(batch, n):
        for r in batch.collect():
            state[r.subj, r.obj] = r.holds

    stream = tables.decode_terms(spark.readStream.schema(tables.LOG).option("maxFilesPerTrigger", 1).parquet(path))
    log_streams.stream_current_statements(stream, str(tmp_path / "c1"), publish).awaitTermination()
    assert {k for k, v in state.items() if v} == want


def test_coverage_texts(spark):
    """The middle day of what lasts less than about a day; years by their first days; midnights end the day before."""
    rows = [("2020-01-01 12:00:00", "2020-01-02 11:00:00"), ("2020-01-01 01:00:00", "2021-01-01 01:00:00"), ("2018-01-01 00:00:00", "2021-01-01 00:00:00"), ("2020-03-01 00:00:00", "2020-03-05 00:00:00"), ("2020-03-01 00:00:00", "2020-03-05 06:00:00"), ("2020-03-01 00:00:00", "2020-03-02 00:00:00"), ("2020-03-01 20:00:00", "2020-03-02 21:00:00"), (None, "2020-03-02 21:00:00")]
    df = spark.createDataFrame(rows, "a string, b string").select(intervals.coverage_text(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("t"))
    assert [r.t for r in df.collect()] == ["2020-01-01", "2020", "2018–2020", "2020-03-01–2020-03-04", "2020-03-01–2020-03-05", "2020-03-01", "2020-03-01–2020-03-02", None]


def test_unique_ids_avoid_numbered_ones(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "z"), (6, "w"), (7, "w"), (8, "w_2")], "row int, base string")
    taken = spark.createDataFrame([("x_2",), ("y",), ("y_7",)], "base string")
    assert {r.row: r.id for r in reconcile.unique_ids(new, taken).collect()} == {1: "x", 2: "x_3", 3: "y_8", 4: "z", 5: "z_2", 6: "w", 7: "w_3", 8: "w_2"}


def test_grid_cells(spark):
    rows = spark.createDataFrame([(-180.0, -90.0), (180.0, 90.0), (-60.0, 0.0), (59.9, 89.0), (0.0, -0.1), (10.0, 45.0)], "lon double, lat double")
    assert [r.c for r in rows.select(geo.grid_cell(F.col("lon"), F.col("lat")).alias("c")).collect()] == ["0_0", "2_1", "1_1_0_0", "1_1_3_2", "1_0", "1_1_2_1"]


def test_chains_with_a_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")] + [(f"n{i + 1:02d}", f"n{i:02d}") for i in range(20)], "new string, old string")
    got = {r.id: (r.chain, r.position, r.length) for r in versions.version_chains(edges).collect()}
    assert got["a"] == ("c", 1, 3) and got["c"] == ("c", 3, 3) and got["x"] == got["y"] == (None, None, None) and got["n00"] == ("n20", 1, 21) and got["n20"] == ("n20", 21, 21)
    items = spark.createDataFrame([(f"n{i:02d}",) for i in range(21)], "id string")
    assert {r.latest for r in versions.latest_versions(edges, items).where("id like 'n%'").collect()} == {"n20"}


def test_object_rows_clear_links_on_any_retraction():
    rows = pd.DataFrame([(1, True, "hasName", "a"), (2, False, "hasName", "b"), (3, True, "wasAcquiredBy", "s1"), (4, False, "wasAcquiredBy", "s2"), (5, True, "wasPerformedAt", "p")], columns=["id", "assertion", "pred", "obj"])
    assert log_streams._apply({}, rows) == {"hasName": "a", "wasPerformedAt": "p"}


def test_overlaps_as_all_pairs(spark):
    """Stretches find each overlap once, with open ends and long intervals."""
    rng = np.random.default_rng(1)
    times = lambda n, most: [(i, int(i % 3), int(a), int(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 300, n), rng.integers(0, most, n)))]
    o, d = times(40, 90), times(60, 200)
    frame = lambda rows, *names: spark.createDataFrame(rows, "id int, k int, a int, b int").selectExpr("id", "k", f"CASE WHEN id % 7 <> 6 THEN TIMESTAMP '2020-01-01' + make_dt_interval(a) END {names[0]}", f"CASE WHEN id % 5 <> 4 THEN TIMESTAMP '2020-01-01' + make_dt_interval(b) END {names[1]}")
    got = sorted((r.id, r.dep) for r in intervals.deployments_for(frame(o, "data_start", "data_end"), frame(d, "start", "stop").withColumnRenamed("id", "dep"), ["k"]).collect())
    end = lambda r: r[3] if r[0] % 5 != 4 else 10**9
    begin = lambda r: r[2] if r[0] % 7 != 6 else -(10**9)
    assert got == sorted((x[0], y[0]) for x in o for y in d if x[1] == y[1] and begin(y) < end(x) and end(y) > begin(x))


def test_links_from_a_table(spark):
    """Hashes in hexadecimal, base64 and base64url name the same objects; a list that names an old one twice is refused."""
    hex_ = lambda b: bytes([b] * 32).hex()
    url = lambda b: base64.urlsafe_b64encode(bytes([b] * 32)).decode().rstrip("=")
    plain = lambda b: base64.b64encode(bytes([b] * 32)).decode()
    rows = [(hex_(1), url(251)), (plain(252), hex_(3)), (hex_(4), ""), (hex_(5), None), ("?", hex_(6))]
    links, twice = versions.links_from_table(spark.createDataFrame(rows, "new_hash string, old_hash string"), "new_hash", "old_hash")
    assert sorted(tuple(r) for r in links.collect()) == sorted([(url(1)[:24], url(251)[:24]), (url(252)[:24], url(3)[:24])]) and twice.count() == 0
    again = [*rows, (hex_(7), plain(251))]
    links, twice = versions.links_from_table(spark.createDataFrame(again, "new_hash string, old_hash string"), "new_hash", "old_hash")
    assert links.count() == 0 and [tuple(r) for r in twice.collect()] == [(url(251)[:24], 2)]


def test_next_versions_under_embargo_and_in_plain_collections(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("p", "a"), ("d", "b"), ("e", "b")], "new string, old string")
    items = spark.createDataFrame([("b", 1, "2030-01-01"), ("c", 1, "2020-01-01"), ("d", None, None), ("e", 1, None), ("m", 1, None), ("n", None, None)], "id string, size int, u string").withColumn("embargo_until", F.col("u").cast("timestamp"))
    members = spark.createDataFrame([("p", "m"), ("p", "n")], "coll string, member string")
    assert sorted(tuple(r) for r in versions.next_versions(edges, items, members, "2025-01-01").collect()) == [("a", "c"), ("a", "m"), ("b", "e")]
    assert sorted(tuple(r) for r in versions.next_versions(edges, items).collect()) == [("a", "b"), ("a", "c"), ("b", "e")]


def test_interval_deprecations_by_less_than_two_metres(spark):
    schema = "id string, station int, spec int, height double, size int, data_start string, data_end string, deprecated boolean"
    old = [("o1", 1, 1, 10.0, 1, "2020-02-01", "2020-03-01", False), ("o2", 1, 1, 12.0, None, "2020-02-01", "2020-03-01", False), ("o3", 1, 1, 12.0, 1, "2020-02-01", "2020-03-01", True)]
    new = [("n1", 1, 1, 11.9, 1, "2020-01-01", "2020-03-01", False), ("n2", 1, 1, 12.0, 1, "2020-01-01", "2021-01-01", False), ("n3", 1, 1, 10.0, None, "2020-01-01", "2021-01-01", False), ("n4", 1, 1, 10.0, 1, "2020-02-02", "2021-01-01", False)]
    assert [tuple(r) for r in versions.interval_deprecations(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()] == [("n1", "o1")]


def test_authors_by_weight_and_species(spark):
    objects = spark.createDataFrame([("a", 1, True, ["co2", "Stdev CO2"], "x"), ("b", 1, True, ["ws"], "CH4 growing"), ("c", 1, False, ["ws"], None), ("d", 1, True, None, None)], "id string, station int, weighted boolean, columns array<string>, spec_label string")
    objects = objects.withColumn("data_start", F.lit("2020-01-01").cast("timestamp")).withColumn("data_end", F.lit("2020-02-01").cast("timestamp"))
    m = [(1, "Ann", 5, "CO2, N2O"), (1, "Bo", 9, "ch4"), (1, "Cy", None, None), (1, "Di", 7, None)]
    memberships = spark.createDataFrame(m, "station int, person string, weight int, extra string").withColumn("start", F.lit(None).cast("timestamp")).withColumn("stop", F.lit(None).cast("timestamp"))
    assert {r.id: r.authors for r in intervals.authors_of(objects, memberships).collect()} == {"a": ["Di", "Ann"], "b": ["Bo", "Di"], "c": ["Bo", "Di", "Ann", "Cy"], "d": ["Bo", "Di", "Ann"]}


def test_spec_rules(spark):
    specs = spark.createDataFrame([(1, True, "D", 0), (2, True, None, 0), (3, False, "D", 0), (4, False, None, 0), (5, False, "D", 9)], "spec int, spatial boolean, dataset string, format int")
    defs = spark.createDataFrame([("D", 1, "v", "TA", False, False), ("D", 2, "w", "P_[0-9]", True, False), ("E", 1, "x", "RH", False, False)], "dataset string, nr int, var string, title string, is_pattern boolean, optional boolean")
    rows = [("ok1", 1, True, None, None, ["TA", "P_1"]), ("var", 1, True, None, None, ["TA", "RH", "P_x"]), ("none", 2, True, None, None, ["TA"]), ("ok2", 2, True, None, None, None), ("kind1", 3, True, None, None, None), ("kind2", 1, False, None, 5, None), ("rows", 3, False, None, None, None), ("ok3", 3, False, None, 5, None), ("time", 4, False, None, None, None), ("ok4", 4, False, "2020-01-01", None, None), ("ok5", 5, False, None, None, None), ("gone", 77, False, None, None, None)]
    packages = spark.createDataFrame(rows, "pkg_id string, spec int, is_spatial boolean, s string, n_rows int, variables array<string>").withColumn("data_start", F.col("s").cast("timestamp"))
    found = sorted((r.pkg_id, r.message) for r in validate.spec_fits(packages, specs, defs, (9,)).collect())
    assert found == [("gone", "unknown spec"), ("kind1", "dataset must be spatiotemporal"), ("kind2", "dataset must be a station's time series"), ("none", "spec has no dataset for variables"), ("rows", "number of rows is missing"), ("time", "interval is missing"), ("var", "unknown variable P_x"), ("var", "unknown variable RH")]


def test_person_lines_in_the_order_of_their_forms(spark):
    lines = ["Ann, Lee , a@x.org, Some Institute, 0000-0002-1825-0097", "Bo,Ek,,Inst,0000-0002-1825-0098", "Berg, Cy: Big Org (BO)", "Dahl, Di", "Ek,Eva,e@x.org", "  ", "nobody", " Falk, Fia "]
    rows = tables.parse_person_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {tuple(r) for r in rows} == {
        ("Ann", "Lee", "a@x.org", None, None, "0000-0002-1825-0097"), ("Bo", "Ek", None, None, None, None), ("Cy", "Berg", None, "Big Org", "BO", None), ("Di", "Dahl", None, None, None, None),
        ("Eva", "Ek", "e@x.org", None, None, None), ("Fia", "Falk", None, None, None, None),
    }


def test_archives_to_purge_and_to_take_from(spark):
    m = lambda p, v, n, md5, ts: (p, v, n, md5, ts)
    members = [m("a", "1", "f", "x", 1), m("a", "1", "g", "y", 1), m("a", "2", "f", "x", 1), m("a", "3", "g", "y", 1), m("b", "1", "f", "old", 1), m("b", "1", "g", "y", 1), m("b", "2", "f", "new", 2), m("c", "1", "f", "x", 1), m("c", "2", "f", "x", 1), m("c", "2", "g", "y", 1)]
    versions_ = [("a", "1", 1), ("a", "2", 2), ("a", "3", 3), ("b", "1", 1), ("b", "2", 2), ("c", "1", 1), ("c", "2", 2)]
    found = versions.archive_repairs(spark.createDataFrame(members, "package string, version string, member string, md5 string, ts int"), spark.createDataFrame(versions_, "package string, version string, ts int"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", "2", "purge"), ("a", "3", "purge"), ("b", "1", "take")]
