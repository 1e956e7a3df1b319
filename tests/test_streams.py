"""Streams against their batch twins, with late records and restarts."""

import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import log as logs
from ledgerloom.sources import log_source, tables
from ledgerloom.streaming import log_streams

RECORD = "id long, subj string, pred string, obj string, obj_kind int, lit_attr string, assertion boolean"


def record(i, rng):
    return i, f"s{rng.randint(0, 30)}", rng.choice("pq"), rng.choice("xyz"), 1, rng.choice([None, "t"]), rng.random() < 0.6


def test_bulk_then_late_and_new_files_equal_the_whole_log(spark, tmp_path):
    rng = random.Random(4)
    records = [record(i, rng) for i in range(400)]
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "c")
    write = lambda rows: spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(path)
    late = [r for r in records[:250] if r[0] % 5 == 0]
    write([r for r in records[:250] if r[0] % 5])
    held, batches = {}, []

    def publish(batch, number):
        rows = batch.collect()
        batches.append(len(rows))
        for r in rows:
            held[r.subj, r.pred, r.obj, r.lit_attr] = r.holds

    bulk, query = log_streams.bulk_then_incremental(spark, path, RECORD, checkpoint, publish)
    query.awaitTermination()
    held |= {(r.subj, r.pred, r.obj, r.lit_attr): r.assertion for r in bulk.collect()}
    assert not sum(batches)  # the bulk's own files aren't read into the stream
    write(late)
    log_streams.bulk_then_incremental(spark, path, RECORD, checkpoint, publish)[1].awaitTermination()
    whole = lambda: {(r.subj, r.pred, r.obj, r.lit_attr) for r in logs.replay(spark.read.schema(RECORD).parquet(path)).collect()}
    assert {k for k, v in held.items() if v} == whole()
    write(records[300:])
    write(records[250:300])
    log_streams.bulk_then_incremental(spark, path, RECORD, checkpoint, publish)[1].awaitTermination()
    assert {k for k, v in held.items() if v} == whole()
    assert sum(batches) > 50


def test_object_rows_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    path = str(tmp_path / "log")
    value, rows = {}, []
    for i in range(300):  # one value of a property at a time: what stands is retracted before the next
        subj, pred = f"s{rng.randint(0, 9)}", rng.choice(["name", "size", "wasSubmittedBy"])
        if (subj, pred) in value:
            rows.append((i, subj, pred, value.pop((subj, pred)), 1, None, False))
        else:
            value[subj, pred] = rng.choice("uvw")
            rows.append((i, subj, pred, value[subj, pred], 1, None, True))
    for k in range(0, 300, 60):
        spark.createDataFrame(rows[k : k + 60], RECORD).coalesce(1).write.mode("append").parquet(path)
    state = {}

    def publish(batch, number):
        import json

        state.update({r.subj: json.loads(r.properties) for r in batch.collect()})

    stream = spark.readStream.schema(RECORD).parquet(path)
    log_streams.stream_object_rows(stream, str(tmp_path / "c"), publish).awaitTermination()
    batch = {(r.subj, r.pred, r.obj) for r in log_streams.object_rows(spark.read.schema(RECORD).parquet(path)).collect()}
    assert {(s, p, o) for s, own in state.items() for p, o in own.items()} == batch == {(s, p, o) for (s, p), o in value.items()}


def test_snapshot_stream_keeps_each_source_s_last(spark, tmp_path):
    rows = [("a", 1, "a1"), ("b", 5, "b5"), ("a", 3, "a3"), ("a", 2, "a2")]
    spark.createDataFrame(rows, "source string, ts long, snapshot string").coalesce(1).write.parquet(str(tmp_path / "s"))
    got = []
    log_streams.stream_latest_snapshot(spark.readStream.schema("source string, ts long, snapshot string").parquet(str(tmp_path / "s")), str(tmp_path / "c"), lambda b, n: got.extend((r.source, r.snapshot) for r in b.collect()), once=True).awaitTermination()
    assert sorted(got) == [("a", "a3"), ("b", "b5")]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def expected_costs(runs, minute_quota, hour_quota):
    out = set()
    for client, minute in {(c, s // 60) for c, s, _ in runs}:
        own = sum(x for c, s, x in runs if c == client and s // 60 == minute)
        hour = sum(x for c, s, x in runs if c == client and minute - 59 <= s // 60 <= minute)
        out.add((client, at(60 * minute + 60), own, hour, own > minute_quota or hour > hour_quota))
    return out


def test_costs_of_a_stream_and_of_a_table(spark, tmp_path):
    rng = random.Random(6)
    runs = [(rng.choice("abc"), rng.randint(0, 9000), float(rng.randint(1, 9))) for _ in range(400)]
    schema = "client string, ts timestamp, cost double"
    frame = lambda rows: spark.createDataFrame([(c, at(s), x) for c, s, x in rows], schema).coalesce(1)
    table = {tuple(r) for r in log_streams.stream_cost(frame(runs), 15, 160).collect()}
    assert table == expected_costs(runs, 15, 160) and {r[4] for r in table} == {True, False}

    # In time order, but for one run within the allowed lateness (it counts) and one far behind it (it doesn't).
    runs.sort(key=lambda r: r[1])
    early, rest = [r for r in runs if r[1] < 5000], [r for r in runs if r[1] >= 5000]
    newest = early[-1][1]
    counted, dropped = ("a", newest - 100, 1000.0), ("b", newest - 2000, 7777.0)
    path = str(tmp_path / "runs")
    # Spark drops late rows by the watermark that held a batch before.
    for rows in (early[:-1], early[-1:], [counted, dropped], rest, [("z", 100_000, 1.0)], [("z", 100_001, 1.0)]):
        frame(rows).write.mode("append").parquet(path)
    stream = log_streams.stream_cost(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), 15, 160, late="3 minutes")
    got = set()
    stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: got.update(tuple(r) for r in b.collect())).trigger(availableNow=True).start().awaitTermination()
    assert got == expected_costs([*runs, counted], 15, 160)


def test_costs_of_a_table_over_midnight_are_not_copied_to_sixty_hours(spark):
    """Hours that begin on the day before, also before 1970; null costs don't count, nor make a row. A minute is dealt to two days at most."""
    rng = random.Random(7)
    runs = [(rng.choice("ab"), 86_400 * rng.choice((-1, 0, 1, 2)) + rng.randint(-5000, 5000), float(rng.randint(1, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(c, at(s), x) for c, s, x in runs] + [("a", at(10 * 86_400), None), ("a", None, 1.0)], "client string, ts timestamp, cost double")
    found = log_streams.stream_cost(rows, 15, 160)
    assert {tuple(r) for r in found.collect()} == expected_costs(runs, 15, 160)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "log.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE rdflog (id INTEGER PRIMARY KEY, tstamp TEXT, assertion INTEGER, type INTEGER, subject TEXT, predicate TEXT, object TEXT, litattr TEXT)")

    def add(ids):
        con.executemany("INSERT INTO rdflog VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(i, at(i).isoformat(), i % 3 > 0, i % 3, f"s{i % 5}", "p", f"o{i}", None) for i in ids])
        con.commit()

    return path, add


def test_log_source_restarts_behind_its_last_id(spark, tmp_path, database):
    path, add = database
    add(range(1, 36))
    spark.dataSource.register(log_source.UpdateLogSource)
    options = {"module": "sqlite3", "database": path, "rowsPerPartition": "10"}
    batch = spark.read.format("update_log").options(**options, fromId="5").load()
    assert sorted(r.id for r in batch.collect()) == list(range(5, 36)) and batch.rdd.getNumPartitions() == 4
    first = tables.decode_terms(batch).where("id = 7").first()
    assert (first.tstamp, first.assertion, first.obj_kind, first.subj, first.lit_attr) == (at(7), True, 1, "s2", tables.XSD_STRING)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        stream = spark.readStream.format("update_log").options(**options).load()
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run() == list(range(1, 36))
    assert run() == list(range(1, 36))
    add(range(36, 60))
    assert run() == list(range(1, 60))


def test_jdbc_log_in_ranges_of_ids(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/log;create=true"
    rows = spark.range(1, 101).select("id", F.timestamp_seconds("id").alias("tstamp"), (F.col("id") % 2 == 0).alias("assertion"), F.lit(0).cast("short").alias("type"), *(F.concat(F.lit(c), "id").alias(c) for c in ("subject", "predicate", "object")), F.lit(None).cast("string").alias("litattr"))
    options = {"url": url, "dbtable": "rdflog", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows.coalesce(1).write.format("jdbc").options(**options).save()
    found = log_source.read_jdbc_log(spark, options, from_id=11, rows=20)
    assert found.rdd.getNumPartitions() == 5 and sorted(r.id for r in found.collect()) == list(range(11, 101))
    assert tables.read_update_log(spark, jdbc=options).count() == 100
    assert log_source.read_jdbc_log(spark, options, from_id=1000).count() == 0
