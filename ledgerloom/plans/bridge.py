"""Catalog tables derived from the given tables by integer arithmetic, in Spark and as SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One data object for each order."""
    n = table(spark, sf_dir, "supplier").count()
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        key.cast("string").alias("id"), (key % 25).cast("int").alias("spec"), F.when(key % 7 != 0, (key % n).cast("int")).alias("station"),
        F.when(key % 3 == 0, (cust % 11).cast("int")).alias("site"), F.col("c_nationkey").cast("int").alias("submitter"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice")).alias("size"), F.concat(F.lit("F"), (cust % 500).cast("string"), F.lit(".csv")).alias("file_name"),
        ((key % 8) * F.lit(12.5)).alias("height"), F.col("o_orderdate").alias("data_start"),
        F.timestamp_add("DAY", (key % 40).cast("int"), "o_orderdate").alias("data_end"), F.timestamp_add("DAY", (key % 40 + 1).cast("int"), "o_orderdate").alias("submitted"), cust.alias("cust"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(new, old): within a customer and spec, the next object where its key is divisible by 4."""
    w = Window.partitionBy("cust", "spec").orderBy("data_start", "key")
    rows = objects(spark, sf_dir).select("cust", "spec", "data_start", F.col("id").cast("long").alias("key"))  # ids are shuffled as numbers
    return rows.withColumn("old", F.lag("key").over(w)).where("old is not null and key % 4 = 0").select(F.col("key").cast("string").alias("new"), F.col("old").cast("string").alias("old"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec for each brand of part, numbered by name; its project by the number of its parts and of their types."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.countDistinct("p_type").alias("types"))
    n = brands.withColumn("spec", F.row_number().over(Window.orderBy("p_brand")) - 1)  # some ten brands
    return n.select("spec", F.concat(F.lit("Spec "), "p_brand").alias("spec_label"), ((F.col("parts") + F.col("types")) % 6).cast("int").alias("project"), (F.col("spec") % 4).alias("level"), (F.col("spec") % 3).alias("format"), (F.col("spec") % 5).alias("theme"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station for each supplier."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(key.cast("int").alias("station"), F.trim("s_name").alias("name"), F.trim("n_name").alias("country"), ((key * 37) % 160 - 80).cast("double").alias("lat"), ((key * 91) % 360 - 180).cast("double").alias("lon"))


def keywords(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keywords of objects (the words of a part's name), specs and projects."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("keyword"))
    n = table(spark, sf_dir, "part").count()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % n).alias("k"))
    own = o.join(p, o.k == p.p_partkey).select("id", "keyword")
    s = specs(spark, sf_dir)
    return own, s.select("spec", F.concat(F.lit("brand"), F.col("spec") % 5).alias("keyword")), s.select("project", F.concat(F.lit("type"), "project").alias("keyword")).distinct()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coll, member, plain): a collection for each customer number modulo 50; every tenth is plain."""
    return objects(spark, sf_dir).select((F.col("cust") % 50).cast("int").alias("coll"), F.col("id").alias("member"), (F.col("cust") % 50 % 10 == 0).alias("plain"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log with one record for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("tstamp"), (F.col("event_id") % 4 != 0).alias("assertion"), F.lit(1).alias("obj_kind"), F.col("user_id").cast("string").alias("subj"),
        F.col("event_type").alias("pred"), (F.col("event_id") % 7).cast("string").alias("obj"), F.lit("xsd:integer").alias("lit_attr"), F.lit("log").alias("graph"),
    )


def deployment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors at a station measuring a variable, from line items; equal rows may repeat."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").cast("int").alias("station"), (F.col("l_partkey") % 10).cast("int").alias("variable"), F.col("l_partkey").alias("sensor"), F.col("l_shipdate").alias("start"), F.timestamp_add("DAY", F.col("l_quantity").cast("int"), "l_shipdate").alias("stop"))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ones of deployment_rows()."""
    return deployment_rows(spark, sf_dir).distinct()


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One membership of a person at a station for each customer; some have no weight or an open end."""
    n = table(spark, sf_dir, "supplier").count()
    key, first = F.col("c_custkey"), F.lit("1992-01-01").cast("timestamp")
    day = lambda c: F.timestamp_add("DAY", c.cast("int"), first)
    return table(spark, sf_dir, "customer").select(
        (key % n).cast("int").alias("station"), F.concat(F.lit("P"), key % 40).alias("person"), F.when(key % 5 != 0, (key % 4).cast("int")).alias("weight"), F.element_at(F.array(F.lit("PI"), F.lit("Researcher"), F.lit("Engineer")), (key % 3 + 1).cast("int")).alias("role"),
        F.when(key % 7 != 0, day(key % 2000)).alias("start"), F.when(key % 3 != 0, day(key % 2000 + key % 1500 + 100)).alias("stop"),
    )


#: The same tables for DuckDB.
SQL = """
objects AS (SELECT CAST(o_orderkey AS VARCHAR) id, CAST(o_orderkey % 25 AS INT) spec, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % (SELECT count(*) FROM supplier) AS INT) END station,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 11 AS INT) END site, CAST(c_nationkey AS INT) submitter, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END size,
  'F' || (o_custkey % 500) || '.csv' file_name, (o_orderkey % 8) * 12.5::DOUBLE height, o_orderdate data_start, o_orderdate + to_days(CAST(o_orderkey % 40 AS INT)) data_end,
  o_orderdate + to_days(CAST(o_orderkey % 40 + 1 AS INT)) submitted, o_custkey cust FROM orders JOIN customer ON o_custkey = c_custkey),
edges AS (SELECT id new, old FROM (SELECT id, lag(id) OVER (PARTITION BY cust, spec ORDER BY data_start, CAST(id AS BIGINT)) old FROM objects) WHERE old IS NOT NULL AND CAST(id AS BIGINT) % 4 = 0),
specs AS (SELECT CAST(i AS INT) spec, 'Spec ' || b spec_label, CAST((parts + types) % 6 AS INT) project, CAST(i % 4 AS INT) level, CAST(i % 3 AS INT) format, CAST(i % 5 AS INT) theme
  FROM (SELECT p_brand b, count(*) parts, count(DISTINCT p_type) types, row_number() OVER (ORDER BY p_brand) - 1 i FROM part GROUP BY p_brand)),
stations AS (SELECT CAST(s_suppkey AS INT) station, trim(s_name) name, trim(n_name) country, CAST(s_suppkey * 37 % 160 - 80 AS DOUBLE) lat, CAST(s_suppkey * 91 % 360 - 180 AS DOUBLE) lon FROM supplier JOIN nation ON s_nationkey = n_nationkey),
own_keywords AS (SELECT id, keyword FROM (SELECT id, CAST(id AS BIGINT) % (SELECT count(*) FROM part) k FROM objects) JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) keyword FROM part) ON k = p_partkey),
keywords AS (SELECT id, keyword FROM own_keywords UNION SELECT id, 'brand' || (spec % 5) FROM objects UNION SELECT id, 'type' || project FROM objects JOIN specs USING (spec)),
members AS (SELECT CAST(cust % 50 AS INT) coll, id member, cust % 50 % 10 = 0 plain FROM objects),
log AS (SELECT event_id id, ts tstamp, event_id % 4 <> 0 assertion, CAST(user_id AS VARCHAR) subj, event_type pred, CAST(event_id % 7 AS VARCHAR) obj FROM events),
deployments AS (SELECT DISTINCT CAST(l_suppkey AS INT) station, CAST(l_partkey % 10 AS INT) variable, l_partkey sensor, l_shipdate start, l_shipdate + to_days(CAST(l_quantity AS INT)) stop FROM lineitem),
memberships AS (SELECT CAST(c_custkey % (SELECT count(*) FROM supplier) AS INT) station, 'P' || (c_custkey % 40) person, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 4 AS INT) END weight, ['PI', 'Researcher', 'Engineer'][c_custkey % 3 + 1] AS role,
  CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '1992-01-01' + to_days(CAST(c_custkey % 2000 AS INT)) END AS start, CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '1992-01-01' + to_days(CAST(c_custkey % 2000 + c_custkey % 1500 + 100 AS INT)) END stop FROM customer),
deprecated AS (SELECT DISTINCT old id FROM edges JOIN objects ON new = id WHERE size IS NOT NULL)
"""
