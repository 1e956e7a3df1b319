"""Consecutive numbers in a global order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.scratch import dealt, discard, materialize, tasks


def number_rows(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """df with ``name`` from 0 in the given order, which must be total for reruns to agree.

    Rows are dealt out by range and written; a range's first number is the count of rows in those before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_rows"))  # one row for each range
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return parts.withColumn("_at", at).join(first, "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def number_and_next(df: DataFrame, key: str, within: str, order: list[str], following: str, rows: int) -> DataFrame:
    """df with ``_number`` from 0 among the rows of its ``key``, in the given order (total, for reruns to agree), and ``_next``: the
    column ``following`` of the next row with the same ``key`` and ``within``, null at the last.

    Rows (``rows`` at most) are dealt out by range of key and order, so that a large key takes several tasks, and written. What
    a range needs from others stands in one small row for each range, key and within: the numbers before it, and what follows it."""
    whole = materialize(df.withColumn("_key", F.struct(key)).withColumn("_within", F.struct(within)), "rows")  # ranges are taken from a sample, which would compute df once more
    parts = materialize(whole.repartitionByRange(tasks(df, rows), key, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    discard(whole)
    pieces = materialize(parts.groupBy("_range", "_key", "_within").agg(F.count("*").alias("_rows"), F.min_by(following, F.struct(*order)).alias("_first")), "pieces")
    whole = pieces.groupBy("_range", "_key").agg(F.sum("_rows").alias("_of_key"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_range", "_key", F.coalesce(F.sum("_of_key").over(earlier), F.lit(0)).alias("_before"))
    later = Window.partitionBy("_key", "_within").orderBy("_range")
    ahead = pieces.select("_range", "_key", "_within", "_rows", F.lead("_first").over(later).alias("_after"))
    joined = dealt(parts, rows, "_range", "_key").join(whole, ["_range", "_key"]).join(ahead, ["_range", "_key", "_within"])
    own, same = Window.partitionBy("_range", "_key").orderBy(*order), Window.partitionBy("_range", "_key", "_within").orderBy(*order)
    numbered = joined.withColumn("_number", F.col("_before") + F.row_number().over(own) - 1)
    found = numbered.withColumn("_next", F.when(F.row_number().over(same) < F.col("_rows"), F.lead(following).over(same)).otherwise(F.col("_after")))
    return found.select(*df.columns, "_number", "_next")
