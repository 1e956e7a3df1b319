"""Tables written to the folder that all executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset: one in the warehouse, or, where driver and tasks are
    one process (a local master), a temporary one for the session."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("ledgerloom.scratch.dir", "")
    if not found:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            found = tempfile.mkdtemp(prefix="ledgerloom-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/ledgerloom-scratch"
        spark.conf.set("ledgerloom.scratch.dir", found)
    return found


def materialize(df: DataFrame, name: str = "t", options: dict | None = None) -> DataFrame:
    """df written once to the shared folder, with the writer's ``options``, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of dealt() sorts or gathers, about.
TASK_ROWS = 250_000


def tasks(df: DataFrame, rows: int) -> int:
    """As many tasks as so many rows ask for; the session's number of shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *keys: Column | str) -> DataFrame:
    """df dealt out by keys, in tasks whose size doesn't grow with its number of rows (an upper bound will do)."""
    return df.repartition(tasks(df, rows), *keys)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
