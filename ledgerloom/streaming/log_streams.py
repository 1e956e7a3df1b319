"""The change log as a stream: current statements, object rows, snapshots and usage costs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.log import STATEMENT

#: Arbitrary state with an initial one needs this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_current_statements(log: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Keeps, for each statement, the last record by id; every batch gives ``publish`` the statements whose state it may change (with ``holds``)."""
    keys = [c for c in STATEMENT if c in log.columns]
    state = log.groupBy(*keys).agg(F.max("id").alias("id"), F.max_by("assertion", "id").alias("holds"))
    return state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()


#: Properties that link an object to another resource; a retraction of any value clears these.
LINKS = frozenset(["wasSubmittedBy", "wasAcquiredBy", "wasPerformedAt"])


def _apply(state: dict, rows: pd.DataFrame) -> dict:
    """Assertions set a property; a retraction clears a link always, another property only if it names the value that stands."""
    for r in rows.sort_values("id").itertuples():
        if r.assertion:
            state[r.pred] = r.obj
        elif r.pred in state and (r.pred in LINKS or state[r.pred] == r.obj):
            state.pop(r.pred)
    return state


def stream_object_rows(log: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Incremental object rows: (subj, properties as a JSON map), state by object."""

    def update(key: tuple, frames, state: GroupState):
        import json

        own = json.loads(state.get[0]) if state.exists else {}
        for pdf in frames:
            own = _apply(own, pdf)
        state.update((json.dumps(own, sort_keys=True),))
        yield pd.DataFrame({"subj": [key[0]], "properties": [json.dumps(own, sort_keys=True)]})

    rows = log.select("subj", "id", "assertion", "pred", "obj").groupBy("subj").applyInPandasWithState(update, "subj string, properties string", "own string", "update", GroupStateTimeout.NoTimeout)
    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()


def object_rows(log: DataFrame) -> DataFrame:
    """The batch twin, for logs with one value of a property at a time: (subj, pred, obj) that stand."""
    last = log.groupBy("subj", "pred").agg(F.max_by(F.struct("assertion", "obj"), "id").alias("l"))
    return last.where("l.assertion").select("subj", "pred", F.col("l.obj").alias("obj"))


class LastRecord(StatefulProcessor):
    """Per statement the last record by id; the state starts from a bulk load's. Records that come late, with an id at or
    below the bulk's last, count by their own id."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "id bigint, assertion boolean")

    def handleInitialState(self, key: tuple, state: pd.DataFrame, timers: object) -> None:
        self.last.update((int(state.id.iloc[0]), bool(state.assertion.iloc[0])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        was = last
        for pdf in rows:
            r = pdf.loc[pdf.id.idxmax()]
            if last is None or r.id > last[0]:
                last = int(r.id), bool(r.assertion)
        self.last.update(last)
        if was is None or was != last:
            yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "id": [last[0]], "holds": [last[1]]})

    def close(self) -> None:
        pass


def bulk_then_incremental(spark: SparkSession, path: str, schema: str, checkpoint: str, publish: Callable[[DataFrame, int], None]) -> tuple[DataFrame, StreamingQuery]:
    """(the bulk load's statements, the stream after it) of a log kept as files in a folder.

    The bulk load takes the files that are there when it's first called: its last record of each statement (with ``id`` and
    ``assertion``) and the names of its files are written beside the checkpoint, and reused when the stream is started again.
    The stream's state starts from them, and takes the records of all other files, whatever their ids; ``publish`` gets the
    statements of a batch whose last record changed, with ``holds``."""
    folder = checkpoint.rstrip("/") + "-bulk"
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS"))
    if not there("state"):
        rows = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"))
        keys = [c for c in STATEMENT if c in rows.columns]
        rows.select("_file").distinct().write.mode("overwrite").parquet(f"{folder}/files")
        last = rows.groupBy(*keys).agg(F.max("id").alias("id"), F.max_by("assertion", "id").alias("assertion"))
        last.write.mode("overwrite").parquet(f"{folder}/state")
    bulk, files = spark.read.parquet(f"{folder}/state"), spark.read.schema("_file string").parquet(f"{folder}/files")
    keys = [c for c in STATEMENT if c in bulk.columns]
    rows = spark.readStream.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file")).join(files, "_file", "left_anti").drop("_file")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = {f.name: f.dataType.simpleString() for f in bulk.schema.fields}
    changed = rows.groupBy(*keys).transformWithStateInPandas(LastRecord(keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", id long, holds boolean", "update", "none", initialState=bulk.groupBy(*keys))
    return bulk, changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()


def stream_latest_snapshot(snapshots: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None], every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Of all snapshots (source, ts, snapshot) between two triggers only each source's last."""
    latest = lambda batch, n: publish(batch.groupBy("source").agg(F.max_by("snapshot", "ts").alias("snapshot"), F.max("ts").alias("ts")), n)
    writer = snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(latest)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stream_cost(runs: DataFrame, minute_quota: float, hour_quota: float, late: str = "1 minute") -> DataFrame:
    """(client, until, minute_cost, hour_cost, over_quota) for each client and minute with runs (client, ts, cost): the cost of
    that minute and of the hour that ends with it. Runs up to ``late`` behind the newest one count.

    Costs are added up by minute first. On a stream (append mode) a minute is then copied to each of the sixty hours that it is
    in, and counts apart for the one that it ends. On a table (all runs count) it isn't: minutes are dealt to days, with a
    copy of a day's last ones for the next day, and a window looks an hour back."""
    minutes = runs.withWatermark("ts", late).groupBy("client", F.window("ts", "60 seconds").alias("minute")).agg(F.sum("cost").alias("cost"))
    over = ((F.col("minute_cost") > minute_quota) | (F.col("hour_cost") > hour_quota)).alias("over_quota")
    if not runs.isStreaming:
        k = F.floor(F.unix_seconds(F.col("minute.end").cast("timestamp")) / 60)
        own, next_ = F.floor(F.col("_k") / 1440), F.floor((F.col("_k") + 59) / 1440)
        dealt = minutes.where("cost is not null").select("client", F.col("minute.end").alias("until"), F.col("cost").alias("minute_cost"), k.alias("_k")).withColumn("_day", F.explode(F.array_distinct(F.array(own, next_))))
        hour = Window.partitionBy("client", "_day").orderBy("_k").rangeBetween(-59, 0)
        return dealt.withColumn("hour_cost", F.sum("minute_cost").over(hour)).where(F.col("_day") == own).select("client", "until", "minute_cost", "hour_cost", over)
    sums = minutes.select("client", F.window_time("minute").alias("at"), "cost")
    hours = sums.select("client", "at", "cost", F.window("at", "3600 seconds", "60 seconds").alias("hour"))
    own = F.when(F.col("at") >= F.col("hour.end") - F.expr("INTERVAL 60 SECONDS"), F.col("cost"))
    costs = hours.groupBy("client", "hour").agg(F.sum(own).alias("minute_cost"), F.sum("cost").alias("hour_cost")).where("minute_cost is not null")
    return costs.select("client", F.col("hour.end").alias("until"), "minute_cost", "hour_cost", over)
