"""The change log of a database: partitioned JDBC reads, and a data source whose streaming offset is the log id."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: The log's columns as stored; tables.decode_terms makes statements of them.
LOG = "id bigint, tstamp timestamp, assertion boolean, type smallint, subject string, predicate string, object string, litattr string"
COLUMNS = [c.split()[0] for c in LOG.split(", ")]


def read_jdbc_log(spark: SparkSession, options: dict[str, str], from_id: int | None = None, rows: int = 1_000_000) -> DataFrame:
    """The stored log (``options``: url, dbtable and others of the jdbc format) with ids from ``from_id`` on, read in parallel:
    ranges of ``rows`` ids at most, from bounds that the database gives."""
    own = {k: v for k, v in options.items() if k != "dbtable"}
    least = f' WHERE "id" >= {int(from_id)}' if from_id is not None else ""
    low, high = spark.read.format("jdbc").options(**own, query=f'SELECT min("id") AS low_id, max("id") AS high_id FROM {options["dbtable"]}{least}').load().first()
    if low is not None:
        own |= {"partitionColumn": "id", "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(1 + (high - low) // rows)}
    found = spark.read.format("jdbc").options(**own, dbtable=options["dbtable"]).load()
    found = found if from_id is None else found.where(F.col("id") >= from_id)
    return found.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in LOG.split(", ")))


class IdRange(InputPartition):
    """Ids from ``low`` up to, but without, ``high``."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.module, self.database, self.table = options["module"], options["database"], options.get("table", "rdflog")
        self.rows, self.first = int(options.get("rowsPerPartition", 1_000_000)), int(options.get("fromId", 0))
        if not self.table.replace("_", "").replace(".", "").isalnum():
            raise ValueError(f"not a table's name: {self.table}")

    def query(self, sql: str) -> Iterator[tuple[Any, ...]]:
        connection = importlib.import_module(self.module).connect(self.database)
        try:
            cursor = connection.cursor()
            cursor.execute(sql)
            while found := cursor.fetchmany(10_000):
                yield from found
        finally:
            connection.close()

    def end(self) -> int:
        """One more than the greatest id."""
        return next(self.query(f"SELECT coalesce(max(id), -1) + 1 FROM {self.table}"))[0]

    def ranges(self, low: int, high: int) -> list[IdRange]:
        return [IdRange(k, min(k + self.rows, high)) for k in range(low, high, self.rows)]

    def read(self, partition: IdRange) -> Iterator[tuple[Any, ...]]:
        import datetime

        for row in self.query(f"SELECT {', '.join(COLUMNS)} FROM {self.table} WHERE id >= {partition.low} AND id < {partition.high} ORDER BY id"):
            at = row[1] if isinstance(row[1], (datetime.datetime, type(None))) else datetime.datetime.fromisoformat(row[1])
            yield row[0], at, None if row[2] is None else bool(row[2]), *row[3:]


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[IdRange]:
        return self.ranges(self.first, self.end()) or [IdRange(0, 0)]


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are the next id to read, so that a restart goes on behind the last record of the last batch."""

    def initialOffset(self) -> dict:
        return {"id": self.first}

    def latestOffset(self) -> dict:
        return {"id": max(self.end(), self.first)}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        return self.ranges(start["id"], end["id"])

    def commit(self, end: dict) -> None:
        pass


class UpdateLogSource(DataSource):
    """Format ``update_log``, batch and stream. Options: module (a DB-API module that the executors have), database (what its
    connect() takes), table, fromId, rowsPerPartition. Ids must become visible in their order: a record that is committed
    after a greater id was read is not seen."""

    @classmethod
    def name(cls) -> str:
        return "update_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
