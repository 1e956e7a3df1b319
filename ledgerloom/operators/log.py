"""The change log over time: replay, histories and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STATEMENT = ["graph", "subj", "pred", "obj", "obj_kind", "lit_attr"]


def replay(log: DataFrame) -> DataFrame:
    """The statements that hold: of each, the last record is an assertion. Partial aggregation, no sort."""
    keys = [c for c in STATEMENT if c in log.columns]
    last = log.groupBy(*keys).agg(F.max_by("assertion", "id").alias("assertion"))
    return last.where("assertion").select(*keys)


def as_of(log: DataFrame, time) -> DataFrame:
    """The statements that held at a time."""
    return replay(log.where(F.col("tstamp") <= F.lit(time).cast("timestamp")))


def status_history(log: DataFrame, labels: DataFrame, pred: str, renamed: dict[str, str]) -> DataFrame:
    """All assertions of a status in time order, legacy codes renamed, with the subject's label."""
    status = F.col("obj")
    for old, new in renamed.items():
        status = F.when(F.col("obj") == old, new).otherwise(status)
    rows = log.where((F.col("pred") == pred) & F.col("assertion")).select("subj", "tstamp", status.alias("status"), "id")
    return rows.join(labels, "subj").orderBy("subj", "tstamp", "id")


def milestones(log: DataFrame, steps: dict[str, tuple[str, str]], overrides: DataFrame | None = None) -> DataFrame:
    """Per subject the first record's time and, for each step (name: value, first or last), its first or last assertion; overrides win."""
    times = [(F.min if which == "first" else F.max)(F.when(F.col("assertion") & (F.col("obj") == value), F.col("tstamp"))).alias(name) for name, (value, which) in steps.items()]
    out = log.groupBy("subj").agg(F.min("tstamp").alias("first_seen"), *times)
    if overrides is None:
        return out
    both = out.alias("a").join(overrides.alias("b"), "subj", "left")
    return both.select("subj", *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in overrides.columns else F.col(f"a.{c}") for c in out.columns if c != "subj"))


def invalid_transitions(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """Consecutive statuses of a subject (before, after) that the table ``allowed`` doesn't have."""
    w = Window.partitionBy("subj").orderBy("tstamp", "id")
    steps = log.where("assertion").select("subj", "tstamp", "id", F.lag("obj").over(w).alias("before"), F.col("obj").alias("after"))
    return steps.where("before is not null and before <> after").join(allowed, ["before", "after"], "left_anti")


def rolling_cost(runs: DataFrame, minute_quota: float, hour_quota: float) -> DataFrame:
    """Per run (client, ts, cost) the client's cost in the last 60 and 3600 seconds, and whether a quota is exceeded."""
    rows = runs.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("client").orderBy("sec")
    rows = rows.withColumn("minute_cost", F.sum("cost").over(w.rangeBetween(-59, 0))).withColumn("hour_cost", F.sum("cost").over(w.rangeBetween(-3599, 0)))
    return rows.withColumn("over_quota", (F.col("minute_cost") > minute_quota) | (F.col("hour_cost") > hour_quota)).drop("sec")


def usage_counts(events: DataFrame, key: str = "id", kind: str = "event_type") -> DataFrame:
    """Events of each kind for each object."""
    return events.groupBy(key, kind).agg(F.count("*").alias("n"))


def patch_log(log: DataFrame, replacements: dict[str, tuple[str, str]] | None = None, drop: tuple | None = None, repair_before=None) -> DataFrame:
    """A corrected copy: text replaced in columns, a time slice left out, and records before a time given the object of the
    first later record of their subject and predicate."""
    out = log
    for column, (old, new) in (replacements or {}).items():
        out = out.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))
    if drop:
        out = out.where(~((F.col("tstamp") >= F.lit(drop[0]).cast("timestamp")) & (F.col("tstamp") < F.lit(drop[1]).cast("timestamp"))))
    if repair_before is not None:
        limit = F.lit(repair_before).cast("timestamp")
        good = out.where(F.col("tstamp") >= limit).groupBy("subj", "pred").agg(F.min_by("obj", F.struct("tstamp", "id")).alias("good"))
        out = out.join(good, ["subj", "pred"], "left").withColumn("obj", F.when(F.col("tstamp") < limit, F.coalesce("good", "obj")).otherwise(F.col("obj"))).drop("good")
    return out
