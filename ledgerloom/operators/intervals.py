"""Intervals and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.ranks import number_and_next
from ledgerloom.scratch import dealt


def stitch_deployments(d: DataFrame, family: Column | None = None, rows: int | None = None) -> DataFrame:
    """Deployments (station, variable, sensor, start, lat, lon) in order of start: runs of one sensor fuse (average place),
    a run stops where the next one of the place starts; then, of a sensor's variable family, where its next run starts.
    ``nr`` numbers a sensor's runs from 0.

    Tasks keep their size: places are dealt to as many as ``rows`` (an upper bound of d's; else they are counted) ask for, and a
    sensor's runs, which may be very many, are numbered by ranges."""
    rows = d.count() if rows is None else rows
    w = Window.partitionBy("station", "variable").orderBy("start", "sensor")
    runs = dealt(d, rows, "station", "variable").withColumn("new", F.coalesce((F.col("sensor") != F.lag("sensor").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    fused = runs.groupBy("station", "variable", "run", "sensor").agg(F.min("start").alias("start"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    stops = fused.withColumn("stop", F.lead("start").over(Window.partitionBy("station", "variable").orderBy("run")))
    stops = stops.withColumn("family", F.col("variable") if family is None else family)
    found = number_and_next(stops, "sensor", "family", ["start", "station", "variable"], "start", rows)
    return found.withColumn("stop", F.least("stop", "_next")).withColumn("nr", F.col("_number").cast("int")).drop("run", "family", "_number", "_next")


def variable_family(name: Column, families: list[str]) -> Column:
    """The part before three trailing numbers of one or two digits, if it is one of ``families``; else null."""
    stem = F.regexp_extract(name, "^(.+)_[0-9]{1,2}_[0-9]{1,2}_[0-9]{1,2}$", 1)
    return F.when(stem.isin(families), stem)


def deployments_for(objects: DataFrame, deployments: DataFrame, keys: list[str], days: int = 32) -> DataFrame:
    """Deployments that overlap an object's acquisition (strictly; open ends pass), with equal keys.

    Both sides are cut into stretches of ``days``; a pair meets in the stretch in which its overlap begins."""
    span = objects.agg(F.min(F.least("data_start", "data_end")).alias("low"), F.max(F.greatest("data_start", "data_end")).alias("high")).first()
    low, high = (F.lit(x).cast("timestamp") for x in span)
    part = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / (86_400 * days))
    clip = lambda t, otherwise: F.greatest(low, F.least(high, F.coalesce(t.cast("timestamp"), otherwise)))

    def cut(df: DataFrame, start: str, stop: str) -> DataFrame:
        a, b = part(clip(F.col(start), low)), part(clip(F.col(stop), high))
        return df.withColumn("_part", F.explode(F.sequence(F.least(a, b), F.greatest(a, b))))

    o, d = cut(objects, "data_start", "data_end").alias("o"), cut(deployments, "start", "stop").alias("d")
    on = F.col("o._part") == F.col("d._part")
    for k in keys:
        on = on & (F.col(f"o.{k}") == F.col(f"d.{k}"))
    overlap = (F.coalesce(F.col("d.start") < F.col("o.data_end"), F.lit(True))) & (F.coalesce(F.col("d.stop") > F.col("o.data_start"), F.lit(True)))
    begins = F.greatest(part(clip(F.col("o.data_start"), low)), part(clip(F.col("d.start"), low)))
    return o.join(d, on & overlap & (begins == F.col("o._part"))).select("o.id", *(f"d.{c}" for c in deployments.columns))


def authors_of(objects: DataFrame, memberships: DataFrame) -> DataFrame:
    """(id, authors): distinct persons whose membership at the station overlaps the acquisition, by weight (descending; without
    one last) and name. memberships: station, person, weight, start, stop, and extra, if there.

    Where objects have ``weighted`` (their theme wants weights), memberships without a weight don't count for these, and, if
    the membership names species (``extra``: a comma list) and the object has ``columns`` (an array of labels), one of the
    species must occur in a column's label or in ``spec_label``, in any case."""
    if "weighted" in objects.columns:
        told = [c for c in ("weighted", "columns", "spec_label") if c in objects.columns]
        pairs = deployments_for(objects, memberships, ["station"]).join(objects.select("id", *told), "id")
        species = F.filter(F.transform(F.split(F.lower("extra"), ","), lambda x: F.trim(x)), lambda x: x.isNotNull())
        within = lambda x: F.exists("columns", lambda c: F.contains(F.lower(c), x)) | F.contains(F.lower(F.coalesce("spec_label", F.lit(""))), x)
        named = F.col("extra").isNull() | F.col("columns").isNull() | F.exists(species, within)
        pairs = pairs.where(~F.coalesce("weighted", F.lit(False)) | F.col("weight").isNotNull() & named)
    else:
        pairs = deployments_for(objects, memberships, ["station"])
    rows = pairs.groupBy("id", "person").agg(F.max("weight").alias("weight"))
    order = F.array_sort(F.collect_list(F.struct((-F.coalesce("weight", F.lit(0))).alias("w"), "person")))
    return rows.groupBy("id").agg(F.transform(order, lambda x: x.person).alias("authors"))


def fundings_of(objects: DataFrame, fundings: DataFrame) -> DataFrame:
    """Fundings (station, funder, start, stop as dates) that overlap the acquisition at noon CET; a missing acquisition passes."""
    noon = lambda c: F.to_utc_timestamp(F.timestamp_add("HOUR", F.lit(12), F.col(c).cast("timestamp")), "CET")
    rows = deployments_for(objects, fundings.withColumn("start", noon("start")).withColumn("stop", noon("stop")), ["station"])
    order = Window.partitionBy("id").orderBy(F.col("stop").asc_nulls_last(), "start", "funder")
    return rows.withColumn("nr", F.row_number().over(order))


def instrument_history(series: DataFrame, most: int = 5, rows: int | None = None) -> DataFrame:
    """Runs of one instrument along a series' times: (series, instrument, start, end), the first start and last end open; none for series with more than ``most`` runs.

    Series are dealt to as many tasks as ``rows`` (an upper bound of theirs; else they are counted) ask for."""
    w = Window.partitionBy("series").orderBy("time")
    runs = dealt(series, series.count() if rows is None else rows, "series").withColumn("new", F.coalesce((F.col("instrument") != F.lag("instrument").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy("series", "run", "instrument").agg(F.min("time").alias("start"), F.max("time").alias("end"))
    every = Window.partitionBy("series")
    spans = spans.withColumn("last", F.max("run").over(every)).where(F.col("last") <= most)
    return spans.select("series", "instrument", F.when(F.col("run") > 1, F.col("start")).alias("start"), F.when(F.col("run") < F.col("last"), F.col("end")).alias("end"))


def coverage_text(start: Column, stop: Column, zone: str = "UTC") -> Column:
    """A day (the middle one, of what is shorter than 24 times 3601 seconds), years (if both ends fall on a first of January), or
    a range of days; where both ends are midnights the last day is the one before."""
    start, stop = start.cast("timestamp"), stop.cast("timestamp")
    micros = F.unix_micros(stop) - F.unix_micros(start)
    middle = F.timestamp_micros(F.floor((F.unix_micros(start) + F.unix_micros(stop)) / 2))
    a, b, m = (F.from_utc_timestamp(t, zone) for t in (start, stop, middle))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    midnight = lambda c: F.date_format(c, "HH:mm:ss") == "00:00:00"
    last_year = F.year(b) - 1
    years = F.when(F.year(a) == last_year, last_year.cast("string")).otherwise(F.concat(F.year(a), F.lit("–"), last_year))
    days = F.concat(day(a), F.lit("–"), F.when(midnight(a) & midnight(b), day(F.date_sub(b, 1))).otherwise(day(b)))
    return F.when(micros < 24 * 3601 * 1_000_000, day(m)).when((F.dayofyear(a) == 1) & (F.dayofyear(b) == 1), years).otherwise(days)


def latest_platform(deployments: DataFrame) -> DataFrame:
    """One deployment (station, id, stop) for each station: an open one wins, else the one that ends last; ties by id."""
    w = Window.partitionBy("station").orderBy(F.col("stop").isNull().desc(), F.desc("stop"), F.desc("id"))
    return deployments.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def local_to_utc(text: Column, offset_hours: Column) -> Column:
    """An instant from yyyy, yyyyMMdd, yyyyMMddHHmm or yyyyMMddHHmmss in local time; other texts give null."""
    part = lambda a, n, default: F.when(F.length(text) >= a + n - 1, F.substring(text, a, n)).otherwise(default).try_cast("int")
    local = F.try_make_timestamp(part(1, 4, "0"), part(5, 2, "1"), part(7, 2, "1"), part(9, 2, "0"), part(11, 2, "0"), part(13, 2, "0").cast("double"))
    good = text.rlike("^([0-9]{4}|[0-9]{8}|[0-9]{12}|[0-9]{14})$")
    return F.when(good, F.timestamp_add("MINUTE", (-offset_hours * 60).cast("int"), local))


def active(memberships: DataFrame, at=None) -> DataFrame:
    """Open memberships, or those that hold at a time."""
    if at is None:
        return memberships.where("stop is null")
    t = F.lit(at).cast("timestamp")
    return memberships.where((F.col("start").isNull() | (F.col("start") <= t)) & (F.col("stop").isNull() | (F.col("stop") > t)))
