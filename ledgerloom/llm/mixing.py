"""Mixing sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, linear between its weight times ``start`` at time 0
and its weight times ``end`` at time 1 (equal: constant). A source's token demand up to time t is its target times the
schedule's integral up to t over the whole integral. ``SCHEDULES``, which the query and the pipeline use, gives sources
factors by rank, as the weights are given: the first falls over time, the second rises, the third stays. Documents of a source stand in an order that a hash fixes; a pass
over them covers the tokens from 0 to the source's size, the next pass those after. A document's position in training is
the time at which the demand reaches the tokens before it: the root of a quadratic. Documents are range-sorted by it.

Targets share ``share`` times all words by weight and stop at ``most`` times their source's size, the excess being
reshared by weight; that level is found in one pass over the sources ordered by the size they can give for a weight.

Prefix sums inside a source run over hash buckets first and inside a bucket then, so that no task holds a source. Rows
that are equal in doc_id and text and more than a bucket should hold have buckets of their own, by where they were read.
Words are runs of other than ASCII whitespace. Null texts have size 0 and are taken 0 times; a null source is a source,
the last one. Rows with the same doc_id and text are documents of their own, told apart by nothing: which of them gets
which share of their words is arbitrary, but the shares agree on every run. Empty tables give empty results. plan()
ignores extra columns; mix() keeps all columns, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import fresh, materialize

#: Rows that a hash bucket holds, about.
BUCKET_ROWS = 4_000
WEIGHTS = (3.0, 1.0, 2.0)
#: Factors at times 0 and 1 of the sources by rank, repeating.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other than ASCII whitespace; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, rank, source_size, weight, target) from (source, source_size); sources by code point, null last, weigh ``weights``, repeating."""
    every = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    listed = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sources.withColumn("rank", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("weight", F.element_at(listed, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    # With the sources before it at their caps, the level that gives the rest out by weight; they only fall after the first that is below its source's cap, which holds.
    level = ranked.withColumn("level", (share * total - before) / after).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = level.withColumn("water", F.max(F.when(F.col("free"), F.col("level"))).over(Window.partitionBy()))
    target = F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return level.select("source", "rank", "source_size", "weight", target.alias("target"))


def demand_time(share: Column, start: Column, end: Column) -> Column:
    """The time at which the integral of a linear schedule reaches ``share`` of the whole: (start t + (end - start) t^2 / 2) = share (start + end) / 2."""
    a, c = (end - start) / 2, -share * (start + end) / 2
    root = F.sqrt(F.greatest(start * start - 4 * a * c, F.lit(0.0)))
    return F.when(share <= 0, 0.0).when(share >= 1, 1.0).otherwise(-2 * c / (start + root))


Schedules = dict[str, tuple[float, float]] | tuple[tuple[float, float], ...]


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows with the bucket's columns: slot (by hash), and own and run for equal rows too many for a slot (else 0)."""
    parts = 1 << max(0, (rows.count() // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("slot", F.shiftrightunsigned(F.col("order"), 40) % parts)
    full = rows.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BUCKET_ROWS).select("slot")  # a few slots, if any
    equal = rows.join(full, "slot", "left_semi").groupBy("order").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS)
    equal = materialize(equal.select("order", F.lit(True).alias("many")), "many")
    if equal.isEmpty():
        return rows.withColumn("own", F.lit(0).cast("long")).withColumn("run", F.lit(0).cast("long"))
    marked = rows.join(equal, "order", "left")
    # Row numbers are consecutive inside a partition of what was read.
    return marked.withColumn("own", F.when(F.col("many"), F.col("order")).otherwise(0)).withColumn("run", F.when(F.col("many"), F.floor(F.col("row_id") / BUCKET_ROWS)).otherwise(0)).drop("many")


def plan(docs: DataFrame, schedules: Schedules | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words over all passes), and ``passes``:
    array<struct<pass, words, position>> of those passes that take words of it, and with ``keep`` the whole row as ``kept``.
    ``schedules`` gives the factors at times 0 and 1 by a source's name, others having 1 and 1, or lists them by rank,
    repeating; without it all are constant."""
    whole = [F.struct(*docs.columns).alias("kept")] if keep else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("order"), *whole)
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    rows = rows.withColumn("none", F.col("source").isNull()).withColumn("named", F.coalesce("source", F.lit("")))
    bucket = ["none", "named", "slot", "own", "run"]
    rows = _bucketed(rows)
    sums = materialize(rows.groupBy(*bucket).agg(F.sum("size").alias("words")), "slots")
    goal = sums.groupBy("none", "named").agg(F.sum("words").alias("source_size"))
    goal = targets(goal.withColumn("source", F.when(~F.col("none"), F.col("named"))), share, most, weights)
    goal = goal.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("named"), "rank", "source_size", "target")
    slots = Window.partitionBy("none", "named").orderBy("slot", "own", "run").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("words").over(slots), F.lit(0))).drop("words")
    ahead = materialize(ahead.join(goal, ["none", "named"]), "ahead")
    inside = Window.partitionBy(*bucket).orderBy("order", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, bucket)
    placed = placed.withColumn("offset", F.col("ahead") + F.col("inside"))
    start, end = F.lit(1.0), F.lit(1.0)
    by_name = isinstance(schedules, dict)
    for key, (a, b) in schedules.items() if by_name else enumerate(schedules or ()):
        same = F.col("source") == key if by_name else F.pmod("rank", F.lit(len(schedules))) == key
        start, end = F.when(same, float(a)).otherwise(start), F.when(same, float(b)).otherwise(end)
    goal_words = F.round("target").cast("long")

    def of_pass(k: Column) -> Column:
        at = F.col("offset") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal_words - at))
        share_before = F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(0.0))
        return F.struct(k.cast("int").alias("pass"), words.alias("words"), demand_time(share_before, start, end).alias("position"))

    all_passes = F.transform(F.sequence(F.lit(0), F.lit(int(most) - 1 + (most > int(most)))), of_pass)
    placed = placed.withColumn("passes", F.filter(all_passes, lambda p: p.words > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, p: acc + p.words)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", *(["kept"] if keep else []))


def mix(docs: DataFrame, schedules: Schedules | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The training order, range-sorted by position: the rows of docs, once for each pass that takes words of them, with
    pass, words (taken in that pass) and position (names that docs has get a line behind)."""
    rows = plan(docs, schedules, share, most, weights, keep=True).select("kept", "doc_id", "source", F.explode("passes").alias("p"))
    ordered = rows.orderBy(F.col("p.position"), "source", "doc_id", F.col("p.pass"))
    return ordered.select("kept.*", *(F.col(f"p.{c}").alias(fresh(docs, c)) for c in ("pass", "words", "position")))
