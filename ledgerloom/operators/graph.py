"""Connected components and closures as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.scratch import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, for all nodes of the edges (a, b).

    Large-star and small-star steps in turn: each node's greater neighbours, then its smaller ones, are moved to the least
    that it knows, until nothing moves. A round is two aggregations and two joins; no component is gathered."""
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = materialize(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        moved = not small.join(links, ["a", "b"], "left_anti").isEmpty() or not links.join(small, ["a", "b"], "left_anti").isEmpty()
        discard(links, large)
        links = small
        if not moved:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def descendants(links: DataFrame) -> DataFrame:
    """(top, below, depth): everything below each ``top`` of the links (top, below), with the least number of steps.

    Level by level: only pairs that are new go on to the next one, so that every pair is joined once, and cycles end."""
    links = materialize(links.select("top", "below").where("top <> below").distinct(), "links")
    depth, frontier = 1, links
    levels = [links.withColumn("depth", F.lit(1))]
    while True:
        depth += 1
        ahead = links.select(F.col("top").alias("below"), F.col("below").alias("next"))
        found = frontier.select("top", "below").join(ahead, "below").select("top", F.col("next").alias("below")).where("top <> below").distinct()
        for level in levels:
            found = found.join(level.select("top", "below"), ["top", "below"], "left_anti")
        frontier = materialize(found, "level")
        if frontier.isEmpty():
            discard(frontier)
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out
