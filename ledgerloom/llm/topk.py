"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors become integers floor(64 x). Candidates are ranked by norm and cut into blocks, the longest vectors first. A
block holds a list for each dimension, sorted by the component. A query walks its dimensions' lists at equal depth (from
the top where its component is positive, from the bottom where it is negative), scores what it meets, and stops once the
bound (its components times the lists' values at that depth) is below the kth score known: an unseen row can't reach it
then. A block whose longest vector can't reach that score by the two norms isn't entered at all.

The first block gives every query a kth score to begin with; all other blocks run in parallel from there, in tasks of
bounded size, and their results are merged by rank. Only pairs of blocks that the norms allow are sent to tasks.

Where sums are beyond 2**53, rows are searched in floating point with a margin for its error, and those that may be
among the k best are scored by Python's integers. Scores beyond a long are given as the nearest long, ranked as they are.

Vectors that are null, empty or hold null or non-finite components take no part; vectors meet only those of their
length. Rows of equal id are rows of their own; a query skips only its own row. Ties go to the smaller id, then to the
row read first. Fewer candidates than k give fewer rows; null ids take no part. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.ranks import number_rows

from ._spark import materialize

#: Rows in a block of candidates and of queries, about.
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Entries of each list that a query reads first; it doubles from there.
FIRST_DEPTH = 4
LONG = 2**63


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(row_id, vec_id, x, scale): the valid rows; their integers are floor(scale * x)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    valid = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    out = rows.where(valid).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(~F.exists("x", bad))
    return out.withColumn("scale", F.lit(scale)).withColumn("row_id", F.monotonically_increasing_id())


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of any finite double."""
    return math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale


def _integers(x: np.ndarray, scale: int, shrink: float) -> np.ndarray:
    """whole() of each component as doubles, times ``shrink``."""
    small = np.abs(x) < 2.0**52
    return np.where(small, np.floor(np.where(small, x, 0.0) * scale) * shrink, x * shrink * scale)


class Lists:
    """The sorted lists of one block of candidates; ``seen`` counts the rows that searches scored."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self.longest = float(np.sqrt((vectors * vectors).sum(axis=1).max()))
        self.seen = 0

    def bound(self, query: np.ndarray, depth: int) -> float:
        """The most that a row unseen at this depth can score."""
        return float(np.maximum(query, 0) @ self.values[depth - 1] + np.minimum(query, 0) @ self.values[len(self.vectors) - depth])

    def search(self, query: np.ndarray, k: int, skip: int = -1, least: float = -np.inf, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows but ``skip`` that may be among the k best and reach ``least``, a kth score found elsewhere.
        Scores are off by ``margin`` at most."""
        n = len(self.vectors)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        if np.sqrt(query @ query) * self.longest * (1 + 1e-9) + margin < least:
            return rows, scores
        if skip >= 0:
            met[skip] = True
        at, depth = 0, min(n, FIRST_DEPTH)
        while True:
            near = np.zeros(n, dtype=bool)
            near[self.order[at:depth, up].ravel()] = True
            near[self.order[n - depth : n - at, down].ravel()] = True
            new = np.flatnonzero(near & ~met)
            met[new] = True
            self.seen += len(new)
            own = self.vectors[new] @ query
            kept = own + margin >= least
            rows, scores = np.concatenate((rows, new[kept])), np.concatenate((scores, own[kept]))
            if len(scores) >= k:
                least = max(least, float(np.partition(scores, -k)[-k]) - margin)
                kept = scores + margin >= least
                rows, scores = rows[kept], scores[kept]
            if self.bound(query, depth) + margin < least or depth == n or met.all():
                break
            at, depth = depth, min(n, depth * 2)
        if not len(up) and not len(down):  # a query of zeros meets no list: all rows score 0
            rows = np.flatnonzero(~met)
            scores = np.zeros(len(rows))
            if least > margin:
                rows, scores = rows[:0], scores[:0]
        return rows, scores


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places in ``rows`` of the k best."""
    return np.lexsort((keys[rows], ids[rows], -scores))[:k]


def _exact_order(rows: np.ndarray, exact: list[int], ids: np.ndarray, keys: np.ndarray, k: int) -> list[int]:
    return sorted(range(len(rows)), key=lambda i: (-exact[i], ids[rows[i]], keys[rows[i]]))[:k]


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of the block for each query. queries: row_id, vec_id, x, scale, least; candidates: row_id, vec_id, x.

    ``score`` is a long; ``high`` orders scores that no long holds."""
    scale = int(queries.scale.iloc[0])
    qx, cx = (np.stack(p.x.to_numpy()) for p in (queries, candidates))
    ids, keys = candidates.vec_id.to_numpy(), candidates.row_id.to_numpy()
    place = {r: i for i, r in enumerate(keys)}
    top_q, top_c = float(np.abs(qx).max()), float(np.abs(cx).max())
    exact = top_q < 2.0**40 and top_c < 2.0**40 and top_q * top_c * scale * scale * qx.shape[1] < 2.0**52
    # Beyond that, vectors shrink by powers of two, so that no product overflows.
    shrink_q, shrink_c = (1.0, 1.0) if exact else (2.0 ** -math.frexp(top_q)[1], 2.0 ** -math.frexp(top_c)[1])
    q, c = _integers(qx, scale, shrink_q), _integers(cx, scale, shrink_c)
    lists = Lists(c)
    out = {"query_row": [], "query_id": [], "row_id": [], "vec_id": [], "score": [], "high": []}
    known = queries.least.to_numpy(dtype=float, na_value=-np.inf) if "least" in queries else np.full(len(q), -np.inf)
    for i in range(len(q)):
        margin = 0.0 if exact else 1e-15 * qx.shape[1] ** 2 * float(np.abs(q[i]).max()) * float(np.abs(c).max()) + 1e-300
        least = known[i] * shrink_q * shrink_c
        if not exact and np.isfinite(least):
            least -= 1e-12 * abs(least)
        rows, scores = lists.search(q[i], k, place.get(queries.row_id.iloc[i], -1), least, margin)
        if exact:
            best = _best(rows, scores, ids, keys, k)
            found, high = scores[best].astype(np.int64), np.full(len(best), "1", dtype=object)
        else:
            own = [whole(x, scale) for x in qx[i]]
            sums = [sum(a * whole(x, scale) for a, x in zip(own, cx[r])) for r in rows]
            best = _exact_order(rows, sums, ids, keys, k)
            found = np.array([max(-LONG, min(LONG - 1, sums[b])) for b in best], dtype=np.int64)
            high = np.array([_beyond(sums[b]) for b in best], dtype=object)
        out["query_row"].append(np.full(len(best), queries.row_id.iloc[i]))
        out["query_id"].append(np.full(len(best), queries.vec_id.iloc[i]))
        out["row_id"].append(keys[rows[best]])
        out["vec_id"].append(ids[rows[best]])
        out["score"].append(found)
        out["high"].append(high)
    return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0) for n, v in out.items()})


def _beyond(score: int) -> str:
    """A text that sorts as the scores do: "1" for all that a long holds."""
    if -LONG <= score < LONG:
        return "1"
    digits = str(abs(score))
    return f"2{len(digits):04d}{digits}" if score > 0 else f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _search_blocks(k: int):
    def run(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("query_row", "query_id", "row_id", "vec_id", "score", "high")})
        return search_block(queries, candidates, k)

    return run


_FOUND = "query_row long, query_id long, row_id long, vec_id long, score long, high string"


def _meet(queries: DataFrame, candidates: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The search of each pair (dims, q, c) of blocks in a task of its own."""
    sent = candidates.join(pairs, ["dims", "c"]).groupBy("dims", "q", "c")
    asked = queries.join(pairs, ["dims", "q"]).groupBy("dims", "q", "c")
    return asked.cogroup(sent).applyInPandas(_search_blocks(k), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("high"), F.desc("score"), "vec_id", "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of integer_vectors() where ``is_query``, the k best of all other rows."""
    largest = F.array_max(F.transform("x", lambda c: F.abs(c)))
    ratio = F.when(largest > 0, F.aggregate("x", F.lit(0.0), lambda acc, c: acc + (c / largest) * (c / largest))).otherwise(F.lit(0.0))
    # A bound of the norm of the integers, which are within 1 of the components times the scale; infinite where a double can't hold it.
    norm = largest * F.sqrt(ratio) * F.col("scale") * (1 + 1e-9) + F.sqrt(F.size("x").cast("double"))
    rows = materialize(vectors.withColumn("norm", norm).withColumn("dims", F.size("x")).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    placed = number_rows(rows, [F.col("dims"), F.desc("norm"), F.col("row_id")], "number")
    placed = materialize(placed.withColumn("c", F.floor(F.col("number") / BLOCK_ROWS).cast("int")).drop("number"), "blocks")
    asked = placed.where("asks")
    cuts = -(-asked.count() // QUERY_ROWS) or 1
    queries = materialize(asked.select("row_id", "vec_id", "x", "scale", "norm", "dims", F.pmod(F.xxhash64("row_id"), F.lit(cuts)).cast("int").alias("q")), "asked")
    candidates = placed.select("row_id", "vec_id", "x", "dims", "c")
    # From here on one row for each block.
    blocks = materialize(placed.groupBy("dims", "c").agg(F.max("norm").alias("longest")), "sizes")
    first = blocks.groupBy("dims").agg(F.min("c").alias("c"))
    none = queries.withColumn("least", F.lit(None).cast("double"))
    begun = materialize(_meet(none, candidates, materialize(queries.select("dims", "q").distinct().join(first, "dims"), "pairs"), k), "begun")
    least = _ranked(begun, k).where((F.col("rank") == k) & (F.col("high") == "1")).select(F.col("query_row").alias("row_id"), F.col("score").cast("double").alias("least"))
    known = materialize(queries.join(least, "row_id", "left"), "queries")
    asks = known.groupBy("dims", "q").agg(F.max("norm").alias("norm"), F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least"))
    rest = blocks.join(first, ["dims", "c"], "left_anti").join(asks, "dims").where(F.col("norm") * F.col("longest") >= F.col("least"))
    rest = materialize(rest.select("dims", "q", "c"), "pairs")
    found = begun.union(_meet(known, candidates, rest, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
