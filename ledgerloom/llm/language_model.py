"""Language-model scores by deleted interpolation.

Tokens are the lower-cased (A-Z) runs of other than ASCII whitespace of a text and one end token; two of these stand
before the first token of each text. With the maximum-likelihood estimates from the training texts the probability of
a token w after g h is

    p3 = a3(b(c(g h))) c(g h w) / c(g h) + (1 - a3) p2,   p2 = a2(b(c(h))) c(h w) / c(h) + (1 - a2) p1,
    p1 = a1 c(w) / N + (1 - a1) / (V + 1)

where b(c) is the bucket of a context's frequency: itself up to 3, from there by doubling (0: unseen, with a = 0). The weights of each bucket
maximise the likelihood of a fold of the training texts (one in ``FOLD``, dealt by a hash) under the counts of the
others, order by order, by expectation-maximisation over held-out counts: tokens of nearly equal estimates are counted
together. Scores use the counts of all training texts.

Each task packs the texts it reads to pieces of about ``PIECE`` bytes, which are written compressed. A piece's distinct
n-grams and counts go, as sorted and compressed arrays, to the shard that the range of their hash names; the shard adds
up and answers each piece with the totals in the same order; texts and answers meet by piece. So each n-gram moves once
per piece, a frequent one is as cheap as any, and repeated rows are in the pieces of those who read them. Nothing of the
corpus is broadcast or kept in one task; only the weights and four totals are. Words are told apart by 64 bits, n-grams of
two and three words by 16 more than the number of the corpus's bytes has (40 at least): at any size two given ones are
taken for each other with a chance below 1 in 2**16 over all of the corpus.

Null texts have the end token alone; rows with a null doc_id are training texts. Rows with the same doc_id are
documents of their own. Extra columns are ignored. Without training texts the counts are 0 and scores are those of
1 / (V + 1) alone; with an empty fold (few texts) the starting weights are used. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ._arrays import hash_words, mix, whitespace_words
from ._spark import clean_text, materialize

#: Bytes of text in a piece, about, and bytes of the whole text for each shard.
PIECE = 8 << 20
SHARD = 16 << 20
#: Pieces are compressed already; a page of the written table holds one, so that no reader or writer buffers many.
BLOBS = {"compression": "uncompressed", "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}
#: One of so many training texts is held out to learn the weights.
FOLD = 28
ROUNDS = 40
ORDERS = (1, 2, 3)
BUCKETS = 48
#: Weights before learning, and of buckets that the fold doesn't have.
STARTING = {1: 0.8, 2: 0.4, 3: 0.4}
END = mix(np.array([0x5EED], dtype=np.uint64))
#: Cells of the held-out counts: steps of a factor 2 ** (1 / 2) in each estimate.
STEP, STEPS = 2, 128


def _pack(limit: int):
    """Rows (doc_id, training, text) to pieces of about ``limit`` bytes."""

    def piece(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        texts = [t for part in parts for t in part.column("text").to_pylist()]
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        plain = lambda name: table.column(name).combine_chunks()
        blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([one(plain("doc_id")), one(plain("training")), one(pa.array([len(t) for t in texts], pa.int64())), pa.array([blob], pa.binary())], ["ids", "training", "sizes", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < len(ends):
                before = int(ends[row - 1]) if row else 0
                end = max(row + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
                parts.append(batch.slice(row, end - row))
                size += int(ends[end - 1]) - before
                if end < len(ends) or size >= limit:
                    yield piece(parts)
                    parts, size = [], 0
                row = end
        if parts:
            yield piece(parts)

    return run


def _texts(sizes: np.ndarray, blob: bytes) -> pa.Array:
    total = int(sizes.sum())
    raw = pa.decompress(blob, decompressed_size=total, codec="zstd") if total else pa.py_buffer(b"")
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), raw])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with an end token after each text, first token of each text and their total)."""
    parts, sizes = [], []
    for _, _, hashes, bounds in hash_words(column, whitespace_words()):
        docs = len(bounds) - 1
        out = np.empty(len(hashes) + docs, dtype=np.uint64)
        ends = bounds[1:] + np.arange(docs)
        kept = np.ones(len(out), dtype=bool)
        kept[ends] = False
        out[kept], out[ends] = hashes, END[0]
        parts.append(out)
        sizes.append(np.diff(bounds) + 1)
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def gram_bits(size: int) -> int:
    """Bits that tell n-grams of a corpus of ``size`` bytes apart."""
    return min(64, max(40, int(size).bit_length() + 16))


def grams(hashes: np.ndarray, bounds: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A hash of each token with the ``order`` - 1 before it; end tokens stand before a text."""
    if order == 1:
        return hashes
    out = np.concatenate((END, hashes[:-1]))
    if order == 3:
        two = np.concatenate((END, END, hashes[:-2]))[: len(hashes)]
        two[bounds[:-1]] = END[0]
        out = mix(two * np.uint64(0xD6E8FEB86659FD93) + np.uint64(3)) + out
    return mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes) >> np.uint64(64 - bits)


def _distinct(hashes: np.ndarray, bounds: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(hashes, bounds, order, bits), return_inverse=True)


def squeeze(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unsqueeze(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel()


def _cuts(found: np.ndarray, shards: int, order: int, bits: int) -> np.ndarray:
    """Bounds of the shards, which are ranges of the sorted hashes."""
    top = found >> np.uint64(32 if order == 1 else bits - 32)
    return np.searchsorted((top * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1))


_GRAMS = "piece long, fold boolean, gram_order int, shard int, n long, grams binary, counts binary"


def _gram_rows(shards: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                piece, fold, trained, sizes, blob = (batch.column(c)[row] for c in ("piece", "fold", "training", "sizes", "blob"))
                hashes, bounds = tokens(_texts(sizes.values.to_numpy(), blob.as_py()))
                weight = np.repeat(trained.values.to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                for order in ORDERS:
                    found, place = _distinct(hashes, bounds, order, bits)
                    counts, cuts = np.bincount(place, weights=weight, minlength=len(found)).astype(np.int64), _cuts(found, shards, order, bits)
                    some = np.flatnonzero(np.diff(cuts))
                    parts = [slice(cuts[s], cuts[s + 1]) for s in some]
                    k = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([piece.as_py()] * k, pa.int64()), pa.array([fold.as_py()] * k, pa.bool_()), pa.array([order] * k, pa.int32()), pa.array(some.astype(np.int32)), pa.array([p.stop - p.start for p in parts], pa.int64())]
                        + [pa.array([squeeze(np.diff(found[p], prepend=np.uint64(0))) for p in parts], pa.binary()), pa.array([squeeze(counts[p]) for p in parts], pa.binary())],
                        names=["piece", "fold", "gram_order", "shard", "n", "grams", "counts"],
                    )

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Totals of a shard's n-grams: for pieces the training counts, for those of the fold the counts of the others."""
    order, sizes = table.column("gram_order")[0].as_py(), table.column("n").to_pylist()
    fold = table.column("fold").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    flat = np.concatenate([unsqueeze(b.as_py(), n).view(np.int64) for b, n in zip(table.column("counts"), sizes)])
    found, place = np.unique(np.concatenate([np.cumsum(unsqueeze(b.as_py(), n), dtype=np.uint64) for b, n in zip(table.column("grams"), sizes)]), return_inverse=True)
    held = np.repeat(fold, sizes)
    every = np.bincount(place, weights=np.where(held, 0, flat), minlength=len(found)).astype(np.int64)
    main = every - np.bincount(place, weights=np.where(held, flat, 0), minlength=len(found)).astype(np.int64)
    ends = np.cumsum(sizes)[:-1]
    answers = [np.where(f, main[p], every[p]) for f, p in zip(fold, np.split(place, ends))]
    # One more row with the shard's totals, for a piece that doesn't exist.
    answers.append(np.array([every.sum(), (every > 0).sum(), main.sum(), (main > 0).sum()]))
    more = lambda name, last, kind: pa.array([*table.column(name).to_pylist(), last], kind)
    shard = table.column("shard")[0].as_py()
    return pa.table(
        [more("piece", -1, pa.int64()), more("fold", False, pa.bool_()), more("gram_order", order, pa.int32()), more("shard", shard, pa.int32()), pa.array([len(a) for a in answers], pa.int64()), pa.array([squeeze(a) for a in answers], pa.binary())],
        names=["piece", "fold", "gram_order", "shard", "n", "counts"],
    )


@dataclass
class Answered:
    """Of each token of a piece: counts of the n-grams that end there (by order), and of their contexts."""

    ids: pa.Array
    bounds: np.ndarray
    counts: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]


def _answered(packs: pa.Table, answers: pa.Table, total: int, bits: int) -> Answered:
    ids, sizes, blob = (packs.column(c)[0] for c in ("ids", "sizes", "blob"))
    hashes, bounds = tokens(_texts(sizes.values.to_numpy(), blob.as_py()))
    order, shard = answers.column("gram_order").to_numpy(), answers.column("shard").to_numpy()
    counts = {}
    for k in ORDERS:
        found, place = _distinct(hashes, bounds, k, bits)
        rows = sorted(np.flatnonzero(order == k), key=lambda i: shard[i])
        totals = np.concatenate([unsqueeze(answers.column("counts")[int(i)].as_py(), answers.column("n")[int(i)].as_py()).view(np.int64) for i in rows])
        counts[k] = totals[place]
        if k == 1:
            end = int(totals[np.searchsorted(found, END[0])])
    contexts = {1: np.full(len(hashes), total), 2: np.concatenate(([end], counts[1][:-1])), 3: np.concatenate(([end], counts[2][:-1]))}
    for k in (2, 3):
        contexts[k][bounds[:-1]] = end  # as many texts begin as end
    return Answered(ids.values, bounds, counts, contexts)


def bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.where(context <= 3, context, np.minimum(np.frexp(context.astype(np.float64))[1] + 1, BUCKETS - 1))


def lower(found: Answered, v: int, weights: dict[int, np.ndarray], order: int) -> np.ndarray:
    """Probabilities of all tokens by the orders below ``order``."""
    p = np.full(len(found.counts[1]), 1.0 / (v + 1))
    for k in range(1, order):
        own = weights[k][bucket(found.contexts[k])]
        p = own * found.counts[k] / np.maximum(found.contexts[k], 1) + (1 - own) * p
    return p


def _held_out(order: int, n: int, v: int, bits: int, weights: dict[int, np.ndarray]):
    def run(key: tuple, packs: pa.Table, answers: pa.Table) -> pa.Table:
        if not packs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("cell", pa.int64()), ("n", pa.int64()), ("own", pa.float64()), ("lower", pa.float64()))})
        found = _answered(packs, answers, n, bits)
        own, low = found.counts[order] / np.maximum(found.contexts[order], 1), lower(found, v, weights, order)
        step = lambda p: np.where(p > 0, np.round(-STEP * np.log2(np.maximum(p, 1e-30))) + 1, 0).astype(np.int64).clip(0, STEPS - 1)
        cell, place = np.unique((bucket(found.contexts[order]) * STEPS + step(own)) * STEPS + step(low), return_inverse=True)
        add = lambda x: np.bincount(place, weights=x, minlength=len(cell))
        return pa.table({"cell": pa.array(cell), "n": pa.array(np.bincount(place, minlength=len(cell))), "own": pa.array(add(own)), "lower": pa.array(add(low))})

    return run


def learn_weights(cells: list[tuple[int, int, float, float]], order: int, rounds: int = ROUNDS) -> np.ndarray:
    """The weight of each bucket by expectation-maximisation over (cell, tokens, sums of the order's estimate and of the lower orders').

    Buckets without tokens (all, if the fold is empty) keep the starting weight; unseen contexts have 0."""
    weights = np.full(BUCKETS, STARTING[order])
    weights[0] = 0.0
    if not cells:
        return weights
    cell, n, own, low = (np.array(c, dtype=float) for c in zip(*cells))
    which, f, p = (cell // (STEPS * STEPS)).astype(int), own / n, low / n
    total = np.bincount(which, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        a = weights[which]
        share = a * f / (a * f + (1 - a) * p)
        weights = np.where(total > 0, np.bincount(which, weights=n * share, minlength=BUCKETS) / np.maximum(total + 1.0, 1.0), weights)
        weights[0] = 0.0
    return weights


def _score(n: int, v: int, bits: int, weights: dict[int, np.ndarray]):
    names = ["doc_id", "training", "n_tokens", "n_known", "base_score", "score"]

    def run(key: tuple, packs: pa.Table, answers: pa.Table) -> pa.Table:
        if not packs.num_rows:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        found = _answered(packs, answers, n, bits)
        add = lambda x: np.add.reduceat(x, found.bounds[:-1])  # noqa: E731  every text has a token
        base = np.log10((found.counts[1] + 1.0) / (n + 1.0 * (v + 1)))
        p = lower(found, v, weights, max(ORDERS) + 1)
        return pa.table([found.ids, packs.column("training")[0].values, pa.array(np.diff(found.bounds)), pa.array(add((found.counts[1] > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))], names=names)

    return run


@dataclass
class Scores:
    """rows: doc_id, held_out, n_tokens, n_known, base_score, score; weights: by order, then bucket."""

    rows: DataFrame
    tokens: int
    distinct: int
    weights: dict[int, np.ndarray]


def score_documents(docs: DataFrame, training: Column, piece_bytes: int = PIECE, shard_bytes: int = SHARD) -> Scores:
    """Scores of all docs (doc_id, text) by a model of those where ``training`` holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), clean_text(docs).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    fold = F.col("training") & (F.pmod(F.shiftrightunsigned("h", 20), F.lit(FOLD)) == 0)
    kind = "ids array<long>, training array<boolean>, sizes array<long>, blob binary"
    pack = lambda some, held: some.select("doc_id", "training", "text").mapInArrow(_pack(piece_bytes), kind).withColumn("fold", F.lit(held))
    packs = materialize(pack(rows, False).union(pack(rows.where(fold), True)).withColumn("piece", F.monotonically_increasing_id()), "pieces", BLOBS)
    size = packs.where("not fold").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, x: acc + x)).alias("n"), F.count("*").alias("pieces")).first()
    shards, pieces = max(1, -(-(size["n"] or 0) // shard_bytes)), max(1, size["pieces"])
    bits = gram_bits(size["n"] or 0)
    found = packs.mapInArrow(_gram_rows(shards, bits), _GRAMS).repartition(len(ORDERS) * shards, "gram_order", "shard")
    answers = found.groupBy("gram_order", "shard").applyInArrow(_merge, "piece long, fold boolean, gram_order int, shard int, n long, counts binary")
    answers = materialize(answers, "answers")
    totals = answers.where("piece = -1 and gram_order = 1").select("counts", "n").toLocalIterator()  # four numbers of each shard
    n, v, n_main, v_main = (int(x) for x in sum((unsqueeze(bytes(r["counts"]), r["n"]).view(np.int64) for r in totals), np.zeros(4, dtype=np.int64)))
    met = lambda held: (df.where((F.col("fold") == held) & (F.col("piece") >= 0)).repartition(pieces, "piece").groupBy("piece") for df in (packs, answers))
    weights: dict[int, np.ndarray] = {}
    for order in ORDERS:
        own, told = met(True)
        cells = own.cogroup(told).applyInArrow(_held_out(order, n_main, v_main, bits, weights), "cell long, n long, own double, lower double")
        cells = cells.groupBy("cell").agg(F.sum("n"), F.sum("own"), F.sum("lower")).orderBy("cell").collect()  # BUCKETS * STEPS * STEPS at most, a few thousand in fact
        weights = {**weights, order: learn_weights([tuple(c) for c in cells], order)}
    own, told = met(False)
    scored = own.cogroup(told).applyInArrow(_score(n, v, bits, weights), "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double")
    return Scores(scored.withColumn("held_out", ~F.col("training")).drop("training"), n, v, weights)
