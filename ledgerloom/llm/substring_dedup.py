"""Removal of passages that occur in an earlier document, found by level-wise doubling.

Words are separated by 0x20 and 0x09-0x0D and compared unchanged. A window is ``length`` words of one document. A word
goes if a window covers it whose words also start in a document with a smaller doc_id.

Windows of half the length come first, then twice that, and so on up to ``length`` (13: 7, 13; 50: 7, 13, 25, 50). Only
windows repeated at one length are extended to the next, until that is reached or no candidate survives:

1. Texts are put into pieces of about 4 MB, compressed and written once; every level reads the pieces again.
2. At the first level a piece looks at the windows with the least hash among those inside some window of the second
   level. These are the same wherever the second window stands, and about a quarter of all.
3. At each level a piece sends the distinct hashes of its windows to shards by hash: one row for a piece and a shard, so
   never more rows than windows, whatever the number of pieces and shards. A window has one entry for a piece, however
   often it occurs there; shards grow in number with the words of the corpus. A shard answers with one bit for each entry:
   whether it occurs in another piece too.
4. A window goes to the next level if its first and last part of the level before are repeated (from the first to the
   second level: if its least part is). Counts may include repeats inside one document; the last level decides.
5. At the last level entries have 96 bits of hash and the piece's smallest doc_id; the bit says whether another piece
   has a smaller one. Inside a piece ids are compared directly.

Windows are judged on the input, not on what is left. Rows with the same doc_id are one document as to smaller and
greater, and rows of their own in the result; a null doc_id counts as greater than all others. Null texts have no words;
texts of fewer words than a window keep all; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._arrays import mix, ngrams, slices, whitespace_words, word_hashes, words
from ._spark import clean_text, materialize

LENGTH = 13
#: Length below which windows aren't halved any more.
SHORTEST = 8
#: Words of the corpus for each shard.
SHARD_WORDS = 1 << 21
#: How pieces are written: a page for each, so that a reader holds one.
BLOBS = {"compression": "uncompressed", "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}
NO_ID = np.int64(np.iinfo(np.int64).max)


def lengths_to(length: int) -> list[int]:
    """The windows' lengths of all levels, from the shortest up."""
    out = [length]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out if len(out) > 1 else [length, length]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces: their number, the documents' ids and sizes in bytes, the number of words, and the compressed texts."""
    number = TaskContext.get().partitionId() << 32
    table = whitespace_words()
    for batch in batches:
        for row, end, data, offsets in slices(batch.column("text")):
            ids = batch.column("doc_id").slice(row, end - row)
            n = len(words(data, offsets, table)[0])
            body = pa.compress(data.tobytes(), codec="zstd", asbytes=True)
            lists = [pa.array([x.tolist() if isinstance(x, np.ndarray) else x.to_pylist()], pa.list_(pa.int64())) for x in (ids, np.diff(offsets))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([n], pa.int64()), pa.array([body], pa.binary())], ["piece", "ids", "sizes", "n_words", "body"])
            number += 1


class Piece:
    """The words of some documents, and which of their windows survive each level."""

    def __init__(self, ids: list, sizes: list[int], body: bytes, lengths: list[int], shards: int):
        self.offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int64)
        self.raw = pa.decompress(body, int(self.offsets[-1]), codec="zstd", asbytes=True) if self.offsets[-1] else b""
        data = np.frombuffer(self.raw, dtype=np.uint8)
        starts, ends, self.bounds = words(data, self.offsets, whitespace_words())
        self.hashes = word_hashes(data, starts, ends, np.arange(256, dtype=np.uint8))
        count = np.diff(self.bounds)
        self.room = np.repeat(self.bounds[1:], count) - np.arange(len(self.hashes))
        self.ids = np.array([NO_ID if x is None else x for x in ids], dtype=np.int64)
        self.doc = np.repeat(self.ids, count)
        self.lengths, self.shards = lengths, np.uint64(shards)

    def _least(self) -> np.ndarray:
        """For each window of the second level, the place of its least part of the first (the first of equal ones)."""
        short, long = self.lengths[:2]
        part = ngrams(self.hashes, short)
        n = max(0, len(self.hashes) - long + 1)
        best, at = part[:n].copy(), np.arange(n)
        for k in range(1, long - short + 1):
            less = part[k : k + n] < best
            best[less] = part[k : k + n][less]
            at[less] = np.flatnonzero(less) + k
        return at

    def levels(self, answers: dict[int, dict[int, bytes]]) -> Level:
        """The first level that isn't answered yet, or the last."""
        repeated = None
        for k, n in enumerate(self.lengths):
            fits = np.flatnonzero(self.room >= (n if k else self.lengths[1]))
            last = k == len(self.lengths) - 1
            if k == 0:
                least = self._least()[fits]
                chosen = np.unique(least)
            elif k == 1:
                chosen = fits[repeated[least]]
            else:
                chosen = fits[repeated[fits] & repeated[fits + n - self.lengths[k - 1]]]
            level = Level(self, n, chosen, last)
            if k not in answers or last:
                return level
            repeated = np.zeros(len(self.hashes), dtype=bool)
            repeated[chosen] = level.said(answers[k]) | (level.number[level.group] > 1)
        raise AssertionError

    def kept(self, level: Level, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
        """Which words stay, by the answers to the last level."""
        gone = level.said(answers[len(self.lengths) - 1]) | (self.doc[level.chosen] > level.least[level.group])
        edges = np.zeros(len(self.hashes) + 1, dtype=np.int32)
        np.add.at(edges, level.chosen[gone], 1)
        np.add.at(edges, level.chosen[gone] + level.length, -1)
        return np.cumsum(edges[:-1]) == 0


class Level:
    """A piece's windows of one length: entries are its distinct ones, in order of their shard."""

    def __init__(self, piece: Piece, length: int, chosen: np.ndarray, last: bool):
        self.length, self.chosen = length, chosen
        one = ngrams(piece.hashes, length)[chosen]
        two = ngrams(mix(piece.hashes + np.uint64(0x2545F4914F6CDD1D)), length)[chosen].astype(np.uint32) if last else np.zeros(len(one), dtype=np.uint32)
        doc = piece.doc[chosen] if last else np.zeros(len(one), dtype=np.int64)
        order = np.lexsort((doc, two, one)) if last else np.argsort(one, kind="stable")
        first = np.ones(len(order), dtype=bool)
        first[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        at = order[first]
        one, two, doc = one[at], two[at], doc[at]
        shard = ((one >> np.uint64(32)) % piece.shards).astype(np.int64)
        moved = np.lexsort((one, doc, shard)) if last else np.argsort(shard, kind="stable")
        place = np.empty(len(moved), dtype=np.int64)
        place[moved] = np.arange(len(moved))
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = place[np.cumsum(first) - 1]
        self.number = np.bincount(self.group, minlength=len(moved))
        self.one, self.two, self.least, self.shard = one[moved], two[moved], doc[moved], shard[moved]
        self.last = last

    def parts(self) -> Iterator[tuple[int, slice]]:
        shards, starts = np.unique(self.shard, return_index=True)
        for k, a, b in zip(shards.tolist(), starts.tolist(), [*starts[1:].tolist(), len(self.shard)]):
            yield k, slice(a, b)

    def entries(self) -> Iterator[tuple[int, bytes, bytes | None, bytes | None, bytes | None]]:
        """(shard, hashes, more of them, doc_ids, entries of each): the last three at the last level only."""
        for k, own in self.parts():
            if not self.last:
                yield k, self.one[own].tobytes(), None, None, None
                continue
            ids, number = np.unique(self.least[own], return_counts=True)  # entries of a shard are in order of their ids
            yield k, self.one[own].tobytes(), self.two[own].tobytes(), ids.tobytes(), number.astype(np.uint32).tobytes()

    def said(self, answers: dict[int, bytes]) -> np.ndarray:
        """The bit of each chosen window."""
        bits = np.zeros(len(self.one), dtype=bool)
        for k, own in self.parts():
            bits[own] = np.unpackbits(np.frombuffer(answers[k], dtype=np.uint8), count=own.stop - own.start).astype(bool)
        return bits[self.group]


def _pieces(batches: Iterator[pa.RecordBatch], lengths: list[int], shards: int) -> Iterator[tuple[int, Piece, list, dict[int, dict[int, bytes]]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            answers: dict[int, dict[int, bytes]] = {}
            for a in row["answers"] or []:
                answers.setdefault(a["level"], {})[a["shard"]] = a["bits"]
            yield row["piece"], Piece(row["ids"], row["sizes"], row["body"], lengths, shards), row["ids"], answers


def _send(lengths: list[int], shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece, _, answers in _pieces(batches, lengths, shards):
            rows = list(piece.levels(answers).entries())
            columns = [pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.binary()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), *columns], ["piece", "shard", "one", "two", "ids", "number"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The bits of one shard's entries, for each piece."""
    column = lambda name, kind: np.frombuffer(b"".join(x or b"" for x in table.column(name).to_pylist()), dtype=kind)
    one = column("one", np.uint64)
    sizes = np.array([len(x) // 8 for x in table.column("one").to_pylist()])
    last = table.column("two").null_count == 0
    two = column("two", np.uint32) if last else np.zeros(len(one), dtype=np.uint32)
    ids = np.repeat(column("ids", np.int64), column("number", np.uint32)) if last else np.zeros(len(one), dtype=np.int64)
    order = np.lexsort((ids, two, one)) if last else np.argsort(one, kind="stable")
    first = np.ones(len(order), dtype=bool)
    first[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    group = np.cumsum(first) - 1
    bits = np.zeros(len(one), dtype=bool)
    bits[order] = ids[order] > ids[order[first]][group] if last else np.bincount(group)[group] > 1
    ends = np.cumsum(sizes)
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(ends - sizes, ends)]
    return pa.table({"piece": table.column("piece"), "shard": table.column("shard"), "bits": pa.array(packed, pa.binary())})


def _finish(lengths: list[int], shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, piece, ids, answers in _pieces(batches, lengths, shards):
            level = piece.levels(answers)
            kept = piece.kept(level, answers) if len(level.chosen) else np.ones(len(piece.hashes), dtype=bool)
            texts, gone = [], []
            for k in range(len(ids)):
                own = piece.raw[piece.offsets[k] : piece.offsets[k + 1]].split()
                stay = kept[piece.bounds[k] : piece.bounds[k + 1]]
                gone.append(len(own) - int(stay.sum()))
                texts.append(b" ".join(own if not gone[-1] else [own[i] for i in np.flatnonzero(stay).tolist()]))
            sizes = np.diff(piece.bounds).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(gone, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and ``kept``, the words that stay, joined by one space."""
    lengths = lengths_to(length)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(docs).alias("text"))
    pieces = materialize(rows.mapInArrow(_pack, "piece long, ids array<long>, sizes array<long>, n_words long, body binary"), "pieces", BLOBS)
    total = pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    shards = 1 + total // SHARD_WORDS
    replies = None
    for k in range(len(lengths)):
        sent = _with_answers(pieces, replies).mapInArrow(_send(lengths, shards), "piece long, shard long, one binary, two binary, ids binary, number binary")
        answered = sent.groupBy("shard").applyInArrow(_answer, "piece long, shard long, bits binary")
        told = materialize(answered.select("piece", F.struct(F.lit(k).alias("level"), "shard", "bits").alias("answer")), "answers")
        replies = told if replies is None else replies.unionByName(told)
        if told.isEmpty():  # no candidate survives
            break
    found = _with_answers(pieces, replies).mapInArrow(_finish(lengths, shards), "doc_id long, n_words long, n_removed long, kept binary")
    return found.withColumn("kept", F.col("kept").cast("string"))


def _with_answers(pieces: DataFrame, replies: DataFrame | None) -> DataFrame:
    """The pieces with all answers so far; these, not the texts, are what a task holds in a hash table."""
    columns = ["piece", "ids", "sizes", "body"]
    if replies is None:
        return pieces.select(*columns, F.lit(None).cast("array<struct<level: int, shard: long, bits: binary>>").alias("answers"))
    own = replies.groupBy("piece").agg(F.collect_list("answer").alias("answers"))
    return pieces.select(*columns).join(own.hint("shuffle_hash"), "piece", "left")
