"""Runs of repeated words: maximal stretches that keep a smallest period and hold it at least twice.

Words are separated by 0x20 and 0x09-0x0D. The words of many texts form one sequence with a mark between texts that
occurs nowhere else. Periods up to ``SMALL`` are read off by comparing the sequence with itself. Longer ones come from
string synchronising sets, one for each dyadic scale t: each place has the hash of the t words from it on, and a place
belongs to the set if the least hash of the t + 1 places from it on is that of the first or the last of them. Windows
with a period of t/3 at most are left out of the minimum. So whether a place belongs depends on its 2t words only, and
every stretch of 3t - 1 words has one of the set among its first t places, unless its period is at most t/3.

1. A run of period q from 3t - 1 to 6t - 2 has two places of the set, q apart, with equal 2t words. Equal contexts
   that near are more than t/3 apart, so each place is paired with few others; every distance is a proposed period.
2. A run whose first period is itself highly periodic has no such place. Then two neighbouring regions of one small
   period, found at an earlier scale, touch or overlap, and the run goes over their border: their shifts up to 6t - 2
   are proposed too.
3. A proposal is extended both ways by comparing fingerprints (modulo 2**61 - 1) of halving lengths, and is a run if it
   has two periods at least. Of runs over the same words the one of smallest period stays.

Work grows with the words times the number of scales. Null texts have no words and no runs; empty tables give empty
results; repeated rows are handled each for itself; ties for the longest run go to the smallest start. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrays import mix, slices, whitespace_words, word_hashes, words
from ._spark import clean_text

#: Words of the shortest run.
LEAST = 12
#: Periods that are compared directly; the first scale is 4, whose periods begin at 11.
SMALL = 10
PRIME = np.uint64((1 << 61) - 1)
BASE = np.uint64(0x1D8AF066B6E2C9B5)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo 2**61 - 1, by halves of 30 and 31 bits."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a0 * b1 + a1 * b0
    return _mod(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)


class Prints:
    """Fingerprints of any stretch of a sequence of codes."""

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        power = np.ones(n + 1, dtype=np.uint64)
        have, step = 1, BASE
        while have <= n:
            more = min(have, n + 1 - have)
            power[have : have + more] = _times(power[:more], np.full(more, step))
            step = _times(np.array([step]), np.array([step]))[0]
            have += more
        terms = _times(_mod(codes), power[:n])
        high, low = np.cumsum(terms >> np.uint64(32), dtype=np.uint64), np.cumsum(terms & np.uint64(0xFFFFFFFF), dtype=np.uint64)
        self.power, self.sums = power, np.zeros(n + 1, dtype=np.uint64)
        self.sums[1:] = _mod(_times(_mod(high), np.full(n, 1 << 32, dtype=np.uint64)) + _mod(low))

    def of(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return _times(_mod(self.sums[at + length] + (PRIME - self.sums[at])), self.power[self.n - at])

    def every(self, length: int) -> np.ndarray:
        """The fingerprint from each place on that has so many codes after it."""
        m = self.n - length + 1
        return _times(_mod(self.sums[length:] + (PRIME - self.sums[:m])), self.power[: self.n - m : -1])

    def common(self, a: np.ndarray, b: np.ndarray, most: int, back: bool = False) -> np.ndarray:
        """How many codes agree from a and b (a < b) on, or before them, if it's less than 2 * ``most``."""
        got = np.zeros(len(a), dtype=np.int64)
        room = a if back else self.n - b
        step = 1 << max(0, int(most).bit_length())
        while step and len(a):
            fits = np.flatnonzero(got + step <= room)
            x, y = (a[fits] - got[fits] - step, b[fits] - got[fits] - step) if back else (a[fits] + got[fits], b[fits] + got[fits])
            got[fits[self.of(x, step) == self.of(y, step)]] += step
            step >>= 1
        return got


def _small(codes: np.ndarray) -> list[np.ndarray]:
    """(start, end, period) of the stretches with a period up to SMALL."""
    found = []
    for q in range(1, min(SMALL, len(codes) // 2) + 1):
        same = np.zeros(len(codes) - q + 2, dtype=np.int8)
        same[1:-1] = codes[:-q] == codes[q:]
        edge = np.diff(same)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        kept = end - start >= q
        found.append(np.stack([start[kept], end[kept] + q, np.full(kept.sum(), q)], axis=1))
    return found


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    """All stretches, each once, with its smallest period, by start and end."""
    rows = np.concatenate([np.zeros((0, 3), dtype=np.int64), *found]).astype(np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def _sync_set(prints: Prints, t: int, known: np.ndarray) -> np.ndarray:
    """Places of the synchronising set of scale t (a power of two); windows inside ``known`` periodic stretches don't count."""
    rank = mix(prints.every(t)) >> np.uint64(1)
    edges = np.zeros(len(rank) + 1, dtype=np.int32)
    calm = known[(3 * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= t)]
    np.add.at(edges, calm[:, 0], 1)
    np.add.at(edges, calm[:, 1] - t + 1, -1)
    rank[np.cumsum(edges[:-1]) > 0] = NONE
    least, width = rank, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], rank[t:])
    return np.flatnonzero((least < NONE) & ((rank[: len(least)] == least) | (rank[t:] == least)))


def _by_context(prints: Prints, t: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) proposed by places of the set with equal 2t words."""
    spots = _sync_set(prints, t, known)
    context = prints.of(spots, 2 * t)
    order = np.argsort(context, kind="stable")
    spots, context = spots[order], context[order]
    at, period = [], []
    for k in range(1, len(spots)):
        near = np.flatnonzero((context[k:] == context[:-k]) & (spots[k:] - spots[:-k] <= 6 * t - 2))
        if not len(near):
            break
        gap = spots[near + k] - spots[near]
        wide = gap >= 3 * t - 1
        at.append(spots[near[wide]])
        period.append(gap[wide])
    none = np.zeros(0, dtype=np.int64)
    at, period = np.concatenate([none, *at]), np.concatenate([none, *period])
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), dtype=bool)  # places of one period at most 2t apart are in one stretch
    new[1:] = (period[1:] != period[:-1]) | (at[1:] - at[:-1] > 2 * t)
    return at[new], period[new]


def _by_regions(prints: Prints, t: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) proposed by neighbouring regions of one small period that touch or overlap."""
    calm = known[(3 * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= 3 * t - 1)]
    calm = calm[np.lexsort((calm[:, 0], calm[:, 2]))]
    one, two = calm[:-1], calm[1:]
    meet = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1])
    one, two = one[meet], two[meet]
    most = np.minimum(6 * t - 2, np.minimum(one[:, 1] - one[:, 0], two[:, 1] - two[:, 0]))
    number = np.maximum(most - (3 * t - 1) + 1, 0)
    pair = np.repeat(np.arange(len(number)), number)
    period = np.arange(len(pair)) - np.repeat(np.cumsum(number) - number, number) + 3 * t - 1
    at = np.maximum(one[pair, 0], two[pair, 0] - period)
    fits = at + period + one[pair, 2] <= prints.n
    at, period, small = at[fits], period[fits], one[pair[fits], 2]
    same = prints.of(at, small) == prints.of(at + period, small)
    return at[same], period[same]


def find_runs(codes: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs of at least ``least`` codes, by start and end; no stretch of equal codes that are
    worth comparing is longer than ``longest``."""
    known = _distinct(_small(codes))
    t = 4
    if 2 * (3 * t - 1) <= longest:
        prints = Prints(codes)
    while 2 * (3 * t - 1) <= longest and 2 * t <= len(codes):
        proposed = [_by_context(prints, t, known), _by_regions(prints, t, known)]
        at, period = (np.concatenate([p[k] for p in proposed]) for k in (0, 1))
        start = at - prints.common(at, at + period, longest, back=True)
        end = at + period + prints.common(at, at + period, longest)
        twice = end - start >= 2 * period
        known = _distinct([known, np.stack([start[twice], end[twice], period[twice]], axis=1)])
        t *= 2
    return known[known[:, 1] - known[:, 0] >= least]


def planted_repeat(doc_id: int | None, n: int) -> tuple[int, int]:
    """(first word, period) from which the words of a document repeat by its id's checksum; (n, 1) where they don't."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return n, 1
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _scan(least: int, planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whitespace_words()
        case = np.arange(256, dtype=np.uint8)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, end, data, offsets in slices(batch.column("text")):
                starts, ends, bounds = words(data, offsets, table)
                sizes = np.diff(bounds)
                source = np.arange(len(starts))
                if planted:
                    for k in range(len(sizes)):
                        a, p = planted_repeat(ids[row + k], int(sizes[k]))
                        if a < sizes[k]:
                            source[bounds[k] + a : bounds[k + 1]] = bounds[k] + a + np.arange(sizes[k] - a) % p
                # One code for each word, and one that occurs nowhere else behind each text.
                at = bounds[:-1] + np.arange(len(sizes))
                place = np.arange(len(source)) + np.repeat(np.arange(len(sizes)), sizes)
                codes = mix(np.arange(len(source) + len(sizes), dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
                codes[place] = mix(word_hashes(data, starts, ends, case))[source]
                runs = find_runs(codes, int(sizes.max(initial=0)), least)
                drop = np.zeros(len(codes) + 1, dtype=np.int32)
                np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
                np.add.at(drop, runs[:, 1], -1)
                kept = np.cumsum(drop[:-1])[place] == 0
                doc = np.searchsorted(at, runs[:, 0], side="right") - 1
                own = np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - at[doc], runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(RUNS.value_type))
                raw, texts = data.tobytes(), []
                for k in range(len(sizes)):
                    of = raw[offsets[k] : offsets[k + 1]].split()
                    chosen = kept[bounds[k] : bounds[k + 1]]
                    moved = source[bounds[k] : bounds[k + 1]][chosen] - bounds[k]
                    texts.append(b" ".join(of) if planted_nothing(moved, len(of)) else b" ".join([of[i] for i in moved]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(own), parts).cast(RUNS), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def planted_nothing(moved: np.ndarray, n: int) -> bool:
    """Whether all n words stand where they stood."""
    return len(moved) == n and bool((moved == np.arange(n)).all())


def collapse_runs(docs: DataFrame, least: int = LEAST, planted: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, ``runs`` (start in words, length, period; by start, then length) and ``collapsed``,
    the words that no run holds after its first period, joined by one space. With ``planted``, every tenth document first
    gets a repeat that its id determines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(docs).alias("text"))
    found = rows.mapInArrow(_scan(least, planted), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
