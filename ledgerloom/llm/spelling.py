"""Spelling variants: words that differ in one code point, each led to its much more frequent form.

Words are maximal runs of A-Z, a-z and U+00C0-U+00FF, lower-cased in A-Z, of at least ``LETTERS`` code points and
``TWICE`` occurrences in all texts.

1. Tasks count the words of their texts before anything is shuffled; sums by word give the vocabulary, a written table.
2. The vocabulary goes into blocked Bloom filters, sharded by length and, where a length has many words, by hash; a block
   is 64 bytes, of which a word sets six bits. Pages of a filter are built in tasks of their own. No more than
   ``MOST_BYTES`` are broadcast at a time: larger vocabularies take several rounds, each with some of the shards.
3. Edits of each word are looked up in the filter of their length: its deletions in the one below, and, in its own, its
   replacements by a greater letter that the vocabulary has. The other halves are the same pairs seen from the other word.
   Hashes of edits come from sums over the word's letters, without building the strings.
4. Only edits that pass are spelled out and joined, exactly, with the vocabulary. That drops the false ones.
5. A word's form is its near word of the largest count (ties: smallest in code-point order), if that is at least
   ``FACTOR`` times its own. Forms are followed by pointer doubling; counts grow tenfold each step, so that a chain over 64-bit
   counts has fewer than twenty words and no cycle.

Null texts have no words; a null doc_id takes part with its runs unchanged in ``damaged`` counting; repeated rows count
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrays import mix, slices
from ._spark import clean_text, materialize

LETTERS = 7
TWICE = 2
FACTOR = 10
#: Bytes of filters that are broadcast at a time.
MOST_BYTES = 64 << 20
#: Bits of a filter for each word.
BITS = 16
#: Words of one page, about, and pages of one shard at most.
PAGE_WORDS, SHARD_PAGES = 1 << 15, 64
BLOCK = 8  # 64-bit words
PROBES = 6
#: Letters or edits looked at together.
CHUNK = 1 << 20
#: Counted words that a task holds before it sends them.
HELD = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LETTERS)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def damage(run: bytes, seed: int) -> bytes:
    """The run as it counts: by a checksum of the document's id and the run, one in 31 loses a code point.
    ``seed`` is the checksum of the id and a colon."""
    h = zlib.crc32(run, seed)
    if h % 31:
        return run
    letters = run.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def _count(damaged: bool, letters: int):
    run_of = RUN if letters == LETTERS else re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % letters)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, _, data, offsets in slices(batch.column("text")):
                raw = data.tobytes().translate(LOWER)
                for k in range(len(offsets) - 1):
                    found = Counter(run_of.findall(raw, int(offsets[k]), int(offsets[k + 1])))
                    if damaged and ids[row + k] is not None:
                        seed = zlib.crc32(b"%d:" % ids[row + k])
                        for w, n in found.items():
                            if zlib.crc32(w, seed) % 31 == 0:
                                w = damage(w, seed)
                                if len(w.decode()) < letters:
                                    continue
                            held[w] += n
                    else:
                        held.update(found)
                    if len(held) >= HELD:
                        yield rows(held)
                        held.clear()
        if held:
            yield rows(held)

    return run


def vocabulary(docs: DataFrame, damaged: bool = False, letters: int = LETTERS, least: int = TWICE) -> DataFrame:
    """(word, n): the words of the texts and their occurrences, n of at least ``least``. With ``damaged``, one run in 31 of
    a document counts without one of its letters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(docs).alias("text"))
    return rows.mapInArrow(_count(damaged, letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def by_size(words: list[str], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indexes of the words, their code points as rows), in pieces of ``most`` letters or one word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    k = 0
    while k < len(order):
        size = int(sizes[order[k]])
        end = min(int(np.searchsorted(sizes[order], size, side="right")), k + max(1, most // max(size, 1)))
        codes = np.frombuffer("".join(words[i] for i in order[k:end]).encode("utf-16-le"), dtype=np.uint16)
        yield size, order[k:end], codes.reshape(end - k, size)
        k = end


def _letter(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))


def _powers(n: int) -> np.ndarray:
    row = np.full(n, BASE, dtype=np.uint64)
    row[:1] = 1
    return np.multiply.accumulate(row)


def word_codes(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of letters: their sum by place, mixed with the length."""
    size = codes.shape[1]
    return mix((_letter(codes) * _powers(size)).sum(axis=1, dtype=np.uint64) + np.uint64(size))


class Shards:
    """Where a word of a length goes: lengths with few words have one shard, others several, by hash; a shard has pages."""

    def __init__(self, counts: dict[int, int]):
        self.pages = {size: max(1, -(-n // PAGE_WORDS)) for size, n in counts.items()}
        self.shards = {size: -(-p // SHARD_PAGES) for size, p in self.pages.items()}

    def page(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """The page of the length's filter, over all its shards; a shard holds SHARD_PAGES in a row."""
        return ((hashes >> np.uint64(32)) % np.uint64(self.pages[size])).astype(np.int64)

    def rounds(self, most: int) -> list[list[tuple[int, int, int]]]:
        """Shards as (length, first page, end page), in groups of ``most`` bytes at most (one shard, at least)."""
        out, held = [], 0
        for size in sorted(self.pages):
            for k in range(self.shards[size]):
                one = (size, k * SHARD_PAGES, min((k + 1) * SHARD_PAGES, self.pages[size]))
                need = (one[2] - one[1]) * PAGE_BYTES
                if not out or held + need > most:
                    out.append([])
                    held = 0
                out[-1].append(one)
                held += need
        return out


PAGE_BYTES = PAGE_WORDS * BITS // 8
PAGE_BLOCKS = PAGE_BYTES // (8 * BLOCK)


def bits_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block within the page, and the PROBES bits (0-511) within the block."""
    block = ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(PAGE_BLOCKS)).astype(np.int64)
    more = mix(hashes + np.uint64(0xA0761D6478BD642F))
    return block, np.stack([((more >> np.uint64(9 * k)) & np.uint64(511)).astype(np.int64) for k in range(PROBES)])


def fill_page(hashes: np.ndarray) -> bytes:
    block, bits = bits_of(hashes)
    flags = np.zeros(PAGE_BYTES * 8, dtype=bool)
    for b in bits:
        flags[block * 512 + b] = True
    return np.packbits(flags).tobytes()


def passes(table: np.ndarray, page: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets pass; ``page`` counts from the table's first."""
    block, bits = bits_of(hashes)
    base = page * (PAGE_BYTES * 8) + block * 512
    left = np.arange(len(hashes))
    for b in bits:
        slot = base[left] + b[left]
        left = left[(table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1]
    return left


def _pages(shards: Shards):
    """(size, page, hash) of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, codes in by_size(batch.column("word").to_pylist(), CHUNK):
                hashes = word_codes(codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), size, dtype=np.int32)), pa.array(shards.page(size, hashes)), pa.array(hashes.view(np.int64))], ["size", "page", "hash"])

    return run


def _fill(table: pa.Table) -> pa.Table:
    bits = fill_page(table.column("hash").to_numpy().view(np.uint64))
    return pa.table({"size": table.column("size")[:1], "page": table.column("page")[:1], "bits": pa.array([bits], pa.binary())})


def _probe(shared, shards: Shards, group: list[tuple[int, int, int]], alphabet: np.ndarray):
    """(word, n, near): edits that pass the filters of this round, spelled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [(size, a, b, np.frombuffer(bits, dtype=np.uint8)) for (size, a, b), bits in zip(group, shared.value)]
        letters = _letter(alphabet)
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            at, near = [], []
            for size, some, own in by_size(words, CHUNK // (len(alphabet) + 1)):
                power = _powers(size)
                terms = _letter(own) * power
                whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
                before = np.cumsum(terms, axis=1, dtype=np.uint64)  # with the letter itself
                places = max(1, CHUNK // ((len(alphabet) + 1) * len(some)))
                for length, first, end, table in filters:
                    for j0 in range(0, size if size - length in (0, 1) else 0, places):
                        j1 = min(size, j0 + places)
                        if length == size:
                            edited = (whole - terms[:, j0:j1])[:, :, None] + letters * power[None, j0:j1, None]
                            wanted = alphabet[None, None, :] > own[:, j0:j1, None]
                        else:
                            edited = ((before - terms)[:, j0:j1] + (whole - before[:, j0:j1]) * UNBASE)[:, :, None]
                            wanted = np.ones(edited.shape, dtype=bool)
                            wanted[:, max(0, 1 - j0) :, 0] = own[:, max(j0, 1) : j1] != own[:, max(j0, 1) - 1 : j1 - 1]  # equal neighbours give the same word
                        spot = np.flatnonzero(wanted)
                        hashes = mix(edited.reshape(-1)[spot] + np.uint64(length))
                        page = shards.page(length, hashes)
                        here = np.flatnonzero((page >= first) & (page < end))
                        hit = spot[here[passes(table, page[here] - first, hashes[here])]]
                        for a, b, c in zip(*(x.tolist() for x in np.unravel_index(hit, wanted.shape))):
                            word = words[some[a]]
                            at.append(int(some[a]))
                            near.append(word[: j0 + b] + (chr(alphabet[c]) if length == size else "") + word[j0 + b + 1 :])
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.string()), pa.array(counts[at], pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])

    return run


def neighbours(words: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(word, n, near, near_n): all pairs of words (a written table of word, n) that differ in exactly one code point
    inserted, deleted or replaced, in both directions."""
    spark = words.sparkSession
    sizes = {r.size: r.n for r in words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).toLocalIterator()}  # a row for each length
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.toLocalIterator()), dtype=np.uint16)  # 90 at most
    shards = Shards(sizes)
    hashes = words.select("word").mapInArrow(_pages(shards), "size int, page long, hash long")
    pages = materialize(hashes.groupBy("size", "page").applyInArrow(_fill, "size int, page long, bits binary"), "filters")
    found = None
    for group in shards.rounds(most_bytes):
        chosen = None
        for size, first, end in group:
            one = (F.col("size") == size) & F.col("page").between(first, end - 1)
            chosen = one if chosen is None else chosen | one
        filters = {(size, first, end): np.zeros((end - first) * PAGE_BYTES, dtype=np.uint8) for size, first, end in group}
        starts = {(size, p): (key, p - key[1]) for key in group for size in key[:1] for p in range(key[1], key[2])}
        for row in pages.where(chosen).toLocalIterator():
            key, k = starts[row["size"], row.page]
            filters[key][k * PAGE_BYTES : (k + 1) * PAGE_BYTES] = np.frombuffer(row.bits, dtype=np.uint8)
        shared = spark.sparkContext.broadcast([filters[key].tobytes() for key in group])
        lengths = sorted({s for size, _, _ in group for s in (size, size + 1)})
        probing = words.where(F.length("word").isin(lengths)).repartition("word") if lengths else words
        passed = probing.mapInArrow(_probe(shared, shards, group, alphabet), "word string, n long, near string")
        found = passed if found is None else found.union(passed)
    if found is None:
        return words.select("word", "n", F.lit("").alias("near"), F.lit(0).cast("long").alias("near_n")).limit(0)
    real = materialize(found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"), "near")
    return real.union(real.select("near", "near_n", "word", "n"))


def spelling_forms(words: DataFrame, factor: int = FACTOR, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per word of the written table (word, n): word, form, root, n, n_near and form_n."""
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    near = neighbours(words, most_bytes).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    led = F.col("best.near_n") >= factor * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(led, F.col("best.near")).alias("form"), F.when(led, F.col("best.near_n")).alias("form_n")), "forms")
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    rows = words.join(near, "word", "left").join(links, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """The vocabulary of the texts with each word's form and root."""
    return spelling_forms(materialize(vocabulary(docs, damaged), "vocabulary"))
