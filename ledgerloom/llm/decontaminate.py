"""Benchmark decontamination over a distributed positional inverted index.

An item's windows are its runs of ``length`` words (an item of fewer words is one window). Words are runs of ASCII
letters, digits and non-ASCII characters, lower-cased in A-Z.

1. Corpus frequencies of the windows' terms are counted (per task first).
2. Each window gets its two rarest positions. The index stores the postings (row, position, term) of window terms
   that stand less than ``length + slack`` words from such a rarest term, the only ones that a match can touch (a
   phrase: ``slack`` 0).
3. The posting lists of a window's rarest terms, shifted by their offsets, are intersected to candidate starts; the
   other offsets' lists are intersected from there. A start that all offsets confirm is an exact match.

``proximity`` returns windows whose distinct words all stand, in any order, in a span of at most ``slack`` more words
than the window has. It looks at the words around each place of a window's rarest term that has its second rarest
near it.

A term filter of fixed size travels with the tasks; what passes it by accident is dropped by the later joins.
Null texts have no words; null item_ids name no item; rows with the same doc_id are handled each for itself; empty
tables give no hits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrays import alnum_words, hash_words, long_lists
from ._spark import anti_join, clean_text, fresh, materialize

LENGTH = 10
#: Words that a proximity match may have more than its window.
SLACK = 5
#: Rarest and second rarest term must stand in this stretch of words, or in two that touch, before their words are looked at.
STRETCH = 256
#: Bits of the term filter, 2 MB.
FILTER_BITS = 1 << 24


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, _, hashes, bounds in hash_words(batch.column("text"), alnum_words()):
            rows += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), long_lists(rows)], ["item_id", "terms"])


def windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(window, terms, items): distinct windows with the sorted ids of the items that have them."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), clean_text(items).alias("text"))
    terms = rows.mapInArrow(_item_words, "item_id string, terms array<long>").where(F.size("terms") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - length + 1, F.lit(1)))
    runs = terms.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("terms", i, length))).alias("terms"))
    return runs.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("window", F.xxhash64("terms"))




def term_filter(terms: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits with one bit set for each term, put together by 4096-byte pages."""
    page = FILTER_BITS // 512
    slots = terms.select(F.shiftrightunsigned("term", 40).alias("slot")).distinct()
    pages = slots.groupBy((F.col("slot") / page).cast("int").alias("page")).agg(F.collect_set((F.col("slot") % page).cast("int")).alias("bits"))

    def pack(batches):
        for pdf in batches:
            out = []
            for bits in pdf.bits:
                flags = np.zeros(page, dtype=bool)
                flags[np.asarray(bits, dtype=np.int64)] = True
                out.append(np.packbits(flags).tobytes())
            yield pd.DataFrame({"page": pdf.page, "bits": out})

    whole = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in pages.mapInPandas(pack, "page int, bits binary").toLocalIterator():  # 512 pages at most
        whole[row.page * page // 8 : (row.page + 1) * page // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return whole.tobytes()


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes >> np.uint64(40)).astype(np.int64)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def _count_terms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for _, _, hashes, _ in hash_words(batch.column("text"), alnum_words()):
                terms, n = np.unique(hashes[_passes(bitmap, hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return run


def _postings(shared_rare, shared_all, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_bits, all_bits = (np.frombuffer(s.value, dtype=np.uint8) for s in (shared_rare, shared_all))
        for batch in batches:
            counts, spots, terms = [], [], []
            for _, _, hashes, bounds in hash_words(batch.column("text"), alnum_words()):
                hit = np.flatnonzero(_passes(rare_bits, hashes))
                near = np.zeros(len(hashes) + 1, dtype=np.int32)
                if len(hit):  # words within reach of a rare term
                    np.add.at(near, np.maximum(hit - reach + 1, 0), 1)
                    np.add.at(near, np.minimum(hit + reach, len(hashes)), -1)
                kept = (np.cumsum(near[:-1]) > 0) if len(hit) else np.zeros(len(hashes), dtype=bool)
                kept = np.flatnonzero(kept)
                kept = kept[_passes(all_bits, hashes[kept])]
                at = np.searchsorted(kept, bounds)
                for k in range(len(bounds) - 1):
                    own = kept[at[k] : at[k + 1]]
                    counts.append(bounds[k + 1] - bounds[k])
                    spots.append(own - bounds[k])
                    terms.append(hashes[own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(counts, dtype=np.int64)), long_lists(spots), long_lists(terms)], ["doc_id", "row_key", "n_words", "spots", "terms"])

    return run


class PositionalIndex:
    """Postings of a corpus for a set of windows, and the phrase and proximity searches over them."""

    def __init__(self, docs: DataFrame, items: DataFrame, length: int = LENGTH, slack: int = SLACK):
        spark = docs.sparkSession
        self.length, self.slack = length, slack
        self.windows = materialize(windows(items, length), "windows")
        places = self.windows.select("window", F.posexplode("terms").alias("offset", "term"))
        self.places = materialize(places, "places")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), clean_text(docs).alias("text"))
        terms = self.places.select("term").distinct()
        every = spark.sparkContext.broadcast(term_filter(terms))
        counted = rows.select("text").mapInArrow(_count_terms(every), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        self.frequencies = materialize(terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "terms")
        ranked = self.places.join(self.frequencies, "term").groupBy("window").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))), 1, 2).alias("rarest"))
        self.rarest = materialize(ranked.select("window", F.col("rarest")[0].alias("one"), F.try_element_at("rarest", F.lit(2)).alias("two")), "rarest")
        rare = self.rarest.select(F.col("one.term").alias("term")).distinct()
        some = spark.sparkContext.broadcast(term_filter(rare))
        index = rows.mapInArrow(_postings(some, every, length + slack), "doc_id long, row_key long, n_words long, spots array<long>, terms array<long>")
        self.index = materialize(index.withColumn("row_id", F.monotonically_increasing_id()), "index")
        self.postings = self.index.where(F.size("spots") > 0).select("row_id", F.explode(F.arrays_zip("spots", "terms")).alias("p")).select("row_id", F.col("p.spots").alias("spot"), F.col("p.terms").alias("term"))

    def phrases(self) -> DataFrame:
        """(window, row_id, start): every exact occurrence of every window."""
        starts = lambda which: self.rarest.select("window", F.col(f"{which}.term").alias("term"), F.col(f"{which}.offset").alias("offset")).where("term is not null").join(self.postings, "term").select("window", "row_id", (F.col("spot") - F.col("offset")).alias("start")).where("start >= 0")
        lone = self.rarest.where("two is null").select("window")
        one = starts("one")
        both = one.join(starts("two"), ["window", "row_id", "start"], "left_semi")
        both = both.union(one.join(lone, "window", "left_semi"))
        both = materialize(both, "starts")
        wanted = both.join(self.places, "window").select("window", "row_id", "start", (F.col("start") + F.col("offset")).alias("spot"), "term")
        found = wanted.join(self.postings, ["row_id", "spot", "term"], "left_semi").groupBy("window", "row_id", "start").agg(F.count("*").alias("n"))
        sizes = self.windows.select("window", F.size("terms").alias("size"))
        return found.join(sizes, "window").where("n = size").select("window", "row_id", "start", "size")

    def proximity(self, slack: int = SLACK) -> DataFrame:
        """(window, row_id, start, size): for each place of a window's words the least span that ends there and holds all of
        the window's distinct terms, in any order, if it has at most as many words as the window and ``slack``."""
        if slack > self.slack:
            raise ValueError(f"the index has postings for a slack of {self.slack} only")
        far = self.length + slack - 1
        spots = lambda which: self.rarest.select("window", F.col(f"{which}.term").alias("term")).where("term is not null").join(self.postings, "term")
        stretch = lambda place: F.floor(place / STRETCH).cast("int")
        lone = self.rarest.where("two is null").select("window")
        one = spots("one").select("window", "row_id", F.col("spot").alias("centre"))
        reached = one.withColumn("stretch", F.explode(F.sequence(stretch(F.col("centre") - far), stretch(F.col("centre") + far))))
        both = reached.join(spots("two").select("window", "row_id", stretch(F.col("spot")).alias("stretch")), ["window", "row_id", "stretch"], "left_semi")
        both = both.drop("stretch").union(one.join(lone, "window", "left_semi")).distinct()
        both = materialize(both, "centres")
        around = both.select("row_id", "centre").distinct().withColumn("spot", F.explode(F.sequence(F.col("centre") - far, F.col("centre") + far)))
        # Spark's size estimate doesn't count the exploded places, so that it would broadcast them.
        around = around.hint("merge").join(self.postings, ["row_id", "spot"]).groupBy("row_id", "centre").agg(F.collect_list(F.struct((F.col("spot") - F.col("centre")).alias("at"), "term")).alias("near"))
        sized = both.join(self.windows.select("window", F.size("terms").alias("size"), F.array_distinct("terms").alias("terms")), "window")
        rows = sized.join(around, ["row_id", "centre"]).select("window", "row_id", "centre", "size", "terms", F.col("near.at").alias("at"), F.col("near.term").alias("near"))
        return rows.mapInArrow(_spans(far, slack), "window long, row_id long, start long, size int").distinct()


def _spans(far: int, slack: int):
    """Proximity matches around each centre, from the words (at: place less the centre, near: term) within ``far`` of it."""
    width, none = 2 * far + 1, -(1 << 40)

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), column.flatten().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, row_id, centre, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("window", "row_id", "centre", "size"))
            near, held = np.zeros((len(window), width), dtype=np.int64), np.zeros((len(window), width), dtype=bool)
            (row, _, at), (_, _, term) = flat(batch.column("at")), flat(batch.column("near"))
            near[row, at + far], held[row, at + far] = term, True
            row, k, term = flat(batch.column("terms"))
            place = np.arange(width, dtype=np.int64)[None, :]
            start, own = np.full(near.shape, 1 << 40, dtype=np.int64), np.zeros(near.shape, dtype=bool)
            for j in range(int(k.max(initial=-1)) + 1):
                some, word = row[k == j], term[k == j]
                same = held[some] & (near[some] == word[:, None])
                own[some] |= same
                start[some] = np.minimum(start[some], np.maximum.accumulate(np.where(same, place, none), axis=1))
            i, end = np.nonzero(own & (start >= 0) & (place - start < size[:, None] + slack))
            first = start[i, end]
            yield pa.RecordBatch.from_arrays([pa.array(window[i]), pa.array(row_id[i]), pa.array(centre[i] + first - far), pa.array((end - first + 1).astype(np.int32))], ["window", "row_id", "start", "size"])

    return run


def _hits(index: PositionalIndex, found: DataFrame, n_hit: str = "n_hit", items: str = "items") -> DataFrame:
    """row_id, number of words inside any of the matches found, and their items; documents with a match only."""
    found = materialize(found, "found")
    hit = found.select("row_id", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("spot")).distinct().groupBy("row_id").agg(F.count("*").alias(n_hit))
    named = found.select("row_id", "window").distinct().join(index.windows.select("window", F.explode("items").alias("item")), "window").select("row_id", "item").distinct()
    named = named.groupBy("row_id").agg(F.array_sort(F.collect_set("item")).alias(items))
    return materialize(hit.join(named, "row_id", "left"), "hits")


def _per_document(index: PositionalIndex, *hits: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_key, n_words and the columns of each of hits, 0 and empty where it has no row."""
    rows = index.index.select("row_id", "doc_id", "row_key", "n_words")
    for h in hits:
        n, items = h.columns[1:]
        rows = rows.join(h, "row_id", "left").withColumns({n: F.coalesce(n, F.lit(0)), items: F.coalesce(items, F.array().cast("array<string>"))})
    return rows.drop("row_id")


def contaminated_documents(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, row_key, n_words, n_hit (words inside any occurrence of a window) and its items."""
    index = PositionalIndex(docs, items, length, slack=0)
    return _per_document(index, _hits(index, index.phrases()))


def near_documents(docs: DataFrame, items: DataFrame, length: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """As contaminated_documents, for proximity matches; exact ones are among them."""
    index = PositionalIndex(docs, items, length, slack)
    return _per_document(index, _hits(index, index.proximity(slack)))


def matched_documents(docs: DataFrame, items: DataFrame, length: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """contaminated_documents with n_near and near_items, which are those of near_documents, from one index."""
    index = PositionalIndex(docs, items, length, slack)
    return _per_document(index, _hits(index, index.phrases()), _hits(index, index.proximity(slack), "n_near", "near_items"))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents in which no window of the items occurs."""
    key = fresh(docs, "row_key")
    hit = contaminated_documents(docs, items, length).where("n_hit > 0").select(F.col("row_key").alias(key)).distinct()
    return anti_join(docs.withColumn(key, F.xxhash64("doc_id", "text")), materialize(hit, "contaminated"), key).drop(key)
