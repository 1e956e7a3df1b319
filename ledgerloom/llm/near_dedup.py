"""Near-duplicate documents by HyperMinHash signatures, banded, estimated and then verified on whole shingle sets.

A document's set holds the hashes of its distinct runs of five words (fewer words: the whole sequence is one). Each of
128 buckets has a hash of its own; of a bucket's least hash only the leading-zero count (6 bits) and the 10 bits after
the leading one are stored, in a 16-bit register. Four registers make a band, so a band is one 64-bit key.

Documents with equal sets are one node. Nodes meet in the buckets of a band's key, first all with the bucket's least
node (linear in the bucket). Where a bucket still holds several components, all pairs of different components are
compared if it has ``SMALL`` nodes at most. Larger ones get up to ``LEADERS`` further rounds with another node of each
bucket; what then is unsettled meets by rare shingles: two sets at or above the threshold share one of the
n - ceil(t n) + 1 shingles of each that fewest of these sets have, whatever the number of nodes. Groups of such a
shingle that are still larger than ``SMALL`` are compared in blocks of bounded size, where only links that join two
components leave the task. Pairs whose collision-corrected estimate is near the threshold or above are confirmed on the
full sets. No bucket is cut; a pair at 0.75 is missed only if none of the 32 bands is common, a chance of 5e-6.

Null or empty texts have an empty set and link with nothing. A null doc_id takes part, but can't name a component
(a component without any doc_id has a null one). Rows with the same doc_id stay rows of their own. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ._arrays import hash_words, long_lists, mix, ngrams, whitespace_words
from ._spark import anti_join, clean_text, discard, fresh, materialize, semi_join

SHINGLE = 5
REGISTERS = 128
BAND = 4
MANTISSA = 10
#: How far below the threshold an estimate may lie to be verified: over five standard deviations.
MARGIN = 0.2
#: Nodes of a bucket that are paired with each other in rows; larger buckets are compared in blocks.
SMALL = 24
#: Rounds with another leader for buckets beyond SMALL.
LEADERS = 1
#: Shingles in one block of a group, about.
BLOCK = 1 << 18
#: Expected share of equal registers of unrelated sets of one size, times 2**MANTISSA (HyperMinHash paper).
COLLISION = 0.16991948715973909


def seeds() -> tuple[np.ndarray, np.ndarray]:
    """Multiplier and addend of each bucket's hash."""
    k = np.arange(1, REGISTERS + 1, dtype=np.uint64)
    return mix(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(k + np.uint64(0x1234567))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, hashes, bounds in hash_words(column, whitespace_words()):
        grams = ngrams(hashes, SHINGLE)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            else:
                yield ngrams(hashes[a:b], b - a) if b > a else grams[:0]


def registers(found: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: leading zeros of each bucket's least hash, then its next bits."""
    up, add = seeds()
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 512):
        x = found[i : i + 512, None] * up[None, :]
        x += add[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=0), out=least)
    bits = np.frexp((least >> np.uint64(11)).astype(np.float64))[1]  # 53 bits are exact in a double
    zeros = np.minimum(53 - bits, 52)
    after = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | after).astype(np.uint16)


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(found):
        return 0, 0
    return int(np.add.reduce(found).view(np.int64)), int(np.bitwise_xor.reduce(mix(found)).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, regs = [], []
        for found in shingle_sets(batch.column("text")):
            rows.append((len(found), *fingerprint(found)))
            regs.append(registers(found).tobytes() if len(found) else None)
        n, a, b = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, dtype=np.int64),) * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(n), pa.array(a), pa.array(b), pa.array(regs, pa.binary())], ["doc_id", "row_key", "n_shingles", "set_a", "set_b", "regs"])


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: row_id, doc_id, row_key, n_shingles, set_a, set_b (the set's name) and the registers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), clean_text(docs).alias("text"))
    out = rows.mapInArrow(_sign, "doc_id long, row_key long, n_shingles long, set_a long, set_b long, regs binary")
    return out.withColumn("row_id", F.monotonically_increasing_id())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets(batch.column("text")))
        for i in range(0, len(found), 500):
            part = found[i : i + 500]
            names = np.array([fingerprint(s) for s in part], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), long_lists(part)], ["set_a", "set_b", "shingles"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(regs: pd.Series) -> pd.Series:
    """The 64-bit key of each band, told apart by the band's number."""
    table = np.frombuffer(b"".join(regs), dtype=np.uint64).reshape(len(regs), REGISTERS // BAND)
    return pd.Series(list(mix(table + np.arange(table.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)))


def corrected(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, without the accidental ones."""
    low, high = np.minimum(n, m).astype(float), np.maximum(n, m).astype(float)
    chance = COLLISION / (1 << MANTISSA) * 4 * (low / high) / (1 + low / high) ** 2
    return np.maximum(0.0, (equal / REGISTERS - chance) / (1 - chance))


@F.pandas_udf(T.DoubleType())
def estimate(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Collision-corrected similarity of two signatures."""
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), REGISTERS) for s in (a, b))
    return pd.Series(corrected((x == y).sum(axis=1), n.to_numpy(), m.to_numpy()))


def _near_size(n: Column, m: Column, percent: int) -> Column:
    """Sets so different in size can't be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _block_links(percent: int):
    """Links between two blocks of one bucket (or inside one), as many as join components that weren't joined before."""

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[1]), int(key[2])
        one = np.flatnonzero(pdf.block.to_numpy() == i)
        two = np.flatnonzero(pdf.block.to_numpy() == j)
        regs = np.frombuffer(b"".join(pdf.regs), dtype=np.uint16).reshape(len(pdf), REGISTERS)
        sizes = np.array([len(x) for x in pdf.shingles])
        names, flat = np.unique(np.concatenate(pdf.shingles.to_numpy()), return_inverse=True)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        theirs = np.concatenate([flat[ends[y] : ends[y + 1]] for y in two])
        starts = np.concatenate(([0], np.cumsum(sizes[two])[:-1]))
        comp, nodes, n = pdf.comp.to_numpy().copy(), pdf.node.to_numpy(), pdf.n.to_numpy()
        own, found = np.zeros(len(names), dtype=bool), []
        for x in one:
            equal = (regs[two] == regs[x]).sum(axis=1)
            likely = (corrected(equal, np.full(len(two), n[x]), n[two]) >= percent / 100 - MARGIN) & (comp[two] != comp[x])
            if i == j:
                likely &= nodes[two] > nodes[x]
            if not likely.any():
                continue
            own[flat[ends[x] : ends[x + 1]]] = True
            common = np.add.reduceat(own[theirs], starts, dtype=np.int64)
            own[flat[ends[x] : ends[x + 1]]] = False
            for y in two[likely & (common * 100 >= (n[x] + n[two] - common) * percent)]:
                if comp[y] != comp[x]:
                    found.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
                    comp[comp == max(comp[x], comp[y])] = min(comp[x], comp[y])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that has an edge (a, b); comp is the least node reachable. Alternating stars."""
    pairs = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        middle = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(middle, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        old, pairs = (pairs, large), materialize(small, "edges")
        discard(*old)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(pairs.select("b", "b").distinct())
        before = now


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, found on the components alone."""
    of = lambda p: comp.select(F.col("node").alias(p), F.col("comp").alias(f"c_{p}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    moved = components(between)
    known = comp.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return materialize(known.union(moved.join(comp.select("node"), "node", "left_anti").select("node", "comp")), "components")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes that pass the estimate and then the comparison of their whole sets."""
    side = lambda p: nodes.select(F.col("node").alias(p), F.col("regs").alias(f"regs_{p}"), F.col("n").alias(f"n_{p}"), F.col("set_a").alias(f"x_{p}"), F.col("set_b").alias(f"y_{p}"), F.col("row_key").alias(f"k_{p}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(_near_size(F.col("n_a"), F.col("n_b"), percent))
    likely = likely.where(estimate("regs_a", "regs_b", "n_a", "n_b") >= percent / 100 - MARGIN).drop("regs_a", "regs_b")
    likely = materialize(likely, "likely")
    keys = likely.select(F.col("k_a").alias("row_key")).union(likely.select("k_b")).distinct()
    sets = _shingles(keys, docs)
    of = lambda p: sets.select(F.col("set_a").alias(f"x_{p}"), F.col("set_b").alias(f"y_{p}"), F.col("shingles").alias(f"s_{p}"))
    both = likely.join(of("a"), ["x_a", "y_a"]).join(of("b"), ["x_b", "y_b"])
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b").distinct()


def _shingles(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_a, set_b, shingles) of the documents with these row keys."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), clean_text(docs).alias("text"))
    chosen = semi_join(rows, materialize(keys, "keys"), "row_key").select("text")
    return chosen.mapInArrow(_sets, "set_a long, set_b long, shingles array<long>")


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id (the class's least doc_id) and keep (one row of each class is kept).

    ``docs`` needs doc_id and text. Documents link where the Jaccard similarity of their sets is ``threshold`` or more."""
    percent = round(threshold * 100)
    sigs = materialize(signatures(docs), "signatures")
    full = sigs.where("n_shingles > 0")
    named = full.groupBy("set_a", "set_b").agg(F.min("row_id").alias("node"))
    named = materialize(named, "named")
    nodes = full.join(named.select(F.col("node").alias("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("node"), F.col("n_shingles").alias("n"), "set_a", "set_b", "row_key", "regs")
    nodes = materialize(nodes, "nodes")
    bands = materialize(_shared(nodes.select("node", "n", F.explode(band_keys("regs")).alias("key"))), "bands")

    lead = bands.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    edges = materialize(_verified(lead, nodes, docs, percent), "links")
    comp = components(edges)

    left = materialize(_unsettled(bands, comp), "left")
    for turn in range(LEADERS):
        large = left.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        links = materialize(_verified(_leaders(large, turn, percent), nodes, docs, percent), "links")
        if links.isEmpty():
            continue
        comp = _joined(comp, links)
        left = materialize(_unsettled(bands.join(left.select("key").distinct(), "key", "left_semi"), comp), "left")
    pairs = _within(left.where((F.col("size") <= SMALL) & (F.col("node") != F.col("first"))), percent)  # the first has met all
    large = left.where(F.col("size") > SMALL)
    more = None
    if not large.isEmpty():
        groups = materialize(_by_rare_shingles(large, nodes, docs, percent), "groups")
        pairs = pairs.union(_within(groups.where(F.col("size") <= SMALL), percent)).distinct()
        more = materialize(_in_blocks(groups.where(F.col("size") > SMALL).select("key", "node", "n", "comp"), nodes, docs, percent), "blocks")
    pairs = materialize(pairs, "pairs")
    if not pairs.isEmpty():
        found = _verified(pairs, nodes, docs, percent)
        more = materialize(found if more is None else more.union(found), "links")
    if more is not None and not more.isEmpty():
        comp = _joined(comp, more)
    return _classes(sigs, named, comp)


def _shared(bands: DataFrame) -> DataFrame:
    """Only keys that several nodes have, with the least of these nodes."""
    bands = materialize(bands, "keys")
    keys = materialize(bands.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1").drop("size"), "shared")
    return bands.join(keys, "key")


def _settle(rows: DataFrame) -> DataFrame:
    """Buckets (key) that hold more than one component, with their number of nodes."""
    rows = materialize(rows, "rows")
    keys = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("first")).where("low <> high")
    return rows.join(materialize(keys.select("key", "size", "first"), "open"), "key")


def _unsettled(bands: DataFrame, comp: DataFrame) -> DataFrame:
    with_comp = bands.join(comp, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    return _settle(with_comp)


def _leaders(buckets: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a node of each bucket, another one each turn, with all nodes there of other components."""
    by = F.xxhash64(F.lit(turn), "node")
    chosen = buckets.groupBy("key").agg(F.min_by(F.struct("node", "n", "comp"), F.struct(by, F.col("node"))).alias("lead"))
    rows = buckets.join(chosen, "key").where((F.col("comp") != F.col("lead.comp")) & _near_size(F.col("n"), F.col("lead.n"), percent))
    return rows.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _by_rare_shingles(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Groups (key: a shingle) of those nodes that have it among their rarest, where the groups hold several components.

    The rarest are so many that two sets of enough similarity can't do without a common one: exact, with no cap."""
    own = nodes.join(buckets.select("node", "comp").distinct(), "node").select("node", "n", "comp", "row_key", "set_a", "set_b")
    own = materialize(own, "members")
    sets = _shingles(own.select("row_key").distinct(), docs).dropDuplicates(["set_a", "set_b"])
    each = own.join(sets, ["set_a", "set_b"]).select("node", "n", "comp", F.explode("shingles").alias("key"))
    each = materialize(each, "shingles")
    counts = each.groupBy("key").agg(F.count("*").alias("owners")).where("owners > 1")
    common = each.join(counts, "key")  # a shingle of one set alone can't be a common one
    alone = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("owners", "key")) + alone
    least = F.ceil(F.col("n") * percent / 100)
    rare = common.withColumn("place", place).where(F.col("place") <= F.col("n") - least + 1)
    return _settle(rare.select("key", "node", "n", "comp"))


def _within(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components in buckets of SMALL nodes at most."""
    members = buckets.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n", "comp"))).alias("all"))
    one = members.select("all", F.explode("all").alias("x"))
    fits = lambda y: (y.node > F.col("x.node")) & (y.comp != F.col("x.comp")) & _near_size(y.n, F.col("x.n"), percent)
    return one.select(F.col("x.node").alias("a"), F.explode(F.filter("all", fits)).alias("y")).select("a", F.col("y.node").alias("b")).distinct()


def _in_blocks(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links inside groups of any size: every two blocks of a group meet in a task of their own, with whole sets."""
    buckets = materialize(buckets, "medium")
    own = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "regs", "row_key", "set_a", "set_b")
    own = materialize(own, "members")
    sets = _shingles(own.select("row_key").distinct(), docs)
    whole = own.drop("row_key").join(sets, ["set_a", "set_b"]).select("node", "regs", "shingles").dropDuplicates(["node"])
    sizes = materialize(buckets.groupBy("key").agg((F.ceil(F.sum("n") / F.lit(BLOCK))).cast("int").alias("blocks")), "sizes")
    rows = buckets.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    rows = rows.select("key", "node", "n", "comp", "block", F.explode(meets).alias("m")).select("key", "node", "n", "comp", "block", F.col("m.i").alias("i"), F.col("m.j").alias("j"))
    return rows.join(whole, "node").groupBy("key", "i", "j").applyInPandas(_block_links(percent), "a long, b long").distinct()


def _classes(sigs: DataFrame, named: DataFrame, comp: DataFrame) -> DataFrame:
    rows = sigs.drop("regs").where("n_shingles > 0").join(named, ["set_a", "set_b"]).join(comp, "node", "left")
    rows = materialize(rows.select("row_id", "doc_id", "row_key", "n_shingles", F.coalesce("comp", "node").alias("class")), "classes")
    least = rows.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("best"))
    least = materialize(least.select("class", "component_id", F.col("best.row_id").alias("kept_row")), "least")
    alone = sigs.where("n_shingles = 0").select("row_id", "doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("keep"))
    of_class = rows.join(least, "class").select("row_id", "doc_id", "row_key", "n_shingles", "component_id", (F.col("row_id") == F.col("kept_row")).alias("keep"))
    return of_class.unionByName(alone)


def deduplicate(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The documents with one row of each class of near-duplicates kept; rows with an empty set all stay.

    The kept row is the one with the least doc_id (null last); of rows that share it and the text, one stays."""
    rows = materialize(near_duplicates(docs, threshold).groupBy("row_key").agg(F.max("keep").alias("keep"), F.count("*").alias("rows"), F.max("n_shingles").alias("n")), "decided")
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    named = lambda found, tag: materialize(found.select(F.col("row_key").alias(key)), tag)
    kept = anti_join(keyed, named(rows.where("not keep"), "gone"), key)
    again = named(rows.where("keep and rows > 1 and n > 0"), "again")
    once = semi_join(kept, again, key).dropDuplicates([key])
    return anti_join(kept, again, key).unionByName(once).drop(key)
