"""Substring dedup, periodic runs and spelling variants against brute force, and on awkward rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import _arrays, _spark, periodic_runs, spelling, substring_dedup
from ledgerloom.llm._arrays import mix
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n long, runs string, collapsed int, piece int"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 700}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 30), (5, long), (6, long), (6, long), (None, "b c " * 20), (None, None), (7, "ÄÖ ß 日本 語 " * 9), (8, "x" * 50_000 + " " + "y" * 50_000), (9, "x" * 50_000 + "\x00 z")]
    return spark.createDataFrame([(i, t, "w", 1, "r", 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# Periodic runs


def all_runs(s, least):
    """{(start, end): period} by trying every period at every place."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return found


def strings(rng):
    """Sequences that repeat at many scales."""
    n = rng.randint(1, 240)
    yield [rng.randint(0, 1) for _ in range(n)]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    yield b[:n]
    s = [0]
    while len(s) < n:
        s = s + [1 - x for x in s]
    yield s
    yield sum(([rng.randint(0, 1) for _ in range(rng.randint(1, 6))] * rng.randint(1, 12) for _ in range(8)), [])
    u = ([0, 1] * rng.randint(1, 20) + [0]) * rng.randint(2, 6)
    yield u
    u = u[:]
    u[rng.randrange(len(u))] = 2
    yield u
    yield (([0, 0, 1] * rng.randint(1, 14) + [0] * rng.randint(0, 2)) * rng.randint(1, 3) + [2] * rng.randint(0, 2)) * rng.randint(2, 4)


@pytest.mark.parametrize("least", [2, 12])
def test_runs_as_brute_force(least):
    rng = random.Random(5)
    for _ in range(40):
        for s in strings(rng):
            codes = mix(np.array(s, dtype=np.uint64) + np.uint64(9))
            found = [tuple(map(int, r)) for r in periodic_runs.find_runs(codes, len(s), least)]
            assert found == sorted((a, b, q) for (a, b), q in all_runs(s, least).items())


def test_places_of_the_synchronising_set_depend_on_their_context():
    rng = random.Random(1)
    s = [rng.randint(0, 40) for _ in range(4000)]
    s[3000:3500] = s[1000:1500]
    codes = mix(np.array(s, dtype=np.uint64))
    prints = periodic_runs.Prints(codes)
    for t in (4, 8, 16, 32):
        spots = periodic_runs._sync_set(prints, t, np.zeros((0, 3), dtype=np.int64))
        assert np.diff(spots).max() <= t and len(spots) < 4 * len(s) / t
        inside = lambda a: {int(x) - a for x in spots if a <= x <= a + 500 - 2 * t}  # noqa: B023, E731
        assert inside(1000) == inside(3000)


def expected_runs(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = sorted((a, b - a, q) for (a, b), q in all_runs(w, 12).items())
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_periodic_runs_query_as_brute_force(spark, texts):
    rows = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert sum(r.n_runs > 0 for r in rows) >= 10
    for r in rows:
        if len(words_of(texts[r.doc_id])) <= 1200:
            assert tuple(r)[1:] == expected_runs(r.doc_id, texts[r.doc_id]), r.doc_id


def test_periodic_runs_awkward(awkward, nothing):
    rows = periodic_runs.collapse_runs(awkward).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and not by[1].runs and by[1].collapsed == ""
    assert [tuple(x) for x in by[4].runs] == [(0, 30, 1)] and by[4].collapsed == "a"
    assert [tuple(x) for x in by[5].runs] == [(0, 40_000, 700)] and len(by[5].collapsed.split()) == 700
    assert sum(r.doc_id == 6 and len(r.runs) == 1 for r in rows) == 2
    assert sorted((len(r.runs), r.collapsed) for r in rows if r.doc_id is None) == [(0, ""), (1, "b c")]
    assert by[7].collapsed == "ÄÖ ß 日本 語" and by[8].n_words == 2
    assert periodic_runs.collapse_runs(nothing).count() == 0


# Spelling variants


def counted(texts):
    n = Counter()
    for i, t in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def expected_forms(n):
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1) if i + k <= len(w)}
        near[w] = (edits - {w}) & n.keys()
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    root = lambda w: root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def test_spelling_query_as_brute_force(spark, texts):
    rows = sorted(tuple(r) for r in QUERIES["op13_spelling_variants"](spark, SF).collect())
    expected = expected_forms(counted(texts))
    assert rows == expected and sum(r[1] is not None for r in expected) >= 5


@pytest.mark.parametrize("most, page", [(64 << 20, 1 << 15), (1, 512)])
def test_spelling_chains_in_one_round_and_in_many(spark, monkeypatch, most, page):
    monkeypatch.setattr(spelling, "PAGE_WORDS", page)
    monkeypatch.setattr(spelling, "PAGE_BYTES", page * spelling.BITS // 8)
    monkeypatch.setattr(spelling, "PAGE_BLOCKS", page * spelling.BITS // 8 // 64)
    monkeypatch.setattr(spelling, "SHARD_PAGES", 1)
    rng = random.Random(2)
    n = {"".join(rng.choice("abcé") for _ in range(rng.randint(7, 9))): rng.choice([2, 3, 30, 400, 5000]) for _ in range(3000)}
    n |= {"chainword": 40_000, "chainwords": 4000, "chainwordsx": 400, "chainwordsxy": 40, "chainwordsxyz": 4, "aaaaaaa": 7, "aaaaaaaa": 70, "z" * 3000: 2, "z" * 3001: 30}
    table = spelling.materialize(spark.createDataFrame(list(n.items()), "word string, n long"))
    rows = sorted(tuple(r) for r in spelling.spelling_forms(table, most_bytes=most).collect())
    assert [r for r in rows if len(r[0]) < 3000] == expected_forms({w: c for w, c in n.items() if len(w) < 3000})
    assert {len(r[0]): len(r[2]) for r in rows if len(r[0]) >= 3000} == {3000: 3001, 3001: 3001}
    assert next(r for r in rows if r[0] == "chainwordsxyz")[1:3] == ("chainwordsxy", "chainword")


def test_filters_let_every_word_pass_and_few_others():
    rng = np.random.default_rng(3)
    inside, outside = (mix(rng.integers(0, 1 << 62, spelling.PAGE_WORDS).astype(np.uint64)) for _ in range(2))
    table = np.frombuffer(spelling.fill_page(inside), dtype=np.uint8)
    page = np.zeros(len(inside), dtype=np.int64)
    assert len(spelling.passes(table, page, inside)) == len(inside)
    assert len(spelling.passes(table, page, outside)) < 0.01 * len(outside)


def test_spelling_awkward(spark, awkward, nothing):
    rows = {r.word[:8]: r for r in spelling.spelling_variants(awkward).collect()}
    assert set(rows) == {"x" * 8} and (rows["x" * 8].n, rows["x" * 8].n_near, rows["x" * 8].form) == (2, 0, None)
    assert spelling.spelling_variants(nothing).count() == 0


# Substring dedup


def without_repeats(rows, length):
    """(doc_id, n_words, n_removed, kept) of rows in order."""
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, 1 << 70), 1 << 65 if i is None else i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (1 << 65 if i is None else i):
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def in_order(rows):
    return sorted(rows, key=repr)


def test_substring_dedup_query_as_brute_force(spark, texts):
    rows = QUERIES["op11_substring_dedup"](spark, SF).collect()
    expected = without_repeats(sorted(texts.items()), 13)
    assert in_order(tuple(r) for r in rows) == in_order((i, n, gone, sha(kept)) for i, n, gone, kept in expected)
    assert sum(r.n_removed > 0 for r in rows) >= 20 and sum(r.n_removed == 0 for r in rows) >= 20


@pytest.mark.parametrize("length, slice_bytes, shard_words", [(1, 4 << 20, 1 << 23), (5, 300, 400), (13, 700, 100), (16, 4 << 20, 1 << 23), (50, 500, 300)])
def test_passages_of_any_length_in_many_pieces_and_shards(spark, monkeypatch, length, slice_bytes, shard_words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(_arrays, "SLICE", slice_bytes)
    rng = random.Random(length)
    passages = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(length, 3 * length + 5))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(0, 20))] + (rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.5 else [])
        rows.append((None if i % 40 == 7 else rng.randint(1, 100), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substring_dedup.remove_repeats(docs, length).collect()
    assert in_order(tuple(r) for r in found) == in_order(without_repeats(rows, length))
    assert any(r.n_removed for r in found)


def test_lengths_of_the_levels():
    assert [substring_dedup.lengths_to(n) for n in (13, 50, 8, 1, 100)] == [[7, 13], [7, 13, 25, 50], [8, 8], [1, 1], [7, 13, 25, 50, 100]]


def test_substring_dedup_awkward(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = substring_dedup.remove_repeats(awkward).collect()
    assert in_order(tuple(r) for r in found) == in_order(without_repeats(rows, 13))
    assert sorted(r.n_removed for r in found if r.doc_id == 6) == [40_000, 40_000]
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_samples_of_any_number_of_rows(spark):
    """About as many rows as asked for, never none, also of far more rows than a bound in millionths could tell apart."""
    assert _spark.bound_for(4000, 4000) is None and _spark.bound_for(4000, 10**30) == 1
    for n in (10**6, 10**11, 10**14):
        assert abs(_spark.bound_for(4000, n) / (1 << 63) * n / 4000 - 1) < 0.001
    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    assert 3600 < rows.where(_spark.chosen(F.col("h"), 4000, 200_000)).count() < 4400
    assert rows.where(_spark.chosen(F.col("h"), 200_000, 200_000)).count() == 200_000
    # Of 1e11 rows about one in 25 million: as many of the least hashes are chosen.
    some = spark.range(0, 40_000_000, numPartitions=8).select(F.xxhash64("id").alias("h")).where(_spark.chosen(F.col("h"), 400_000, 10**11)).count()
    assert 100 < some < 230
