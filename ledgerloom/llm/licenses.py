"""License scan with a positional rare-token index of notice templates.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z. The index maps a template word to
its places in the templates. The corpus gives each template word's inverse document frequency. Each template has rare
places of its own: those of highest IDF that together weigh more than ``1 - LEAST`` of it, so that an alignment that
reaches ``LEAST`` has one of them right. A file with key phrases looks up the rare words of the templates that these
belong to; the words' places, minus the template places, give alignments (template, start). Those with a key phrase of
the template in the aligned stretch are scored by the IDF-weighted share of the template's words that stand at their
places, and give the label if that share reaches ``LEAST``. No alignment that holds is missed, however many notices a
file has; of each label the best is returned, the first one of equals.

Base places are those where a fixed phrase's words stand consecutively. Null texts have no words. Rows are independent
of each other and all are returned, repeated ones too. Extra columns are ignored. The tasks carry the templates (a
parameter) and one number for each of their words, never anything that grows with the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrays import alnum_words, hash_text, hash_words
from ._spark import clean_text
from .license_texts import BODIES

#: Phrases and the labels of the base places.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label: (notices, mandatory key phrases).
TEMPLATES = {
    "apache-2.0": (["licensed under the apache license version 2 0"], ["apache license version 2"]),
    "bsd-3-clause": (["redistribution and use in source and binary forms with or without modification are permitted"], ["redistribution and use in source and binary forms"]),
    "cc-by-4.0": (["licensed under cc by 4 0"], ["cc by 4"]),
    "cc-by-nc-4.0": (["licensed under cc by nc 4 0"], ["cc by nc"]),
    "cc-by-sa-4.0": (["licensed under cc by sa 4 0"], ["cc by sa"]),
    "gpl-3.0": (["this work is licensed under the gnu general public license version 3", "free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"], ["gnu general public license"]),
    "lgpl-3.0": (["licensed under the gnu lesser general public license version 3"], ["gnu lesser general public license"]),
    "mit": (["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"], ["mit license", "permission is hereby granted free of charge"]),
    "mpl-2.0": (["this source code form is subject to the terms of the mozilla public license v 2 0"], ["mozilla public license"]),
}
LEAST = 0.6
#: Words of a segment of a whole text, and by how many words segments may stand off their places.
SEGMENT, DRIFT = 16, 8
#: Alignments of a whole text that are compared at a time.
BLOCK = 2048


class TemplateIndex:
    """Words, places and key phrases of the templates, as hashes."""

    def __init__(self, templates: dict = TEMPLATES, phrases: dict = PHRASES, bodies: dict = BODIES):
        table = alnum_words()
        self.templates = [(label, hash_text(t, table), [hash_text(k, table) for k in keys]) for label, (texts, keys) in templates.items() for t in texts]
        self.bodies = [(label, hash_text(t, table), [hash_text(k, table) for k in keys]) for label, (t, keys) in bodies.items()]
        self.phrases = [(hash_text(p, table), label) for p, label in phrases.items()]
        every = self.templates + self.bodies
        self.words = np.unique(np.concatenate([t for _, t, _ in every] + [k for *_, keys in every for k in keys]))
        self.key_sets = [set(map(int, k)) for k in {tuple(k): k for *_, keys in every for k in keys}.values()]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which words the templates have."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return self.words[at] == hashes


def places(hashes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Starts of a phrase in a run of words."""
    at = np.flatnonzero(hashes[: max(0, len(hashes) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[hashes[at + k] == phrase[k]]
    return at


def _document_counts(index: TemplateIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(len(index.words), dtype=np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for _, _, hashes, bounds in hash_words(batch.column("text"), alnum_words()):
                at = np.flatnonzero(index.known(hashes))
                doc = np.searchsorted(bounds, at, side="right") - 1
                pair = np.unique(doc * len(index.words) + np.searchsorted(index.words, hashes[at]))
                counts += np.bincount(pair % len(index.words), minlength=len(index.words))
        names = np.append(index.words.view(np.int64), 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(len(counts), dtype=np.int32), np.int32(1)).astype(np.int32)), pa.array(names), pa.array(np.append(counts, docs))], ["is_total", "word", "n"])

    return run


def inverse_frequencies(docs: DataFrame, index: TemplateIndex) -> dict[int, float]:
    """log(documents / documents with the word) + 1 of each template word."""
    counted = docs.select(clean_text(docs).alias("text")).mapInArrow(_document_counts(index), "is_total int, word long, n long")
    rows = counted.groupBy("is_total", "word").agg(F.sum("n").alias("n")).collect()  # one row for each template word
    total = sum(r["n"] for r in rows if r["is_total"])
    found = {r["word"] & (2**64 - 1): r["n"] for r in rows if not r["is_total"]}
    return {int(w): float(np.log((total + 1) / (found.get(int(w), 0) + 1)) + 1) for w in index.words}


@dataclass
class Rare:
    """A template's words' weights and the postings (word: places) of its rare places."""

    weight: np.ndarray
    postings: dict[int, list[int]]
    words: np.ndarray

    @staticmethod
    def of(text: np.ndarray, idf: dict[int, float]) -> Rare:
        weight = np.array([idf[int(w)] for w in text])
        order = np.lexsort((np.arange(len(text)), text, -weight))
        enough = np.cumsum(weight[order]) > (1 - LEAST) * weight.sum() + 1e-9
        postings = defaultdict(list)
        for at in order[: int(np.argmax(enough)) + 1]:
            postings[int(text[at])].append(int(at))
        return Rare(weight, dict(postings), np.array(sorted(postings), dtype=np.uint64))


def rare_places(index: TemplateIndex, idf: dict[int, float]) -> list[Rare]:
    """Of the notices, then of the whole texts."""
    return [Rare.of(text, idf) for _, text, _ in index.templates + index.bodies]


def _starts(hashes: np.ndarray, at: np.ndarray, text: np.ndarray, keys: list[np.ndarray], rare: Rare, drift: int = 0) -> np.ndarray:
    """Starts at which a rare place is right and a key phrase stands in the stretch, which reaches two words (and the drift) beyond the aligned ones."""
    stands = [(k, len(key)) for key in keys for k in places(hashes, key)]
    if not stands:
        return np.zeros(0, dtype=np.int64)
    found = at[np.isin(hashes[at], rare.words)]
    which, none = hashes[found], np.zeros(0, dtype=np.int64)
    starts = np.unique(np.concatenate([none, *((found[which == w][:, None] - np.array(rare.postings[int(w)])).ravel() for w in np.unique(which))]))
    near, reach = np.zeros(len(starts) + 1, dtype=np.int64), 2 + drift
    for k, size in stands:
        from_, to = np.searchsorted(starts, k + size - len(text) - reach), np.searchsorted(starts, k + reach, side="right")
        near[from_] += to > from_
        near[to] -= to > from_
    return starts[np.cumsum(near[:-1]) > 0]


def _shares(hashes: np.ndarray, starts: np.ndarray, text: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """For each start the weights of the words that stand at their places, added up by segments of ``size`` words."""
    out = []
    for block in range(0, len(starts), BLOCK):
        spots = starts[block : block + BLOCK, None] + np.arange(len(text))
        inside = (spots >= 0) & (spots < len(hashes))
        same = inside & (hashes[np.where(inside, spots, 0)] == text)
        out.append(np.add.reduceat(np.where(same, weight, 0.0), np.arange(0, len(text), size), axis=1))
    return np.concatenate(out) if out else np.zeros((0, -(-len(text) // size)))


def whole_texts(hashes: np.ndarray, at: np.ndarray, index: TemplateIndex, rare: list[Rare]) -> list[tuple[str, int, int, float, float]]:
    """(label, start, end, weight, score) of whole texts that hold, without those that heavier ones cover by half."""
    found = []
    for (label, text, keys), own in zip(index.bodies, rare):
        starts = _starts(hashes, at, text, keys, own, DRIFT)
        if not len(starts):
            continue
        offsets = np.unique((starts[:, None] + np.arange(-DRIFT, DRIFT + 1)).ravel())
        parts, weight = _shares(hashes, offsets, text, own.weight, SEGMENT), np.zeros(len(starts))
        where = np.searchsorted(offsets, starts)
        best = parts[where]
        for step in range(-DRIFT, DRIFT + 1):  # all offsets around a start are there, next to each other
            best = np.maximum(best, parts[where + step])
        weight = best.sum(axis=1)
        score = weight / own.weight.sum()
        found += [(label, int(s), int(s) + len(text), float(w), float(c)) for s, w, c in zip(starts, weight, score) if c >= LEAST - 1e-12]
    kept = Covers()
    for label, start, end, weight, score in sorted(found, key=lambda m: (-m[3], m[1], m[0])):
        if not kept.cover(label, start, end, weight, same=True):
            kept.add((label, start, end, weight, score))
    return sorted(m for ms in kept.at.values() for m in ms)


class Covers:
    """Stretches of whole texts, found again by blocks of words."""

    WORDS = 256

    def __init__(self, stretches: list | None = None):
        self.at: dict[int, list] = defaultdict(list)
        self.longest = 0
        for m in stretches or []:
            self.add(m)

    def add(self, m: tuple[str, int, int, float, float]) -> None:
        self.at[m[1] // self.WORDS].append(m)
        self.longest = max(self.longest, m[2] - m[1])

    def cover(self, label: str, start: int, end: int, weight: float, same: bool = False) -> bool:
        """Whether half of a stretch lies in one of greater or the same weight, of another label (or of the same one, too)."""
        blocks = range((start - self.longest) // self.WORDS, end // self.WORDS + 1)
        return any((same or m[0] != label) and m[3] >= weight and 2 * (min(m[2], end) - max(m[1], start)) >= end - start for b in blocks for m in self.at.get(b, ()))


def matches(hashes: np.ndarray, index: TemplateIndex, idf: dict[int, float], rare: list[Rare] | None = None) -> list[tuple[str, int, float]]:
    """(label, start word, score) of the alignments that hold, the best for each label. ``rare`` is rare_places(index, idf)."""
    at = np.flatnonzero(index.known(hashes))
    present = {int(w) for w in np.unique(hashes[at])}
    if not any(keys <= present for keys in index.key_sets):
        return []
    rare = rare or rare_places(index, idf)
    whole = whole_texts(hashes, at, index, rare[len(index.templates) :])
    covers, best = Covers(whole), {}

    def offer(label: str, start: int, score: float) -> None:
        old = best.get(label, (0, 0.0))
        if score > old[1] or score == old[1] and start < old[0]:
            best[label] = (max(0, start), score)

    for label, start, _, _, score in whole:
        offer(label, start, score)
    for (label, text, keys), own in zip(index.templates, rare):
        starts = _starts(hashes, at, text, keys, own)
        near = _shares(hashes, starts, text, own.weight, len(text))[:, 0] >= LEAST * own.weight.sum() - 1e-9
        for start in starts[near]:
            spots = np.arange(max(0, -start), min(len(text), len(hashes) - start))
            weight = own.weight[spots[hashes[spots + start] == text[spots]]].sum()
            score = float(weight / own.weight.sum())
            if score >= LEAST and not covers.cover(label, int(start), int(start) + len(text), float(weight)):
                offer(label, int(start), score)
    return sorted((label, start, score) for label, (start, score) in best.items())


def _scan(index: TemplateIndex, idf: dict[int, float]):
    rare = rare_places(index, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, base, found = [], [], []
            for _, _, hashes, bounds in hash_words(batch.column("text"), alnum_words()):
                hits = sorted((int(p), label, len(phrase)) for phrase, label in index.phrases for p in places(hashes, phrase))
                by_doc = defaultdict(list)
                for p, label, size in hits:
                    doc = int(np.searchsorted(bounds, p, side="right")) - 1
                    if p + size <= bounds[doc + 1]:
                        by_doc[doc].append({"label": label, "start": p - int(bounds[doc])})
                for doc in range(len(bounds) - 1):
                    n_words.append(int(bounds[doc + 1] - bounds[doc]))
                    base.append(by_doc.get(doc, []))
                    found.append([{"label": a, "start": b, "score": c} for a, b, c in matches(hashes[bounds[doc] : bounds[doc + 1]], index, idf, rare)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(base, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))), pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())])))],
                ["doc_id", "n_words", "base", "found"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict = TEMPLATES, phrases: dict = PHRASES, bodies: dict = BODIES) -> DataFrame:
    """doc_id, n_words, base (label and start word of each base place) and found (label, start word and score of each aligned notice or text)."""
    index = TemplateIndex(templates, phrases, bodies)
    idf = inverse_frequencies(docs, index)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(docs).alias("text"))
    return rows.mapInArrow(_scan(index, idf), "doc_id long, n_words long, base array<struct<label:string,start:long>>, found array<struct<label:string,start:long,score:double>>")
