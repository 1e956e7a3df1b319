"""Personal data by patterns and by a semi-Markov conditional random field.

Four patterns give the base spans. The field then labels stretches of tokens that hold a digit or an @ sign: it scores
whole candidate segments by features of the whole span (its shape, length, digits and their check sum, separators, the
characters before and after) and of the type of the segment before it in the stretch, and a dynamic programme over
segments of bounded length chooses boundaries and types together. Tokens are runs of letters and digits, single other
characters, and runs of blanks. A candidate segment has up to ``LONGEST`` tokens, starts with a letter, digit, + or (,
ends with a letter or digit, and holds an @, or three dots, or 7 digits, and 24 digits at most: no datum of the four
kinds is otherwise. All else is outside. Stretches without a candidate are not looked at; they can't hold a segment.

Weights maximise the conditional log likelihood, by gradient steps with the forward and backward sums over segments, on
the base spans of a bounded number of snippets as labels, besides stretches without any. To learn more than the patterns,
every training span is also shown in forms that they miss (a phone without its plus, a card with dots), with the same
label. Decoding takes place in what the base spans leave of the stretches, and adds its spans to these.

The patterns are matched in time that grows with the text's length, and the programme keeps the segments of one start at
a time, so that very long texts are no exception. Positions count code points; ends are exclusive. Null texts are empty.
Rows are independent and all are returned; repeated rows stay. Extra columns are ignored. Without any base span in the
sample the field adds nothing. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import chosen, clean_text, materialize

#: Kinds, in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
#: For the same matches in linear time: what follows an e-mail's local part, and numbers joined by dots.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: What a stretch that the field looks at is made of.
NUMBERS = re.compile(r"[+(]?[0-9][0-9\x20().-]*")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
ADDRESS = frozenset(LOCAL)
LONGEST = 24
#: Documents with digits or an @ that training snippets come from, about; snippets and gradient steps of the training.
SAMPLE = 4_000
SNIPPETS = 800
STEPS = 40
FEATURES = 1 << 12
#: State before the first segment of a stretch; weights of a kind after state y stand behind its features.
NONE = len(KINDS)
COLUMNS = FEATURES + NONE + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL: each @ that a domain follows, with the part before it up to the match or @ before."""
    end = last = 0
    for m in AT.finditer(text):
        low = max(end, last)
        start = low + len(text[low : m.start()].rstrip(LOCAL))
        last = m.start() + 1
        if start < m.start():
            end = m.end()
            yield start, end


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of IP with parts of 255 at most: four by four of the numbers that dots join."""
    for m in CHAIN.finditer(text):
        parts = m[0].split(".") if m[0].count(".") >= 3 else []
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted: leftmost non-overlapping matches of each pattern, failing ones dropped."""
    out = [(a, 0, b) for a, b in emails(text)] + [(a, 1, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


@lru_cache(1 << 16)
def _hash(text: str) -> int:
    value = 2166136261
    for c in text.encode():
        value = (value ^ c) * 16777619 & 0xFFFFFFFF
    return value % FEATURES


def segment_features(text: str, before: str, after: str) -> list[int]:
    """Features of a whole candidate segment; a type adds its own weights to them."""
    digits = _digits(text)
    seps = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", text))))
    groups = re.findall("[0-9]+", text)
    shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "9", text)))
    names = [
        "bias", f"n{min(len(digits), 20)}", f"seps{seps}", f"groups{min(len(groups), 6)}", f"shape{shape[:24]}",
        f"luhn{14 <= len(digits) <= 19 and luhn(digits)}", f"at{text.count('@')}", f"first{'d' if text[0].isdigit() else 'a' if text[0].isalpha() else text[0]}",
        f"octets{len(groups) == 4 and seps == '.' and all(len(g) < 4 and int(g) <= 255 for g in groups)}",
        f"lens{','.join(str(len(g)) for g in groups[:5])}", f"before{before}", f"after{after}",
        f"letters{bool(re.search('[A-Za-z]', text))}{len(digits) > 0}", f"dotend{bool(re.search('[.][A-Za-z]{2,}$', text))}",
    ]
    return [_hash(n) for n in names]


def _class(c: str) -> str:
    return "edge" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "blank" if c.isspace() else c


def token_cuts(text: str, start: int, end: int) -> list[int]:
    """Token boundaries of a stretch."""
    return [m.start() for m in TOKEN.finditer(text, start, end)] + [end]


def candidates(text: str, cuts: list[int], i: int) -> list[tuple[int, list[int]]]:
    """(end token, features) of the candidate segments that start at token i."""
    first, out = text[cuts[i]], []
    if not (first.isascii() and (first.isalnum() or first in "+(")):
        return out
    digits, at, dots = 0, False, 0
    for j in range(i + 1, min(i + LONGEST, len(cuts) - 1) + 1):
        own, last = text[cuts[j - 1]], text[cuts[j] - 1]
        digits += cuts[j] - cuts[j - 1] if own in "0123456789" else 0
        at, dots = at or own == "@", dots + (own == ".")
        if digits > 24:
            break
        if (digits >= 7 or at or dots >= 3) and last.isascii() and last.isalnum():
            before, after = text[cuts[i] - 1 : cuts[i]], text[cuts[j] : cuts[j] + 1]
            out.append((j, segment_features(text[cuts[i] : cuts[j]], _class(before), _class(after))))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold a segment: seven digits or three dots in a run of numbers, or an @ and what adjoins it."""
    out = []
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() >= 7 and (sum(c.isdigit() for c in m[0]) >= 7 or m[0].count(".") >= 3):
            out.append((m.start(), m.end()))
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and text[a - 1] in ADDRESS:
            a -= 1
        while b < len(text) and text[b] in ADDRESS:
            b += 1
        out.append((a, b))
        at = text.find("@", b)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def gaps(parts: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What sorted base spans leave of sorted stretches."""
    k = 0
    for a, b in parts:
        while k < len(base) and base[k][0] < b:
            start, _, end = base[k]
            if start > a:
                yield a, start
            a = max(a, end)
            if end > b:  # it may reach into the next stretch
                break
            k += 1
        if a < b:
            yield a, b


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def _scores(features: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """(segment, kind)"""
    return weights[:, np.array(features)].sum(axis=2).T


def decode(n: int, segments: Callable[[int], list[tuple[int, list[int]]]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, end token, kind) of the best segmentation; ``segments`` gives (end token, features) of a first token.

    Tokens outside segments score 0. Of the states (token, type of the last segment) only those that a segment can still
    reach are held, besides where each kept segment came from."""
    moves, low = weights[:, FEATURES:].T, float("-inf")
    best, back = {0: [low] * NONE + [0.0]}, {}
    for i in range(n):
        own = best.pop(i)
        if i + 1 not in best:
            best[i + 1] = own
        else:
            for y, value in enumerate(own):
                if value >= best[i + 1][y]:
                    best[i + 1][y] = value
                    back.pop((i + 1, y), None)
        found = segments(i)
        if not found:
            continue
        before = np.array(own)[:, None] + moves
        came = before.argmax(axis=0).tolist()
        for (j, _), scores in zip(found, (_scores([f for _, f in found], weights) + before.max(axis=0)).tolist()):
            at = best.setdefault(j, [low] * (NONE + 1))
            if at is own:  # not to change what it was copied from
                at = best[j] = list(own)
            for k, value in enumerate(scores):
                if value > at[k]:
                    at[k] = value
                    back[j, k] = (i, came[k])
    last, out, j = best[n], [], n
    y = max(range(NONE + 1), key=lambda k: (last[k], k))
    while j > 0:
        if (j, y) in back:
            i, before_it = back[j, y]
            out.append((i, j, y))
            j, y = i, before_it
        else:
            j -= 1
    return out[::-1]


def gradient(n: int, segments: list[tuple[int, int, list[int]]], truth: list[tuple[int, int, int]], weights: np.ndarray, out: np.ndarray) -> float:
    """Adds the gradient of one stretch's log likelihood to ``out``, seen features less expected ones; returns the likelihood.

    segments: (first token, end token, features); truth: (first token, end token, kind) in order."""
    first, end = (np.array([s[k] for s in segments]) for k in (0, 1))
    features = np.array([s[2] for s in segments])
    scores, moves = _scores(features, weights), weights[:, FEATURES:].T
    forward, backward = np.full((n + 1, NONE + 1), -np.inf), np.zeros((n + 1, NONE + 1))
    forward[0, NONE] = 0.0
    for j in range(1, n + 1):
        forward[j], own = forward[j - 1], np.flatnonzero(end == j)
        if len(own):
            into = scores[own] + _log_sum(forward[first[own]][:, :, None] + moves[None], 1)
            forward[j, :NONE] = _log_sum(np.concatenate((into, forward[j - 1 : j, :NONE])), 0)
    for i in range(n - 1, -1, -1):
        backward[i], own = backward[i + 1], np.flatnonzero(first == i)
        if len(own):
            onto = moves[None] + (scores[own] + backward[end[own]][:, :NONE])[:, None, :]
            backward[i] = _log_sum(np.concatenate((onto.transpose(0, 2, 1).reshape(-1, NONE + 1), backward[i + 1 : i + 2])), 0)
    whole = _log_sum(forward[n], 0)
    chance = np.exp(forward[first][:, :, None] + moves[None] + (scores + backward[end][:, :NONE])[:, None, :] - whole)
    change, value, before = -chance.sum(axis=1), -float(whole), NONE
    out[:, FEATURES:] -= chance.sum(axis=0).T
    place = {s[:2]: k for k, s in enumerate(segments)}
    for i, j, kind in truth:
        s = place[i, j]
        change[s, kind] += 1
        out[kind, FEATURES + before] += 1
        value += float(scores[s, kind] + moves[before, kind])
        before = kind
    for k in range(NONE):
        out[k, :FEATURES] += np.bincount(features.ravel(), weights=np.repeat(change[:, k], features.shape[1]), minlength=FEATURES)
    return value


def _variants(text: str, span: tuple[int, int, int]) -> list[tuple[str, tuple[int, int, int]]]:
    """The same datum in forms that the patterns miss, in its place."""
    start, kind, end = span
    own = text[start:end]
    forms = {3: [own.lstrip("+"), own.replace(" ", ".")], 2: [".".join(re.findall("....|.+$", _digits(own)))]}.get(kind, [])
    left, right = text[max(0, start - 30) : start], text[end : end + 30]
    return [(left + f + right, (len(left), kind, len(left) + len(f))) for f in forms]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        snippets, starts, ends, kinds = [], [], [], []
        for raw in batch.column("text").to_pylist():
            text = raw.decode("utf-8", "replace")
            for span in base_spans(text):
                shown = [(text[max(0, span[0] - 30) : span[2] + 30], (min(30, span[0]), span[1], min(30, span[0]) + span[2] - span[0]))]
                for snippet, (a, k, b) in shown + _variants(text, span):
                    snippets.append(snippet), starts.append(a), ends.append(b), kinds.append(k)
            base = base_spans(text)
            for a, b in stretches(text):
                if not any(s[0] < b and a < s[2] for s in base):
                    snippets.append(text[max(0, a - 30) : b + 30]), starts.append(0), ends.append(0), kinds.append(-1)
        yield pa.RecordBatch.from_arrays([pa.array(snippets, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.int32())], ["snippet", "start", "end", "kind"])


def _stretch_data(snippet: str, start: int, end: int, kind: int) -> Iterator[tuple[int, list, list]]:
    """(tokens, segments, truth) of the snippet's stretches that the datum touches, or of all without one. Base spans beside it are labels too."""
    data = [(start, kind, end)] if kind >= 0 else []
    beside = [s for s in base_spans(snippet) if kind >= 0 and not (s[0] < end and start < s[2])]
    for a, b in stretches(snippet):
        cuts = token_cuts(snippet, a, b)
        segments = [(i, j, f) for i in range(len(cuts) - 1) for j, f in candidates(snippet, cuts, i)]
        place, known = {c: i for i, c in enumerate(cuts)}, {s[:2] for s in segments}
        truth = lambda spans: [(place[x], place[y], k) for x, k, y in spans if x in place and y in place and (place[x], place[y]) in known]
        own = truth(data)
        if segments and (own or kind < 0):  # what else a span's surroundings hold isn't known
            both, taken = [], -1
            for i, j, k in sorted(own + truth(beside)):
                if i >= taken:
                    both.append((i, j, k))
                    taken = j
            yield len(cuts) - 1, segments, both


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames), ignore_index=True)
    data = [x for r in rows.itertuples() for x in _stretch_data(r.snippet, r.start, r.end, r.kind)]
    weights, moment = np.zeros((NONE, COLUMNS)), np.full((NONE, COLUMNS), 1e-8)
    weights[:, _hash("bias")] = -2.0
    decay = np.append(np.full(FEATURES, 1e-4), np.full(NONE + 1, 1e-2))
    for _ in range(STEPS):
        out = np.zeros_like(weights)
        for n, segments, truth in data:
            gradient(n, segments, truth, weights, out)
        out = out / max(1, len(data)) - decay * weights
        moment += out * out
        weights += 0.5 * out / np.sqrt(moment)
    k, f = np.nonzero(weights)
    yield pd.DataFrame({"kind": k, "feature": f, "weight": weights[k, f], "n": len(data)})


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (kind, feature), from snippets around the base spans of at most about ``sample`` documents that have digits or an @."""
    rows = docs.select(F.xxhash64("text").alias("h"), clean_text(docs).alias("text")).where(F.col("text").cast("string").rlike(r"[0-9]{4}|@"))
    some = rows.where(chosen(F.col("h"), sample, rows.count())).select("text")
    snippets = materialize(some.mapInArrow(_examples, "snippet string, start int, end int, kind int"), "snippets")
    weights = np.zeros((NONE, COLUMNS))
    if snippets.where("kind >= 0").isEmpty():
        weights[:, _hash("bias")] = -50.0
        return weights
    kinds = len(KINDS) + 1
    by_kind = [snippets.where(F.col("kind") == k).distinct().orderBy(F.xxhash64("snippet", "start"), "snippet").limit(SNIPPETS // kinds) for k in range(-1, len(KINDS))]
    some = by_kind[0]
    for part in by_kind[1:]:
        some = some.union(part)
    found = some.repartition(1).mapInPandas(_fit, "kind int, feature int, weight double, n long").toPandas()
    weights[found.kind, found.feature] = found.weight
    return weights


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("order", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for raw in batch.column("text").to_pylist():
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                spans = [(*s, True) for s in base]
                for a, b in gaps(stretches(text), base):
                    cuts = token_cuts(text, a, b)
                    spans += [(cuts[i], k, cuts[j], False) for i, j, k in decode(len(cuts) - 1, partial(candidates, text, cuts), weights)]
                out.append([{"start": s, "order": k, "end": e, "kind": KINDS[k], "base": own} for s, k, e, own in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return run


def find_personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and spans (start, order, end, kind, base: from a pattern) by start, then kind as listed."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(docs).alias("text"))
    return rows.mapInArrow(_scan(shared), "doc_id long, spans array<struct<start:long,order:int,end:long,kind:string,base:boolean>>")
