"""Secrets by patterns and by sliding-window entropy, in DataFrame expressions only.

Base kinds are three patterns (assigned values, access keys, long hex runs). The entropy kind looks at candidate
strings, runs of 20 and more characters out of letters, digits and ``+/_=-``: a window of 20 characters slides over a
candidate, with a count for each character; a step changes the counts of the character that leaves and of the one that
enters, and by these the window's Shannon entropy. A candidate is a secret if a window's entropy is at least the
threshold of its character class (hex digits, letters and digits, base64). Allow-listed strings (placeholders, digests
with a prefix, identifiers, paths, runs of one case without digits) are suppressed. Candidates end before a base match and go
on behind it, so that what base spans leave of a run is looked at, and they are not.

The work grows in proportion to the text, also for a long candidate or very many matches: places are running sums, kept
in chunks. Positions count code points; ends are exclusive; byte_start and byte_end count UTF-8 bytes. Null and empty
texts have no spans. Extra columns are kept as they are, repeated rows too; rows are independent of each other. An empty
table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ._spark import fresh

#: The base patterns, in the order in which spans of equal start are listed.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LETTER = r"[A-Za-z0-9+/_=-]"
CANDIDATE = LETTER + "{20,}"
ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
WINDOW = 20
#: Bits a character that a window must reach, by the candidate's character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
#: Strings that are never secrets by their entropy.
ALLOWED = (
    r"(?i)(example|placeholder|changeme|dummy|sample|xxxx|0000000|abcdef|123456789)",
    r"^[a-z_=/-]+$|^[A-Z_=/-]+$|^[A-Z][a-z]+$|^[0-9_=/+-]+$",
    r"^(?:/[A-Za-z0-9_=-]{0,15})++/?$",
    r"^[a-z]*+(?:[A-Z][a-z]+)++$",
)
#: An assigned value that counts.
ASSIGNED = ASSIGN[: -len("+)")] + "{6,})"
#: Base matches, or else what candidates are cut to by them.
CUT = f"{ASSIGNED}|{ACCESS}|{HEX}|(?:(?!{ASSIGNED}|{ACCESS}|{HEX}){LETTER}){{20,}}+"
#: Elements of a running sum that are in one list while it is made.
CHUNK = 256
#: Codes of the characters that a window counts, from the first one on.
FIRST_CODE, CODES = 33, 94


def _let(value: Column, use) -> Column:
    """use(value), where the value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, step) -> Column:
    """For an array of longs, step(...step(step(0, first), second)...) up to each element; the step is associative, and 0 changes nothing."""
    empty = F.array().cast("array<bigint>")

    def one(chunk: Column, start: Column) -> Column:
        add = lambda acc, x: F.struct(step(acc.at, x).alias("at"), F.array_append(acc.out, step(acc.at, x)).alias("out"))
        return F.aggregate(chunk, F.struct(start.alias("at"), empty.alias("out")), add, lambda acc: acc.out)

    def of(chunks: Column) -> Column:
        zero = F.lit(0).cast("long")
        totals = one(F.transform(chunks, lambda c: F.aggregate(c, zero, step)), zero)
        return F.flatten(F.zip_with(chunks, _let(totals, lambda t: F.concat(F.array(zero), F.slice(t, 1, F.size(t) - 1))), one))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(cut(v), of)).otherwise(empty))


_SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string,value:string,checked:int,byte_start:bigint,byte_end:bigint>>"


def spans_of(text: Column, pattern: str, kind: str, checked_group: int = 0, least: int = 1, where: str | None = None) -> Column:
    """array<struct<start, order, end, kind, value, checked, byte_start, byte_end>> of a pattern's matches whose group has
    ``least`` characters; only of texts that match ``where`` (the pattern itself, if not given).

    A place follows from the lengths of the pieces between the matches and of the matches before it."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(checked_group)).alias("checked"), F.split(text, pattern, -1).alias("piece"))

    def place(m: Column) -> Column:
        each = F.sequence(F.lit(0), F.size(m.match) - 1)
        ends = lambda size: running(F.transform(each, lambda i: (size(F.get(m.piece, i)) + size(F.get(m.match, i))).cast("long")), lambda x, y: x + y)

        def spans(at: Column) -> Column:
            end, byte_end = lambda i: F.get(at.chars, i), lambda i: F.get(at.bytes, i)
            own = lambda i: F.get(m.match, i)
            return F.transform(each, lambda i: F.struct((end(i) - F.length(own(i))).alias("start"), F.lit(ORDER[kind]).alias("order"), end(i).alias("end"), F.lit(kind).alias("kind"), own(i).alias("value"), F.length(F.get(m.checked, i)).alias("checked"), (byte_end(i) - F.octet_length(own(i))).alias("byte_start"), byte_end(i).alias("byte_end")))

        return _let(F.struct(ends(F.length).alias("chars"), ends(F.octet_length).alias("bytes")), spans)

    return F.when(text.rlike(where or pattern), F.filter(_let(found, place), lambda s: s.checked >= least)).otherwise(F.array().cast(_SPANS))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of any ``window`` characters of a string of printable ASCII characters.

    The state is a count for each character and the sum of n log2 n over them; both change only by the character that
    leaves the window and the one that enters."""
    terms = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)))

    def step(acc: Column, x: Column) -> Column:
        n, m = F.get(acc.counts, x.old), F.get(acc.counts, x.new)
        moved = acc.total - F.when(x.old >= 0, F.get(terms, n) - F.get(terms, n - 1)).otherwise(0.0) + F.get(terms, m + 1) - F.get(terms, m)
        total = F.when(x.old == x.new, acc.total).otherwise(moved)
        counts = F.when(x.old == x.new, acc.counts).otherwise(F.transform(acc.counts, lambda c, i: F.when(i == x.new, c + 1).when(i == x.old, c - 1).otherwise(c)))
        return F.struct(counts.alias("counts"), total.alias("total"), F.when(x.full, F.least(acc.best, total)).otherwise(acc.best).alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("best"))

    def fold(codes: Column) -> Column:
        size = F.least(F.size(codes), F.lit(window))
        old = F.concat(F.array_repeat(F.lit(-1), window), codes)
        moves = _let(old, lambda o: F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.get(o, i).alias("old"), (i >= size - 1).alias("full"))))
        return F.log2(size.cast("double")) - F.aggregate(moves, start, step, lambda acc: acc.best) / size

    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST_CODE)
    return F.when(F.length(value) > 0, _let(codes, fold)).otherwise(F.lit(0.0))


def _is_secret(value: Column) -> Column:
    hexadecimal = value.rlike("^[0-9a-fA-F]+$")
    alnum = value.rlike("^[A-Za-z0-9]+$")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") | value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[+/=]")
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    threshold = F.when(hexadecimal, THRESHOLDS["hex"]).when(alnum, THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    return F.when(mixed & ~allowed, window_entropy(value) >= threshold).otherwise(F.lit(False))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with ``out``: array<struct<start, order, end, kind, value, checked, byte_start, byte_end>> by start, then kind as listed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(spans_of(whole, ASSIGN, "assign", 2, 6), spans_of(whole, ACCESS, "access"), spans_of(whole, HEX, "hex"))
    # Base matches are matched here too, so that candidates are what is between them.
    others = spans_of(whole, CUT, "entropy", where=CANDIDATE)
    own = lambda s: ~s.value.rlike(f"{ASSIGNED}|{ACCESS}|{HEX}") & _is_secret(s.value)
    return docs.withColumn(out, F.array_sort(F.concat(base, F.filter(others, own))))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs whose secrets are replaced by ``mark``; of overlapping spans the union is. n_chars, if there, follows."""
    name, kept = fresh(docs, "secrets"), fresh(docs, "redacted")
    found = find_secrets(docs, text, name)

    def cut(x: Column) -> Column:
        """The pieces before the spans, each with a mark, and what follows the last one."""
        before = lambda i: F.when(i > 0, F.get(x.until, i - 1)).otherwise(F.lit(0))
        part = lambda a, b: x.raw.substr((a + 1).cast("int"), (b - a).cast("int")).cast("string")
        start = lambda i: F.get(x.spans, i).byte_start
        pieces = F.transform(F.sequence(F.lit(0), F.size(x.spans) - 1), lambda i: F.when(start(i) >= before(i), F.concat(part(before(i), start(i)), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(x.until, -1), F.length(x.raw)))

    until = running(F.transform(name, lambda s: s.byte_end), lambda x, y: F.greatest(x, y))
    changed = F.when(F.size(name) > 0, _let(F.struct(F.col(name).alias("spans"), until.alias("until"), F.col(text).cast("binary").alias("raw")), cut)).otherwise(F.col(text))
    out = found.withColumn(kept, changed)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(kept).alias(text))
        elif c == "n_chars":
            columns.append(F.when(F.size(name) > 0, F.length(kept).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
