"""Scalar functions on ids, terms and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bytes of a content hash that identify it, and the characters of its base64url id.
HASH_BYTES, ID_LENGTH = 18, 24


def hash_id(text: Column) -> Column:
    """The 24-character id of a hash in hexadecimal (36 or 64 digits), base64 or base64url; other texts give null."""
    t = F.trim(text)
    of_hex = F.base64(F.substring(F.unhex(F.when(t.rlike("^[0-9a-fA-F]{36,64}$"), t)), 1, HASH_BYTES))
    of_base64 = F.when(t.rlike("^[A-Za-z0-9+/_-]{24,43}=?$"), F.substring(t, 1, ID_LENGTH))
    return F.translate(F.coalesce(of_hex, of_base64), "+/", "-_")


def id_of_iri(iri: Column) -> Column:
    """The 24-character id at the end of an IRI; else null."""
    return F.nullif(F.regexp_extract(iri, "([A-Za-z0-9_-]{24})$", 1), F.lit(""))


def local_name(iri: Column) -> Column:
    return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)


def comma_list(text: Column) -> Column:
    """Trimmed, non-empty items."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def json_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def literal(kind: Column, attr: Column, obj: Column, dtype: str, sql_type: str) -> Column:
    """A literal's value if its datatype is exactly ``dtype`` (none: xsd:string) and its lexical value is good; else null."""
    return F.when((kind == 1) & (F.coalesce(attr, F.lit("xsd:string")) == dtype), obj.try_cast(sql_type))


def orcid_valid(text: Column) -> Column:
    """Whether an ORCID iD's last character is its check digit (ISO 7064 MOD 11-2)."""
    digits = F.regexp_replace(text, "-", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda acc, i: (acc + F.substring(digits, i, F.lit(1)).try_cast("int")) * 2 % 11)
    check = (12 - total) % 11
    return F.coalesce(digits.rlike("^[0-9]{15}[0-9X]$") & (F.when(check == 10, "X").otherwise(check.cast("string")) == F.substring(digits, 16, 1)), F.lit(False))


def format_bytes(size: Column) -> Column:
    """1023 B, 1.0 KB, …: steps of 1024."""
    step = F.when(size < 1024, 0).otherwise(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 10).cast("int"))
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB", "PB"))), F.least(step, F.lit(5)) + 1)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_number(size / F.pow(F.lit(1024.0), step), 1), F.lit(" "), unit))


def iso_instant(text: Column) -> Column:
    return F.try_to_timestamp(text)


def encode_iri(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def country_code(name: Column, codes: dict[str, str]) -> Column:
    """A code by a country's name, in any case."""
    table = F.create_map(*(F.lit(x) for k, v in codes.items() for x in (k.lower(), v)))
    return table[F.lower(F.trim(name))]
