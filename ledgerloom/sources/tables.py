"""Sources and sinks of catalog data."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.terms import orcid_valid
from ledgerloom.sources.log_source import LOG, read_jdbc_log

XSD_STRING = "xsd:string"

PACKAGE = (
    "submitterId string, hashSum string, fileName string, objectSpecification string, isNextVersionOf array<string>, preExistingDoi string, partialUpload boolean,"
    "specificInfo struct<station:string,site:string,acquisitionInterval:struct<start:timestamp,stop:timestamp>,instrument:array<string>,samplingHeight:float,"
    "production:struct<creator:string,contributors:array<string>,hostOrganization:string,comment:string,sources:array<string>,creationDate:timestamp>>,"
    "references struct<keywords:array<string>,licence:string,moratorium:timestamp,duplicateFilenameAllowed:boolean>"
)


def decode_terms(log: DataFrame) -> DataFrame:
    """Log records as statements: type 0 an IRI, 1 a typed literal (no datatype: string), 2 a language literal."""
    attr = F.when(F.col("type") == 1, F.coalesce("litattr", F.lit(XSD_STRING))).when(F.col("type") == 2, F.col("litattr"))
    return log.select("id", "tstamp", "assertion", F.col("subject").alias("subj"), F.col("predicate").alias("pred"), F.col("object").alias("obj"), F.col("type").cast("int").alias("obj_kind"), attr.alias("lit_attr"))


def read_update_log(spark: SparkSession, path: str | None = None, from_id: int | None = None, jdbc: dict | None = None) -> DataFrame:
    """The change log from Parquet or a database (in ranges of ids), optionally from an id on (the filter reaches the source)."""
    if jdbc:
        rows = read_jdbc_log(spark, jdbc, from_id)
    else:
        rows = spark.read.schema(LOG).parquet(path)
    return decode_terms(rows if from_id is None else rows.where(F.col("id") >= from_id))


def append_update_log(updates: DataFrame, path: str, start_id: int) -> None:
    """Updates (seq, assertion, subj, pred, obj, obj_kind, lit_attr) appended with ids from start_id on, by seq, and the time of writing."""
    attr = F.when((F.col("obj_kind") == 1) & (F.col("lit_attr") == XSD_STRING), F.lit(None)).otherwise(F.col("lit_attr"))
    rows = updates.select((F.col("seq") + start_id).cast("bigint").alias("id"), F.current_timestamp().alias("tstamp"), "assertion", F.col("obj_kind").cast("smallint").alias("type"), F.col("subj").alias("subject"), F.col("pred").alias("predicate"), F.col("obj").alias("object"), attr.alias("litattr"))
    rows.write.mode("append").parquet(path)


def _unescape(c: Column) -> Column:
    for a, b in ((r"\\n", "\n"), (r"\\t", "\t"), (r'\\"', '"'), (r"\\\\", r"\\")):
        c = F.regexp_replace(c, a, b)
    return c


def read_ntriples(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """Statements of N-Triples lines; comments and lines of another form are dropped."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*$'
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda g: F.regexp_extract("value", pattern, g)
    rows = rows.select(part(1).alias("s"), part(2).alias("pred"), part(3).alias("o"))
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = F.col("o").startswith('"')
    body = lambda g: F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(\S+))?$', g)
    kind = F.when(~literal, 0).when(body(3) != "", 2).otherwise(1)
    attr = F.when(kind == 1, F.coalesce(F.nullif(body(2), F.lit("")), F.lit(XSD_STRING))).when(kind == 2, body(3))
    return rows.select(F.lit(graph).alias("graph"), bare(F.col("s")).alias("subj"), "pred", F.when(literal, _unescape(body(1))).otherwise(bare(F.col("o"))).alias("obj"), kind.alias("obj_kind"), attr.alias("lit_attr"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", trim: bool = True) -> DataFrame:
    """A table with a header; cells trimmed, empty ones null, doubled quotes unescaped, a byte order mark dropped."""
    rows = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', nullValue="", multiLine=False)
    names = [c.lstrip("﻿").strip() for c in rows.columns]
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")) if trim else F.col(f"`{c}`"), F.lit(""))
    return rows.select(*(cell(c).alias(n) for c, n in zip(rows.columns, names)))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Upload packages, one JSON document in a line."""
    return spark.read.schema(PACKAGE).json(path)


#: The forms of a person's line, in the order in which they are tried, and which group holds what.
PERSON_FORMS = [
    (r"^(.+),(.+),(.*),.+,(.*)$", {"given": 1, "family": 2, "email": 3, "orcid": 4}),
    (r"^(.+),\ (.+):\ (.+)\ \((.+)\)$", {"family": 1, "given": 2, "organisation": 3, "organisation_id": 4}),
    (r"^(.+),\ (.+)$", {"family": 1, "given": 2}),
    (r"^(.+),(.+),(.+)$", {"family": 1, "given": 2, "email": 3}),
]


def parse_person_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """(given, family, email, organisation, organisation_id, orcid) of text lines by the first form that fits: "given, family,
    mail, affiliation, ORCID"; "family, given: organisation (id)"; "family, given"; "family,given,mail". Lines of no form are
    left out; an ORCID with a wrong check digit is null."""
    fields = ["given", "family", "email", "organisation", "organisation_id", "orcid"]
    line = F.trim(text)
    value = lambda p, g: F.nullif(F.trim(F.regexp_extract(line, p, g)), F.lit(""))
    found = [F.when(line.rlike(p), F.struct(*((value(p, groups[n]) if n in groups else F.lit(None).cast("string")).alias(n) for n in fields))) for p, groups in PERSON_FORMS]
    rows = lines.select(F.coalesce(*found).alias("p")).where("p is not null").select("p.*")
    code = F.regexp_extract("orcid", r"([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])$", 1)
    return rows.withColumn("orcid", F.when(orcid_valid(code), code))


def read_zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, md5, ts) of the members of zip archives, nested ones as outer!inner."""

    def members(name: str, raw: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                body = z.read(info)
                if info.filename.lower().endswith(".zip"):
                    yield from ((f"{info.filename}!{m}", *rest) for m, *rest in members(info.filename, body))
                else:
                    yield info.filename, info.file_size, hashlib.md5(body).hexdigest(), pd.Timestamp(*info.date_time)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                yield pd.DataFrame([(r.path, *m) for m in members(r.path, r.content)], columns=["archive", "member", "size", "md5", "ts"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, size long, md5 string, ts timestamp")


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)


def dump_objects(statements: DataFrame) -> DataFrame:
    """(end of submission, object, file name), in that order."""
    value = lambda p, n: F.max(F.when(F.col("pred") == p, F.col("obj"))).alias(n)
    rows = statements.where(F.col("pred").isin("hasName", "hasEndTime")).groupBy(F.col("subj").alias("object")).agg(value("hasEndTime", "submitted"), value("hasName", "file_name"))
    return rows.select("submitted", "object", "file_name").orderBy("submitted", "object")
