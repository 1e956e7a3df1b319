"""Statements of nested upload packages and collections: each part is an array of cells, exploded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.terms import hash_id
from ledgerloom.operators.statements import TYPE

CELL = "array<struct<subj: string, pred: string, obj: string, obj_kind: int, lit_attr: string>>"


def _cells(subj: Column, *cells: tuple) -> Column:
    """Cells (pred, value, kind, attr) of one subject; an array gives one for each item; without subject or value there is none."""
    out = []
    for pred, value, *rest in cells:
        kind, attr = (*rest, None, None)[:2] if rest else (0, None)
        values = F.coalesce(value.cast("array<string>"), F.array().cast("array<string>")) if rest and rest[-1] == "each" else F.array(value.cast("string"))
        attr = None if attr == "each" else attr
        out.append(F.transform(values, lambda v: F.struct(subj.alias("subj"), F.lit(pred).alias("pred"), v.alias("obj"), F.lit(kind).cast("int").alias("obj_kind"), F.lit(attr).cast("string").alias("lit_attr"))).cast(CELL))
    return F.filter(F.concat(*out), lambda c: c.subj.isNotNull() & c.obj.isNotNull())


def _contributors(subj: Column, pred: str, people: Column, node: Column) -> Column:
    """One contributor is named directly, more through a sequence with numbered members."""
    people = F.coalesce(people, F.array().cast("array<string>"))
    numbered = F.transform(people, lambda p, i: F.struct(node.alias("subj"), F.concat(F.lit("rdf:_"), i + 1).alias("pred"), p.alias("obj"), F.lit(0).alias("obj_kind"), F.lit(None).cast("string").alias("lit_attr"))).cast(CELL)
    many = F.concat(_cells(node, (TYPE, F.lit("rdf:Seq"))), _cells(subj, (pred, node)), numbered)
    return F.when(F.size(people) > 1, many).otherwise(_cells(subj, (pred, people, 0, "each")))


def _time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def packages_to_statements(packages: DataFrame, organisations: DataFrame, now, graph: str = "objects") -> DataFrame:
    """(graph, subj, pred, obj, obj_kind, lit_attr) of upload packages (sources.read_packages): the object, its submission,
    acquisition and production nodes, named after the hash's id, keywords, licence and version links. organisations:
    submitterId, org. A partial upload replaces a version through a plain collection, next_<id>, that holds it. An embargo that
    ends after ``now`` is the submission's end. Hashes may be in any notation; a package without one gives nothing."""
    info, refs = "specificInfo", "references"
    p = packages.join(organisations, "submitterId", "left").withColumn("_id", hash_id(F.col("hashSum"))).where("_id is not null")
    node = lambda kind: F.concat(F.lit(f"{kind}_"), F.col("_id"))
    obj, submission, acquisition, production = F.col("_id"), node("subm"), node("acq"), node("prod")
    get = lambda path: F.col(path)
    t = F.lit(now).cast("timestamp")
    partial = F.coalesce(F.col("partialUpload"), F.lit(False)) if "partialUpload" in packages.columns else F.lit(False)
    earlier = F.transform(F.coalesce("isNextVersionOf", F.array().cast("array<string>")), hash_id)
    keywords = F.filter(F.transform(get(f"{refs}.keywords"), lambda k: F.trim(k)), lambda k: k != "")
    has = lambda c: F.when(c.isNotNull(), F.lit(True))
    made = get(f"{info}.production")
    previous = F.get(earlier, F.lit(0))
    group = F.when(partial & (F.size(earlier) == 1), F.concat(F.lit("next_"), previous))
    string, time = (1, "xsd:string"), (1, "xsd:dateTime")
    parts = F.concat(
        _cells(obj, (TYPE, F.lit("DataObject")), ("hasObjectSpec", get("objectSpecification")), ("hasName", get("fileName"), *string), ("hasSha256sum", get("hashSum"), 1, "xsd:base64Binary"), ("wasSubmittedBy", submission), ("hasDoi", get("preExistingDoi"), *string)),
        _cells(obj, ("hasKeywords", F.when(F.size(keywords) > 0, F.array_join(keywords, ",")), *string), ("dcterms:license", get(f"{refs}.licence"))),
        _cells(submission, (TYPE, F.lit("Submission")), ("startedAtTime", _time(t), *time), ("wasAssociatedWith", get("org")), ("endedAtTime", _time(F.when(get(f"{refs}.moratorium") > t, get(f"{refs}.moratorium"))), *time)),
        F.when(partial, F.array().cast(CELL)).otherwise(_cells(obj, ("isNextVersionOf", earlier, 0, "each"))),
        _cells(group, (TYPE, F.lit("PlainCollection")), ("dcterms:hasPart", obj), ("isNextVersionOf", previous)),
        F.when(get(info).isNotNull(), F.concat(
            _cells(obj, ("wasAcquiredBy", acquisition)),
            _cells(acquisition, (TYPE, F.lit("Acquisition")), ("wasAssociatedWith", get(f"{info}.station")), ("wasPerformedAt", get(f"{info}.site")), ("startedAtTime", _time(get(f"{info}.acquisitionInterval.start")), *time), ("endedAtTime", _time(get(f"{info}.acquisitionInterval.stop")), *time), ("hasSamplingHeight", get(f"{info}.samplingHeight"), 1, "xsd:float"), ("wasPerformedWith", get(f"{info}.instrument"), 0, "each")),
        )).otherwise(F.array().cast(CELL)),
        F.when(has(made), F.concat(
            _cells(obj, ("wasProducedBy", production), ("hadPrimarySource", F.transform(F.coalesce(made.sources, F.array().cast("array<string>")), hash_id), 0, "each")),
            _cells(production, (TYPE, F.lit("Production")), ("wasPerformedBy", made.creator), ("hasEndTime", _time(made.creationDate), *time), ("rdfs:comment", made.comment, *string), ("wasHostedBy", made.hostOrganization)),
            _contributors(production, "wasParticipatedInBy", made.contributors, node("contribs")),
        )).otherwise(F.array().cast(CELL)),
    )
    return p.select(F.lit(graph).alias("graph"), F.explode(parts).alias("c")).select("graph", "c.*").distinct()


def collections_to_statements(collections: DataFrame, graph: str = "collections") -> DataFrame:
    """Statements of collections: id, title, description, creator, doi, and the arrays previous, members and documentation."""
    string = (1, "xsd:string")
    c = F.col
    cells = _cells(c("id"), (TYPE, F.lit("Collection")), ("dcterms:title", c("title"), *string), ("dcterms:creator", c("creator")), ("dcterms:description", c("description"), *string), ("hasDoi", c("doi"), *string), ("isNextVersionOf", c("previous"), 0, "each"), ("dcterms:hasPart", c("members"), 0, "each"), ("rdfs:seeAlso", c("documentation"), 0, "each"))
    return collections.select(F.lit(graph).alias("graph"), F.explode(cells).alias("c")).select("graph", "c.*").distinct()
