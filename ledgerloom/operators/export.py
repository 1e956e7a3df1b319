"""Exports for citation, discovery and measurement archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .intervals import coverage_text
from .ranks import number_rows
from .statements import unpivot


LICENCE = "https://creativecommons.org/licenses/by/4.0/"


def dcat_export(objects: DataFrame, specs: DataFrame, stations: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Statements of the datasets, distributions and periods of current objects with a station, and of their keywords.

    objects: also prod_end and subm_start, where known: modified is the end of production if that is before the submission
    began, else that. specs: spec, spec_label and, if there, comment and theme_iri. keywords: id, keyword. Nodes are named after
    the object: <id>/distribution, <id>/period."""
    rows = objects.where("size is not null and not deprecated").join(specs, "spec").join(stations.select("station", "name"), "station")
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    began = F.coalesce(have("subm_start", "timestamp"), F.col("submitted"))
    made = have("prod_end", "timestamp")
    node = lambda part: F.concat("id", F.lit(f"/{part}"))
    rows = rows.select(
        "id", F.col("file_name").alias("title"), F.concat("spec_label", F.lit(", station "), "name", F.lit(". "), F.coalesce(have("comment", "string"), F.lit(""))).alias("description"), text("submitted").alias("issued"),
        text(F.when(made < began, made).otherwise(began)).alias("modified"), F.col("station").cast("string").alias("station"), node("period").alias("period"), node("distribution").alias("distribution"), have("theme_iri", "string").alias("theme"),
        text("data_start").alias("begin"), text("data_end").alias("end"), F.col("size").cast("string").alias("bytes"), F.lit(LICENCE).alias("licence"), F.concat(F.lit("data:"), "id").alias("download"), F.lit("dcat:Dataset").alias("kind"), F.lit("dct:PeriodOfTime").alias("period_kind"), F.lit("dcat:Distribution").alias("distribution_kind"),
    )
    string, time = (1, "xsd:string"), (1, "xsd:dateTime")
    of_dataset = {"kind": ("rdf:type", 0, None), "title": ("dct:title", *string), "description": ("dct:description", *string), "issued": ("dct:issued", *time), "modified": ("dct:modified", *time), "station": ("prov:wasAttributedTo", 0, None), "period": ("dct:temporal", 0, None), "distribution": ("dcat:distribution", 0, None), "theme": ("dcat:theme", 0, None)}
    of_period = {"period_kind": ("rdf:type", 0, None), "begin": ("dcat:startDate", *time), "end": ("dcat:endDate", *time)}
    of_distribution = {"distribution_kind": ("rdf:type", 0, None), "id": ("dcat:accessURL", 0, None), "licence": ("dct:license", 0, None), "bytes": ("dcat:byteSize", 1, "xsd:long"), "download": ("dcat:downloadURL", 0, None)}
    out = unpivot(rows, "id", of_dataset, "dcat").union(unpivot(rows, "period", of_period, "dcat")).union(unpivot(rows, "distribution", of_distribution, "dcat"))
    if keywords is not None:
        told = keywords.select("id", "keyword").distinct().join(rows.select("id"), "id", "left_semi")
        out = out.union(unpivot(told, "id", {"keyword": ("dcat:keyword", *string)}, "dcat"))
    return out


def site_export(stations: DataFrame, pis: DataFrame) -> DataFrame:
    """(station, name, pi, geojson): one PI per station, the point as text. pis: station, person."""
    one = pis.groupBy("station").agg(F.min("person").alias("pi"))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    return stations.join(one, "station", "left").select("station", "name", "pi", point.alias("geojson"))


def b2find_export(objects: DataFrame, specs: DataFrame, stations: DataFrame) -> DataFrame:
    """Flat rows for a discovery portal."""
    rows = objects.where("size is not null and not deprecated").join(specs.select("spec", "spec_label"), "spec").join(stations.select("station", "name"), "station", "left")
    return rows.select("id", F.coalesce(F.concat_ws(" at ", "spec_label", "name"), "spec_label").alias("title"), F.date_format("data_start", "yyyy-MM-dd").alias("begin"), F.date_format("data_end", "yyyy-MM-dd").alias("end"), F.year("submitted").cast("string").alias("publication_year"))


def citations(objects: DataFrame, specs: DataFrame, stations: DataFrame, authors: DataFrame) -> DataFrame:
    """(id, citation): authors (year). title, coverage, pid. authors: id, authors (array)."""
    rows = objects.join(specs.select("spec", "spec_label"), "spec").join(stations.select("station", "name"), "station", "left").join(authors, "id", "left")
    names = F.nullif(F.array_join("authors", ", "), F.lit(""))
    title = F.concat_ws(", ", "spec_label", "name", coverage_text(F.col("data_start"), F.col("data_end")))
    return rows.select("id", F.concat(F.coalesce(F.concat(names, F.lit(" ")), F.lit("")), F.lit("("), F.year("submitted"), F.lit("). "), title, F.lit(", "), "id").alias("citation"))


def bibtex(rows: DataFrame) -> DataFrame:
    """(id, bibtex) from id, authors (array), title, year, url; lines without a value are left out."""
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    body = F.concat_ws(",\n", line("author", F.array_join("authors", " and ")), line("title", F.col("title")), line("year", F.col("year").cast("string")), line("url", F.col("url")))
    return rows.select("id", F.concat(F.lit("@misc{"), "id", F.lit(",\n"), body, F.lit("\n}")).alias("bibtex"))


def ris(rows: DataFrame) -> DataFrame:
    """(id, ris) from the same columns."""
    line = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{tag}  - "), c))
    authors = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n")
    return rows.select("id", F.concat_ws("\n", F.lit("TY  - DATA"), F.nullif(authors, F.lit("")), line("TI", F.col("title")), line("PY", F.col("year").cast("string")), line("UR", F.col("url")), F.lit("ER  - ")).alias("ris"))


def doi_metadata(rows: DataFrame) -> DataFrame:
    """(id, json): creators, title, subjects, dates, rights, a geographic box and, where rows have ``fundings`` (an array of
    struct funder, award), the funding references; without any of these there is no such field. rows: id, authors, title,
    keywords (arrays), data_start, data_end, licence, box."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    fields = [
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("creators"), F.array(F.struct(F.col("title").alias("title"))).alias("titles"), F.transform("keywords", lambda k: F.struct(k.alias("subject"))).alias("subjects"),
        F.array(F.struct(F.concat_ws("/", day("data_start"), day("data_end")).alias("date"), F.lit("Collected").alias("dateType"))).alias("dates"), F.array(F.struct(F.col("licence").alias("rightsUri"))).alias("rightsList"), F.array(F.struct(F.col("box").alias("geoLocationBox"))).alias("geoLocations"),
    ]
    if "fundings" in rows.columns:
        fields.append(F.when(F.size("fundings") > 0, F.transform(F.array_distinct("fundings"), lambda f: F.struct(f.funder.alias("funderName"), f.award.alias("awardNumber")))).alias("fundingReferences"))
    return rows.select("id", F.to_json(F.struct(*fields)).alias("json"))


def schema_org(rows: DataFrame) -> DataFrame:
    """(id, json): a JSON-LD dataset. rows: id, title, description, keywords, licence, data_start, data_end."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Dataset").alias("@type"), F.col("id").alias("@id"), F.col("title").alias("name"), "description", "keywords", F.col("licence").alias("license"), F.concat_ws("/", day("data_start"), day("data_end")).alias("temporalCoverage"))
    return rows.select("id", F.to_json(doc).alias("json"))


def measurement_table(series: DataFrame) -> DataFrame:
    """series: site, species, time, value, sd, n. Mole fractions scaled (CO2 by 1e6, else 1e9), blanked where n is 0 (sd where n is 1 at most), missing as -999.999 and -9."""
    factor = F.when(F.upper("species") == "CO2", 1e6).otherwise(1e9)
    value = F.when(F.coalesce("n", F.lit(1)) > 0, F.col("value") * factor)
    sd = F.when(F.coalesce("n", F.lit(2)) > 1, F.col("sd") * factor)
    parts = {"year": F.year("time"), "month": F.month("time"), "day": F.dayofmonth("time"), "hour": F.hour("time"), "minute": F.minute("time")}
    return series.select("site", "species", *(c.alias(n) for n, c in parts.items()), F.coalesce(value, F.lit(-999.999)).alias("value"), F.coalesce(sd, F.lit(-999.999)).alias("sd"), F.coalesce("n", F.lit(-9)).alias("n"))


def catalogue_id(objects: DataFrame, maps: dict[str, DataFrame], name: str = "file_name") -> DataFrame:
    """objects with ``catalogue_id``: codes of the file name's parts (maps: part name -> table of key, code, in order of the parts), padded to four; an unknown part gives an empty text."""
    out = objects.withColumn("_parts", F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_"))
    codes = []
    for k, (part, look) in enumerate(maps.items()):
        out = out.withColumn("key", F.get("_parts", F.lit(k))).join(look.select("key", F.col("code").alias(part)), "key", "left").drop("key")
        codes.append(F.lpad(part, 4, "0"))
    known = codes[0].isNotNull()
    for c in codes[1:]:
        known = known & c.isNotNull()
    return out.withColumn("catalogue_id", F.when(known, F.concat_ws("-", *codes)).otherwise("")).drop("_parts", *maps)


def number_by_appearance(rows: DataFrame, key: str, seq: str, prefix: str) -> DataFrame:
    """(key, number, code): keys numbered by their first appearance; one row for each contact or organisation."""
    first = rows.groupBy(key).agg(F.min(seq).alias("first"))
    n = F.col("_n") + 1
    return number_rows(first, ["first", key], "_n").select(key, n.alias("number"), F.concat(F.lit(prefix), F.lpad(n.cast("string"), 4, "0")).alias("code"))


def submission_window(objects: DataFrame, start, end, key: list[str]) -> DataFrame:
    """Of each key the newest object submitted in the closed window."""
    rows = objects.where(F.col("submitted").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    w = Window.partitionBy(*key).orderBy(F.desc("submitted"), F.asc("id"))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def instrument_uri_from_filename(objects: DataFrame, prefix: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, instrument) from names like XX-Yyy_EC_201801_L03_F01: station and logger and file number without a leading zero; and those whose instrument isn't known (instrument)."""
    part = lambda g: F.regexp_replace(F.regexp_extract("file_name", r"^([A-Za-z]{2}-[A-Za-z0-9]{3})_[^_]+_.*_L0*([0-9]+)_F0*([0-9]+)", g), "^0", "")
    rows = objects.where(part(1) != "").select("id", F.concat(F.lit(prefix), F.concat_ws("_", part(1), part(2), part(3))).alias("instrument"))
    return rows, rows.join(known.select("instrument"), "instrument", "left_anti")
