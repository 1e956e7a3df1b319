"""Bulk validation of upload packages: every rule gives rows (pkg_id, rule, message); a package without rows is valid.

packages: pkg_id, spec, station, submitter, file_name, data_start, data_end, previous, hash, level, description, keywords,
references (array of person or organisation ids), is_growing, embargo_until, theme, variables (array)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _rows(bad: DataFrame, rule: str, message: str | Column) -> DataFrame:
    return bad.select("pkg_id", F.lit(rule).alias("rule"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def previous_exists(packages: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """C1: the previous version exists, is complete, isn't the object itself and has no other complete successor."""
    named = packages.where("previous is not null")
    own = objects.select(F.col("id").alias("previous"), "size")
    found = named.join(own, "previous", "left")
    complete = objects.where("size is not null").select(F.col("id").alias("new"))
    taken = edges.join(complete, "new", "left_semi").select(F.col("old").alias("previous"), F.col("new").alias("hash"))
    other = named.join(taken.select("previous", F.col("hash").alias("other")), "previous").where("other <> hash")
    parts = [_rows(found.where("size is null"), "C1", "previous version is missing or incomplete"), _rows(named.where("previous = hash"), "C1", "previous version is the object itself"), _rows(other, "C1", "previous version has another successor")]
    return reduce(DataFrame.union, parts).distinct()


def references_resolve(packages: DataFrame, known: DataFrame, column: str = "references") -> DataFrame:
    """C2: every referenced id is known (known: ref)."""
    refs = packages.select("pkg_id", F.explode(column).alias("ref"))
    return _rows(refs.join(known, "ref", "left_anti"), "C2", F.concat(F.lit("unknown reference "), F.col("ref"))).distinct()


def name_is_free(packages: DataFrame, objects: DataFrame) -> DataFrame:
    """C3: no other current complete object has the file name, but for the declared previous version.

    The objects of a name are counted first; what the package itself and its previous version are of them is taken off."""
    taken = objects.where("size is not null and not deprecated").select("file_name", "id").distinct()
    counts = taken.groupBy("file_name").agg(F.count("*").alias("n"))
    own = packages.select("pkg_id", "file_name", F.explode(F.array_distinct(F.array_compact(F.array("previous", "hash")))).alias("id"))
    own = own.join(taken, ["file_name", "id"], "left_semi").distinct().groupBy("pkg_id", "file_name").agg(F.count("*").alias("own"))
    hit = packages.select("pkg_id", "file_name").distinct().join(counts, "file_name").join(own, ["pkg_id", "file_name"], "left").where(F.col("n") > F.coalesce("own", F.lit(0)))
    return _rows(hit.select("pkg_id").distinct(), "C3", "file name is taken")


def name_deprecations(packages: DataFrame, objects: DataFrame) -> DataFrame:
    """(pkg_id, previous): for packages that declare none, the current object of the same name and spec that they replace."""
    taken = objects.where("size is not null and not deprecated").select("file_name", "spec", F.col("id").alias("found"))
    return packages.where("previous is null").join(taken, ["file_name", "spec"]).where("found <> hash").select("pkg_id", F.col("found").alias("previous"))


def sane_interval(packages: DataFrame, now) -> DataFrame:
    """C4: below level 3 the coverage isn't in the future and starts before it ends."""
    low = packages.where("level < 3")
    t = F.lit(now).cast("timestamp")
    return _rows(low.where(F.col("data_end") > t), "C4", "coverage ends in the future").union(_rows(low.where("data_start > data_end"), "C4", "coverage ends before it starts"))


def sane_production(packages: DataFrame, extensions: DataFrame) -> DataFrame:
    """C5: level 0 has no production; descriptions have 5000 characters at most; the extension fits the format (extensions: spec, extension)."""
    ext = packages.join(extensions, "spec")
    return reduce(DataFrame.union, [
        _rows(packages.where("level = 0 and production is not null"), "C5", "level 0 has no production"), _rows(packages.where(F.length("description") > 5000), "C5", "description is too long"),
        _rows(ext.where(F.substring_index("file_name", ".", -1) != F.col("extension")), "C5", "extension doesn't fit the format"),
    ])


def same_on_reupload(packages: DataFrame, objects: DataFrame) -> DataFrame:
    """C6: an uploaded object keeps its submitter and spec."""
    own = objects.select(F.col("id").alias("hash"), F.col("submitter").alias("s"), F.col("spec").alias("f"))
    both = packages.join(own, "hash")
    return _rows(both.where("submitter <> s"), "C6", "submitter changed").union(_rows(both.where("spec <> f"), "C6", "format changed"))


def spec_fits(packages: DataFrame, specs: DataFrame, defs: DataFrame | None = None, row_info: tuple[int, ...] = ()) -> DataFrame:
    """C7: the spec is known and fits the package.

    packages: spec and, if there, is_spatial, data_start, n_rows, variables (array). specs: spec and, if there, spatial (its
    datasets are spatio-temporal, else station time series), dataset (null: the spec has none), format. defs: dataset and the
    columns of resolve_variables. A spatial package's variables need a dataset, and one of its definitions each. A time series
    needs an interval if there is no dataset, else its number of rows, unless the format (``row_info``) tells it itself."""
    rows = [_rows(packages.join(specs, "spec", "left_anti"), "C7", "unknown spec")]
    if "spatial" not in specs.columns:
        return rows[0]
    both = packages.join(specs.select("spec", "spatial", "dataset", "format"), "spec")
    fits = both.where(F.col("is_spatial") == F.col("spatial"))
    rows += [
        _rows(both.where("is_spatial and not spatial"), "C7", "dataset must be spatiotemporal"), _rows(both.where("not is_spatial and spatial"), "C7", "dataset must be a station's time series"),
        _rows(fits.where("not is_spatial and dataset is null and data_start is null"), "C7", "interval is missing"),
        _rows(fits.where("not is_spatial and dataset is not null and n_rows is null").where(~F.col("format").isin(list(row_info))), "C7", "number of rows is missing"),
        _rows(fits.where("is_spatial and dataset is null and size(variables) > 0"), "C7", "spec has no dataset for variables"),
    ]
    if defs is not None:
        named = fits.where("is_spatial and dataset is not null").select("pkg_id", "dataset", F.explode(F.array_distinct("variables")).alias("name"))
        known = resolve_variables(named, defs, ["dataset"])
        rows.append(_rows(named.join(known, ["dataset", "name"], "left_anti"), "C7", F.concat(F.lit("unknown variable "), F.col("name"))))
    return reduce(DataFrame.union, rows)


def growing_grows(packages: DataFrame, objects: DataFrame) -> DataFrame:
    """C8: a growing object ends later than its previous version."""
    own = objects.select(F.col("id").alias("previous"), F.col("data_end").alias("old_end"))
    return _rows(packages.where("is_growing").join(own, "previous").where("data_end <= old_end"), "C8", "it doesn't end later than its previous version")


def literal_prefix(pattern: Column) -> Column:
    """The text that every match of a regular expression begins with, as far as its first characters show it: up to the first
    special character, without a character that a quantifier makes optional; empty if the pattern has alternatives."""
    bare = F.regexp_replace(pattern, r"^\^", "")
    text = F.regexp_extract(bare, r"^([^\\\[\](){}.*+?^$|]*)", 1)
    after = F.substring(bare, F.length(text) + 1, F.lit(1))
    kept = F.when(after.isin("*", "?", "{"), F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))).otherwise(text)
    return F.when(pattern.contains("|"), "").otherwise(kept)


def resolve_variables(names: DataFrame, defs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """C9: (*keys, name, var): the definition of the same title, the last one of equal ones; else the first pattern that matches
    the whole name, mandatory ones first, in order of the definitions. names: *keys, name; defs: *keys, nr (their order), var,
    title, is_pattern, optional; ``keys`` say which definitions a name has.

    Patterns are indexed by their literal prefix: a name meets those whose prefix it begins with, by an equality of texts."""
    keys = keys or []
    wanted = names.select(*keys, "name").distinct()
    titles = defs.where("not is_pattern").groupBy(*keys, F.col("title").alias("name")).agg(F.max_by("var", "nr").alias("exact"))
    known = wanted.join(titles, [*keys, "name"], "left")
    patterns = defs.where("is_pattern").select(*keys, "nr", "var", "title", "optional", literal_prefix(F.col("title")).alias("prefix"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substring("name", F.lit(1), k))
    begun = known.where("exact is null").select(*keys, "name", F.explode(prefixes).alias("prefix")).join(patterns, [*keys, "prefix"])
    found = begun.where(F.expr("name rlike concat('^(?:', title, ')$')")).groupBy(*keys, "name").agg(F.min_by("var", F.struct("optional", "nr")).alias("matched"))
    return known.join(found, [*keys, "name"], "left").select(*keys, "name", F.coalesce("exact", "matched").alias("var")).where("var is not null")


def sane_embargo(packages: DataFrame, now) -> DataFrame:
    """C10: an embargo ends in the future and is only set before publication."""
    t = F.lit(now).cast("timestamp")
    return _rows(packages.where(F.col("embargo_until") <= t), "C10", "embargo is over").union(_rows(packages.where("embargo_until is not null and is_published"), "C10", "already published"))


def submitter_may(packages: DataFrame, allowed: DataFrame) -> DataFrame:
    """C11: the submitter's allowed themes (submitter, themes) hold the package's; without a row nothing is allowed."""
    both = packages.join(allowed, "submitter", "left")
    return _rows(both.where(~F.coalesce(F.array_contains("themes", F.col("theme")), F.lit(False))), "C11", "theme isn't allowed")


def validate_packages(*rules: DataFrame) -> DataFrame:
    """All rules' rows."""
    return reduce(DataFrame.union, rules)
