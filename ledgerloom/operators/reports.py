"""Catalog reports over wide tables. Dimension tables (specs, stations, formats) are joined after aggregation where possible.

objects: id, spec, station, site, submitter, size, file_name, height, data_start, data_end, submitted, deprecated.
specs: spec, spec_label, project, level, format, theme. stations: station, name, country, lat, lon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.scratch import TASK_ROWS, dealt
from .search import Filter, All, object_stats


def spec_basics(specs: DataFrame, hidden_projects: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Specs but for those of hidden projects, with their dataset and resolution where they have one."""
    rows = specs.join(hidden_projects, "project", "left_anti")
    return rows if datasets is None else rows.join(datasets, "spec", "left")


def spec_variables(columns: DataFrame, variables: DataFrame, flags: DataFrame) -> DataFrame:
    """(spec, name, value_type, unit): columns and variables of datasets without flag columns, unit default "(not applicable)"."""
    rows = columns.select("spec", "name", "value_type", "unit").union(variables.select("spec", "name", "value_type", "unit"))
    rows = rows.join(flags.select("spec", "name"), ["spec", "name"], "left_anti")
    return rows.withColumn("unit", F.coalesce("unit", F.lit("(not applicable)"))).distinct()


def origin_stats(objects: DataFrame, stations: DataFrame, specs: DataFrame, condition: Filter = All(), hidden: DataFrame | None = None) -> DataFrame:
    """Counts by origin of complete objects that aren't deprecated (where the objects tell), without specs of ``hidden`` projects,
    with spec label, station name and country and, where stations have them, ecosystem and ``stationclass``: Associated for
    classes that begin with Ass, ICOS for others, Other for stations without one. The joins come after the aggregation."""
    if "deprecated" in objects.columns:
        objects = objects.where("size is not null and not deprecated")
    counts, labels = object_stats(objects, condition), specs.select("spec", "spec_label")
    if hidden is not None:
        counts = counts.join(specs.join(hidden, "project", "left_semi").select("spec"), "spec", "left_anti")
    more = [c for c in ("ecosystem", "station_class") if c in stations.columns]
    out = counts.join(labels, "spec", "left").join(stations.select("station", "name", "country", *more), "station", "left")
    if "station_class" not in more:
        return out
    told = F.when(F.col("station_class").startswith("Ass"), "Associated").otherwise("ICOS")
    return out.withColumn("stationclass", F.when(F.col("station_class").isNotNull(), told).when(F.col("station").isNotNull(), "Other")).drop("station_class")


def object_details(objects: DataFrame, stations: DataFrame, dois: DataFrame) -> DataFrame:
    """One row per object: the least station name and the joined DOIs of its collections. dois: member, doi."""
    joined = dois.groupBy(F.col("member").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("doi")), ",").alias("dois"))
    names = stations.groupBy("station").agg(F.min("name").alias("station_name"))
    return objects.join(names, "station", "left").join(joined, "id", "left")


def labels(st: DataFrame, excluded: DataFrame, name: str = "hasName", label: str = "rdfs:label") -> DataFrame:
    """(subj, label): the name, else the label, of resources that aren't of excluded classes (obj)."""
    rows = st.where(F.col("pred").isin(name, label)).groupBy("subj").agg(F.coalesce(F.min(F.when(F.col("pred") == name, F.col("obj"))), F.min("obj")).alias("label"))
    types = st.where("pred = 'rdf:type'").join(excluded, "obj", "left_semi").select("subj").distinct()
    return rows.join(types, "subj", "left_anti")


def spec_keywords(of_spec: DataFrame, of_project: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, keywords): the project's and the spec's, sorted and joined."""
    rows = of_spec.select("spec", "keyword").union(specs.select("spec", "project").join(of_project, "project").select("spec", "keyword"))
    return rows.groupBy("spec").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("keywords"))


def stations_with_pis(stations: DataFrame, memberships: DataFrame, role: str = "PI") -> DataFrame:
    """Stations with the ;-joined sorted last names of their active PIs. memberships: station, role, last_name, stop."""
    pis = memberships.where((F.col("role") == role) & F.col("stop").isNull()).groupBy("station").agg(F.array_join(F.array_sort(F.collect_set("last_name")), ";").alias("pis"))
    return stations.join(pis, "station")


def list_objects(objects: DataFrame, condition: Filter = All(), offset: int = 0, limit: int | None = None) -> DataFrame:
    """Current complete objects, newest first."""
    rows = objects.where("size is not null and not deprecated").where(condition.column()).orderBy(F.desc("submitted"), F.asc("id"))
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def product_availability(objects: DataFrame, stations: DataFrame, specs: list[int]) -> DataFrame:
    """Objects of given specs with interval, height, station and its name."""
    rows = objects.where(F.col("spec").isin(specs) & ~F.col("deprecated")).select("id", "spec", "station", "height", "data_start", "data_end")
    return rows.join(stations.select("station", "name"), "station")


def raw_files_by_type(objects: DataFrame, types: DataFrame, file_type: str, station: int | None = None, since=None) -> DataFrame:
    """(pid, file_name, spec) of a file type, through the table types: file_type, spec."""
    rows = objects.join(types.where(F.col("file_type") == file_type), "spec")
    rows = rows if station is None else rows.where(F.col("station") == station)
    rows = rows if since is None else rows.where(F.col("data_start") >= F.lit(since).cast("timestamp"))
    return rows.select(F.substring("id", -24, 24).alias("pid"), "file_name", "spec")


def preview_schema(columns: DataFrame, formats: DataFrame, good_flags: DataFrame) -> DataFrame:
    """Columns of a spec with format, unit and the joined good flags. columns: spec, name, value_type, unit, flag_column; good_flags: format, flag."""
    flags = good_flags.groupBy("format").agg(F.array_join(F.array_sort(F.collect_set("flag")), ";").alias("good_flags"))
    return columns.join(formats, "value_type", "left").join(flags, "format", "left")


def known_objects(objects: DataFrame, ids: DataFrame, edges: DataFrame, variables: DataFrame) -> DataFrame:
    """Objects of given ids with has_next and has_variables."""
    nxt = edges.select(F.col("old").alias("id")).distinct().withColumn("has_next", F.lit(True))
    var = variables.select("id").distinct().withColumn("has_variables", F.lit(True))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return objects.join(ids, "id", "left_semi").join(nxt, "id", "left").join(var, "id", "left").select(*objects.columns, flag("has_next"), flag("has_variables"))


def latest_for(objects: DataFrame, keys: list[str]) -> DataFrame:
    """The newest current object of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("data_end"), F.asc("id"))
    return objects.where("size is not null and not deprecated").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def products_per_domain(specs: DataFrame, keywords: DataFrame, objects: DataFrame, theme: int, text: str, project: int | None = None) -> DataFrame:
    """Specs of levels 1 and 2 of a theme that belong to ``project`` or whose project's or own keywords contain a text, and that
    have a dataset (where specs tell) and objects."""
    rows = specs.where((F.col("theme") == theme) & F.col("level").isin(1, 2))
    hits = keywords.where(F.col("keyword").contains(text)).select("spec").distinct()
    rows = rows if "dataset" not in specs.columns else rows.where("dataset is not null")
    chosen = rows.join(hits, "spec", "left_semi")
    if project is not None:
        chosen = chosen.union(rows.where(F.col("project") == project)).distinct()
    return chosen.join(objects.select("spec"), "spec", "left_semi")


def findable_specs(specs: DataFrame, hidden: DataFrame) -> DataFrame:
    """Specs of levels 2 and 3 whose project isn't hidden."""
    return specs.where("level in (2, 3)").join(hidden, "project", "left_anti").select("spec")


def incomplete_uploads(objects: DataFrame) -> DataFrame:
    """Objects without a size, newest first."""
    return objects.where("size is null").orderBy(F.desc("submitted"), "id")


def objects_in_collections(objects: DataFrame, members: DataFrame, start, end) -> DataFrame:
    """(coll, id, submitted) submitted in a window."""
    rows = objects.where((F.col("submitted") >= F.lit(start).cast("timestamp")) & (F.col("submitted") < F.lit(end).cast("timestamp")))
    return rows.select("id", "submitted").join(members.select(F.col("member").alias("id"), "coll"), "id")


def geo_stats(objects: DataFrame, inside: DataFrame, specs: DataFrame) -> DataFrame:
    """Counts by spec (label and level) of objects in ``inside`` (id)."""
    counts = objects.join(inside.select("id").distinct(), "id", "left_semi").groupBy("spec").agg(F.count("*").alias("n"))
    return counts.join(specs.select("spec", "spec_label", "level"), "spec")


def stations_of_pi(memberships: DataFrame, email: str) -> DataFrame:
    """Stations of active PIs with an e-mail address, in any case."""
    return memberships.where((F.lower("email") == email.lower()) & F.col("stop").isNull()).select("station").distinct()


def last_objects(objects: DataFrame, specs: DataFrame, n: int) -> DataFrame:
    """The newest n objects with spec label and level."""
    top = objects.where("size is not null").orderBy(F.desc("submitted"), "id").limit(n)
    return top.join(specs.select("spec", "spec_label", "level"), "spec").select("id", "submitted", "spec_label", "level")


def per_format_stats(objects: DataFrame, specs: DataFrame, left_out: int) -> DataFrame:
    """Complete objects per format but for one."""
    counts = objects.where("size is not null").groupBy("spec").agg(F.count("*").alias("n"))
    return counts.join(specs.select("spec", "format"), "spec").where(F.col("format") != left_out).groupBy("format").agg(F.sum("n").alias("n"))


def species_and_heights(objects: DataFrame, variables: DataFrame) -> DataFrame:
    """Per station the distinct variables, heights and pairs, sorted and joined. variables: spec, variable. An object with a list
    of its own (``variables``, an array) has only those of its spec's that are in it; deprecated and incomplete objects don't
    count, where the objects tell."""
    rows = objects.where("station is not null")
    rows = rows.where("size is not null and not deprecated") if "deprecated" in objects.columns else rows
    own = ["variables"] if "variables" in objects.columns else []
    rows = rows.select("station", "spec", "height", *own).distinct().join(variables, "spec")
    rows = rows.where(F.col("variables").isNull() | F.array_contains("variables", F.col("variable"))) if own else rows
    text = F.col("height").cast("decimal(9,1)").cast("string")
    listed = lambda c, name: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name)
    return rows.groupBy("station").agg(listed(F.col("variable"), "variables"), listed(text, "heights"), listed(F.concat_ws("@", "variable", text), "pairs"))


def duplicates(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one current object."""
    return objects.where("size is not null and not deprecated").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: Objects of one name and spec meet in runs: so many earlier ones, so many later ones.
EARLIER_RUN, LATER_RUN = 64, 256
#: Objects of a task that spreads runs to pairs, about; few, as each is returned in many pairs.
PAIR_ROWS = 50_000


def resubmitted_files(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, later): a later object of the same name and spec that isn't linked as its next version.

    All such pairs. Objects are shuffled once by name and spec, together with the links from them, placed there by time, and meet as
    runs (arrays), which are spread to pairs only in what is returned: pairs are never shuffled, and neither a task's objects nor a
    run grows with the number of objects, but all of one name and spec are placed by one task. A run's pairs come in order, which
    writers pack well."""
    rows = objects.select("id", "file_name", "spec", "submitted").where("file_name is not null and spec is not null and submitted is not null")
    n, key = rows.count(), ["file_name", "spec"]
    links = dealt(edges.select(F.col("old").alias("id"), F.col("new").alias("link")), n, "id").join(dealt(rows.select("id", *key), n, "id"), "id")
    rows = dealt(rows.unionByName(links, allowMissingColumns=True), n * TASK_ROWS // PAIR_ROWS, *key)
    rows = rows.groupBy(*key, "id").agg(F.collect_list("submitted").alias("times"), F.collect_set("link").alias("links"))
    w = Window.partitionBy(*key).orderBy("submitted", "id")
    after = F.count("*").over(w).cast("int").alias("after")  # the place of the first that is later; equal ones count to the frame
    rows = rows.select(*key, "id", "links", F.explode("times").alias("submitted")).select(*key, (F.row_number().over(w) - 1).alias("place"), "id", after, "links")

    def runs(size: int, name: str) -> DataFrame:
        run = F.sort_array(F.collect_list(F.struct("place", "id", "after", "links")))  # whole on either side: one shuffle serves both
        return rows.groupBy(*key, F.expr(f"place div {size}").alias(f"{name}_run")).agg(run.alias(name))

    later = runs(LATER_RUN, "b").select(*key, "b_run", F.col("b.id").alias("b"))
    met = runs(EARLIER_RUN, "a").join(later, key).where(f"b_run >= a_run * {EARLIER_RUN} div {LATER_RUN}")
    pairs = met.select(F.explode("a").alias("a"), "b_run", "b").select("a", "b_run", F.posexplode("b").alias("i", "later"))
    return pairs.where(F.expr(f"b_run * {LATER_RUN} + i >= a.after and not coalesce(array_contains(a.links, later), false)")).select("a.id", "later")


def station_discrepancies(one: DataFrame, two: DataFrame, columns: list[str]) -> DataFrame:
    """Stations of two sources that differ in any column where both have a value."""
    a, b = one.alias("a"), two.alias("b")
    differs = F.lit(False)
    for c in columns:
        differs = differs | F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(False))
    return a.join(b, "station").where(differs).select("station", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in columns for s in "ab"))


def labelling_status(stations: DataFrame, statuses: DataFrame, dates: DataFrame) -> DataFrame:
    """Stations with a status text: the date of labelling, else the status, else 'not started'."""
    rows = stations.join(statuses, "station", "left").join(dates, "station", "left")
    return rows.select("station", F.when(F.col("labelled").isNotNull(), F.concat(F.lit("labelled "), F.date_format("labelled", "yyyy-MM-dd"))).otherwise(F.coalesce("status", F.lit("not started"))).alias("status"))


def no_activity(stations: DataFrame, activity: DataFrame, key: str = "station") -> DataFrame:
    return stations.join(activity.select(key), key, "left_anti").distinct()


def station_roles(memberships: DataFrame, people: DataFrame, stations: DataFrame) -> DataFrame:
    """People, roles, weights and times of stations."""
    return memberships.join(people, "person", "left").join(stations.select("station", "name"), "station").select("station", "name", "person", "role", "weight", "start", "stop")


def station_geography(stations: DataFrame, sites: DataFrame, points: DataFrame) -> DataFrame:
    """Stations, their sites' coverage and the sites' sampling points. sites: station, site, geo; points: site, point."""
    return stations.select("station", "name").join(sites, "station").join(points, "site", "left")


def polygon_tracks(geo: DataFrame, objects: DataFrame, fmt: int, specs: DataFrame, prefix: str) -> DataFrame:
    """Objects of a format whose geometry is a polygon, with a link built from the id."""
    rows = objects.join(specs.where(F.col("format") == fmt).select("spec"), "spec", "left_semi").join(geo.where(F.col("geojson").contains('"Polygon"')), "id")
    return rows.select("id", "file_name", F.concat(F.lit(prefix), F.substring_index("id", "/", -1)).alias("link")).orderBy(F.asc("file_name"), F.desc("id"))


def licence_of(objects: DataFrame, own: DataFrame, of_spec: DataFrame, of_project: DataFrame, specs: DataFrame, default: str) -> DataFrame:
    """(id, licence): own, else the spec's, else the project's, else a default."""
    rows = objects.select("id", "spec").join(specs.select("spec", "project"), "spec", "left").join(own.select("id", F.col("licence").alias("l1")), "id", "left")
    rows = rows.join(of_spec.select("spec", F.col("licence").alias("l2")), "spec", "left").join(of_project.select("project", F.col("licence").alias("l3")), "project", "left")
    return rows.select("id", F.coalesce("l1", "l2", "l3", F.lit(default)).alias("licence"))


def sitemap(objects: DataFrame, stations: DataFrame, specs: DataFrame, country: str | None = None) -> DataFrame:
    """(country, id) of current objects of levels 2 and 3."""
    rows = objects.where("size is not null and not deprecated").join(specs.where("level in (2, 3)").select("spec"), "spec", "left_semi")
    rows = rows.join(stations.select("station", "country"), "station", "left").select("country", "id")
    return rows if country is None else rows.where(F.col("country") == country)


def sitemap_of_lists(collections: DataFrame, documents: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id) of collections (id, doi) that have a DOI, and of documents (id), that nothing replaces (edges: new, old)."""
    old = edges.select(F.col("old").alias("id")).distinct()
    rows = collections.where("doi is not null").select(F.lit("collection").alias("kind"), "id").union(documents.select(F.lit("document"), "id"))
    return rows.join(old, "id", "left_anti").select("kind", "id")


def unlisted_hosts(objects: DataFrame, prefixes: list[str], iri: str = "id") -> DataFrame:
    """Current objects whose IRI starts with none of the prefixes."""
    known = F.lit(False)
    for p in prefixes:
        known = known | F.col(iri).startswith(p)
    return objects.where(~F.col("deprecated") & ~known)
