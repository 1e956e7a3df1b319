"""Object search: a small filter tree compiled to columns, paging, statistics and keywords."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.geo import intersecting


class Filter:
    """A condition on object rows; & | ~ combine. A null property satisfies no condition, and so every negated one."""

    def column(self) -> Column:
        raise NotImplementedError

    def prepare(self, objects: DataFrame) -> DataFrame:
        """objects with the columns that column() needs besides their own."""
        return objects

    def found(self, objects: DataFrame) -> DataFrame:
        """The rows of objects that satisfy the condition."""
        return self.prepare(objects).where(self.column()).select(*objects.columns)

    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)

    def __invert__(self) -> Filter:
        return Not(self)


class Where(Filter):
    """Any boolean column."""

    def __init__(self, condition: Column):
        self.condition = condition

    def column(self) -> Column:
        return F.coalesce(self.condition, F.lit(False))


class All(Filter):
    def column(self) -> Column:
        return F.lit(True)


class Nothing(Filter):
    def column(self) -> Column:
        return F.lit(False)


class Parts(Filter):
    def __init__(self, *parts: Filter):
        self.parts = parts

    def prepare(self, objects: DataFrame) -> DataFrame:
        return reduce(lambda o, p: p.prepare(o), self.parts, objects)


class And(Parts):
    """Without parts: everything."""

    def found(self, objects: DataFrame) -> DataFrame:
        """Conditions on columns first; a part that needs another table then is a semi join, not a flag."""
        plain = And(*(p for p in self.parts if not isinstance(p, Related))) if any(isinstance(p, Related) for p in self.parts) else None
        if plain is None:
            return super().found(objects)
        return reduce(lambda o, p: p.found(o), (p for p in self.parts if isinstance(p, Related)), plain.found(objects))

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))


class Or(Parts):
    """Without parts: nothing."""

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts), F.lit(False))


class Not(Filter):
    def __init__(self, part: Filter):
        self.part = part

    def prepare(self, objects: DataFrame) -> DataFrame:
        return self.part.prepare(objects)

    def column(self) -> Column:
        return ~self.part.column()


class Related(Filter):
    """Rows whose value of ``name`` is among those of a table's first column: a semi join, or, below Or and Not, a flag."""

    def __init__(self, name: str, table: DataFrame):
        self.name, self.table, self.flag = name, table.toDF("_value").where("_value is not null").distinct(), f"_related_{uuid.uuid4().hex}"

    def prepare(self, objects: DataFrame) -> DataFrame:
        if self.flag in objects.columns:
            return objects
        flags = self.table.select(F.col("_value").alias(f"{self.flag}_key"), F.lit(True).alias(self.flag))
        return objects.join(flags, objects[self.name] == flags[f"{self.flag}_key"], "left").drop(f"{self.flag}_key")

    def found(self, objects: DataFrame) -> DataFrame:
        return objects.join(self.table, objects[self.name] == self.table["_value"], "left_semi")

    def column(self) -> Column:
        return F.coalesce(F.col(self.flag), F.lit(False))


def intersects(geometries: DataFrame, area: list[tuple[float, float]], name: str = "id") -> Filter:
    """Objects with any geometry that meets a polygon. geometries: ``name``, coords, geom_type and the envelope, best from a layout."""
    return Related(name, intersecting(geometries, area).select(name))


def any_of(name: str, values: DataFrame) -> Filter:
    """The property's value is in a table, of any length."""
    return Related(name, values)


def has_keyword(bridge: DataFrame, wanted: Iterable[str]) -> Filter:
    """Objects with any of the keywords; bridge: id, keyword."""
    return Related("id", bridge.where(F.col("keyword").isin(list(wanted))).select("id"))


def has_variable(variables: DataFrame, wanted: Iterable[str]) -> Filter:
    """Objects with any of the variables; variables: id, variable."""
    return Related("id", variables.where(F.col("variable").isin(list(wanted))).select("id"))


def exists(name: str, listed: bool = False) -> Filter:
    """The property is present; a listed one isn't empty."""
    return Where(F.size(name) > 0 if listed else F.col(name).isNotNull())


def one_of(name: str, values: Iterable) -> Filter:
    return Where(F.col(name).isin(list(values)))


def matches(name: str, pattern: str) -> Filter:
    """The whole value matches."""
    return Where(F.col(name).rlike(f"^(?:{pattern})$"))


def compare(name: str, operator: str, value) -> Filter:
    """operator: = > >= < <=."""
    c = F.col(name)
    return Where({"=": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[operator])


def between(name: str, low, high) -> Filter:
    return Where(F.col(name).between(low, high))


def by_id(ids: Iterable[str]) -> Filter:
    """Full hashes and their first 24 characters name the same object."""
    return Where(F.substring("id", 1, 24).isin([str(i)[-24:] if len(str(i)) > 24 and "/" in str(i) else str(i)[:24] for i in ids]))


def host(name: str, domain: str) -> Filter:
    """The IRI's host is the domain."""
    return Where(F.expr(f"try_parse_url({name}, 'HOST')") == domain)


def is_complete() -> Filter:
    """Only objects with spec and submitter are found."""
    return exists("spec") & exists("submitter")


def fetch_objects(objects: DataFrame, condition: Filter = All(), sort: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filtered objects; sorting leaves out those without the property, ties by id ascending."""
    found = And(is_complete(), *(condition.parts if isinstance(condition, And) else [condition])).found(objects)
    if sort:
        found = found.where(F.col(sort).isNotNull()).orderBy(F.col(sort).desc() if descending else F.col(sort).asc(), F.col("id").asc())
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def object_keywords(own: DataFrame, of_spec: DataFrame, of_project: DataFrame, objects: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, keyword): the object's, its spec's and the spec's project's; the small sides have one row for each spec."""
    base = objects.select("id", "spec")
    project = base.join(specs.select("spec", "project"), "spec").join(of_project, "project").select("id", "keyword")
    return own.select("id", "keyword").union(base.join(of_spec, "spec").select("id", "keyword")).union(project).distinct()


def with_keywords(objects: DataFrame, bridge: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Objects that have any of the keywords."""
    return objects.join(bridge.where(F.col("keyword").isin(list(wanted))), "id", "left_semi")


def object_variables(objects: DataFrame, names: str = "columns_json", nodes: str | None = None) -> DataFrame:
    """(id, variable): from a JSON array of names, and from variable IRIs' last parts."""
    own = objects.select("id", F.explode(F.from_json(names, "array<string>")).alias("variable"))
    if nodes:
        own = own.union(objects.select("id", F.explode(F.transform(nodes, lambda x: F.url_decode(F.substring_index(x, "/", -1)))).alias("variable")))
    return own.distinct()


def with_variables(objects: DataFrame, variables: DataFrame, wanted: Iterable[str]) -> DataFrame:
    return objects.join(variables.where(F.col("variable").isin(list(wanted))), "id", "left_semi")


def deprecation_flag(objects: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """objects with ``deprecated``: replaced by a complete object, a collection, or a plain collection with a complete member.

    edges: new, old; members: coll, member, plain, with coll as text comparable to new."""
    complete = objects.where("size is not null").select(F.col("id").alias("new"))
    old = edges.join(complete, "new", "left_semi").select("old")
    if members is not None:
        colls = members.groupBy(F.col("coll").cast("string").alias("new")).agg(F.max("plain").alias("plain"), F.collect_set("member").alias("m"))
        whole = colls.where("not plain").select("new")
        inner = members.where("plain").select(F.col("coll").cast("string").alias("coll"), F.col("member").alias("new")).join(complete, "new", "left_semi").select(F.col("coll").alias("new"))
        old = old.union(edges.join(whole.union(inner).distinct(), "new", "left_semi").select("old"))
    flags = old.distinct().select(F.col("old").alias("id"), F.lit(True).alias("deprecated"))
    return objects.join(flags, "id", "left").withColumn("deprecated", F.coalesce("deprecated", F.lit(False)))


def object_stats(objects: DataFrame, condition: Filter = All(), by_site: bool = True) -> DataFrame:
    """Counts by spec, submitter, station and site; null stations and sites are groups."""
    keys = ["spec", "submitter", "station", *(["site"] if by_site else [])]
    return fetch_objects(objects, condition).groupBy(*keys).agg(F.count("*").alias("n"))


def object_stats_rollup(objects: DataFrame, condition: Filter = All()) -> DataFrame:
    """Counts with and without site in one pass; ``with_site`` tells them apart."""
    found = fetch_objects(objects, condition)
    sets = found.groupingSets([["spec", "submitter", "station", "site"], ["spec", "submitter", "station"]], "spec", "submitter", "station", "site")
    return sets.agg(F.count("*").alias("n"), (F.grouping("site") == 0).alias("with_site"))


def unique_keywords(objects: DataFrame, bridge: DataFrame, condition: Filter = All()) -> DataFrame:
    """One row: the sorted distinct keywords of the found objects, comma-joined."""
    found = bridge.join(fetch_objects(objects, condition).select("id"), "id", "left_semi")
    return found.select("keyword").distinct().agg(F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("keywords"))


def union_search(objects: DataFrame, conditions: Iterable[Filter]) -> DataFrame:
    """Objects that any of the conditions finds, each once."""
    return fetch_objects(objects, Or(*conditions))
