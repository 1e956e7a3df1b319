"""Operators on statement tables: graph, subj, pred, obj, obj_kind (0 IRI, 1 typed, 2 language), lit_attr."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.scratch import dealt, materialize

from .ranks import number_rows

KEY = ["subj", "pred", "obj", "obj_kind", "lit_attr"]
TYPE, SUBCLASS = "rdf:type", "rdfs:subClassOf"


def same_key(a: DataFrame, b: DataFrame, keys: list[str] = KEY) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def match(st: DataFrame, s=None, p=None, o=None, graphs: list[str] | None = None) -> DataFrame:
    """Statements of a pattern; any part may be free."""
    for name, value in (("subj", s), ("pred", p), ("obj", o)):
        st = st if value is None else st.where(F.col(name) == value)
    return st if graphs is None else st.where(F.col("graph").isin(graphs))


def typed_values(st: DataFrame, pred: str, dtype: str, sql_type: str) -> DataFrame:
    """Distinct (subj, value) of a property with exactly this datatype; bad lexical values are dropped."""
    rows = st.where((F.col("pred") == pred) & (F.col("obj_kind") == 1) & (F.col("lit_attr") == dtype))
    return rows.select("subj", F.col("obj").try_cast(sql_type).alias("value")).where("value is not null").distinct()


def check_cardinality(st: DataFrame, subjects: DataFrame, pred: str, dtype: str, sql_type: str, low: int, high: int | None) -> tuple[DataFrame, DataFrame]:
    """(subj, values) of subjects with between low and high values, and (subj, error) of the others."""
    values = typed_values(st, pred, dtype, sql_type)
    found = subjects.select("subj").distinct().join(values, "subj", "left").groupBy("subj").agg(F.array_sort(F.collect_set("value")).alias("values"))
    good = (F.size("values") >= low) & (F.lit(True) if high is None else F.size("values") <= high)
    errors = found.where(~good).select("subj", F.concat(F.lit(f"{pred}: expected {low}..{'n' if high is None else high} values, found "), F.size("values")).alias("error"))
    return found.where(good), errors


def follow_path(st: DataFrame, start: DataFrame, preds: list[str], optional: bool = False) -> DataFrame:
    """(start, end) along predicates from the column ``node``; an optional path keeps its start with a null end."""
    out = start.select(F.col("node").alias("start"), F.col("node").alias("end"))
    for p in preds:
        step = st.where(F.col("pred") == p).select(F.col("subj").alias("end"), F.col("obj").alias("next"))
        out = out.join(step, "end", "left" if optional else "inner").select("start", F.col("next").alias("end"))
    return out


def alt_path(st: DataFrame, start: DataFrame, paths: list[list[str]]) -> DataFrame:
    """The union of several paths, with repeats."""
    return reduce(DataFrame.union, (follow_path(st, start, p) for p in paths))


def unpivot(rows: DataFrame, subject: str, preds: dict[str, tuple[str, int, str]], graph: str = "") -> DataFrame:
    """Statements of a wide table: column -> (predicate, obj_kind, lit_attr); null cells give none, arrays one for each item."""
    kinds = dict(rows.dtypes)

    def cell(column: str, pred: str, kind: int, attr: str | None) -> Column:
        values = F.col(column) if kinds[column].startswith("array") else F.array(column)
        return F.transform(values, lambda v: F.struct(F.lit(pred).alias("pred"), v.cast("string").alias("obj"), F.lit(kind).alias("obj_kind"), F.lit(attr).cast("string").alias("lit_attr")))

    cells = [cell(column, *spec) for column, spec in preds.items()]
    all_cells = F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<struct<pred:string,obj:string,obj_kind:int,lit_attr:string>>")) for c in cells)))
    return rows.select(F.lit(graph).alias("graph"), F.col(subject).cast("string").alias("subj"), F.explode(all_cells).alias("c")).select("graph", "subj", "c.*").where("obj is not null")


OBJECT_PREDICATES = {
    "spec": ("hasObjectSpec", 0, None), "submitter": ("wasSubmittedBy", 0, None), "station": ("wasAcquiredBy", 0, None), "site": ("wasPerformedAt", 0, None), "size": ("hasSizeInBytes", 1, "xsd:long"),
    "file_name": ("hasName", 1, "xsd:string"), "height": ("hasSamplingHeight", 1, "xsd:float"), "data_start": ("hasStartTime", 1, "xsd:dateTime"), "data_end": ("hasEndTime", 1, "xsd:dateTime"),
}


def objects_to_statements(objects: DataFrame) -> DataFrame:
    return unpivot(objects, "id", OBJECT_PREDICATES, "objects")


def build_objects(st: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Wide objects from statements: one aggregation by subject, no self-join. ``kinds``: SQL type of each column."""
    kinds = kinds or {"spec": "int", "submitter": "int", "station": "int", "site": "int", "size": "bigint", "file_name": "string", "height": "double", "data_start": "timestamp", "data_end": "timestamp"}
    used = st.where(F.col("pred").isin([OBJECT_PREDICATES[c][0] for c in kinds]))
    return used.groupBy(F.col("subj").alias("id")).agg(*(F.max(F.when(F.col("pred") == OBJECT_PREDICATES[c][0], F.col("obj"))).try_cast(t).alias(c) for c, t in kinds.items()))


def instances_of(st: DataFrame, cls: str, subclasses: bool = False) -> DataFrame:
    """Members of a class, optionally of its direct subclasses too."""
    types = st.where(F.col("pred") == TYPE)
    if not subclasses:
        return types.where(F.col("obj") == cls).select("subj").distinct()
    below = st.where((F.col("pred") == SUBCLASS) & (F.col("obj") == cls)).select(F.col("subj").alias("obj"))
    return types.join(below.union(below.sparkSession.createDataFrame([(cls,)], "obj string")).distinct(), "obj", "left_semi").select("subj").distinct()


def overlay(st: DataFrame, base_graph: str, over_graph: str, props: list[str]) -> DataFrame:
    """(subj, pred, obj): the overriding graph's value wins, else the base's."""
    rows = st.where(F.col("pred").isin(props))
    value = lambda g: F.min(F.when(F.col("graph") == g, F.col("obj")))
    return rows.groupBy("subj", "pred").agg(F.coalesce(value(over_graph), value(base_graph)).alias("obj")).where("obj is not null")


def not_contained(new: DataFrame, st: DataFrame) -> DataFrame:
    """Statements of new that st doesn't have."""
    return new.join(st, same_key(new, st), "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Updates from old to new: retractions (assertion false) and assertions, each once; one shuffle by the statement."""
    both = old.select(*KEY, F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(*KEY, F.lit(0), F.lit(1)))
    sides = both.groupBy(*KEY).agg(F.max("o").alias("o"), F.max("n").alias("n")).where("o <> n")
    return sides.select(*KEY, (F.col("n") == 1).alias("assertion"))


def diff_with_stability(old: DataFrame, new: DataFrame, policy: dict[str, str]) -> DataFrame:
    """snapshot_diff with a policy for each predicate: plain; sticky (keep old if new is silent); fixed (write only if old is empty)."""
    rule = F.coalesce(F.create_map(*(F.lit(x) for kv in policy.items() for x in kv))[F.col("pred")] if policy else F.lit(None), F.lit("plain"))
    both = old.select(*KEY, F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(*KEY, F.lit(0), F.lit(1)))
    w = Window.partitionBy("subj", "pred")
    sides = both.groupBy(*KEY).agg(F.max("o").alias("o"), F.max("n").alias("n")).withColumn("has_old", F.max("o").over(w)).withColumn("has_new", F.max("n").over(w)).where("o <> n").withColumn("rule", rule)
    kept = sides.where((F.col("rule") == "plain") | ((F.col("rule") == "sticky") & (F.col("has_new") == 1)) | ((F.col("rule") == "fixed") & (F.col("has_old") == 0)))
    return kept.select(*KEY, (F.col("n") == 1).alias("assertion"))


def materialize_updates(ops: DataFrame) -> DataFrame:
    """Settle ordered ops (seq, subj, pred, obj, ..., op: A assert, R retract, W retract only if an assertion follows in the
    same subj and pred).

    Per value, A then R cancel each other, and R then A is an assertion. So what stands is decided by the retractions after a
    value's last assertion: none leaves the assertion, one cancels it, more retract; without an assertion any retracts. No
    history is gathered; all is one shuffle by subj and pred."""
    keys = [c for c in KEY if c in ops.columns]
    last = lambda *by: F.max(F.when(F.col("op") == "A", F.col("seq"))).over(Window.partitionBy(*by))
    live = ops.withColumn("_last", last("subj", "pred")).where((F.col("op") != "W") | (F.col("_last") > F.col("seq")))
    live = live.withColumn("_own", last(*keys))
    after = F.count(F.when((F.col("op") != "A") & (F.col("_own").isNull() | (F.col("seq") > F.col("_own"))), 1))
    settled = live.groupBy(*keys).agg(F.max("_own").alias("_own"), after.alias("_after")).where("_own is null or _after <> 1")
    return settled.select(*keys, (F.col("_after") == 0).alias("assertion"))


def effective_only(updates: DataFrame, st: DataFrame) -> DataFrame:
    """Without assertions of what holds and retractions of what doesn't."""
    on = [c for c in KEY if c in updates.columns]
    a, r = updates.where("assertion"), updates.where("not assertion")
    return r.join(st, same_key(r, st, on), "left_semi").union(a.join(st, same_key(a, st, on), "left_anti"))


def stabilize_bnodes(st: DataFrame, graph: str) -> DataFrame:
    """Blank nodes (_:x) become IRIs numbered by first occurrence in (subject, predicate, object) order; only they are ranked."""
    is_blank = lambda c: F.col(c).startswith("_:")
    own = st.where(F.col("graph") == graph)
    places = own.where(is_blank("subj")).select(F.col("subj").alias("b"), "subj", "pred", "obj").union(own.where(is_blank("obj")).select("obj", "subj", "pred", "obj"))
    first = places.groupBy("b").agg(F.min(F.struct("subj", "pred", "obj")).alias("at"))
    names = number_rows(first, ["at", "b"]).select("b", F.concat(F.lit(f"{graph}/bnode"), F.col("number").cast("string")).alias("iri"))
    s, o = names.select(F.col("b").alias("subj"), F.col("iri").alias("s_iri")), names.select(F.col("b").alias("obj"), F.col("iri").alias("o_iri"))
    return own.join(s, "subj", "left").join(o, "obj", "left").select("graph", F.coalesce("s_iri", "subj").alias("subj"), "pred", F.coalesce("o_iri", "obj").alias("obj"), "obj_kind", "lit_attr")


def rename_resource(st: DataFrame, mapping: DataFrame) -> DataFrame:
    """Updates that move statements of ``old`` and all usages as object to ``new``; mapping: old, new."""
    s, o = mapping.select(F.col("old").alias("subj"), F.col("new").alias("s_new")), mapping.select(F.col("old").alias("obj"), F.col("new").alias("o_new"))
    hit = st.join(s, "subj", "left").join(o, "obj", "left").withColumn("o_new", F.when(F.col("obj_kind") == 0, F.col("o_new"))).where("s_new is not null or o_new is not null")
    gone = hit.select(*KEY, F.lit(False).alias("assertion"))
    return gone.union(hit.select(F.coalesce("s_new", "subj"), "pred", F.coalesce("o_new", "obj"), "obj_kind", "lit_attr", F.lit(True)))


def rewrite_iris(st: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """A copy with subjects and IRI objects rewritten."""
    change = lambda c: F.regexp_replace(c, pattern, replacement)
    return st.withColumn("subj", change("subj")).withColumn("obj", F.when(F.col("obj_kind") == 0, change("obj")).otherwise(F.col("obj")))


def purge_closure(st: DataFrame, subjects: DataFrame, version_pred: str = "isNextVersionOf") -> DataFrame:
    """Statements to remove with subjects: their own, those one hop below but not over the version link, and usages.

    Statements are written once and dealt to tasks by their number, so that a task's share doesn't grow with it."""
    st = materialize(st, "statements")
    rows = st.count()
    by_subj = dealt(st, rows, "subj")
    subj = materialize(subjects.select("subj").distinct(), "subjects")
    own = by_subj.join(subj, "subj", "left_semi").select(*st.columns)
    below = own.where((F.col("obj_kind") == 0) & (F.col("pred") != version_pred) & (F.col("pred") != TYPE)).select(F.col("obj").alias("subj")).distinct()
    usages = dealt(st, rows, "obj").join(subj.select(F.col("subj").alias("obj")), "obj", "left_semi").select(*st.columns)
    found = own.union(by_subj.join(below, "subj", "left_semi").select(*st.columns)).union(usages)
    return dealt(found, rows, *st.columns).distinct()


def orphans(st: DataFrame, cls: str, required: str | None = None, incoming: str | None = None) -> DataFrame:
    """All statements of a class's instances that lack a needed link or that nobody refers to."""
    found = instances_of(st, cls)
    bad = []
    if required:
        bad.append(found.join(st.where(F.col("pred") == required), "subj", "left_anti"))
    if incoming:
        bad.append(found.join(st.where(F.col("pred") == incoming).select(F.col("obj").alias("subj")), "subj", "left_anti"))
    return st.join(reduce(DataFrame.union, bad).distinct(), "subj", "left_semi")


def move_by_predicate(st: DataFrame, pred: str, from_graph: str) -> DataFrame:
    """All statements in a graph of resources that carry a predicate there."""
    own = st.where(F.col("graph") == from_graph)
    return own.join(own.where(F.col("pred") == pred).select("subj").distinct(), "subj", "left_semi")


def current_object_statements(st: DataFrame, subjects: DataFrame, derived: tuple[str, ...] = ("hasBiblioInfo", "hasCitationString")) -> DataFrame:
    """(of, *KEY) of objects ``subjects`` (subj): an object's own statements; those of what it refers to, but over the version link;
    those of its production's list of contributors; and, of a plain collection that replaces something and holds the object, its
    membership, or all statements where it is the only member. ``derived`` predicates are left out."""
    rows = st.select(*KEY).distinct()
    own = subjects.select(F.col("subj").alias("of")).distinct().join(rows, F.col("of") == F.col("subj"))
    of = lambda nodes: nodes.join(rows, F.col("node") == F.col("subj")).select("of", *KEY)
    below = own.where((F.col("pred") != "isNextVersionOf") & (F.col("obj_kind") == 0)).select("of", F.col("obj").alias("node")).distinct()
    made = own.where("pred = 'wasProducedBy'").select("of", F.col("obj").alias("prod"))
    lists = made.join(rows.where("pred = 'wasParticipatedInBy'"), F.col("prod") == F.col("subj")).select("of", F.col("obj").alias("node"))
    lists = lists.join(rows.where((F.col("pred") == TYPE) & (F.col("obj") == "rdf:Seq")).select(F.col("subj").alias("node")), "node", "left_semi")
    kinds = rows.where((F.col("pred") == TYPE) & (F.col("obj") == "PlainCollection")).select("subj")
    parts = rows.where("pred = 'dcterms:hasPart'").join(kinds, "subj", "left_semi").join(rows.where("pred = 'isNextVersionOf'").select("subj"), "subj", "left_semi")
    sizes = parts.groupBy("subj").agg(F.countDistinct("obj").alias("members"))
    held = parts.join(own.select("of").distinct(), F.col("obj") == F.col("of")).select("of", F.col("subj").alias("node")).join(sizes.withColumnRenamed("subj", "node"), "node")
    through = held.join(rows, F.col("node") == F.col("subj")).where((F.col("members") == 1) | (F.col("pred") == "dcterms:hasPart") & (F.col("obj") == F.col("of"))).select("of", *KEY)
    found = own.select("of", *KEY).union(of(below)).union(of(lists.select("of", "node"))).union(through)
    return found.where(~F.col("pred").isin(list(derived))).distinct()


def ordered_members(st: DataFrame, node: str | None = None) -> DataFrame:
    """(subj, members): of rdf:Seq nodes by index (_1, _2, …), other members by name."""
    rows = st.where(F.col("pred").rlike("^rdf:(_[0-9]+|member)$"))
    rows = rows if node is None else rows.where(F.col("subj") == node)
    index = F.regexp_extract("pred", "_([0-9]+)$", 1).try_cast("int")
    lists = rows.groupBy("subj").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(index, F.lit(2**31 - 1)).alias("i"), F.col("obj").alias("m")))).alias("l"))
    return lists.select("subj", F.transform("l", lambda x: x.m).alias("members"))


def extract_subset(st: DataFrame, subjects: DataFrame, hops: list[str]) -> DataFrame:
    """Statements of chosen subjects and of their nodes along ``hops``."""
    own = st.join(subjects.select("subj").distinct(), "subj", "left_semi")
    nodes = own.where(F.col("pred").isin(hops) & (F.col("obj_kind") == 0)).select(F.col("obj").alias("subj")).distinct()
    return own.union(st.join(nodes, "subj", "left_semi").select(*own.columns)).distinct()


def add_missing_link(st: DataFrame, cls: str, pred: str, target: str) -> DataFrame:
    """One assertion for every instance that lacks the link."""
    lacking = instances_of(st, cls).join(st.where(F.col("pred") == pred), "subj", "left_anti")
    return lacking.select("subj", F.lit(pred).alias("pred"), F.lit(target).alias("obj"), F.lit(0).alias("obj_kind"), F.lit(None).cast("string").alias("lit_attr"), F.lit(True).alias("assertion"))


def resource_view(st: DataFrame, resources: DataFrame, labels: DataFrame) -> DataFrame:
    """The properties of resources, with the labels of their values."""
    own = st.join(resources.select("subj").distinct(), "subj", "left_semi")
    return own.join(labels.select(F.col("subj").alias("obj"), F.col("label").alias("obj_label")), "obj", "left")


def resource_usages(st: DataFrame, resources: DataFrame, labels: DataFrame) -> DataFrame:
    """Statements that refer to resources, with the labels of their subjects."""
    used = st.where("obj_kind = 0").join(resources.select(F.col("subj").alias("obj")).distinct(), "obj", "left_semi")
    return used.join(labels.select("subj", F.col("label").alias("subj_label")), "subj", "left")
