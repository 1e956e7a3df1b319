"""Reconciling snapshots of source tables with the catalog's current state."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.scratch import materialize

from .statements import KEY, materialize_updates, same_key


def resolved_ids(current: DataFrame, new: DataFrame, own: DataFrame) -> DataFrame:
    """(source_id, id) of the new snapshot's entities: the portal's id if it has the entity, else the current one, else the
    proposed one, numbered where it is taken. current, new, own: source_id, id; of several current ids the least counts."""
    known = own.groupBy("source_id").agg(F.min("id").alias("own_id")).join(current.groupBy("source_id").agg(F.min("id").alias("cur_id")), "source_id", "full")
    rows = new.groupBy("source_id").agg(F.min("id").alias("base")).join(known, "source_id", "left").withColumn("id", F.coalesce("own_id", "cur_id"))
    fresh = rows.where("id is null").select(F.col("source_id").alias("row"), "base")
    taken = current.select(F.col("id").alias("base")).union(own.select("id")).distinct()
    return rows.where("id is not null").select("source_id", "id").union(unique_ids(fresh, taken).select("row", "id"))


def entity_diff(
    current: DataFrame, new: DataFrame, own: DataFrame, statements: DataFrame, new_statements: DataFrame, own_statements: DataFrame, retractable: tuple[str, ...] = (), multivalued: tuple[str, ...] = ()
) -> DataFrame:
    """Updates (subj, pred, obj, obj_kind, lit_attr, assertion) that bring a source's statements to its new snapshot.

    current, new, own: source_id, id of the entities that the source's graph, the snapshot and the portal's own graph have.
    statements and own_statements: those graphs. new_statements name entities by source_id, as subject and as object.

    * An entity that neither graph has is asserted, under an id that is free.
    * A current one keeps its id. Old values fall only where the snapshot has others for the predicate; those of
      ``retractable`` predicates fall outright.
    * One that the portal took over moves to the portal's id, with all usages. Predicates that the portal states itself (but
      ``multivalued`` ones) leave the source's graph; the others follow the snapshot.
    * What the snapshot lacks stays, with the rule before for entities taken over.
    Updates without effect are left out, so that a second run has none."""
    names = materialize(resolved_ids(current, new, own), "names")
    told = current.select("source_id", "id", F.lit(1).alias("rank")).union(own.select("source_id", "id", F.lit(0)))
    known = names.union(told.join(names, "source_id", "left_anti").groupBy("source_id").agg(F.min_by("id", F.struct("rank", "id")).alias("id")))
    as_subject, as_object = names.select(F.col("source_id").alias("subj"), F.col("id").alias("_s")), known.select(F.col("source_id").alias("obj"), F.lit(0).alias("obj_kind"), F.col("id").alias("_o"))
    came = new_statements.select(*KEY).join(as_subject, "subj").join(as_object, ["obj", "obj_kind"], "left")
    came = materialize(came.select(F.col("subj").alias("source_id"), F.col("_s").alias("subj"), "pred", F.coalesce("_o", "obj").alias("obj"), "obj_kind", "lit_attr").distinct(), "came")

    ours = own.groupBy("source_id").agg(F.min("id").alias("own_id"))
    both = current.join(ours, "source_id").groupBy("source_id", "own_id")
    moved = materialize(both.agg(F.coalesce(F.min(F.when(F.col("id") != F.col("own_id"), F.col("id"))), F.first("own_id")).alias("gone")), "moved")
    exclusive = own_statements.where(~F.col("pred").isin(list(multivalued))).select(F.col("subj").alias("own_id"), "pred").distinct()

    graph = statements.select(*KEY).distinct()
    op = lambda df, seq, kind: df.select(F.lit(seq).alias("seq"), *KEY, F.lit(kind).alias("op"))
    kept = current.join(ours, "source_id", "left_anti").join(new.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.min("id").alias("subj"))
    held = graph.join(kept.select("subj"), "subj", "left_semi")
    old = graph.join(moved.select(F.col("gone").alias("subj"), "own_id"), "subj")
    under = old.withColumn("subj", F.col("own_id"))  # as they are under the portal's id
    away = F.col("subj") != F.col("own_id")
    yielded = under.join(exclusive, ["own_id", "pred"], "left_semi")
    over = came.join(moved.select("source_id", "own_id"), "source_id").join(exclusive, ["own_id", "pred"], "left_anti")
    plain = came.join(ours, "source_id", "left_anti")
    ops = [
        op(old.where(away), 1, "R"), op(old.where(away).withColumn("subj", F.col("own_id")), 2, "A"), op(under, 3, "W"), op(yielded, 4, "R"), op(over, 5, "A"),
        op(held.where(~F.col("pred").isin(list(retractable))), 3, "W"), op(held.where(F.col("pred").isin(list(retractable))), 4, "R"), op(plain, 5, "A"),
    ]
    settled = materialize_updates(reduce(DataFrame.union, ops))
    usages = graph.where("obj_kind = 0").join(moved.where("gone <> own_id").select(F.col("gone").alias("obj"), "own_id"), "obj")
    renamed = usages.select(*KEY, F.lit(False).alias("assertion")).union(usages.withColumn("obj", F.col("own_id")).select(*KEY, F.lit(True)))
    updates = materialize(settled.select(*KEY, "assertion").union(renamed).distinct(), "updates")
    gone, made, everything = updates.where("not assertion"), updates.where("assertion"), graph.union(own_statements.select(*KEY))
    return gone.join(graph, same_key(gone, graph), "left_semi").union(made.join(everything, same_key(made, everything), "left_anti"))


def unique_ids(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new (row, base) with ``id``: the base if it is free, for its first row, else with a number after the highest one that
    ids taken (base), or other bases of new, have behind an underscore; from 2 on."""
    parts = lambda c, k: F.regexp_extract(c, "^(.+)_([0-9]{1,9})$", k)
    ids = taken.select("base", F.lit(True).alias("held")).union(new.select("base", F.lit(False))).groupBy("base").agg(F.max("held").alias("held"))
    numbered = ids.where(parts("base", 1) != "").select(parts("base", 1).alias("base"), parts("base", 2).cast("int").alias("used"))
    used = ids.where("held").select("base", F.lit(1).alias("used"), F.lit(True).alias("held")).union(numbered.withColumn("held", F.lit(False))).groupBy("base").agg(F.max("used").alias("used"), F.max("held").alias("held"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("row")) - F.when(F.coalesce("held", F.lit(False)), 0).otherwise(1)
    rows = new.join(used, "base", "left").withColumn("nth", nth)
    number = F.greatest(F.coalesce("used", F.lit(1)), F.lit(1)) + F.col("nth")
    return rows.withColumn("id", F.when(F.col("nth") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", number.cast("string")))).drop("used", "held", "nth")


def dedupe_entities(entities: DataFrame, order: list[str]) -> DataFrame:
    """One row per best id (source id, else own id)."""
    key = F.coalesce("tc_id", "own_id")
    w = Window.partitionBy("best_id").orderBy(*order)
    return entities.withColumn("best_id", key).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def membership_score(a: pd.Series, b: pd.Series) -> int:
    """How alike two intervals of a role are."""
    same = lambda x, y: not pd.isna(x) and not pd.isna(y) and x == y
    open_ = lambda x, y: pd.isna(x) and pd.isna(y)
    return sum(100 * same(a[c], b[c]) + 10 * open_(a[c], b[c]) for c in ("start", "stop"))


def match_memberships(current: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """(cur_id, new_id) pairs of the same role: where each side has one they match; else greedily by score, in order of the current ones."""
    sides = lambda d, n: d.withColumn(f"{n}_count", F.count("*").over(Window.partitionBy(*keys)))
    c, l = sides(current, "c"), sides(latest, "l")
    easy = c.where("c_count = 1").select(*keys, F.col("id").alias("cur_id")).join(l.where("l_count = 1").select(*keys, F.col("id").alias("new_id")), keys).select("cur_id", "new_id")
    hard_c = c.where("c_count > 1").select(*keys).union(l.where("l_count > 1").select(*keys)).distinct()
    rows = current.select(*keys, "id", "start", "stop", F.lit(0).alias("side")).union(latest.select(*keys, "id", "start", "stop", F.lit(1).alias("side"))).join(hard_c, keys, "left_semi")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:  # a role of one person at one station has a few intervals
        cur, free, out = pdf[pdf.side == 0].sort_values(["start", "id"]), pdf[pdf.side == 1].sort_values(["start", "id"]), []
        for _, r in cur.iterrows():
            if len(free):
                best = max(free.index, key=lambda i: membership_score(r, free.loc[i]))
                out.append((r.id, free.loc[best].id))
                free = free.drop(best)
        return pd.DataFrame(out, columns=["cur_id", "new_id"])

    return easy.union(rows.groupBy(*keys).applyInPandas(lambda pdf: greedy(pdf), "cur_id string, new_id string"))


def roles_diff(current: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """Memberships (id, keys, start, stop): (id, what, start, stop) with what = new for roles that weren't there or have no match, changed for matched ones with other times; vanished ones stay."""
    pairs = match_memberships(current, latest, keys)
    new = latest.join(pairs.select(F.col("new_id").alias("id")), "id", "left_anti").select("id", F.lit("new").alias("what"), "start", "stop")
    a, b = current.select(F.col("id").alias("cur_id"), F.col("start").alias("s"), F.col("stop").alias("e")), latest.select(F.col("id").alias("new_id"), "start", "stop")
    both = pairs.join(a, "cur_id").join(b, "new_id").where(~(F.col("s").eqNullSafe(F.col("start")) & F.col("e").eqNullSafe(F.col("stop"))))
    return new.union(both.select(F.col("cur_id").alias("id"), F.lit("changed").alias("what"), "start", "stop"))


def preserve_ids(new: DataFrame, lookup: DataFrame, columns: list[str]) -> DataFrame:
    """The portal's id of known entities (lookup: tc_id, cp_id) in the given columns."""
    for c in columns:
        new = new.join(lookup.select(F.col("tc_id").alias(c), F.col("cp_id").alias("_cp")), c, "left").withColumn(c, F.coalesce("_cp", c)).drop("_cp")
    return new


def drop_dangling(updates: DataFrame, st: DataFrame, pred: str) -> DataFrame:
    """Without assertions of ``pred`` whose object no statement describes."""
    checked = updates.where((F.col("pred") == pred) & F.col("assertion"))
    rest = updates.where(~((F.col("pred") == pred) & F.col("assertion")))
    return rest.union(checked.join(st.select(F.col("subj").alias("obj")).distinct(), "obj", "left_semi").select(*rest.columns))


def harmonise(qualifier: Column, variable: Column) -> Column:
    """A qualifier without its variable's name in front."""
    return F.when(qualifier.startswith(F.concat(variable, F.lit("_"))), F.substring(qualifier, F.length(variable) + 2, F.length(qualifier))).otherwise(qualifier)


def eav_to_entries(raw: DataFrame) -> DataFrame:
    """One entry per (site, idVar): variable, date from the DATE qualifier, and the sorted list of other qualified values."""
    rows = raw.select("site", "idVar", "Variable", harmonise(F.col("Qualifier"), F.col("Variable")).alias("q"), F.when(F.col("Value") != "-9999", F.col("Value")).alias("v")).where("v is not null")
    values = F.array_sort(F.collect_list(F.when(F.col("q") != "DATE", F.struct("q", "v"))))
    return rows.groupBy("site", "idVar").agg(F.min("Variable").alias("variable"), F.max(F.when(F.col("q") == "DATE", F.col("v"))).alias("date"), values.alias("values"))


def assemble(base: DataFrame, lookups: list[tuple[DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    """base with the columns of lookups (table, key, error); rows with an unresolved key go apart, with all their errors. Lookup keys are unique."""
    out, errors = base, []
    for k, (look, key, message) in enumerate(lookups):
        out = out.join(look.withColumn(f"_found{k}", F.lit(True)), key, "left")
        errors.append(F.when(F.col(key).isNotNull() & F.col(f"_found{k}").isNull(), message))
    out = out.withColumn("errors", F.filter(F.array(*errors), lambda e: e.isNotNull())).drop(*(f"_found{k}" for k in range(len(lookups))))
    return out.where(F.size("errors") == 0).drop("errors"), out.where(F.size("errors") > 0)


def collect_errors(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks (null doesn't), and the others with the messages of what failed."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), m) for m, c in checks.items())), lambda e: e.isNotNull())
    marked = rows.withColumn("errors", failed)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def dedupe_orgs(sources: list[DataFrame]) -> DataFrame:
    """(id, name, label) of organisations; a later source wins; the label stands in parentheses of the name."""
    ranked = reduce(DataFrame.union, (s.select("id", "name", F.lit(k).alias("k")) for k, s in enumerate(sources)))
    best = ranked.groupBy("id").agg(F.max_by("name", F.struct("k", "name")).alias("name"))
    return best.select("id", F.trim(F.regexp_replace("name", r"\([^)]*\)", "")).alias("name"), F.nullif(F.regexp_extract("name", r"\(([^)]*)\)", 1), F.lit("")).alias("label"))


