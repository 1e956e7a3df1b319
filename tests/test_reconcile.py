"""Reconciliation, settling of updates, variables and collections on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile, statements as st, validate, versions

IDS = "source_id string, id string"
STATEMENTS = "subj string, pred string, obj string, obj_kind int, lit_attr string"


class Graphs:
    """A source's graph and the portal's, to which updates are applied."""

    def __init__(self, spark, own_ids=(), own=()):
        self.spark, self.ids, self.graph, self.own_ids, self.own = spark, {}, set(), list(own_ids), set(own)

    def update(self, snapshot, retractable=("network",), multivalued=("role",)):
        """snapshot: {source_id: (proposed id, {pred: value or a list})}; values like @x name an entity."""
        frame = lambda rows, schema: self.spark.createDataFrame(list(rows), schema)
        literal = lambda v: (v[1:], 0, None) if v.startswith("@") else (v, 1, "string")
        new = [(key, p, *literal(v)) for key, (_, own) in snapshot.items() for p, vs in own.items() for v in (vs if isinstance(vs, list) else [vs])]
        current = [(s, i) for s, i in self.ids.items()]
        found = reconcile.entity_diff(
            frame(current, IDS), frame([(s, i) for s, (i, _) in snapshot.items()], IDS), frame(self.own_ids, IDS), frame(self.graph, STATEMENTS), frame(new, STATEMENTS), frame(self.own, STATEMENTS), retractable, multivalued,
        ).collect()
        for r in sorted(found, key=lambda r: r.assertion):
            (self.graph.add if r.assertion else self.graph.remove)((r.subj, r.pred, r.obj, r.obj_kind, r.lit_attr))
        for s, p, o, *_ in self.graph:
            if p == "source":
                self.ids[o] = s
        self.ids = {k: v for k, v in self.ids.items() if any(s == v and p == "source" for s, p, *_ in self.graph)}
        return sorted((r.subj, r.pred, r.obj, r.assertion) for r in found)


def jane(name="Doe", id="Jane_Doe", **more):
    return {"p1": (id, {"source": "p1", "name": name, **more})}


def test_new_changed_and_vanished_entities(spark):
    g = Graphs(spark)
    assert g.update(jane(mail="j@x")) == [("Jane_Doe", "mail", "j@x", True), ("Jane_Doe", "name", "Doe", True), ("Jane_Doe", "source", "p1", True)]
    assert g.update(jane(mail="j@x")) == []
    # Another last name and so another proposed id: the id stays, only the name changes; the mail that isn't told stays.
    assert g.update(jane("Smith", "Jane_Smith")) == [("Jane_Doe", "name", "Doe", False), ("Jane_Doe", "name", "Smith", True)]
    assert g.update({"p2": ("John", {"source": "p2", "name": "J"})}) == [("John", "name", "J", True), ("John", "source", "p2", True)]
    assert g.update({}) == []


def test_taken_ids_get_numbers_and_references_follow(spark):
    g = Graphs(spark, [("x", "AIR")], {("AIR", "name", "own", 1, "string")})
    snapshot = {"s1": ("AIR", {"source": "s1"}), "s2": ("AIR", {"source": "s2"}), "r": ("role1", {"source": "r", "at": ["@s1", "@s2", "@x", "@elsewhere"]})}
    found = g.update(snapshot)
    assert [(o, a) for s, p, o, a in found if p == "at"] == [("AIR", True), ("AIR_2", True), ("AIR_3", True), ("elsewhere", True)]
    assert g.update(snapshot) == []


def test_networks_fall_outright(spark):
    g = Graphs(spark)
    g.update({"s": ("AIR", {"source": "s", "network": "@n1", "name": "a"})})
    assert g.update({"s": ("AIR", {"source": "s"})}) == [("AIR", "network", "n1", False)]


def test_the_portal_takes_over(spark):
    g = Graphs(spark)
    snapshot = {**jane(mail="j@x", role="@r9"), "m": ("memb", {"source": "m", "holder": "@p1"})}
    g.update(snapshot)
    g.own_ids, g.own = [("p1", "Jane_CP")], {("Jane_CP", "name", "CP", 1, "string"), ("Jane_CP", "role", "r1", 0, None), ("Jane_CP", "source", "p1", 1, "string")}
    found = g.update(snapshot)
    assert {(s, p) for s, p, _, a in found if not a} == {("Jane_Doe", "source"), ("Jane_Doe", "name"), ("Jane_Doe", "mail"), ("Jane_Doe", "role"), ("memb", "holder")}
    # What the portal states itself yields; the mail and the role (one of many) move; usages follow.
    assert {(s, p, o) for s, p, o, a in found if a} == {("Jane_CP", "mail", "j@x"), ("Jane_CP", "role", "r9"), ("memb", "holder", "Jane_CP")}
    assert g.update(snapshot) == []
    # From now on the snapshot still leads for what the portal doesn't state.
    found = g.update({**jane("New", "X", mail="new@x", role="@r9"), "m": ("memb", {"source": "m", "holder": "@p1"})})
    assert found in ([], [("Jane_CP", "mail", "j@x", False), ("Jane_CP", "mail", "new@x", True)])


def test_taken_over_without_a_snapshot_s_word(spark):
    g = Graphs(spark)
    g.update(jane(mail="j@x"))
    g.own_ids, g.own = [("p1", "Jane_Doe")], {("Jane_Doe", "name", "CP", 1, "string")}
    assert g.update({}) == [("Jane_Doe", "name", "Doe", False)]  # the same id: only what the portal states goes
    assert g.update({}) == []


def test_reconciling_nothing(spark):
    assert Graphs(spark).update({}) == []


def settled(ops):
    """By definition: weak retractions first, then a fold for each value."""
    live = [(v, "R" if t == "W" else t) for i, (v, t) in enumerate(ops) if t != "W" or any(u == "A" for _, u in ops[i + 1 :])]
    out = {}
    for v, t in live:
        out[v] = None if out.get(v) == "A" and t == "R" else t
    return {(v, t == "A") for v, t in out.items() if t}


def test_settling_as_the_fold(spark):
    rng = random.Random(3)
    cases = {f"s{k}": [(rng.choice("xyz"), rng.choice("AARRW")) for _ in range(rng.randint(1, 9))] for k in range(200)}
    rows = [(i, s, "p", v, t) for s, ops in cases.items() for i, (v, t) in enumerate(ops)]
    found = {(r.subj, r.obj, r.assertion) for r in st.materialize_updates(spark.createDataFrame(rows, "seq int, subj string, pred string, obj string, op string")).collect()}
    assert found == {(s, v, a) for s, ops in cases.items() for v, a in settled(ops)}


DEFS = "nr int, var string, title string, is_pattern boolean, optional boolean"


def test_variables_as_trying_every_definition(spark):
    defs = [
        (1, "v1", "TA", False, False), (2, "v2", "TA_[0-9]+", True, True), (3, "v3", "TA_\\d+_x", True, False), (4, "v4", "S?W.*", True, False), (5, "v5", "TA_1", False, True), (6, "v6", ".*_QC", True, True),
        (7, "v7", "TA", False, True), (8, "v8", "TA|PA", True, False), (9, "v9", "(?:LW)_IN", True, False), (10, "v10", "P{2}A", True, False), (11, "v11", "CO2_[ab]*", True, True), (12, "v12", "CO2_.*", True, True), (13, "v13", "^H2O$", True, False), (14, "v14", "a.c\\.d", True, False),
    ]
    names = ["TA", "TA_1", "TA_12", "TA_1_x", "SW_OUT", "W", "PA", "LW_IN", "PPA", "CO2_", "CO2_ab", "CO2_x", "H2O", "x_QC", "TA_QC", "abc.d", "abcxd", "", "nothing", "TA_"]

    def first(name):
        exact = [v for _, v, t, p, _ in defs if not p and t == name]
        if exact:
            return exact[-1]
        return next((v for _, v, t, p, _ in sorted(defs, key=lambda d: (d[4], d[0])) if p and re.fullmatch(t, name)), None)

    found = validate.resolve_variables(spark.createDataFrame([(n,) for n in [*names, "TA"]], "name string"), spark.createDataFrame(defs, DEFS))
    assert {r.name: r["var"] for r in found.collect()} == {n: first(n) for n in names if first(n)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    prefixes = spark.createDataFrame([(d[2],) for d in defs], "t string").select("t", validate.literal_prefix(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in prefixes} == {"TA": "TA", "TA_[0-9]+": "TA_", "TA_\\d+_x": "TA_", "S?W.*": "", "TA_1": "TA_1", ".*_QC": "", "TA|PA": "", "(?:LW)_IN": "", "P{2}A": "", "CO2_[ab]*": "CO2_", "CO2_.*": "CO2_", "^H2O$": "H2O", "a.c\\.d": "a"}


def test_rollup_of_nested_collections_with_a_cycle(spark):
    members = [("a", "b"), ("a", "o1"), ("b", "c"), ("b", "o2"), ("c", "o3"), ("c", "a"), ("d", "c"), ("d", "missing"), ("e", "o1"), ("e", "o1"), ("f", "missing")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    creators = frame([("o1", "Ann"), ("o2", "Bo"), ("o3", "Ann"), ("o9", "Cy")], "id string, value string")
    funders = frame([("o3", "EU"), ("o3", None)], "id string, value string")
    found = versions.collection_rollup(frame(members, "coll string, member string"), frame([(f"o{k}",) for k in range(5)], "id string"), creators=creators, funders=funders).collect()
    assert {r.coll: (r.n_objects, r.creators, r.funders) for r in found} == {**{c: (3, ["Ann", "Bo"], ["EU"]) for c in "abcd"}, "e": (1, ["Ann"], [])}


@pytest.mark.parametrize("rows", [[], [("a", "o1")]])
def test_rollup_without_nesting(spark, rows):
    found = versions.collection_rollup(spark.createDataFrame(rows, "coll string, member string"), spark.createDataFrame([("o1",)], "id string"))
    assert [tuple(r) for r in found.collect()] == [(c, 1) for c, _ in rows]
