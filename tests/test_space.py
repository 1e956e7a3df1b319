"""Merging of geometries, hulls in rounds, components and closures against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import coverage, geo, graph

SCHEMA = "owner string, geom_type string, coords array<struct<lon: double, lat: double>>, label string"


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return list(out.values())


def test_components_as_brute_force(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + k, 1001 + k) for k in range(200)] + [(2000, 2000 + k) for k in range(1, 60)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({n for p in pairs if p[0] != p[1] for n in p})
    assert found == {n: min(c) for c in classes(nodes, [p for p in pairs if p[0] != p[1]]) for n in c}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_descendants_with_a_cycle(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    found = {(r.top, r.below): r.depth for r in graph.descendants(spark.createDataFrame(links, "top string, below string")).collect()}
    assert found == {("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1, ("a", "d"): 1, ("a", "c"): 2, ("b", "d"): 2, ("x", "y"): 1, ("y", "z"): 1, ("z", "x"): 1, ("x", "z"): 2, ("y", "x"): 2, ("z", "y"): 2}


@pytest.mark.parametrize("group", [5, 40, 4096])
def test_extents_in_rounds_are_the_hull_of_all(spark, group):
    rng = np.random.default_rng(3)
    clusters = {"cloud": rng.normal(size=(400, 2)), "circle": np.column_stack((np.cos(np.arange(90)), np.sin(np.arange(90)))), "one": np.array([[1.0, 2.0]] * 4), "line": np.column_stack((np.arange(30.0), np.arange(30.0)))}
    rows = [(c, str(i), [(float(x), float(y))]) for c, ps in clusters.items() for i, (x, y) in enumerate(ps)]
    found = coverage.cluster_extents(spark.createDataFrame(rows, "cluster string, id string, coords array<struct<lon: double, lat: double>>"), group).collect()
    assert {r["cluster"]: (r.n_objects, r.dense) for r in found} == {c: (len(ps), c == "one") for c, ps in clusters.items()}
    for r in found:
        assert {tuple(p) for p in r.hull} == {tuple(map(float, p)) for p in geo.convex_hull(clusters[r["cluster"]])}


def box(x, y, w, h):
    return "box", [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def fused(rows, most):
    """All pairs, transitively, then the close ones; {(geom_type, corners, label)}."""

    def fuse(geoms, d, thin):
        near = [(i, j) for i, j in itertools.combinations(range(len(geoms)), 2) if coverage.gap(np.array(geoms[i][1]), geoms[i][0], np.array(geoms[j][1]), geoms[j][0]) <= d]
        out = []
        for c in classes(range(len(geoms)), near):
            if len(c) == 1:
                out.append(geoms[c[0]])
                continue
            points = np.array([p for i in c for p in geoms[i][1]])
            hull = geo.convex_hull(points)
            area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, np.roll(hull, -1, 0)))) / 2
            if thin and len(c) <= 3 and area < 0.05 * (np.ptp(points, axis=0) ** 2).sum():
                out += [geoms[i] for i in c]
            else:
                out.append((("polygon", "line", "point")[max(0, 3 - len(hull))], [tuple(p) for p in hull], frozenset().union(*(geoms[i][2] for i in c))))
        return out

    geoms = {}
    for kind, coords, label in rows:
        geoms.setdefault((kind, tuple(coords)), set()).update({label} - {None})
    geoms = fuse([(k, list(c), frozenset(n)) for (k, c), n in geoms.items()], 0.0, False)
    centres = np.array([coverage.centroid(np.array(c), k) for k, c, _ in geoms])
    size = 2 * np.hypot(*(centres - centres.mean(0)).T).mean()
    geoms = fuse(geoms, 0.01 * size, True) if len(geoms) > most else geoms
    return sorted((k, tuple(sorted((round(float(x), 6), round(float(y), 6)) for x, y in c)), ", ".join(sorted(n))) for k, c, n in geoms)


@pytest.mark.parametrize("most", [1, 10_000])
def test_merged_coverage_as_all_pairs(spark, most):
    rng = np.random.default_rng(7)
    rows = []
    for owner in ("a", "b", None):
        for i in range(70):
            x, y = (float(v) for v in rng.uniform((-170, -80), (150, 60)))
            kind = i % 4
            size = float(rng.choice([0.3, 4, 25]))
            shape = box(x, y, size, size / 2) if kind < 2 else ("point", [(x, y)]) if kind == 2 else ("polygon", [(x, y), (x + size, y), (x, y + size)])
            rows.append((owner, *shape, f"L{i}" if i % 5 else None))
        rows += [(owner, "point", [(10.0, 10.0)], "P")] * 30 + [(owner, "point", [(10.0 + 0.1 * k, 10.0)], None) for k in range(3)]
        rows.append((owner, "line", [(-120.0, -50.0), (100.0, 40.0)], "track"))
    found = coverage.merge_coverage(spark.createDataFrame(rows, SCHEMA).union(spark.createDataFrame([("a", "point", [], "x"), ("a", "point", None, "y")], SCHEMA)), most).collect()
    for owner in ("a", "b", None):
        own = sorted((r.geom_type, tuple(sorted((round(p.lon, 6), round(p.lat, 6)) for p in r.coords)), r.label) for r in found if r.owner == owner)
        expected = fused([r[1:] for r in rows if r[0] == owner], most)
        assert [r for r in own if len(r[1]) < 14] == [r for r in expected if len(r[1]) < 15] or len(own) == len(expected) and all(len(a[1]) <= 14 for a in own)
        assert sorted(r[2] for r in own) == sorted(r[2] for r in expected)


def counted(monkeypatch):
    """The sizes of the tables that coverage writes from now on."""
    sizes, write = [], coverage.materialize

    def materialize(df, *args):
        out = write(df, *args)
        sizes.append((out.count(), *args))
        return out

    monkeypatch.setattr(coverage, "materialize", materialize)
    return sizes


def test_stacks_side_by_side_dont_meet_as_pairs(spark, monkeypatch):
    sizes = counted(monkeypatch)
    rows = [("o", *box(1.9 * k + i / 1000, i / 1000, 2.0, 12 + i / 1000), f"s{k}") for i in range(120) for k in range(10)]
    assert [r.label for r in coverage.merge_coverage(spark.createDataFrame(rows, SCHEMA), 10_000).collect()] == [", ".join(f"s{k}" for k in range(10))]
    assert max(sizes)[0] <= 30 * len(rows), max(sizes)


@pytest.mark.parametrize("splits", [1, 4])
def test_quartered_cells_as_all_pairs(spark, monkeypatch, splits):
    monkeypatch.setattr(coverage, "MATES", 0)
    monkeypatch.setattr(coverage, "SPLITS", splits)
    rng = np.random.default_rng(splits)
    rows = []
    for i in range(160):
        x, y, w = (float(v) for v in rng.uniform((-40, -40, 0.2), (20, 20, 3)))
        rows.append([("o", *box(x, y, w, w / 2), f"L{i}"), ("o", "line", [(x, y), (x + w, y + 2 * w)], f"L{i}"), ("o", "polygon", [(x, y), (x + w, y), (x, y + w)], f"L{i}"), ("o", "point", [(x, y)], f"L{i}")][i % 4])
    for most in (1, 10_000):
        found = coverage.merge_coverage(spark.createDataFrame(rows, SCHEMA), most).collect()
        assert sorted(", ".join(sorted(r.label.split(", "))) for r in found) == sorted(r[2] for r in fused([r[1:] for r in rows], most))


def test_lines_that_quarters_dont_part_meet_once(spark, monkeypatch):
    monkeypatch.setattr(coverage, "MATES", 0)
    sizes = counted(monkeypatch)
    rows = [("o", "line", [(i / 1000, 0.0), (10 + i / 1000, 10.0)], f"L{i}") for i in range(60)]
    assert len(coverage.merge_coverage(spark.createDataFrame(rows, SCHEMA), 10_000).collect()) == 60
    assert max(sizes)[0] <= 60 * 59 / 2, max(sizes)


def test_merged_coverage_of_nothing(spark):
    assert coverage.merge_coverage(spark.createDataFrame([], SCHEMA), 3).count() == 0


def test_thin_and_far_groups_stay_apart(spark):
    far = [("o", *box(0.0, 0.0, 1.0, 1.0), "north"), ("o", *box(0.5, 0.5, 1.0, 1.0), "south"), ("o", *box(100.0, 50.0, 1.0, 1.0), "far")]
    rows = coverage.merge_coverage(spark.createDataFrame(far, SCHEMA), 1).collect()
    assert sorted(r.label for r in rows) == ["far", "north, south"]
    assert {r.label: (round(r.pin.lon, 6), round(r.pin.lat, 6)) for r in rows if r.pin} == {"far": (100.5, 50.5), "north, south": (0.75, 0.75)}
    thin = [("o", "point", [(0.0, 0.0)], "p"), ("o", "point", [(0.001, 0.0)], "q"), ("o", "point", [(50.0, 0.0)], "r")]
    assert sorted(r.label for r in coverage.merge_coverage(spark.createDataFrame(thin, SCHEMA), 1).collect()) == ["p", "q", "r"]


def test_gaps():
    unit = np.array([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    assert coverage.gap(unit, "polygon", np.array([[0.5, 0.5]]), "point") == 0
    assert coverage.gap(unit, "line", np.array([[0.5, 0.5]]), "point") == pytest.approx(0.5)
    assert coverage.gap(unit + 3, "box", unit, "box") == pytest.approx(8**0.5)
    assert coverage.gap(unit * 0.1 + 0.4, "box", unit, "box") == 0
    assert coverage.centroid(np.array([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]), "polygon") == (2, 1)
    assert coverage.centroid(np.array([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0)]), "line") == pytest.approx((16 / 6, 2 / 6))


def test_label_order(spark):
    merge = lambda *x: spark.createDataFrame([(list(x),)], "l array<string>").select(geo.merge_labels(F.col("l")).alias("t")).first().t
    assert merge("TA", "SW_1_2_3 / SW_4_5_6", "KIT", "P_2_1_1_9", "x", "CD-Ygb", "CH-Dav", "ABC") == "CD-Ygb, CH-Dav, KIT, ABC, SW_n_n_n, P_n_n_n_n, x, TA"
    assert merge() == "" and merge("a_1_2") == "a_1_2"
