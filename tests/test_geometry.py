"""Geometry kernels, components and boxes against plain versions."""

import random
from fractions import Fraction

import pytest

from tessera.operators import geometry, graph, lod


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


@pytest.mark.parametrize("seed", range(30))
def test_triangles_cover_the_polygon(seed):
    from math import cos, pi, sin

    rng = random.Random(seed)
    n = rng.randrange(3, 40)
    outer = [[r * f(2 * pi * k / n) for f in (cos, sin)] for k in range(n) for r in [rng.uniform(4, 9)]]
    if seed % 2:
        outer.reverse()
    rings = [outer]
    if n > 12:
        for cx, cy in [(-0.6, 0.0), (0.8, 0.3), (0.1, -1.0)][: seed % 4]:
            rings.append([[cx + 0.25 * f(2 * pi * k / 5) for f in (cos, sin)] for k in range(5)])
    assert geometry.polygon_problem(rings) is None
    points = [p for r in rings for p in r]
    tris = geometry.triangulate(rings)
    assert len(tris) == len(points) + 2 * (len(rings) - 1) - 2
    areas = [area([points[i] for i in t]) for t in tris]
    assert min(areas) > 0
    assert sum(areas) == pytest.approx(abs(area(outer)) - sum(abs(area(r)) for r in rings[1:]))


def test_problems():
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = lambda x, d=1: [[x, 1], [x, 1 + d], [x + d, 1 + d], [x + d, 1], [x, 1]]
    why = geometry.polygon_problem
    assert why([square]) is None and why([square, hole(1)]) is None and why([]) == "empty"
    assert why([square, hole(6)]) == "hole_outside"
    assert why([square, hole(1, 2), [[1.5, 1.5], [1.5, 2], [2, 2]]]) == "nested_holes"
    assert why([[[0, 0], [2, 2], [2, 0], [0, 2]]]) == "self_intersection"
    assert why([[[0, 0], [1, 1], [2, 2]]]) == "degenerate" and why([[[0, 0], [1, float("nan")], [2, 2]]]) == "nonfinite"
    assert why([[[0, 0], [4, 0], [2, 0], [2, 3]]]) == "self_intersection"


def test_simplify():
    rng = random.Random(3)
    path = [[k, rng.uniform(-1, 1), rng.uniform(-1, 1)] for k in range(200)]
    for tolerance in (0.0, 0.5, 1.5, 9):
        kept, error = geometry.simplify(path, tolerance)
        assert kept[0] == 0 and kept[-1] == 199 and error <= tolerance
        worst = max((geometry._off_segment(path[k], path[a], path[b]) for a, b in zip(kept, kept[1:]) for k in range(a + 1, b)), default=0)
        assert worst == pytest.approx(error)
    locked = [k == 77 for k in range(200)]
    assert 77 in geometry.simplify(path, 9, locked)[0]
    closed = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    assert len(geometry.simplify(closed, 50)[0]) == 4
    assert geometry.simplify([[1, 1]], 1) == ([0], 0.0)


def test_plane():
    mean, normal, off = geometry.plane_fit([[0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]])
    assert mean == [0.5, 0.5, 1] and normal == pytest.approx([0, 0, 1]) and off == pytest.approx(0)


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(9, 9)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(100, 101)] * 3
    frame = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.components(frame).collect()} == brute_components(edges)
    assert graph.components(frame.where("a is null")).count() == 0


def test_co_render_groups(spark):
    rng = random.Random(2)
    for n in (1, 3, 6):
        rows = sorted({(v, "".join(rng.choice("01") for _ in range(rng.randrange(0, 5)))) for v in range(4) for _ in range(n)})
        edges = [(a, b) for v, a in rows for w, b in rows if v == w and (a == b or not (a.startswith(b) or b.startswith(a)))]
        got = {r["path"]: r["grp"] for r in graph.co_render_groups(spark.createDataFrame(rows, "vertex long, path string")).collect()}
        assert got == brute_components(edges)


def test_boxes_enclose(spark):
    rng = random.Random(6)
    tiles = {p: [rng.uniform(-9, 9) for _ in range(3)] + [rng.uniform(0, 3) for _ in range(3)] for p in ["", "0", "1", "00", "01", "010", "011", "10"]}
    frame = spark.createDataFrame([(p, *v) for p, v in tiles.items()], "path string, cx double, cy double, cz double, ex double, ey double, ez double")

    def half(p, k):
        return max([tiles[p][3 + k]] + [abs(tiles[c][k] - tiles[p][k]) + half(c, k) for c in tiles if len(c) == len(p) + 1 and c.startswith(p)])

    for r in lod.enclosing_boxes(frame).collect():
        assert [r["ex"], r["ey"], r["ez"]] == pytest.approx([half(r["path"], k) for k in range(3)])


def test_dyadic_exponent(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(float(v),) for v in (0, 1, 65535, 65536, 131070, 3)], "e double")
    for r in frame.select("e", lod.lattice_exponent(F.col("e")).alias("k")).collect():
        if r["e"]:
            assert Fraction(r["e"]) <= 65535 * Fraction(2) ** r["k"] and Fraction(r["e"]) > 65535 * Fraction(2) ** (r["k"] - 1)
