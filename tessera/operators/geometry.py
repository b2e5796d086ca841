"""Geometries as nested arrays: parts -> rings (or one path) -> points -> coordinates.

What array functions express stays in SQL (area, parts, rings, holes, boxes, charts); path and polygon
algorithms work on one geometry at a time in Arrow batches. A geometry is bounded by the vertex cap of its reader.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import hypot, isfinite, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Point = Sequence[float]
Ring = Sequence[Point]
RING = "array<array<double>>"


def _shifted(ring: Column) -> Column:
    """Each point with the next one, the last with the first."""
    return F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)).alias("b"))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring in XY by the shoelace sum from its first point; closed or open, positive when counter-clockwise, 0 below 3 points."""
    origin = F.get(ring, F.lit(0))

    def cross(p: Column) -> Column:
        ax, ay = F.get(p["a"], F.lit(0)) - F.get(origin, F.lit(0)), F.get(p["a"], F.lit(1)) - F.get(origin, F.lit(1))
        bx, by = F.get(p["b"], F.lit(0)) - F.get(origin, F.lit(0)), F.get(p["b"], F.lit(1)) - F.get(origin, F.lit(1))
        return ax * by - ay * bx

    total = F.aggregate(F.transform(_shifted(ring), cross), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(total / 2)


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less that of its holes."""
    areas = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return F.aggregate(F.slice(areas, F.lit(2), F.greatest(F.size(areas) - 1, F.lit(0))), F.get(areas, F.lit(0)), lambda s, v: s - v)


def exploded_rings(polygons: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per ring with its part and ring number; ring 0 is the outer one."""
    rest = [c for c in polygons.columns if c != parts]
    by_part = polygons.select(*rest, F.posexplode(parts).alias("part", "rings"))
    return by_part.select(*rest, "part", F.posexplode("rings").alias("ring", "points"))


def without_holes(parts: Column) -> Column:
    return F.transform(parts, lambda rings: F.slice(rings, 1, 1))


def constant_height(points: Column) -> Column:
    """Whether all points have the first one's z (0 where there is none), so that the source chart can be kept."""
    z = lambda p: F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))
    return F.forall(points, lambda p: z(p) == z(F.get(points, F.lit(0))))


def path_box(points: Column) -> Column:
    """struct(lx, hx, ly, hy) over the points of one path."""
    at = lambda k: F.transform(points, lambda p: F.get(p, F.lit(k)))
    return F.struct(*(f(at(k)).alias(f"{p}{a}") for k, a in enumerate("xy") for p, f in (("l", F.array_min), ("h", F.array_max))))


def box_corners(box: Column) -> Column:
    """The eight corners of an oriented box: an array of its centre and three half-axis vectors, twelve numbers; bit k of a corner's number tells the side along axis k."""
    at = lambda k: F.get(box, F.lit(k))
    corner = lambda n: F.array(*(at(i) + sum((at(3 * k + 3 + i) * (1 if n >> k & 1 else -1) for k in range(3)), F.lit(0.0)) for i in range(3)))
    return F.array(*(corner(n) for n in range(8)))


def box_contains(box: Column, point: Column, slack: float = 0.0) -> Column:
    """Whether the point is in the oriented box, distances along its axes exceeding their halves by slack at most. A half axis without length counts as the coordinate axis of its number."""
    at = lambda k: F.get(box, F.lit(k))
    d = [F.get(point, F.lit(i)) - at(i) for i in range(3)]
    test = F.lit(True)
    for k in range(3):
        half = [at(3 * k + 3 + i) for i in range(3)]
        length = F.sqrt(sum((h * h for h in half[1:]), half[0] * half[0]))
        along = sum((u * h for u, h in zip(d[1:], half[1:])), d[0] * half[0])
        test = test & F.when(length > 0, F.abs(along / F.nullif(length, F.lit(0.0))) <= length + slack).otherwise(F.abs(d[k]) <= slack)
    return test


def _plain(rings) -> list[list[list[float]]]:
    return [[p.tolist() for p in r] for r in rings]


def _off_segment(p: Point, a: Point, b: Point) -> float:
    d = [v - u for u, v in zip(a, b)]
    e = [v - u for u, v in zip(a, p)]
    length = sum(v * v for v in d)
    t = 0.0 if length == 0 else min(1.0, max(0.0, sum(u * v for u, v in zip(d, e)) / length))
    return sqrt(sum((u - t * v) ** 2 for u, v in zip(e, d)))


def simplify(path: Ring, tolerance: float, locked: Sequence[bool] | None = None) -> tuple[list[int], float]:
    """Kept indices and the largest distance of a dropped point to the kept path.

    Douglas-Peucker in all dimensions between anchors: both ends, the point farthest from the
    first, and locked points. The farthest point splits a stretch, the earlier one on ties. A
    closed path keeps three different points at least. Iterative, so that long paths don't recurse.
    """
    n = len(path)
    if n < 3:
        return list(range(n)), 0.0
    distance = [sqrt(sum((u - v) ** 2 for u, v in zip(p, path[0]))) for p in path]
    anchors = {0, n - 1, max(range(n), key=lambda k: (distance[k], -k))} | {k for k, on in enumerate(locked or ()) if on}
    keep, error = set(anchors), 0.0
    order = sorted(anchors)
    todo = list(zip(order, order[1:]))
    dropped: list[tuple[float, int]] = []
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        off = [_off_segment(path[k], path[a], path[b]) for k in range(a + 1, b)]
        worst = max(off)
        if worst > tolerance:
            k = a + 1 + off.index(worst)
            keep.add(k)
            todo += [(a, k), (k, b)]
        else:
            dropped.append((worst, a + 1 + off.index(worst)))
    if list(path[0]) == list(path[-1]) and len(keep) < 4 and dropped:
        dropped.sort(key=lambda d: (-d[0], d[1]))
        keep.add(dropped.pop(0)[1])
    error = max((d[0] for d in dropped), default=0.0)
    return sorted(keep), error


def simplified(lines: DataFrame, tolerance: float, points: str = "points") -> DataFrame:
    """lines with the points that stay and simplify_error. Null and empty paths stay as they are, with error 0."""

    @pandas_udf(f"struct<points:{RING},error:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch:
                if path is None:
                    out.append((None, 0.0))
                    continue
                path = [p.tolist() for p in path]
                kept, error = simplify(path, tolerance)
                out.append(([path[k] for k in kept], float(error)))
            yield pd.DataFrame(out, columns=["points", "error"])

    rest = [c for c in lines.columns if c != points]
    got = lines.select(*rest, run(points).alias("_s"))
    return got.select(*rest, F.col("_s.points").alias(points), F.col("_s.error").alias("simplify_error"))


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _open(ring: Ring) -> list[Point]:
    out = [p for k, p in enumerate(ring) if k == 0 or list(p) != list(ring[k - 1])]
    return out[:-1] if len(out) > 1 and list(out[0]) == list(out[-1]) else out


def _on(p: Point, a: Point, b: Point) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether closed segments ab and cd have a common point."""
    sign = lambda v: (v > 0) - (v < 0)
    s = [sign(_cross(a, b, c)), sign(_cross(a, b, d)), sign(_cross(c, d, a)), sign(_cross(c, d, b))]
    if s[0] != s[1] and s[2] != s[3]:
        return True
    return any(z == 0 and _on(p, *e) for z, p, e in zip(s, (c, d, a, b), ((a, b), (a, b), (c, d), (c, d))))


def _inside(p: Point, ring: Ring) -> bool:
    """Even-odd rule; the boundary counts as inside."""
    odd = False
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        if _cross(a, b, p) == 0 and _on(p, a, b):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def polygon_problem(rings: Sequence[Ring]) -> str | None:
    """Why a polygon is not valid, or None: empty, nonfinite, degenerate, self_intersection, hole_outside, nested_holes.

    Edges are swept along x, so that only those with overlapping spans are tested.
    """
    if len(rings) == 0:
        return "empty"
    loops = [_open(r) for r in rings]
    if any(not isfinite(v) for r in loops for p in r for v in p):
        return "nonfinite"
    for r in loops:
        if len(r) < 3 or all(_cross(r[0], a, b) == 0 for a, b in zip(r[1:], r[2:])):
            return "degenerate"
    edges = [(min(r[k][0], r[(k + 1) % len(r)][0]), max(r[k][0], r[(k + 1) % len(r)][0]), i, k, r[k], r[(k + 1) % len(r)]) for i, r in enumerate(loops) for k in range(len(r))]
    edges.sort(key=lambda e: (e[0], e[2], e[3]))
    active: list[tuple] = []
    for e in edges:
        active = [o for o in active if o[1] >= e[0]]
        for o in active:
            if o[2] == e[2] and (o[3] - e[3]) % len(loops[e[2]]) in (1, len(loops[e[2]]) - 1):
                shared, far = (e[4], e[5]) if o[5] is e[4] else (e[5], e[4])
                other = o[4] if o[5] is shared else o[5]
                if len(loops[e[2]]) > 3 and _cross(shared, far, other) == 0 and (far[0] - shared[0]) * (other[0] - shared[0]) + (far[1] - shared[1]) * (other[1] - shared[1]) > 0:
                    return "self_intersection"
            elif _meet(e[4], e[5], o[4], o[5]):
                return "self_intersection"
        active.append(e)
    for i, hole in enumerate(loops[1:], 1):
        if not _inside(hole[0], loops[0]):
            return "hole_outside"
        if any(_inside(hole[0], o) for j, o in enumerate(loops[1:], 1) if j != i):
            return "nested_holes"
    return None


def triangulate(rings: Sequence[Ring]) -> list[tuple[int, int, int]]:
    """Triangles over the points of all open rings in order, counter-clockwise. Holes are bridged to the outline from their rightmost point, then ears are cut."""
    loops = [_open(r) for r in rings]
    points = [p for r in loops for p in r]
    starts = np.cumsum([0, *map(len, loops)]).tolist()
    at = lambda i: points[i]

    def oriented(k: int, positive: bool) -> list[int]:
        idx = list(range(starts[k], starts[k + 1]))
        doubled = sum(_cross(at(idx[0]), at(a), at(b)) for a, b in zip(idx[1:], idx[2:]))
        return idx if (doubled > 0) == positive else idx[::-1]

    outline = oriented(0, True)
    holes = sorted((oriented(k, False) for k in range(1, len(loops))), key=lambda h: -max(at(i)[0] for i in h))
    for n, hole in enumerate(holes):
        first = max(range(len(hole)), key=lambda k: (at(hole[k])[0], -k))
        hole = hole[first:] + hole[:first]
        p = at(hole[0])
        walls = [(a, b) for loop in (outline, *(h for h in holes[n:])) for a, b in zip(loop, [*loop[1:], loop[0]])]

        def sees(i: int) -> bool:
            q = at(i)
            return all(list(at(v)) in (list(p), list(q)) or list(at(w)) in (list(p), list(q)) or not _meet(p, q, at(v), at(w)) for v, w in walls)

        ranked = sorted(range(len(outline)), key=lambda k: (hypot(at(outline[k])[0] - p[0], at(outline[k])[1] - p[1]), k))

        def leaves_inside(k: int) -> bool:
            a, b, c = at(outline[k - 1]), at(outline[k]), at(outline[(k + 1) % len(outline)])
            if _cross(a, b, c) >= 0:
                return _cross(a, b, p) >= 0 and _cross(b, c, p) >= 0
            return _cross(a, b, p) >= 0 or _cross(b, c, p) >= 0

        k = next((k for k in ranked if sees(outline[k]) and leaves_inside(k)), ranked[0])
        outline = outline[: k + 1] + hole + [hole[0]] + outline[k:]
    out: list[tuple[int, int, int]] = []
    ring = list(outline)
    while len(ring) > 3:
        for k in range(len(ring)):
            a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
            if _cross(at(a), at(b), at(c)) <= 0:
                continue
            corner = [list(at(v)) for v in (a, b, c)]
            if any(list(at(v)) not in corner and min(_cross(at(a), at(b), at(v)), _cross(at(b), at(c), at(v)), _cross(at(c), at(a), at(v))) >= 0 for v in ring):
                continue
            out.append((a, b, c))
            del ring[k]
            break
        else:  # only collinear or touching corners are left: drop the flattest one
            k = min(range(len(ring)), key=lambda k: (abs(_cross(at(ring[k - 1]), at(ring[k]), at(ring[(k + 1) % len(ring)]))), k))
            del ring[k]
    if len(ring) == 3 and _cross(*(at(v) for v in ring)) > 0:
        out.append(tuple(ring))
    return out


def plane_fit(points: Sequence[Point]) -> tuple[list[float], list[float], float]:
    """Mean point, unit normal (largest component positive) and largest distance of the least-squares plane."""
    p = np.asarray(points, dtype=float)
    mean = p.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((p - mean).T, bias=True))
    normal = vectors[:, 0]
    normal = normal * (1 if normal[np.argmax(np.abs(normal))] > 0 else -1)
    return mean.tolist(), normal.tolist(), float(np.abs((p - mean) @ normal).max())


def checked(polygons: DataFrame, parts: str = "parts") -> DataFrame:
    """polygons with `problem`, the first reason over their parts, null for valid ones; a null or empty geometry is `empty`."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([next((why for rings in g if (why := polygon_problem(_plain(rings)))), None) if g is not None and len(g) else "empty" for g in batch], dtype=object)

    return polygons.withColumn("problem", run(parts))


def triangles(polygons: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """(key, part, triangle, a, b, c): one row per triangle with its corner points."""

    @pandas_udf("array<struct<part:int,triangle:int,a:array<double>,b:array<double>,c:array<double>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for g in batch:
                found = []
                for n, rings in enumerate(g if g is not None else ()):
                    rings = _plain(rings)
                    if not rings or len(_open(rings[0])) < 3:
                        continue
                    flat = [p for r in rings for p in _open(r)]
                    found += [{"part": n, "triangle": k, "a": flat[a], "b": flat[b], "c": flat[c]} for k, (a, b, c) in enumerate(triangulate(rings))]
                out.append(found)
            yield pd.Series(out)

    return polygons.select(key, F.explode(run(parts)).alias("t")).select(key, "t.*")
