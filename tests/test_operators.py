"""Invariants and refusals of the core operators on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import features, hierarchy, points


def brute_octree(rows, most):
    out = {}

    def go(rows, path, lo, hi):
        if len(rows) <= most:
            out.update({r[0]: path for r in rows})
            return
        data = [(min(r[k] for r in rows), max(r[k] for r in rows)) for k in (1, 2, 3)]
        if all(a == b for a, b in data):
            for k, r in enumerate(rows):
                buckets.setdefault((path, min(7, k * 8 // len(rows))), []).append(r)
            for b in range(8):
                if (path, b) in buckets:
                    go(buckets.pop((path, b)), path + str(b), lo, hi)
            return
        while True:
            mid = [a + (b - a) / 2 for a, b in zip(lo, hi)]
            if not all(d[1] < m or d[0] >= m for d, m in zip(data, mid)):
                break
            lo, hi = [m if d[0] >= m else a for d, m, a in zip(data, mid, lo)], [b if d[0] >= m else m for d, m, b in zip(data, mid, hi)]
        parts = {}
        for r in rows:
            parts.setdefault(sum((r[k + 1] >= mid[k]) << k for k in range(3)), []).append(r)
        for b, part in parts.items():
            go(part, path + str(b), [mid[k] if b >> k & 1 else lo[k] for k in range(3)], [hi[k] if b >> k & 1 else mid[k] for k in range(3)])

    buckets = {}
    go(rows, "", [min(r[k] for r in rows) for k in (1, 2, 3)], [max(r[k] for r in rows) for k in (1, 2, 3)])
    return out


@pytest.mark.parametrize("whole", [10**6, 100, 20])
@pytest.mark.parametrize("partitions", [1, 5])
def test_octree(spark, partitions, whole, monkeypatch):
    """One task a node, passes of several digits, and both; a tight cluster with a far point needs many halvings."""
    monkeypatch.setattr(points, "WHOLE", whole)
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.gauss(0, 1), 0.001 * rng.random()) for i in range(300)]
    rows += [(300 + i, 5.0, 5.0, 5.0) for i in range(160)] + [(500 + i, 1e-20 * rng.random(), 0.0, 1e-22 * rng.random()) for i in range(50)]
    frame = spark.createDataFrame(rows, "ordinal long, x double, y double, z double").repartition(partitions)
    got = {r["ordinal"]: r["path"] for r in points.octree(frame, 20).collect()}
    assert got == brute_octree(rows, 20)


def brute_halves(rows, most, path=""):
    if len(rows) <= most:
        return {r[:2]: path for r in rows}
    x, y, z = (max(r[k] for r in rows) - min(r[k] for r in rows) for k in (2, 3, 4))
    k = 4 if z > x and z > y else 3 if y > x else 2
    rows = sorted(rows, key=lambda r: (r[k], *r[:2]))
    return brute_halves(rows[: len(rows) // 2], most, path + "0") | brute_halves(rows[len(rows) // 2 :], most, path + "1")


@pytest.mark.parametrize("whole", [10**6, 90])
def test_kd_median(spark, whole, monkeypatch):
    monkeypatch.setattr(hierarchy, "WHOLE", whole)
    rng = random.Random(9)
    rows = [(rng.choice(["a", "ä", "Z", "b"]), i, float(rng.randrange(6)), rng.random(), 2.0) for i in range(500)]
    frame = spark.createDataFrame(rows, "layer string, id long, x double, y double, z double").repartition(3)
    got = {(r["layer"], r["id"]): r["path"] for r in hierarchy.kd_median(frame, 30, ("layer", "id")).collect()}
    assert got == brute_halves(rows, 30)


def test_kd_keeps_rows_and_budget(spark):
    rng = random.Random(5)
    rows = [("a", i, rng.random(), rng.random(), 1.0) for i in range(200)]
    frame = spark.createDataFrame(rows, "layer string, id long, x double, y double, z double").repartition(3)
    got = hierarchy.kd_median(frame, 10, ("layer", "id"))
    assert got.count() == 200 and got.select("id").distinct().count() == 200
    assert max(r["count"] for r in got.groupBy("path").count().collect()) <= 10


def test_strict_rejection(spark):
    judged = features.with_rejections(spark.range(3), {"two": F.col("id") == 2})
    assert features.accepted(judged, skip_invalid=True).count() == 2
    with pytest.raises(ValueError):
        features.accepted(judged, skip_invalid=False)


def test_coincident_by_brute_force(spark):
    rng = random.Random(6)
    at = [[(i, *(rng.uniform(0, 3) for _ in range(3))) for i in range(60)] for _ in range(2)]
    frames = [spark.createDataFrame(a, "id long, x double, y double, z double") for a in at]
    got = {(r["a"], r["b"]) for r in features.coincident(*frames, 0.3).collect()}
    assert got == {(p[0], q[0]) for p in at[0] for q in at[1] if all(abs(p[k] - q[k]) <= 0.3 for k in (1, 2, 3))}


def test_filter_reaches_the_scan(spark, sf_dir):
    frame = features.where(spark.read.parquet(f"{sf_dir}/events.parquet"), "value > 50 AND user_id = 7").select("event_id")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value)" in plan and "props" not in plan.split("ReadSchema")[1]
