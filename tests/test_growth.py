"""Queries against their SQL on tables larger or odder than the smoke tables."""

import duckdb
import pytest
from conftest import compare

from tessera.operators import graph, hierarchy
from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def made(tmp_path):
    """Writes tables given as SQL, and returns their folder and a connection that sees them."""

    def make(**tables):
        con = duckdb.connect()
        for name, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        return str(tmp_path), con

    return make


def check(spark, made, name, **tables):
    folder, con = made(**tables)
    got, expected = compare(QUERIES[name](spark, folder), con, SQL[name])
    assert got == expected
    return got


@pytest.mark.parametrize("rows", [5, 3001, 60_001])
def test_degenerate_split_is_one_level(spark, made, rows):
    check(spark, made, "par_octree_degenerate", embeddings=f"SELECT 7 * range AS vec_id, [1.0::FLOAT, 2.0, 3.0] AS embedding, 0 AS label FROM range({rows})")


#: Parts, also without key, below the root, far apart and at the edges of deep levels.
PARTS = "SELECT k AS p_partkey, (1 + k % 50)::INT AS p_size, 900.0::DOUBLE + (k % 1000 * 7919) % 1000 AS p_retailprice FROM (SELECT range AS k FROM range(1500) UNION ALL SELECT ((1::BIGINT << (2 * n)::INT) - 1) // 3 - d FROM range(7, 31) a(n), range(3) b(d))"


def tile_plan(spark, made, name):
    """A tile query matches its SQL, reads the key a few times a scan only, and broadcasts no tiles."""
    folder, con = made(part=PARTS)
    got, expected = compare(QUERIES[name](spark, folder), con, SQL[name])
    assert got == expected
    run = QUERIES[name](spark, folder)._jdf.queryExecution()
    plan = run.optimizedPlan().toString()
    assert plan.count("p_partkey#") <= 12 * plan.count("Relation ")
    assert "BroadcastHashJoin" not in run.executedPlan().toString()


def test_jn_parent_child_grows_with_its_input(spark, made):
    tile_plan(spark, made, "jn_parent_child")


def test_lod_skip_level_grows_with_its_input(spark, made):
    tile_plan(spark, made, "lod_skip_level")


def test_agg_counters_grows_with_its_input(spark, made):
    tile_plan(spark, made, "agg_counters")


def test_agg_leaf_fragments_grows_with_its_input(spark, made):
    tile_plan(spark, made, "agg_leaf_fragments")


def test_agg_top_error_grows_with_its_input(spark, made):
    tile_plan(spark, made, "agg_top_error")


def test_agg_max_error_grows_with_its_input(spark, made):
    tile_plan(spark, made, "agg_max_error")


def test_val_error_order_grows_with_its_input(spark, made):
    tile_plan(spark, made, "val_error_order")


def test_src_list_tiles_grows_with_its_input(spark, made):
    tile_plan(spark, made, "src_list_tiles")


def test_hier_roles_grows_with_its_input(spark, made):
    tile_plan(spark, made, "hier_roles")


def no_filter_computes_paths(spark, made, name):
    """Level and path are written once in the plan, and no filter holds a copy of them, which would be work a row."""
    folder, con = made(part=PARTS + " WHERE k < 1500")
    got, expected = compare(QUERIES[name](spark, folder), con, SQL[name])
    assert got == expected
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "p_partkey#" in line]
    assert plan.count("lpad(") == 1


#: Parts beyond the last level's keys; no two have the same path.
LAST = "SELECT ((1::BIGINT << 62) - 1) // 3 + d AS p_partkey, (1 + d % 50 * 37 % 50)::INT AS p_size, 900.0::DOUBLE + d % 97 AS p_retailprice FROM (SELECT range AS d FROM range(9) UNION ALL SELECT (1::BIGINT << (3 * n)::INT) + 77 FROM range(4, 21) t(n))"


def last_level_begins_again(spark, made, name):
    assert check(spark, made, name, part=LAST)


def test_lod_skip_level_computes_paths_once(spark, made):
    no_filter_computes_paths(spark, made, "lod_skip_level")


def test_lod_skip_level_beyond_the_last_level(spark, made):
    last_level_begins_again(spark, made, "lod_skip_level")


def test_agg_leaf_fragments_computes_paths_once(spark, made):
    no_filter_computes_paths(spark, made, "agg_leaf_fragments")


def test_agg_leaf_fragments_beyond_the_last_level(spark, made):
    last_level_begins_again(spark, made, "agg_leaf_fragments")


def int_keys(spark, made, name):
    """Keys of 32 bits, up to the largest and with the root: three times such a key is no such number."""
    assert check(spark, made, name, part="SELECT k::INT AS p_partkey, (1 + k % 50)::INT AS p_size, 900.0::DOUBLE + k % 97 AS p_retailprice FROM (SELECT range AS k FROM range(90) UNION ALL SELECT 2147483647 - range FROM range(90))")


def test_agg_leaf_fragments_of_int_keys(spark, made):
    int_keys(spark, made, "agg_leaf_fragments")


def test_agg_top_error_computes_paths_once(spark, made):
    no_filter_computes_paths(spark, made, "agg_top_error")


def test_agg_top_error_of_int_keys(spark, made):
    int_keys(spark, made, "agg_top_error")


@pytest.mark.parametrize("name", ["geo_triangulate", "geo_valid"])
def test_geometries_are_dealt_over_tasks(spark, made, name):
    """One small file isn't one task's work."""
    folder, con = made(part=PARTS + " WHERE k < 1500")
    got, expected = compare(QUERIES[name](spark, folder), con, SQL[name])
    assert got == expected
    assert "hashpartitioning(p_partkey" in QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("under", ["", "t1"])
def test_groups_cost_a_link_per_tile(spark, monkeypatch, under):
    """200 vertices held by the same 12 tiles, also with one tile above some others: links don't grow with the vertices."""
    seen = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda edges: (seen.append(edges.count()), whole(edges))[1])
    tiles = [f"t{k}" for k in range(10, 21)] + [under or "u"]
    holders = spark.createDataFrame([(v, t) for v in range(200) for t in tiles], "vertex long, path string")
    got = {r["path"]: r["grp"] for r in graph.co_render_groups(holders).collect()}
    # t1 is above t10 .. t19, but not above t20, so that it hangs together with that
    assert got == dict.fromkeys(tiles, min(tiles))
    assert seen[0] <= 2 * len(tiles)


def test_unresolved_names_by_one_aggregation(spark):
    members = spark.createDataFrame([(1,), (2,), (2,), (None,), (5,)], "name long")
    references = spark.createDataFrame([(2,), (3,), (3,), (None,), (None,), (5,)], "name long")
    found = hierarchy.unresolved(members, references)
    assert sorted(map(repr, found.collect())) == sorted(f"Row(name={n}, problem='{p}')" for n, p in [(1, "unreferenced"), (3, "missing"), (None, "missing"), (None, "unreferenced")])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
