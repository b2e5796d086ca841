"""Queries over vector features, archive members and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import features as op
from tessera.operators import hierarchy as tree
from tessera.plans.registry import query
from tessera.plans.tables import FEATURES, features, table


@query("flt_where", "SELECT event_id, event_type, value FROM events WHERE value BETWEEN 20 AND 80 AND event_type ILIKE 'c%' AND NOT (user_id % 3 = 1)")
def flt_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.where(table(spark, sf_dir, "events"), "Value BETWEEN 20 AND 80 AND event_type LIKE 'C%' AND NOT (user_id % 3 == 1)").select("event_id", "event_type", "value")


_TYPED = """SELECT event_id, coalesce(upper(substr(event_type, 1, 2)), 'NONE') AS code FROM events
 WHERE length(event_type) > 4 AND abs(value) > 1.5 AND event_type IS NOT NULL AND user_id // 2 <> 3 AND event_id % 5 <> 0 AND greatest(user_id, event_id % 5) > 3
 AND event_type NOT ILIKE '%\\%' AND (event_id // 3 % 4 IN (0, 1, 3) OR value IS NULL)"""


@query("flt_where_typing", _TYPED)
def flt_where_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are above numbers, integers divide to integers, max of a null is null, a backslash is a character."""
    text = r"length(event_type) > 4 AND abs(value) > 1.5 AND event_type > 5 AND user_id / 2 <> 3 AND max(user_id, nullif(event_id % 5, 0)) > 3 AND event_type NOT LIKE '%\%' AND (event_id / 3 % 4 IN (0, 1, 3) OR value ISNULL)"
    got = op.where(table(spark, sf_dir, "events"), text)
    return got.select("event_id", F.expr("coalesce(upper(substring(event_type, 1, 2)), 'NONE')").alias("code"))


@query("prj_fields", f"WITH {FEATURES} SELECT layer, id, segment FROM feats")
def prj_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep_fields(features(spark, sf_dir), keep=["segment"])


@query("prj_drop_fields", f"WITH {FEATURES} SELECT layer, id, x, y, z FROM feats")
def prj_drop_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep_fields(features(spark, sf_dir), drop=["segment"])


@query("prj_list_json", "SELECT vec_id, '[' || (embedding[1] > 0)::VARCHAR || ',' || label || ']' AS list FROM embeddings")
def prj_list_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("["), F.to_json(F.struct((F.get("embedding", F.lit(0)) > 0).alias("a"))).substr(6, 5), F.lit("")).alias("t"), "label").select("vec_id", F.concat(F.lit("["), F.when(F.col("t").contains("true"), "true").otherwise("false"), F.lit(","), F.col("label").cast("string"), F.lit("]")).alias("list"))


@query("prj_source_id", f"WITH {FEATURES} SELECT layer, coalesce(CASE WHEN id % 7 = 0 THEN NULL ELSE id::VARCHAR END, 'row ' || id) AS _source_id FROM feats")
def prj_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string"))
    return features(spark, sf_dir).select("layer", F.coalesce(own, F.concat(F.lit("row "), F.col("id").cast("string"))).alias("_source_id"))


@query("prj_kind_register", "SELECT event_type AS field, CASE WHEN count(DISTINCT k) = 1 THEN min(k) WHEN count(DISTINCT k) = 2 AND min(k) = 'integer' AND max(k) = 'real' THEN 'real' ELSE 'conflict' END AS kind FROM (SELECT event_type, CASE WHEN event_type = 'click' THEN 'integer' WHEN user_id % 2 = 0 THEN 'integer' ELSE 'real' END AS k FROM events) GROUP BY event_type")
def prj_kind_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "integer").when(F.col("user_id") % 2 == 0, "integer").otherwise("real")
    return op.field_kinds(table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), kind.alias("kind")))


_REASONS = "CASE WHEN segment IS NULL THEN 'no_geometry' WHEN x < 0 THEN 'negative' WHEN y > 20 THEN 'outside' END"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_rejections(features(spark, sf_dir), {"no_geometry": F.col("segment").isNull(), "negative": F.col("x") < 0, "outside": F.col("y") > 20})


@query("flt_reject", f"WITH {FEATURES} SELECT layer, id, {_REASONS} AS reject_reason FROM feats")
def flt_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("layer", "id", "reject_reason")


@query("flt_no_geometry", f"WITH {FEATURES} SELECT layer, id FROM feats WHERE segment IS NOT NULL AND x >= 0 AND y <= 20")
def flt_no_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.accepted(_judged(spark, sf_dir), skip_invalid=True).select("layer", "id")


@query("agg_layer_report", f"WITH {FEATURES}, j AS (SELECT layer, {_REASONS} AS r FROM feats) SELECT layer, count(*) FILTER (r IS NULL) AS accepted, count(*) FILTER (r <> 'no_geometry') AS rejected, count(*) FILTER (r = 'no_geometry') AS without_geometry FROM j GROUP BY layer")
def agg_layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.layer_report(_judged(spark, sf_dir))


@query("set_union_layers", f"WITH {FEATURES} SELECT layer, id, x, y, z, segment FROM feats")
def set_union_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir)


@query("src_layers", f"WITH {FEATURES} SELECT layer, count(*) AS n FROM feats WHERE layer IN ('supplier', 'customer') GROUP BY layer")
def src_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where(F.col("layer").isin("supplier", "customer")).groupBy("layer").agg(F.count("*").alias("n"))


@query("agg_estimate", "SELECT o_orderkey AS id, count(*) AS points, (count(*) * 32 + length(any_value(o_orderpriority)) + 2048)::BIGINT AS estimate FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def agg_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("points"))
    o = table(spark, sf_dir, "orders").join(points, "o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), "points", (F.col("points") * 32 + F.length("o_orderpriority") + 2048).alias("estimate"))


@query("flt_limits", "SELECT l_orderkey AS id, count(*) AS points FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 5")
def flt_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("points")).where("points <= 5")


_VERTS = "v AS (SELECT l_orderkey AS owner, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem)"


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))


@query("agg_shared_vertex", f"WITH {_VERTS} SELECT x, y, z, min(owner) AS owner, count(DISTINCT owner) > 1 AS shared FROM v GROUP BY x, y, z")
def agg_shared_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.shared_vertices(_vertices(spark, sf_dir))


@query("agg_shared_count", f"WITH {_VERTS} SELECT count(*) AS n FROM (SELECT x, y, z FROM v GROUP BY x, y, z HAVING count(DISTINCT owner) > 1)")
def agg_shared_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.shared_vertices(_vertices(spark, sf_dir)).where("shared").agg(F.count("*").alias("n"))


@query("jn_vertex_lock", f"WITH {_VERTS}, s AS (SELECT x, y, z, count(DISTINCT owner) > 1 AS shared FROM v GROUP BY x, y, z) SELECT owner, count(*) FILTER (shared) AS locked, count(*) AS n FROM v JOIN s USING (x, y, z) GROUP BY owner")
def jn_vertex_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vertices(spark, sf_dir)
    flags = op.lock_flags(v, op.shared_vertices(v))
    return flags.groupBy("owner").agg(F.sum(F.when(F.col("shared"), 1).otherwise(0)).cast("long").alias("locked"), F.count("*").alias("n"))


@query("agg_weld", f"WITH {_VERTS} SELECT x, y, z, count(*) AS corners FROM v GROUP BY x, y, z")
def agg_weld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertices(spark, sf_dir).groupBy("x", "y", "z").agg(F.count("*").alias("corners"))


@query("agg_vertex_depth", f"WITH {_VERTS} SELECT x, y, z, max(owner % 9)::BIGINT AS depth FROM v GROUP BY x, y, z")
def agg_vertex_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertices(spark, sf_dir).groupBy("x", "y", "z").agg(F.max(F.col("owner") % 9).alias("depth"))


@query("agg_interface", f"WITH {_VERTS} SELECT x, y, z, min(owner % 64)::BIGINT AS lo, max(owner % 64)::BIGINT AS hi FROM v GROUP BY x, y, z HAVING min(owner % 64) <> max(owner % 64)")
def agg_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = F.col("owner") % 64
    return _vertices(spark, sf_dir).groupBy("x", "y", "z").agg(F.min(leaf).alias("lo"), F.max(leaf).alias("hi")).where("lo <> hi")


@query("jn_interval_outer", f"WITH {_VERTS}, i AS (SELECT x, y, z, min(owner % 64)::BIGINT AS lo, max(owner % 64)::BIGINT AS hi FROM v GROUP BY x, y, z) SELECT x, y, z FROM i WHERE lo < 8 OR hi >= 56")
def jn_interval_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = F.col("owner") % 64
    return _vertices(spark, sf_dir).groupBy("x", "y", "z").agg(F.min(leaf).alias("lo"), F.max(leaf).alias("hi")).where("lo < 8 or hi >= 56").select("x", "y", "z")


@query("jn_coincident", "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a JOIN supplier b ON b.s_acctbal BETWEEN a.c_acctbal - 8::DOUBLE AND a.c_acctbal + 8::DOUBLE AND b.s_nationkey = a.c_nationkey")
def jn_coincident(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0).alias("z")
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"), zero)
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"), zero)
    return op.coincident(left, right, 8.0)


@query("jn_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = op.where(table(spark, sf_dir, "customer"), "c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("jn_corner_position", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey")
def jn_corner_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return table(spark, sf_dir, "lineitem").join(positions, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_retailprice")


@query("jn_corner_attributes", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_size, s_acctbal, o_totalprice FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey")
def jn_corner_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem")
    for name, key, own, value in (("part", "l_partkey", "p_partkey", "p_size"), ("supplier", "l_suppkey", "s_suppkey", "s_acctbal"), ("orders", "l_orderkey", "o_orderkey", "o_totalprice")):
        out = out.join(table(spark, sf_dir, name).select(F.col(own).alias(key), value), key)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_size", "s_acctbal", "o_totalprice")


_ROWS = "r AS (SELECT o_custkey % 40 AS path, o_orderpriority AS layer, o_orderkey AS id, o_totalprice AS diagonal, o_orderkey % 5 <> 0 AS omissible FROM orders)"


def _standin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("path"), F.col("o_orderpriority").alias("layer"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("diagonal"), (F.col("o_orderkey") % 5 != 0).alias("omissible"))


_RANKED = _ROWS + ", k AS (SELECT *, omissible AND diagonal <= 200000 AS minor FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY path, minor ORDER BY diagonal DESC, layer, id) AS rank FROM k)"


@query("lod_standins", f"WITH {_RANKED} SELECT path, count(*) FILTER (NOT minor OR rank <= 16) AS kept, max(diagonal) FILTER (minor AND rank = 17) AS omitted_error FROM q GROUP BY path")
def lod_standins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stand_ins(_standin_rows(spark, sf_dir), 200000.0, 16)


@query("win_top_standins", f"WITH {_RANKED} SELECT path, layer, id, rank FROM q WHERE minor AND rank <= 16")
def win_top_standins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.kept_standins(_standin_rows(spark, sf_dir), 200000.0, 16)


@query("lim_topk_standin", f"WITH {_RANKED} SELECT path, layer, id, rank FROM q WHERE minor AND rank <= 3")
def lim_topk_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.kept_standins(_standin_rows(spark, sf_dir), 200000.0, 3)


@query("lim_budget_prune", f"WITH {_ROWS} SELECT path, count(*) AS n, CASE WHEN count(*) > 380 THEN 'features' WHEN max(diagonal) > 490000 THEN 'vertices' ELSE 'fits' END AS routing_reason FROM r GROUP BY path")
def lim_budget_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("n") > 380, "features").when(F.col("d") > 490000, "vertices").otherwise("fits")
    return _standin_rows(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.max("diagonal").alias("d")).select("path", "n", reason.alias("routing_reason"))


@query("lim_offset", f"WITH {_ROWS}, q AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY diagonal, layer, id) AS k, count(*) OVER (PARTITION BY path) AS n FROM r) SELECT path, id, diagonal FROM q WHERE k = n // 2")
def lim_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standin_rows(spark, sf_dir)
    n = rows.groupBy("path").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("path").orderBy("diagonal", "layer", "id"))
    return rows.withColumn("k", k).join(n, "path").where(F.col("k") == F.floor(F.col("n") / 2)).select("path", "id", "diagonal")


@query("srt_features", "SELECT o_orderpriority AS layer, o_orderkey AS id, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders")
def srt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place in the total order, from range partitions: per-partition counts give the bases, so that no single task sorts everything."""
    return _placed(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("layer"), F.col("o_orderkey").alias("id")), "layer", "id")


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    from tessera.operators.checkpoints import stored

    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "places")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    bases = counts.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return dealt.join(F.broadcast(bases), "part").select(*rows.columns, (F.col("base") + F.col("seq") - F.col("first") + 1).alias("place"))


@query("srt_external", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def srt_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _placed(li, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("lim_reports_sample", "SELECT event_id, event_type FROM events WHERE value < 10 ORDER BY event_id LIMIT 100")
def lim_reports_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value < 10").orderBy("event_id").limit(100).select("event_id", "event_type")


@query("lim_labels", "SELECT DISTINCT url AS label FROM pages ORDER BY url LIMIT 64")
def lim_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("label")).distinct().orderBy("label").limit(64)


@query("set_dedup_payload", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS members FROM documents GROUP BY sha256(text)")
def set_dedup_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"))


@query("id_content_name", "SELECT DISTINCT 't/' || sha256(text) || '.glb' AS name FROM documents")
def id_content_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("t/"), F.sha2("text", 256), F.lit(".glb")).alias("name")).distinct()


@query("val_hash", "SELECT page_id, sha256(html) AS sha256, md5(url) AS md5 FROM pages")
def val_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.md5("url").alias("md5"))


_HALVES = ", ".join(f"array_to_string([substr(md5, i, 2) FOR i IN range({s + 14}, {s - 1}, -2)], '') AS {n}" for s, n in ((1, "low"), (17, "high")))


@query("snk_3tz_index", f"SELECT name, md5, {_HALVES} FROM (SELECT url AS name, md5(url) AS md5 FROM pages)")
def snk_3tz_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.index_order(table(spark, sf_dir, "pages").select(F.col("url").alias("name")))


@query("srt_names", "SELECT name, row_number() OVER (ORDER BY name) AS place FROM (SELECT DISTINCT url AS name FROM pages)")
def srt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "pages").select(F.col("url").alias("name")).distinct(), "name")


@query("jn_resource_refs", "SELECT name, 'missing' AS problem FROM (SELECT DISTINCT l_orderkey AS name FROM lineitem) WHERE name NOT IN (SELECT event_id FROM events) UNION ALL SELECT event_id, 'unreferenced' FROM events WHERE event_id NOT IN (SELECT l_orderkey FROM lineitem)")
def jn_resource_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for members, line items for references."""
    members = table(spark, sf_dir, "events").select(F.col("event_id").alias("name"))
    return tree.unresolved(members, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name")))


@query("val_refs", "SELECT l_partkey AS name, 'missing' AS problem FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) UNION ALL SELECT p_partkey, 'unreferenced' FROM part WHERE p_size > 3 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def val_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("name"))
    return tree.unresolved(members, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name")))


@query("set_unreferenced", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("set_subset", "SELECT DISTINCT c_mktsegment AS layer FROM customer EXCEPT SELECT 'BUILDING'")
def set_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.range(1).select(F.lit("BUILDING").alias("layer"))
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("layer")).distinct().subtract(asked)


_FP = "sha256(concat_ws(chr(31), coalesce(c_custkey::VARCHAR, ''), coalesce(c_mktsegment, ''), coalesce(c_nationkey::VARCHAR, '')))"


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("path", (F.col("c_custkey") % 32).cast("string"))
    return op.fingerprints(c, "c_custkey", "c_mktsegment", "c_nationkey")


@query("id_fingerprint", f"SELECT c_custkey, {_FP} AS fingerprint FROM customer")
def id_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir).select("c_custkey", "fingerprint")


_SIG = "sha256('config-1' || string_agg(f, '' ORDER BY f))"


@query("id_signature", f"SELECT path, {_SIG} AS signature FROM (SELECT (c_custkey % 32)::VARCHAR AS path, {_FP} AS f FROM customer) GROUP BY path")
def id_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.signatures(_prints(spark, sf_dir), "config-1")


@query("jn_layer_prev", "SELECT path, CASE WHEN bool_or(c_custkey >= 1000) THEN 'rebuild' ELSE 'restore' END AS state FROM (SELECT (c_custkey % 32)::VARCHAR AS path, c_custkey FROM customer) GROUP BY path")
def jn_layer_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prints(spark, sf_dir)
    return op.changes(op.signatures(rows, "config-1"), op.signatures(rows.where("c_custkey < 1000"), "config-1"))


_RESTORE = """WITH now AS (SELECT (c_custkey % 32)::VARCHAR AS path, count(*) AS features, sum(CASE WHEN c_custkey % 32 < 4 AND c_custkey % 7 = 0 THEN 1 ELSE 0 END) AS moved, max(c_custkey % 32) AS p FROM customer GROUP BY 1)
 SELECT path, features, CASE WHEN p >= 28 THEN 'new' WHEN moved > 0 THEN 'rebuild' WHEN features > (SELECT avg(features) FROM now) THEN 'over_budget' ELSE 'restore' END AS state FROM now"""


@query("id_restore", _RESTORE)
def id_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an earlier table that lacks four paths and has other nations in four others; the budget is the mean of the features."""
    c = table(spark, sf_dir, "customer").withColumn("path", (F.col("c_custkey") % 32).cast("string"))
    moved = (F.col("c_custkey") % 32 < 4) & (F.col("c_custkey") % 7 == 0)
    old = c.where("c_custkey % 32 < 28").withColumn("c_nationkey", F.when(moved, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    now, before = (op.signatures(op.fingerprints(t, "c_custkey", "c_mktsegment", "c_nationkey"), "config-1") for t in (c, old))
    sizes = c.groupBy("path").agg(F.count("*").alias("features"))
    return op.restorable(now, before, sizes, sizes.agg(F.avg("features").alias("budget"))).select("path", "features", "state")


@query("md_property_table", "SELECT min(v) AS no_data FROM (SELECT -9007199254740992::BIGINT + unnest(range((SELECT count(*) + 1 FROM supplier))) AS v) WHERE v NOT IN (SELECT -9007199254740992::BIGINT + s_suppkey FROM supplier)")
def md_property_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sentinel(table(spark, sf_dir, "supplier").select((F.lit(-(1 << 53)) + F.col("s_suppkey")).alias("v")), "v")


@query("md_string_offsets", "SELECT s_suppkey, (coalesce(sum(strlen(s_name)) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM supplier")
def md_string_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in one table's joined strings: sums within range partitions, and the partitions' bases."""
    from tessera.operators.checkpoints import stored

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.octet_length("s_name").cast("long").alias("size"))
    dealt = stored(s.repartitionByRange("s_suppkey").sortWithinPartitions("s_suppkey").withColumn("part", F.spark_partition_id()), "offsets")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part").agg(F.sum("size").alias("size")).select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("own", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return own.join(F.broadcast(bases), "part").select("s_suppkey", (F.col("own") + F.col("base")).alias("start"))


@query("md_feature_ids", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS feature_id FROM customer")
def md_feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", k.cast("long").alias("feature_id"))


@query("src_las_dims", "SELECT event_id, event_id & 7 AS return_number, (event_id >> 3) & 7 AS number_of_returns, user_id * 0.001::DOUBLE + 500000.0::DOUBLE AS x FROM events")
def src_las_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", i.bitwiseAND(F.lit(7)).alias("return_number"), F.shiftright(i, 3).bitwiseAND(F.lit(7)).alias("number_of_returns"), (F.col("user_id") * F.lit(0.001) + F.lit(500000.0)).alias("x"))


@query("agg_payload_rows", "SELECT source AS uri, count(*) AS n, sum(n_chars)::BIGINT AS vertices FROM documents GROUP BY source")
def agg_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("uri")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("vertices"))


@query("par_split_feature", None)
def par_split_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of their items, halved until no part has more than 4 points."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("points"))
    return op.split_lines(line.select("id", F.lit("").alias("fragment_path"), "points"), 4).select("id", "fragment_path", F.size("points").cast("long").alias("n"))
