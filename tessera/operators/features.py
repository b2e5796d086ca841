"""Vector features: filters, fields, kinds, shared vertices, stand-ins and layer reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numeric import no_negative_zero
from tessera.operators.filters import translate


def where(features: DataFrame, text: str) -> DataFrame:
    """Rows on which the filter (see filters.py) is true; it becomes an ordinary predicate and reaches the scan."""
    return features.where(F.expr(translate(text, features.schema)))


def keep_fields(features: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None, identity: tuple[str, ...] = ("layer", "id")) -> DataFrame:
    """Only the named fields, or all but them; the identity always stays."""
    if keep is not None and drop is not None:
        raise ValueError("keep and drop exclude each other")
    unknown = [f for f in keep or drop or [] if f not in features.columns]
    if unknown:
        raise ValueError(f"unknown fields {unknown}")
    if keep is not None:
        return features.select(*(c for c in features.columns if c in identity or c in keep))
    return features.drop(*(c for c in drop or [] if c not in identity))


def field_kinds(observed: DataFrame) -> DataFrame:
    """The kind of each field over all rows: observed(field, kind). integer with real is real; any other mix is a conflict."""
    kinds = observed.groupBy("field").agg(F.array_sort(F.collect_set("kind")).alias("k"))
    mixed = F.when(F.size("k") == 1, F.get("k", F.lit(0))).when(F.array_join("k", ",") == "integer,real", "real").otherwise("conflict")
    return kinds.select("field", mixed.alias("kind"))


def with_rejections(features: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """The first reason that applies to each row, null for those that are accepted."""
    out = F.lit(None).cast("string")
    for name, test in reversed(list(reasons.items())):
        out = F.when(test, name).otherwise(out)
    return features.withColumn("reject_reason", out)


def accepted(features: DataFrame, skip_invalid: bool) -> DataFrame:
    """Rows without a reason. In strict mode one rejection refuses the whole job."""
    if not skip_invalid and not features.where("reject_reason is not null").isEmpty():
        raise ValueError("features were rejected")
    return features.where("reject_reason is null").drop("reject_reason")


def layer_report(features: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    r = F.col("reject_reason")
    return features.groupBy("layer").agg(n(r.isNull()).alias("accepted"), n(r.isNotNull() & (r != "no_geometry")).alias("rejected"), n(r == "no_geometry").alias("without_geometry"))


def shared_vertices(vertices: DataFrame, owner: str = "owner") -> DataFrame:
    """Exact positions and whether different owners use them: the least and largest owner tell, without collecting any."""
    at = [no_negative_zero(F.col(a)).alias(a) for a in "xyz"]
    found = vertices.select(*at, F.col(owner).alias("owner")).groupBy("x", "y", "z").agg(F.min("owner").alias("owner"), (F.min("owner") != F.max("owner")).alias("shared"))
    return found


def lock_flags(vertices: DataFrame, shared: DataFrame) -> DataFrame:
    """vertices with the shared flag of their exact position."""
    at = [no_negative_zero(F.col(a)).alias(a) for a in "xyz"]
    rest = [c for c in vertices.columns if c not in ("x", "y", "z")]
    return vertices.select(*rest, *at).join(shared.select("x", "y", "z", "shared"), ["x", "y", "z"])


def coincident(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b) within a box of half-width reach: cells of that size, the right side sent to its 27 neighbours, exact test after the join."""
    size = 2 * reach
    keys = ["cx", "cy", "cz"]
    l = left.select(F.col("id").alias("a"), *(F.col(c).alias(f"a{c}") for c in "xyz"), *(F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in "xyz"))
    r = right.select(F.col("id").alias("b"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    for c in "xyz":
        r = r.withColumn(f"c{c}", F.explode(F.array(*(F.floor(F.col(f"b{c}") / size).cast("long") + k for k in (-1, 0, 1)))))
    near = F.lit(True)
    for c in "xyz":
        near = near & F.col(f"b{c}").between(F.col(f"a{c}") - reach, F.col(f"a{c}") + reach)
    return l.join(r, keys).where(near).select("a", "b")


def stand_ins(rows: DataFrame, tolerance: float, max_features: int) -> DataFrame:
    """Per prefix, the largest omissible rows within the tolerance that stay, and the diagonal of the next one: rows(path, layer, id, diagonal, omissible).

    Minor rows are ranked by descending diagonal, layer and id.
    """
    minor = F.col("omissible") & (F.col("diagonal") <= tolerance)
    rank = F.row_number().over(Window.partitionBy("path", "minor").orderBy(F.col("diagonal").desc(), "layer", "id"))
    ranked = rows.withColumn("minor", minor).withColumn("rank", rank)
    kept = F.sum(F.when(~F.col("minor") | (F.col("rank") <= max_features), 1).otherwise(0)).cast("long").alias("kept")
    omitted = F.max(F.when(F.col("minor") & (F.col("rank") == max_features + 1), F.col("diagonal"))).alias("omitted_error")
    return ranked.groupBy("path").agg(kept, omitted)


def kept_standins(rows: DataFrame, tolerance: float, max_features: int) -> DataFrame:
    minor = rows.where(F.col("omissible") & (F.col("diagonal") <= tolerance))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.col("diagonal").desc(), "layer", "id"))
    return minor.withColumn("rank", rank.cast("long")).where(F.col("rank") <= max_features).select("path", "layer", "id", "rank")


def split_lines(parts: DataFrame, max_points: int) -> DataFrame:
    """Lines halved at a shared middle vertex until none has more than max_points: parts(id, fragment_path, points array)."""
    while True:
        long = parts.where(F.size("points") > max_points)
        if max_points < 2 or long.isEmpty():
            return parts
        m = F.floor(F.size("points") / 2).cast("int")
        first = F.struct(F.concat("fragment_path", F.lit("0")).alias("fragment_path"), F.slice("points", F.lit(1), m + 1).alias("points"))
        second = F.struct(F.concat("fragment_path", F.lit("1")).alias("fragment_path"), F.slice("points", m + 1, F.size("points") - m).alias("points"))
        whole = F.struct("fragment_path", "points")
        pieces = F.when((F.size("points") > max_points) & (F.size("points") > 2), F.array(first, second)).otherwise(F.array(whole))
        parts = parts.select("id", F.explode(pieces).alias("p")).select("id", "p.fragment_path", "p.points")
        if parts.where((F.size("points") > max_points) & (F.size("points") > 2)).isEmpty():
            return parts


def fingerprints(rows: DataFrame, *fields: str) -> DataFrame:
    """SHA-256 of the fields' text, a null being an empty text, with unit separators."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    return rows.withColumn("fingerprint", F.sha2(text, 256))


def signatures(rows: DataFrame, config: str, by: str = "path") -> DataFrame:
    """Identity of each subtree: SHA-256 of the configuration and its rows' fingerprints in order. A group here is one tile's rows, bounded by the tile budget."""
    joined = F.concat(F.lit(config), F.array_join(F.array_sort(F.collect_list("fingerprint")), ""))
    return rows.groupBy(by).agg(F.sha2(joined, 256).alias("signature"))


def changes(now: DataFrame, before: DataFrame, by: str = "path") -> DataFrame:
    """Which subtrees can be restored (same signature) and which must be built."""
    old = before.select(by, F.col("signature").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("signature"), "restore").otherwise("rebuild")
    return now.join(old, by, "left").select(by, state.alias("state"))


def restorable(now: DataFrame, before: DataFrame, sizes: DataFrame, budget: DataFrame, by: str = "path") -> DataFrame:
    """changes() with the size of each subtree, sizes(by, features): one above the budget (one row) is not restored, even if nothing changed."""
    judged = changes(now, before, by).join(sizes, by).join(F.broadcast(budget.select("budget")))
    over = (F.col("state") == "restore") & (F.col("features") > F.col("budget"))
    return judged.withColumn("state", F.when(over, "over_budget").otherwise(F.col("state"))).drop("budget")


def sentinel(values: DataFrame, column: str) -> DataFrame:
    """The integer that stands for null: counting up from -2**53, the first that no row has. One row."""
    base = -(1 << 53)
    taken = values.where(F.col(column) >= base).select(F.col(column).cast("long").alias("v")).distinct()
    free = taken.select((F.col("v") + 1).alias("v")).union(taken.sparkSession.range(1).select(F.lit(base).alias("v"))).join(taken, "v", "left_anti")
    return free.agg(F.min("v").alias("no_data"))


def index_order(members: DataFrame, name: str = "name") -> DataFrame:
    """MD5 of each member's name with the two little-endian halves that order an archive's index."""
    md5 = F.md5(F.col(name))

    def half(start: int) -> Column:
        return F.concat(*(F.substring("md5", start + 2 * k, 2) for k in range(7, -1, -1)))

    return members.select(F.col(name), md5.alias("md5")).withColumn("low", half(1)).withColumn("high", half(17))
