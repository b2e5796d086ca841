"""Benchmark decontamination: size-partitioned MinHash containment search, in SQL functions only.

An item of m distinct shingles is contained at threshold t if ceil(t m) of them are in the
document, so that any floor(m - ceil(t m)) + 1 of them include a hit. Those with the smallest
hashes, the item's bottom-k MinHash sketch, are looked up in the hashes of each document's
shingles. k depends on m: items are partitioned by size, in classes of powers of two, and a
document smaller than a class's least requirement is not searched for it. The search loses
nothing; its candidates are then verified by counting the shingles themselves.

Items of fewer words than a shingle are one shingle of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, shared_dir

WORDS, THRESHOLD = 5, 0.8
_NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _NOT_WORD), lambda w: w != "")


def shingle_hashes(words: str, n: int) -> Column:
    """64-bit hashes of all runs of n words, in order, repeats included; none for shorter texts."""
    at = F.col(words)
    one = lambda i: F.xxhash64(*(F.get(at, i + k) for k in range(n)))
    starts = F.when(F.size(at) >= n, F.sequence(F.lit(0), F.size(at) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, one)


def shingles(words: str, n: int) -> Column:
    at = F.col(words)
    starts = F.when(F.size(at) >= n, F.sequence(F.lit(0), F.size(at) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(at, i + k) for k in range(n))))


def item_shingles(items: DataFrame, n: int) -> DataFrame:
    """(item_id, len, h, shingle, m): distinct shingles of each item with its size m. Items without words have none; a repeated id pools its texts."""
    w = items.select(F.col("item_id").cast("long").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0)
    per_len = []
    for k in range(1, n + 1):
        fits = F.size("words") >= n if k == n else F.size("words") == k
        per_len.append(w.where(fits).select("item_id", F.lit(k).alias("len"), F.explode(shingles("words", k)).alias("shingle")))
    every = per_len[0]
    for x in per_len[1:]:
        every = every.unionByName(x)
    every = every.distinct().withColumn("h", F.xxhash64(*(F.get(F.split("shingle", " "), k) for k in range(n))))
    every = every.withColumn("h", F.when(F.col("len") == n, F.col("h")).otherwise(_short_hash("shingle", "len", n)))
    size = every.groupBy("item_id").agg(F.count("*").alias("m"))
    return every.join(size, "item_id")


def _short_hash(shingle: str, length: str, n: int) -> Column:
    out = F.lit(None).cast("long")
    for k in range(1, n):
        out = F.when(F.col(length) == k, F.xxhash64(*(F.get(F.split(shingle, " "), i) for i in range(k)))).otherwise(out)
    return out


def needed(m: Column, threshold: float) -> Column:
    """Least number of shared shingles: ceil(t m), with room for the threshold's rounding."""
    return F.ceil(m * F.lit(threshold) - 1e-9).cast("long")


def sketches(pieces: DataFrame, threshold: float) -> DataFrame:
    """(item_id, len, h, class, least): each item's bottom-k sketch, its size class and what the class needs at least."""
    from pyspark.sql.window import Window

    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle")))
    kept = ranked.where(F.col("k") <= F.col("m") - needed(F.col("m"), threshold) + 1)
    size_class = F.floor(F.log2("m")).cast("int")
    kept = kept.withColumn("class", size_class)
    return kept.withColumn("least", needed(F.pow(F.lit(2.0), F.col("class")), threshold)).select("item_id", "len", "h", "class", "least")


def leaks_by_row(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """leaks() with the column version, a hash of the text, which tells rows of one id apart."""
    pieces = item_shingles(items, words)
    lengths = [r[0] for r in pieces.select("len").distinct().orderBy("len").collect()]  # at most `words` rows
    sketch = sketches(pieces, threshold)
    light = F.broadcast if pieces.count() <= BROADCAST_ROWS else (lambda d: d)

    key = F.xxhash64("text").alias("version")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split = base.where("text is not null").select("doc_id", key, words_of("text").alias("words"))
    found = None
    for n in lengths:
        each = split.select("doc_id", "version", F.greatest(F.size("words") - (n - 1), F.lit(0)).alias("size"), F.explode(shingle_hashes("words", n)).alias("h"))
        own = light(sketch.where(F.col("len") == n).select("item_id", "h", "least").withColumnRenamed("h", "key"))
        hit = each.join(own, (F.col("h") == F.col("key")) & (F.col("size") >= F.col("least"))).select("doc_id", "version", "item_id")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, version long, item_id long, n_shared long, n_shingles long")
    candidates = materialize(found.distinct(), f"{shared_dir(docs.sparkSession, 'decontamination')}/candidates")

    # candidate documents only, one row per text, whatever the number of items in it
    texts = candidates.select("doc_id", "version").distinct()
    few = candidates.count() <= BROADCAST_ROWS
    if few:
        texts = F.broadcast(texts)
    keyed = base.where("text is not null").select("doc_id", key, "text")
    again = keyed.join(texts.withColumnRenamed("doc_id", "d").withColumnRenamed("version", "v"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left_semi")
    again = again.dropDuplicates(["doc_id", "version"]).select("doc_id", "version", words_of("text").alias("words"))
    exact = None
    for n in lengths:
        each = again.select("doc_id", "version", F.explode(F.array_distinct(shingles("words", n))).alias("shingle"))
        own = light(pieces.where(F.col("len") == n).select("item_id", "shingle", "m"))
        got = each.join(own, "shingle").select("doc_id", "version", "item_id", "m")
        exact = got if exact is None else exact.unionByName(got)
    shared = exact.groupBy("doc_id", "version", "item_id").agg(F.count("*").alias("n_shared"), F.first("m").alias("n_shingles"))
    shared = shared.where(F.col("n_shared") >= needed(F.col("n_shingles"), threshold))
    sure = (F.col("s.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("s.version") == F.col("c.version")) & (F.col("s.item_id") == F.col("c.item_id"))
    verified = shared.alias("s").join((F.broadcast(candidates) if few else candidates).alias("c"), sure, "left_semi")
    return verified.select("doc_id", "version", "item_id", "n_shared", F.col("n_shingles").cast("long").alias("n_shingles"))


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) where docs(doc_id, text) hold at least `threshold` of the distinct shingles of items(item_id, text).

    Null and empty texts hold nothing; items without words are in nothing. Each row of docs
    is judged by itself; rows with one id give the id's best row, and null ids are told
    as null. Repeated items of one id are one item. Other columns are ignored.
    """
    found = leaks_by_row(docs, items, words, threshold)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.first("n_shingles").alias("n_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that hold none of the items.

    Null and empty texts and null ids stay; repeated rows go or stay together; an empty table on
    either side takes nothing away. Columns may have any names. Few rows that go are broadcast after they are
    counted, so that no text moves. Items of fewer words than a shingle would strike out every document that has
    those words: they are not searched for here (short_items tells them).
    """
    long_enough = items.where(F.size(words_of("text")) >= words)
    found = leaks_by_row(docs, long_enough, words, threshold).select("doc_id", "version").distinct()
    gone = materialize(found, f"{shared_dir(docs.sparkSession, 'decontaminated')}/gone")
    gone = gone.select(F.col("doc_id").alias("gone id"), F.col("version").alias("gone version"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    hit = docs["doc_id"].cast("long").eqNullSafe(gone["gone id"]) & (F.xxhash64(docs["text"]) == gone["gone version"])
    return docs.join(gone, hit, "left_anti")


def short_items(items: DataFrame, words: int = WORDS) -> DataFrame:
    """The items that decontaminated() doesn't search for: those with some words, but fewer than a shingle."""
    return items.where((F.size(words_of("text")) > 0) & (F.size(words_of("text")) < words))


ORACLE = """
WITH words_d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
words_i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words_i WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS m FROM items GROUP BY item_id),
docs AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest([array_to_string(w[i:i+n-1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS s FROM words_d, (SELECT DISTINCT least(len(w), 5) AS n FROM words_i WHERE len(w) > 0) WHERE len(w) >= n))
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, max(m)::BIGINT AS n_shingles
FROM docs JOIN items USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.8 * max(m) - 1e-9)
"""
