"""Near-duplicates by SimHash and the Jaccard similarity of word shingles; every pair at or above the threshold is found.

First links come from the Gray-order index of simhash over fingerprints of the shingles: each text with
its closest ones there. Pairs that similar may lie up to 17 of 64 bits apart, which no
index by distance can search whole, so that the rest is found by prefixes of the sets.

Two sets of m and n shingles of similarity t share one of the first m - ceil(t m) + 1 and
n - ceil(t n) + 1 in any order that holds for all sets, and more than one where the sizes are close
(`least_shared`). Here shingles that are common in a sample of the texts come last, so that passages
held by many texts join few of them; the sample bears on speed only.

Texts that share such a shingle are compared by size and by parity bitmaps of 1024 bits, whose
difference is never more than that of the sets. Pairs are counted over the shingles they
share, and those that share enough are verified on the sets. At first each text goes with its nearest
one of a shingle, and only pairs of different components are searched in full after that, so
that a group of near copies doesn't cost all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, as_bytes, lean, materialize, rows_of, shared_dir
from .simhash import components, first_of_each, links

SEED, WORDS, SIMILARITY = 42, 5, 0.8
#: Texts whose shingles tell the common ones, and in how many of these a common one is.
SAMPLE_TEXTS, COMMON = 4000, 8
BITS, CELLS = 1024, 1 << 20
#: Differing bits at which the index gives first links, and the share of `least_shared` that makes a first link.
DISTANCE, FIRST_SHARE = 3, 0.25
_ROUNDING = 1e-9


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Ascending distinct XXH64 of the word shingles of the lower-cased text; a shorter text is one shingle."""
    w = text.lower().split()
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(w) - n :] - 1).tolist() if w else [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64))


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles one of which a similar set shares, common ones last."""
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - _ROUNDING)) + 1
    late = np.isin(hashes, common)
    return np.concatenate([hashes[~late], hashes[late]])[:n]


def least_shared(m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles of their prefixes two similar sets of m and n shingles share at least.

    They share a = ceil(t (m + n) / (1 + t)). Of the prefix that ends first in the order, what is
    shared lies in the other one too, so that at most ceil(t max(m, n)) - 1 are shared beyond it.
    """
    most = np.maximum(m, n)
    need = np.ceil(similarity / (1 + similarity) * (m + n) - _ROUNDING) - np.ceil(similarity * most - _ROUNDING) + 1
    return np.maximum(need, 1).astype(np.int64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * np.add.reduce(bits, axis=0, dtype=np.int32) > len(hashes)).tobytes(), "little")


def bitmap(hashes: np.ndarray) -> bytes:
    odd = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def pairs_within(n: np.ndarray, bits: np.ndarray, root: np.ndarray, similarity: float, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different roots that may be similar; with nearest, for each member the one with the least difference alone."""
    order = np.argsort(n, kind="stable")
    n, bits, root = n[order], bits[order], root[order]
    share = (1 - similarity) / (1 + similarity)
    a, b, start = [], [], 0
    while start < len(n):
        lo = int(np.searchsorted(n, np.ceil(similarity * n[start] - _ROUNDING))) if nearest else start
        rows = max(1, CELLS // (len(n) - lo))
        stop = min(len(n), start + rows)
        hi = int(np.searchsorted(n, n[stop - 1] / similarity + _ROUNDING, "right"))
        i, j = np.arange(start, stop), np.arange(lo, hi)
        apart = np.zeros((len(i), len(j)), np.int32)
        for k in range(bits.shape[1]):
            apart += np.bitwise_count(bits[i, k][:, None] ^ bits[None, lo:hi, k])
        may = (apart <= share * (n[i][:, None] + n[None, lo:hi]) + _ROUNDING) & (root[i][:, None] != root[None, lo:hi])
        may &= np.minimum(n[i][:, None], n[None, lo:hi]) >= similarity * np.maximum(n[i][:, None], n[None, lo:hi]) - _ROUNDING
        if nearest:
            at = np.where(may, apart, BITS + 1).argmin(axis=1)
            some = may[np.arange(len(i)), at]
            a.append(i[some])
            b.append(j[at[some]])
        else:
            p, q = np.nonzero(may & (i[:, None] < j[None, :]))
            a.append(i[p])
            b.append(j[q])
        start = stop
    return order[np.concatenate(a)], order[np.concatenate(b)]


def candidates(members: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Distinct (a, b), a < b, of members(shingle, v, n, bits, root) that share enough of their prefixes to be similar.

    With nearest, those that share FIRST_SHARE of that in shingles where one is the nearest of the other.
    """
    share = FIRST_SHARE if nearest else 1.0

    def close(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        shingle, v, n, bits, root = (np.concatenate(x) for x in zip(*held, strict=True))
        cuts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1], [True]]))
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        m, k = n[two], n[two + 1]
        apart = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int64)
        may = (root[two] != root[two + 1]) & (np.minimum(m, k) >= similarity * np.maximum(m, k) - _ROUNDING)
        two = two[may & (apart <= (1 - similarity) / (1 + similarity) * (m + k) + _ROUNDING)]
        a, b, need = [v[two]], [v[two + 1]], [least_shared(n[two], n[two + 1], similarity)]
        for g in np.flatnonzero(sizes > 2).tolist():
            lo, hi = cuts[g], cuts[g + 1]
            if (root[lo:hi] == root[lo]).all():
                continue
            p, q = pairs_within(n[lo:hi], bits[lo:hi], root[lo:hi], similarity, nearest)
            if nearest:  # a pair once, though each may be the other's nearest
                p, q = np.unique(np.sort(np.stack([p, q], axis=1), axis=1), axis=0).T
            a.append(v[lo + p])
            b.append(v[lo + q])
            need.append(least_shared(n[lo + p], n[lo + q], similarity))
        a, b, need = np.concatenate(a), np.concatenate(b), np.concatenate(need)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], names=["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, v, n, root = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shingle", "v", "n", "root"))
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(v), -1)
            new = (shingle, v, n, bits, root)
            if held and shingle[0] != held[-1][0][-1]:
                yield from close(held)
                held.clear()
            # whole groups but the last go at once
            last = int(np.searchsorted(shingle, shingle[-1]))
            if last:
                held.append(tuple(x[:last] for x in new))
                yield from close(held)
                held.clear()
            held.append(tuple(x[last:] for x in new))
        if held:
            yield from close(held)

    grouped = members.select("shingle", "v", "n", "bits", "root").repartition("shingle").sortWithinPartitions("shingle")
    counted = grouped.mapInArrow(lean(run), "a long, b long, need long").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    return counted.where(F.col("n") >= F.col("need") * share).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, version, root) of each row of docs(doc_id, text): version is a hash of the text, root one of its component of similar texts.

    Null and empty texts are alike. Rows with a null id take part; repeated rows are kept; an empty table gives
    no rows. A very long text is read whole by one task. Other columns, of whatever names, are ignored.
    """
    uri = shared_dir(docs.sparkSession, "similarity")
    texts = as_bytes(docs).withColumn("version", F.xxhash64("text"))
    ids = materialize(texts.select("doc_id", "version"), f"{uri}/ids")
    n_texts = ids.agg(F.count_distinct("version")).first()[0]
    every = max(1, n_texts // SAMPLE_TEXTS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for _, t in rows_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["v", "hashes"])

    def sets_of(some: DataFrame) -> DataFrame:
        return some.select("version", "text").dropDuplicates(["version"]).mapInArrow(lean(hashed), "v long, hashes array<long>")

    sample = sets_of(texts.where(F.pmod(F.xxhash64("version"), F.lit(every)) == 0)).select(F.explode("hashes").alias("h"))
    often = [r[0] for r in sample.groupBy("h").count().where(F.col("count") >= COMMON).select("h").collect()]
    common = np.sort(np.array(often, np.int64).view(np.uint64))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for _, t in rows_of(batch)]
            n = pa.array([len(s) for s in sets], pa.int64())
            fp = pa.array(np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64))
            first = pa.array([prefix(s, common, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, fp, pa.array([bitmap(s) for s in sets], pa.binary()), first], names=["v", "n", "fp", "bits", "first"])

    # a text that stands there more than once is described once: no text but repeated ones' moves
    known = materialize(_distinct_texts(texts, ids, uri).mapInArrow(lean(described), "v long, n long, fp long, bits binary, first array<long>"), f"{uri}/texts")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are similar, by their whole sets."""
        pairs = materialize(pairs, f"{uri}/{name}-pairs")
        asked = pairs.select(F.col("a").alias("version")).union(pairs.select("b")).distinct()
        asked = materialize(asked, f"{uri}/{name}-asked")
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
        sets = materialize(sets_of(texts.join(asked, "version", "left_semi")), f"{uri}/{name}-sets")
        both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
        inter = F.size(F.array_intersect("ha", "hb"))
        return materialize(both.where(inter * (1 + similarity) >= similarity * (F.size("ha") + F.size("hb")) - _ROUNDING).select("a", "b"), f"{uri}/{name}-links")

    # links of the index, between the first texts of their fingerprints, and from each text to the first one of its own
    least = materialize(known.groupBy("fp").agg(F.min("v").alias("least")), f"{uri}/distinct")
    index = links(least, distance, f"{uri}/gray", closest=True)
    pairs = index.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select("x", "y")
    pairs = pairs.unionByName(known.join(least, "fp").where("v <> least").select(F.col("v").alias("x"), F.col("least").alias("y")))
    close = similar(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "index")

    by_shingle = Window.partitionBy("shingle").orderBy("v")
    shared = known.select("v", F.explode("first").alias("shingle")).withColumn("before", F.lag("v").over(by_shingle)).withColumn("after", F.lead("v").over(by_shingle))
    shared = shared.where("before is not null or after is not null").select("shingle", "v")
    members = materialize(shared.join(known.select("v", "n", "bits"), "v"), f"{uri}/members")

    def rooted(edges: DataFrame, name: str) -> DataFrame:
        roots = components(edges, f"{uri}/{name}").withColumnRenamed("root", "r")
        return members.join(roots, "v", "left").withColumn("root", F.coalesce("r", "v"))

    near = close.unionByName(similar(candidates(rooted(close, "close"), similarity, True), "near"))
    every_link = near.unionByName(similar(candidates(rooted(near, "near"), similarity, False), "rest"))
    final = components(every_link, f"{uri}/all")
    return ids.join(final.withColumnRenamed("v", "version"), "version", "left").select("doc_id", "version", F.coalesce("root", "version").alias("root"))


def _distinct_texts(texts: DataFrame, ids: DataFrame, uri: str) -> DataFrame:
    """(version, text), each version once; only texts of versions that repeat are shuffled, if these are few enough to be told by a broadcast."""
    twice = materialize(ids.groupBy("version").agg(F.count("*").alias("n")).where("n > 1").select("version"), f"{uri}/twice")
    if twice.count() > BROADCAST_ROWS:
        return texts.select("version", "text").dropDuplicates(["version"])
    twice = F.broadcast(twice)
    once = texts.join(twice, "version", "left_anti").select("version", "text")
    return once.unionByName(texts.join(twice, "version", "left_semi").select("version", "text").dropDuplicates(["version"]))


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component: the one of the smallest id, as simhash.deduplicated."""
    return first_of_each(docs, near_duplicates(docs, words, similarity))
