"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are reduced to the distinct ones first, so that exact copies cost one row.
The index has one, or a few, layouts of the bits: with at most `distance` differing bits, of
`distance + m` blocks m stay intact, and each choice of m blocks, laid first, is a layout. m is
the least that gives the leading bits which part the table into groups of about GROUP; a small
table is one group of one layout. Fingerprints of a group stand in Gray order, cut in pieces
of at most PIECE. Over the runs of a piece stand nodes, up to its root, which hold the bits
on which all their members agree; a query carries the differences counted so far down the tree
and leaves a node with its whole group once they exceed the distance.

The pieces of a larger group are nodes of one more level: their masks and patterns are a stored
table, and a query goes only to those pieces of its group that its differences don't rule out.

Links are merged inside a piece, so that a group of g yields g - 1 edges at most, and one edge
goes from a query to each merged class of another piece. Edges are joined into components by
alternating star contraction on stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, as_bytes, drop_dir, lean, materialize, partition_id, rows_of, shared_dir

SEED, WORDS, DISTANCE = 42, 3, 2
LEAF, FANOUT, QUERIES = 16, 8, 1024
#: Fingerprints of a group that the leading bits aim at, and at most in a piece.
GROUP, PIECE = 4096, 65_536


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles of the lower-cased text; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(w) - n :] - 1).tolist()
    digest = xxhash.xxh64_digest
    h = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)])
    bits = np.unpackbits(np.frombuffer(h, np.uint8).reshape(n, 8), axis=1)
    count = np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp): version is a hash of the text, fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for _, t in rows_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp, pa.int64())], names=["doc_id", "version", "fp"])

    return as_bytes(docs).withColumn("version", F.xxhash64("text")).mapInArrow(lean(run), "doc_id long, version long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def layouts(distance: int, bits: int) -> list[list[tuple[int, int]]]:
    """Orders of the blocks (shift, width) of the 64 bits, such that of two words within the distance one order keeps the first `bits` bits intact."""
    if not bits:
        return [[(0, 64)]]
    widths = {m: m * (64 // (distance + m)) for m in range(1, 64 - distance)}
    m = min((m for m in widths if widths[m] >= bits), default=max(widths, key=widths.get))
    n = distance + m
    cuts = [round(64 * k / n) for k in range(n + 1)]
    blocks = [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(n)]
    return [[blocks[k] for k in kept] + [blocks[k] for k in range(n) if k not in kept] for kept in combinations(range(n), m)]


def group_bits(n: int, distance: int) -> int:
    """Leading bits that part n fingerprints into groups of about GROUP, as far as intact blocks have them."""
    most = max(m * (64 // (distance + m)) for m in range(1, 64 - distance))
    return min(most, max(0, ceil(log2(max(1, n / GROUP)))))


def laid_out(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(fp)
    for shift, width in order:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Tree:
    """Nodes over runs of code words in Gray order. mask: the bits all members share; pattern: their values."""

    def __init__(self, words: np.ndarray):
        self.words, self.levels = words, []
        self.met = self.cut = 0  # members that queries stood before, and those left with their group
        every, some = words, words
        size = LEAF
        while True:
            at = np.arange(0, len(every), size)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            self.levels.append((~(every ^ some), every))
            if len(at) == 1:
                break
            size = FANOUT

    def near(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all pairs within the distance."""
        mask, pattern = self.levels[-1]
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        known = np.broadcast_to(mask[0], len(queries))
        found = _ones((queries ^ pattern[0]) & mask[0]).astype(np.int64)
        keep = found <= distance
        q, node, known, found = q[keep], node[keep], known[keep], found[keep]
        for mask, pattern in reversed(self.levels[:-1]):
            q, known, found = (np.repeat(x, FANOUT) for x in (q, known, found))
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            keep = node < len(mask)
            q, node, known, found = q[keep], node[keep], known[keep], found[keep]
            found = found + _ones((queries[q] ^ pattern[node]) & mask[node] & ~known)
            known = mask[node]
            keep = found <= distance
            q, node, known, found = q[keep], node[keep], known[keep], found[keep]
        q = np.repeat(q, LEAF)
        member = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        keep = member < len(self.words)
        q, member = q[keep], member[keep]
        self.met += len(queries) * len(self.words)
        self.cut += len(queries) * len(self.words) - len(q)
        keep = _ones(queries[q] ^ self.words[member]) <= distance
        return q[keep], member[keep]


def merged(words: np.ndarray, distance: int) -> np.ndarray:
    """For code words in Gray order, the index of the first word of each one's component."""
    root = np.arange(len(words))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = Tree(words)
    for start in range(0, len(words), QUERIES):
        q, member = tree.near(words[start : start + QUERIES], distance)
        q = q + start
        keep = member < q
        for i, j in zip(q[keep].tolist(), member[keep].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(words))], np.int64)


def nearest(words: np.ndarray, distance: int) -> np.ndarray:
    """For code words in Gray order, the index of the closest earlier word within the distance, else the own one."""
    out, tree = np.arange(len(words)), Tree(words)
    for start in range(0, len(words), QUERIES):
        q, member = tree.near(words[start : start + QUERIES], distance)
        q = q + start
        q, member = q[member < q], member[member < q]
        order = np.lexsort((_ones(words[q] ^ words[member]), q))
        q, at = np.unique(q[order], return_index=True)
        out[q] = member[order][at]
    return out


def _columns(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of one value of the first column after the other, as arrays of at most `most` rows."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _columns(batch, *names)
        cuts = np.flatnonzero(np.concatenate([[True], new[0][1:] != new[0][:-1], [True]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and held[-1][0][-1] != new[0][i]:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
            while most and n + j - i >= most:
                held.append(tuple(x[i : i + most - n] for x in new))
                i += most - n
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
            if i < j:
                held.append(tuple(x[i:j] for x in new))
                n += j - i
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def links(distinct: DataFrame, distance: int, uri: str, closest: bool = False) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that join exactly the components of the graph of all links.

    With closest, pairs within the distance instead: each fingerprint with its closest earlier one in every layout and piece.
    """
    bits = group_bits(distinct.count(), distance)
    plans = layouts(distance, bits)
    within = nearest if closest else merged

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, order in enumerate(plans):
                w = laid_out(fp, order)
                group = (w >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(w), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k << 50 | group), pa.array(gray_rank(w).view(np.int64)), pa.array(w.view(np.int64)), pa.array(fp.view(np.int64))], names=["node", "rank", "word", "fp"]
                )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = partition_id()
        for k, (node, word, fp) in enumerate(_runs(batches, ("node", "word", "fp"), PIECE)):
            root = fp[within(word.view(np.uint64), distance)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(node), part << 32 | k)), pa.array(word), pa.array(fp), pa.array(root)], names=["node", "piece", "word", "fp", "root"])

    nodes = distinct.select("fp").mapInArrow(spread, "node long, rank long, word long, fp long")
    hot = materialize(nodes.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > PIECE).select("node"), f"{uri}/index-hot")
    shape = "node long, piece long, word long, fp long, root long"

    def edges_in(placed: DataFrame) -> DataFrame:
        return placed.where("root <> fp").select(F.col("fp").alias("a"), F.col("root").alias("b"))

    if hot.isEmpty():
        return edges_in(nodes.repartition("node").sortWithinPartitions("node", "rank").mapInArrow(lean(place), shape))

    # a group too large for a piece is dealt out by ranges of its Gray order
    whole = nodes.join(hot, "node", "left_anti").repartition("node").sortWithinPartitions("node", "rank").mapInArrow(lean(place), shape)
    ranges = nodes.join(hot, "node", "left_semi").repartitionByRange("node", "rank").sortWithinPartitions("node", "rank")
    placed = materialize(ranges.mapInArrow(lean(place), shape), f"{uri}/index")
    own = edges_in(whole).unionByName(edges_in(placed))
    top = placed.groupBy("node", "piece").agg(F.expr("bit_and(word)").alias("every"), F.expr("bit_or(word)").alias("some"))
    top = materialize(top, f"{uri}/index-top")

    near = F.expr("bit_count((word ^ every) & ~(every ^ some))") <= distance
    there = top.select(F.col("node").alias("n2"), F.col("piece").alias("p2"), "every", "some")
    asks = placed.join(there, (F.col("node") == F.col("n2")) & (F.col("p2") > F.col("piece")) & near).select(F.col("p2").alias("piece"), F.lit(1).alias("asks"), "word", "fp", "root")
    members = placed.join(top.select("piece"), "piece", "left_semi").select("piece", F.lit(0).alias("asks"), "word", "fp", "root")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a piece come first and become a tree; its queries stream past it."""
        at, held, tree = None, [], None
        for batch in batches:
            piece, asks, word, fp, root = _columns(batch, "piece", "asks", "word", "fp", "root")
            for p in np.unique(piece).tolist():
                i, j = np.searchsorted(piece, p), np.searchsorted(piece, p, "right")
                if p != at:
                    at, held, tree = p, [], None
                k = i + np.searchsorted(asks[i:j], 1)
                if k > i:
                    held.append((word[i:k], fp[i:k], root[i:k]))
                if k == j:
                    continue
                if tree is None:
                    w, names, roots = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(gray_rank(w.view(np.uint64)))
                    tree, names, roots = Tree(w.view(np.uint64)[order]), names[order], roots[order]
                for s in range(k, j, QUERIES):
                    e = min(j, s + QUERIES)
                    q, member = tree.near(word[s:e].view(np.uint64), distance)
                    apart = _ones(word[s:e].view(np.uint64)[q] ^ tree.words[member])
                    group = q if closest else np.unique(roots[member], return_inverse=True)[1].reshape(-1) + q * (len(roots) + 1)
                    order = np.lexsort((apart, group))
                    first = order[np.unique(group[order], return_index=True)[1]]
                    if len(first):
                        yield pa.RecordBatch.from_arrays([pa.array(fp[s:e][q[first]]), pa.array(names[member[first]])], names=["a", "b"])

    both = members.unionByName(asks).repartition("piece").sortWithinPartitions("piece", "asks")
    return own.unionByName(both.mapInArrow(lean(search), "a long, b long"))


def components(edges: DataFrame, uri: str) -> DataFrame:
    """(v, root) for each node of edges(a, b); root is the component's smallest node. Each round is a stored table."""
    spark = edges.sparkSession

    def toward_min(e: DataFrame) -> DataFrame:
        """e(u, v): each v above u points to the smallest among u and its neighbours."""
        least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return e.join(least, "u")

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, f"{uri}/stars-0")
    mark, k = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = toward_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_in = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        t = toward_min(small_in)
        small = t.select(F.col("v").alias("u"), F.col("m").alias("v")).union(t.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        k += 1
        new = materialize(small, f"{uri}/stars-{k}")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if k > 1:
            drop_dir(spark, f"{uri}/stars-{k - 2}")
        if now == mark:
            return new.select(F.col("u").alias("v"), F.col("v").alias("root"))
        e, mark = new, now


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, version, fp, component_id, root) of each row of docs(doc_id, text); version and root are a hash of the text and the component's smallest fingerprint.

    component_id is the smallest id that links reach, the row's own included. Null and empty
    texts have fingerprint zero and are linked like any other. Rows with a null id are kept and
    take part in links; a component of null ids alone has a null component_id. Repeated rows
    are kept. An empty table gives no rows. A very long text is read whole by one task. Other
    columns, of whatever names, are ignored.
    """
    uri = shared_dir(docs.sparkSession, "simhash")
    all_fp = materialize(fingerprints(docs), f"{uri}/fingerprints")
    distinct = materialize(all_fp.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{uri}/distinct")
    roots = components(links(distinct, distance, uri), uri)
    named = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = materialize(named.select("fp", "root").join(least, "root").select("fp", "component_id", "root"), f"{uri}/components")
    return all_fp.join(component, "fp").select("doc_id", "version", "fp", "component_id", "root")


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each root of found(doc_id, version, root): the one of the smallest id, rows of one id by a hash of their text; null ids last.

    What goes is settled on ids and hashes. If it is few rows they are broadcast, and no text moves.
    """
    uri = shared_dir(docs.sparkSession, "first")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")
    rows = found.groupBy("root", "doc_id", "version").agg(F.count("*").alias("n"))
    rows = materialize(rows, f"{uri}/rows")
    stay = rows.groupBy("root").agg(F.min(order).alias("s")).select("root", F.col("s.doc_id").alias("i"), F.col("s.version").alias("v"))
    told = rows.join(stay, "root")
    kept = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v"))
    gone = materialize(told.where(~kept).select("doc_id", "version"), f"{uri}/gone")
    often = materialize(told.where(kept & (F.col("n") > 1)).select("doc_id", "version"), f"{uri}/often")
    left = without(docs, gone)
    if often.isEmpty():
        return left
    mark = f"text version {uri}"
    once = keyed(docs, often, "left_semi").withColumn(mark, text_version(F.col("text"))).dropDuplicates(["doc_id", mark]).drop(mark)
    return without(left, often).unionByName(once)


def text_version(text: F.Column) -> F.Column:
    """A hash of a text; null and empty ones are alike."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def keyed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with keys(doc_id, version), whatever other columns docs has. Few keys are broadcast after they are counted."""
    keys = keys.select(F.col("doc_id").alias("key id"), F.col("version").alias("key version"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = docs["doc_id"].cast("long").eqNullSafe(keys["key id"]) & (text_version(docs["text"]) == keys["key version"])
    return docs.join(keys, same, how)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return keyed(docs, keys, "left_anti")


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: the one of the smallest id, rows of one id by a hash of their text; null ids last.

    Nulls, empty texts and empty tables are as in near_duplicates; all columns are kept as they are.
    """
    return first_of_each(docs, near_duplicates(docs, distance))
