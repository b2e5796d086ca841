"""Stupid-backoff language-model scores, computed relationally.

The model is a table of n-gram hashes of all orders with their counts over the whole corpus,
partitioned by hash. The words of texts, as hashes, are kept in blocks on shared storage. A block explodes its n-grams
and adds equal ones up; a row of the exploded table holds those of one block in one hash range,
sorted and front-coded, since a row per n-gram would take several times the input. The rows are
shuffled by range; a range sums them, which is its share of the count table, joins the
sums back to the rows, and tells each block the n-grams that other blocks have too. A block then
sums the scores of its documents. A frequent n-gram costs one entry per block that holds it, a row
is never empty, so that rows are no more than n-grams, and nothing is sent to the driver.

Word i of a document is scored with the words before it, order - 1 at most:

S(w | u v) = c(u v w) / c(u v)         if c(u v w) >= min_count,
             backoff * S(w | v)        otherwise;   S(w) = c(w) / N.

A document's score is the sum over its words of round(1e6 ln S), an exact integer in any order.
N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, as_bytes, blocks_of, lean, materialize, shared_dir

ORDER, MIN_COUNT, BACKOFF = 3, 1, 0.4
#: Bytes of text of a block, and of those whose n-grams make one hash range; most tasks over the ranges.
BLOCK_BYTES, RANGE_BYTES, MOST_TASKS = 16 << 20, 8 << 20, 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    x = (a ^ (a >> np.uint64(29))) * _MIX + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sums(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each stands there)."""
    first = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.empty(0, np.int64)
    return ascending[first], np.diff(np.append(first, len(ascending)))


def _packed(raw: bytes) -> bytes:
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], struct.unpack_from("<q", blob)[0], codec="zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """Ascending hashes as differences, by byte planes, so that the upper planes compress away."""
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return _packed(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_planes(blob: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(_unpacked(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes, with 255 standing for the next of the large ones, which follow."""
    large = counts >= 255
    return _packed(np.uint32(len(counts)).tobytes() + np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes())


def _from_small(blob: bytes) -> np.ndarray:
    blob = _unpacked(blob)
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    out = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<u8", offset=4 + n).astype(np.int64)
    return out


def write_words(uri: str, name: str, doc_ids: list, texts: list[bytes]) -> int:
    """One block: its documents' ids and numbers of words, the hashes of its distinct words, and which of them each word is. Gives the number of words."""
    known: dict[bytes, int] = {}
    which: list[int] = []
    sizes = []
    for t in texts:
        words = t.split()
        which += [known.setdefault(w, len(known)) for w in words]
        sizes.append(len(words))
    digest = xxhash.xxh64_intdigest
    names = np.array([digest(w) for w in known], "<u8")
    ids = np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8), np.array(sizes, "<i8")
    planes = np.array(which, "<u4").view(np.uint8).reshape(-1, 4).T  # words that come early are frequent: the upper planes compress away
    parts = [_packed(x.tobytes()) for x in (*ids, names, planes)]
    stream, commit = Store(uri).open_write(name)
    stream.write(struct.pack("<5q", *map(len, parts)) + b"".join(parts))
    commit()
    return len(which)


def read_words(uri: str, name: str) -> tuple[list, np.ndarray, np.ndarray]:
    """(ids, first word's index of each text and the end, hash of each word)."""
    blob = memoryview(Store(uri).read(name))
    ends = 40 + np.cumsum(struct.unpack_from("<5q", blob))
    ids, none, sizes, names, planes = (_unpacked(blob[i:j]) for i, j in zip([40, *ends[:-1].tolist()], ends.tolist(), strict=True))
    which = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    words = np.frombuffer(names, "<u8")[which].astype(np.uint64) if len(which) else np.empty(0, np.uint64)
    doc_ids = [None if n else i for i, n in zip(np.frombuffer(ids, "<i8").tolist(), none, strict=True)]
    return doc_ids, np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))]).astype(np.int64), words


def ngrams(words: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = 1 .. order: n, which words end an n-gram within their text, and the hashes of these n-grams."""
    place = np.arange(len(words), dtype=np.int32) - np.repeat(starts[:-1], np.diff(starts)).astype(np.int32)
    grams = words
    for n in range(1, order + 1):
        if n > 1:
            longer = np.zeros_like(words)
            longer[1:] = _pair(grams[:-1], words[1:])
            grams = longer
        here = place >= n - 1
        yield n, here, grams[here]


def counted(words: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct hashes, counts) of all n-grams."""
    every = np.concatenate([g for _, _, g in ngrams(words, starts, order)])
    every.sort()
    return _sums(every)


def _in_ranges(values: np.ndarray, n: int) -> np.ndarray:
    """Where the n equal ranges of hashes start in ascending values, and the end."""
    step = (1 << 64) // n
    return np.concatenate([[0], np.searchsorted(values, np.array([step * k for k in range(1, n)], np.uint64)), [len(values)]]).astype(np.int64)


def scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_backoff, n_once, score_micro) of each row of docs(doc_id, text), the counts being those of all of docs.

    n_backoff counts the steps back to shorter n-grams, n_once the words whose longest n-gram stands once in docs.
    A null or empty text has no words and score 0. Null and repeated ids are kept; repeated
    rows count as often as they stand there. An empty table gives no rows. A very long text is a
    block of its own. Other columns, of whatever names, are ignored.
    """
    spark = docs.sparkSession
    uri = shared_dir(spark, "lm")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks_of(batches, BLOCK_BYTES):
            # a name of its own for each attempt: only the names of finished ones are told
            block = uuid.uuid4().hex
            n_words = write_words(f"{uri}/blocks", block, ids, texts)
            yield pa.RecordBatch.from_pydict({"block": [block], "size": [sum(map(len, texts))], "n_words": [n_words]})

    blocks = materialize(as_bytes(docs).mapInArrow(lean(store), "block string, size long, n_words long"), f"{uri}/block-names")
    total, size, n_blocks = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.greatest(F.count("*"), F.lit(1))).first()
    ranges = ranges or max(1, -(-size // RANGE_BYTES))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                _, starts, words = read_words(f"{uri}/blocks", block)
                h, n = counted(words, starts, order)
                at = _in_ranges(h, ranges)
                some = np.flatnonzero(np.diff(at))
                for k in range(0, len(some), 64):
                    own = some[k : k + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own.astype(np.int32)), pa.array([block] * len(own), pa.string()),
                        pa.array([_planes(h[at[r] : at[r + 1]]) for r in own], pa.binary()), pa.array([_small(n[at[r] : at[r + 1]]) for r in own], pa.binary()),
                    ], names=["range", "block", "grams", "n"])

    def join(table: pa.Table) -> pa.Table:
        """All rows of one hash range: their sums, joined back and told to each block where they are more than its own."""
        hashes = [_from_planes(b) for b in table.column("grams").to_pylist()]
        own = [_from_small(b) for b in table.column("n").to_pylist()]
        every, counts = np.concatenate(hashes), np.concatenate(own)
        by_hash = np.argsort(every)
        _, often = _sums(every[by_hash])
        summed = np.add.reduceat(counts[by_hash], np.cumsum(often) - often)
        full = np.empty_like(counts)
        full[by_hash] = np.repeat(summed, often)
        more = full != counts
        out = []
        ends = np.cumsum([len(h) for h in hashes])
        for block, e, h in zip(table.column("block").to_pylist(), ends.tolist(), hashes, strict=True):
            i = e - len(h)
            if more[i:e].any():
                out.append((block, _packed(np.packbits(more[i:e]).tobytes()), _small(full[i:e][more[i:e]])))
        names, masks, totals = zip(*out, strict=True) if out else ((), (), ())
        r = table.column("range")[0].as_py()
        return pa.table({"block": pa.array(names, pa.string()), "range": pa.array([r] * len(out), pa.int32()), "mask": pa.array(masks, pa.binary()), "totals": pa.array(totals, pa.binary())})

    exploded = blocks.select("block").repartition(n_blocks, "block").mapInArrow(lean(explode), "range int, block string, grams binary, n binary")
    told = exploded.repartition(min(ranges, MOST_TASKS), "range").groupBy("range").applyInArrow(join, "block string, range int, mask binary, totals binary")
    marks = blocks.select("block", F.lit(None).cast("int").alias("range"), F.lit(None).cast("binary").alias("mask"), F.lit(None).cast("binary").alias("totals"))
    told = materialize(told.unionByName(marks), f"{uri}/told")

    def score(table: pa.Table) -> pa.Table:
        """All that one block is told."""
        ids, starts, words = read_words(f"{uri}/blocks", table.column("block")[0].as_py())
        h, counts = counted(words, starts, order)
        at = _in_ranges(h, ranges)
        for r, mask, totals in zip(table.column("range").to_pylist(), table.column("mask").to_pylist(), table.column("totals").to_pylist(), strict=True):
            if r is not None:
                more = np.unpackbits(np.frombuffer(_unpacked(mask), np.uint8), count=int(at[r + 1] - at[r])).view(bool)
                counts[at[r] : at[r + 1]][more] = _from_small(totals)
        s, before = np.zeros(len(words)), None
        back, longest = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for n, here, grams in ngrams(words, starts, order):
            by_hash = np.argsort(grams)
            c, own = np.zeros(len(words), np.int64), np.empty(len(grams), np.int64)
            own[by_hash] = counts[np.searchsorted(h, grams[by_hash])]
            c[here] = own
            if n == 1:
                s = c / max(1, total)
            else:
                seen = np.flatnonzero(here & (c >= min_count))
                s[here] *= backoff
                back[here] += 1
                s[seen] = c[seen] / before[seen - 1]
                back[seen] = 0
            longest[here] = own
            before = c
        out = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(starts), pa.int64())}
        for name, values in (("n_backoff", back), ("n_once", longest == 1), ("score_micro", np.rint(1e6 * np.log(s)).astype(np.int64))):
            sums = np.concatenate([[0], np.cumsum(values)])
            out[name] = pa.array(np.diff(sums[starts]), pa.int64())
        return pa.table(out)

    schema = "doc_id long, n_words long, n_backoff long, n_once long, score_micro long"
    return told.repartition(n_blocks, "block").groupBy("block").applyInArrow(score, schema)


ORACLE = """
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS word,
                  generate_subscripts(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) AS i FROM documents),
g AS (SELECT doc_id, word AS c, lag(word) OVER d AS b, lag(word, 2) OVER d AS a FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT c, count(*) AS n FROM g GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
total AS (SELECT count(*) AS n FROM g),
s AS (SELECT g.doc_id, coalesce(three.n, two.n, one.n) AS longest,
             CASE WHEN g.a IS NOT NULL THEN three.n / before2.n::DOUBLE WHEN g.b IS NOT NULL THEN two.n / before1.n::DOUBLE ELSE one.n / total.n::DOUBLE END AS s
      FROM g JOIN one ON one.c = g.c LEFT JOIN two ON two.b = g.b AND two.c = g.c LEFT JOIN three ON three.a = g.a AND three.b = g.b AND three.c = g.c
      LEFT JOIN one before1 ON before1.c = g.b LEFT JOIN two before2 ON before2.b = g.a AND before2.c = g.b, total)
SELECT d.doc_id, count(s.s)::BIGINT AS n_words, 0::BIGINT AS n_backoff, coalesce(sum((longest = 1)::INT), 0)::BIGINT AS n_once, coalesce(sum(round(1e6 * ln(s.s))), 0)::BIGINT AS score_micro
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
