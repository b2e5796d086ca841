"""Best-fit packing planned on a histogram of lengths.

1. Each document becomes one piece, or pieces of exactly `capacity` tokens after a first,
   shorter one if it is longer. Pieces get a rank within (partition, length) on the way.
2. The histogram (capacity bins at most) goes to the driver, where best-fit decreasing runs
   over counts: one step places as many pieces of a length as the tightest room takes.
   The plan is a list of runs: pieces of one length, by rank, to a run of sequences.
3. A piece's rank within its length over all partitions (prefix sums of the per-partition
   counts) finds its run by binary search. No piece ever meets another in a group, so a
   length that holds a third of all pieces is dealt like any other.

The plan is broadcast; it has at most 2 * (capacity + rooms exhausted) runs, and a length
exhausts each of at most `capacity` rooms once, so that its size depends on the capacity alone,
never on the number of documents.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, lean, materialize, partition_id, rows_of, shared_dir
from .encoding import encoder, together

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local_rank long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts. Rows: length, first rank, pieces, first sequence, pieces per sequence, first offset.

    Pieces first rank .. first rank + pieces - 1 of that length go, `per sequence` to each, to
    consecutive sequences from the first one, side by side from the first offset.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, sequences)]
    open_rooms: list[int] = []
    out, next_sequence = [], 0
    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        left, rank = counts[length], 0
        sizes = sorted(r for r in rooms if r >= length)
        heapq.heapify(sizes)
        while left:
            if sizes:
                room = heapq.heappop(sizes)
                runs = rooms.pop(room)
            else:
                room, runs = capacity, [(next_sequence, -(-left // (capacity // length)))]
                next_sequence += runs[0][1]
            per = room // length
            while left and runs:
                first, n = runs.pop()
                full = min(n, left // per)
                if full:
                    out.append((length, rank, full * per, first, per, capacity - room))
                    rooms.setdefault(room - per * length, []).append((first, full))
                    left, rank, first, n = left - full * per, rank + full * per, first + full, n - full
                if n and left and left < per:
                    out.append((length, rank, left, first, left, capacity - room))
                    rooms.setdefault(room - left * length, []).append((first, 1))
                    left, rank, first, n = 0, rank + left, first + 1, n - 1
                if n:
                    runs.append((first, n))
            if runs:
                rooms.setdefault(room, []).extend(runs)
        rooms.pop(0, None)
    return np.array(out, np.int64).reshape(-1, 6)


def pieces_of(docs: DataFrame, tokenizer: str, cut: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece with its rank among the pieces of its length in the same partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, cut), partition_id()
        end = np.array([end_id], "<u4")
        seen: dict[int, int] = {}
        rows = (r for batch in batches for r in rows_of(batch))
        for doc_ids, texts in together(rows):
            out: list[tuple] = []
            for doc_id, got in zip(doc_ids, enc.encode(texts), strict=True):
                ids = np.concatenate([got.astype("<u4"), end])
                start = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    out.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, rank))
                    start += n
            if out:
                kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=[c.split()[0] for c in PIECE.split(", ")],
                )

    return as_bytes(docs).mapInArrow(lean(run), PIECE)


def pack(docs: DataFrame, tokenizer: str, cut: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs(doc_id, text).

    A null or empty text is the end id alone. Null or repeated doc_ids are kept, a row each.
    An empty table gives no rows. Other columns are ignored. A very long text is read whole by
    one task and becomes as many pieces as it fills. Which of several pieces of equal
    length takes which slot depends on the partitions read; the set of slots doesn't.
    """
    spark = docs.sparkSession
    uri = shared_dir(spark, "packing")
    pieces = materialize(pieces_of(docs, tokenizer, cut, end_id, capacity), f"{uri}/pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")
    bases = materialize(bases, f"{uri}/bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        # lengths are below 2**20 here and ranks below 2**43
        keys = (runs[:, 0] << 43) | runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = runs[np.searchsorted(keys, (length << 43) | rank, "right") - 1]
            i = rank - at[:, 1]
            placed = [pa.array(at[:, 3] + i // at[:, 4]), pa.array(at[:, 5] + i % at[:, 4] * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + placed, names=[*names, "sequence_id", "offset"])

    # a row per part and length grows with the input, and so isn't broadcast
    ranked = pieces.join(bases.select("part", "length", "base").hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
