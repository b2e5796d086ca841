"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are dealt out by ranges of their id, sorted within each range, encoded, and
appended to one triple of files per range:

* ``NNNNN.ids``      token ids, unsigned 16 or 32 bit little-endian (whichever the vocabulary fits),
* ``NNNNN.offsets``  n_docs + 1 unsigned 64-bit token offsets from the start of this file,
* ``NNNNN.docs``     n_docs signed 64-bit document ids.

A part's base (tokens and documents in all parts before it) comes from prefix sums over
the parts' totals: one row per part reaches the driver, no document does. Files appear
whole or not at all, so that a part can be written again when its executor is lost.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, as_bytes, partition_id, rows_of, shared_dir
from .encoding import encoder, together


@dataclass(frozen=True)
class Part:
    part: int
    n_docs: int
    n_null_ids: int
    n_tokens: int
    doc_base: int = 0
    token_base: int = 0


def write_token_files(docs: DataFrame, tokenizer: str, cut: str, end_id: int, uri: str | None = None) -> str:
    """Encode every text of docs(doc_id, text) and write the files; gives their folder.

    Order: ascending doc_id, null ids first, rows with equal ids by their text. A null or
    empty text gives the end id alone. Repeated rows are kept. An empty table gives a
    manifest without parts. Other columns are ignored. A very long text is encoded whole by one task.
    """
    spark = docs.sparkSession
    uri = uri or shared_dir(spark, "token-ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, store, part = encoder(tokenizer, cut), Store(uri), partition_id()
        end = np.array([end_id], enc.dtype).tobytes()
        offsets, ids, total, nulls = [0], [], 0, 0
        stream = None
        rows = (r for batch in batches for r in rows_of(batch))
        for doc_ids, texts in together(rows):
            if stream is None:
                stream, commit = store.open_write(f"{part:05d}.ids")
            for doc_id, got in zip(doc_ids, enc.encode(texts), strict=True):
                stream.write(got.tobytes())
                stream.write(end)
                total += len(got) + 1
                offsets.append(total)
                ids.append(doc_id or 0)
                nulls += doc_id is None
        if stream is None:
            return
        commit()
        for suffix, values, dtype in (("offsets", offsets, "<u8"), ("docs", ids, "<i8")):
            stream, commit = store.open_write(f"{part:05d}.{suffix}")
            stream.write(np.array(values, dtype).tobytes())
            commit()
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(ids)], "n_null_ids": [nulls], "n_tokens": [total]})

    ordered = (
        as_bytes(docs)
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
        .select("doc_id", "text")
    )
    rows = ordered.mapInArrow(write, "part long, n_docs long, n_null_ids long, n_tokens long").collect()
    parts, doc_base, token_base = [], 0, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        parts.append(Part(r["part"], r["n_docs"], r["n_null_ids"], r["n_tokens"], doc_base, token_base))
        doc_base, token_base = doc_base + r["n_docs"], token_base + r["n_tokens"]
    stream, commit = Store(uri).open_write("manifest.json")
    stream.write(json.dumps({"dtype": encoder(tokenizer, cut).dtype, "end_id": end_id, "parts": [asdict(p) for p in parts]}).encode())
    commit()
    return uri


def read_manifest(uri: str) -> tuple[str, list[Part]]:
    found = json.loads(Store(uri).read("manifest.json"))
    return found["dtype"], [Part(**p) for p in found["parts"]]


def read_token_files(spark: SparkSession, uri: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the memory-mapped files, one task per part."""
    dtype, parts = read_manifest(uri)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(uri)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p = parts[k]
                ids = store.memmap(f"{p.part:05d}.ids", dtype)
                offsets = np.asarray(store.memmap(f"{p.part:05d}.offsets", "<u8")).astype(np.int64)
                names = np.asarray(store.memmap(f"{p.part:05d}.docs", "<i8"))
                for i in range(0, p.n_docs, 4096):
                    j = min(i + 4096, p.n_docs)
                    own = [np.asarray(ids[offsets[n] : offsets[n + 1]]) for n in range(i, j)]
                    mask = np.arange(i, j) < p.n_null_ids
                    out = {
                        "doc_id": pa.array(names[i:j], pa.int64(), mask=mask),
                        "start": pa.array(offsets[i:j] + p.token_base, pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[i : j + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    n = max(1, len(parts))
    return spark.range(0, len(parts), 1, n).mapInArrow(read, schema)
