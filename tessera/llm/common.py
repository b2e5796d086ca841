"""Pieces shared by the training-data operators: shared storage, blocks of text, words."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and one machine does everything (tests) a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_dir(spark: SparkSession, uri: str) -> None:
    """Delete a folder of intermediate results that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, uri: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet to shared storage and return the stored table: cuts the lineage and survives lost executors."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


class Store:
    """Files below a URI, written whole or not at all, so that a task can be run again."""

    def __init__(self, uri: str):
        self.uri = uri
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.fs, self.root = None, parsed.path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def open_write(self, name: str):
        """(stream, commit): nothing appears under name until commit() has been called."""
        path = f"{self.root}/{name}"
        tmp = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            f = open(tmp, "wb", buffering=1 << 20)

            def commit() -> None:
                f.close()
                os.replace(tmp, path)
        else:
            self.fs.create_dir(self.root, recursive=True)
            f = self.fs.open_output_stream(tmp)

            def commit() -> None:
                f.close()
                self.fs.move(tmp, path)

        return f, commit

    def read(self, name: str) -> bytes:
        if self.local:
            with open(f"{self.root}/{name}", "rb") as f:
                return f.read()
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def read_at(self, name: str, at: int, size: int) -> bytes:
        if self.local:
            with open(f"{self.root}/{name}", "rb") as f:
                return os.pread(f.fileno(), size, at)
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return f.read_at(size, at)

    def memmap(self, name: str, dtype: str):
        """A read-only array over the file; memory-mapped where the store is a mounted file system."""
        import numpy as np

        if self.local:
            if not os.path.getsize(f"{self.root}/{name}"):
                return np.empty(0, dtype)
            return np.memmap(f"{self.root}/{name}", dtype=dtype, mode="r")
        return np.frombuffer(self.read(name), dtype=dtype)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of narrow tables (hashes, ids) that may be broadcast once they are counted; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bytes of rows handed to a Python worker at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """docs, with Arrow batches bounded by bytes (rows alone are no bound for long texts) where the session doesn't say so itself."""
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))
    return docs


def as_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, UTF-8 bytes of the text); a null text counts as empty. Extra columns are dropped."""
    return bounded_batches(docs).select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"),
    )


def release() -> None:
    """Give freed memory back to the system: workers live on, and hold what their largest task took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run):
    """A function for mapInArrow that releases freed memory at the end of each task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return inner


def lean_group(run):
    """A function for applyInArrow that releases freed memory after each group."""

    def inner(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return inner


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


# --- blocks: bounded pieces of a text table kept on shared storage -----------------------

BLOCK_BYTES = 12 << 20


def write_block(uri: str, name: str, ids: list, texts: list[bytes]) -> None:
    """One block as a compressed Arrow file."""
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
    stream, commit = Store(uri).open_write(name)
    with pa.ipc.new_file(stream, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table, max_chunksize=4096)
    commit()


def read_block(uri: str, name: str) -> tuple[list, list[bytes]]:
    table = pa.ipc.open_file(pa.BufferReader(Store(uri).read(name))).read_all()
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


class Packets:
    """Compressed pieces of one file on shared storage, each found by its place: a shuffle's payload that need not pass through the JVM."""

    def __init__(self, uri: str, name: str):
        self.stream, self.commit = Store(uri).open_write(name)
        self.at = 0

    def add(self, parts: list[bytes]) -> tuple[int, int]:
        """(place, size) of the packet."""
        sizes = struct.pack(f"<{len(parts)}q", *(len(p) for p in parts))
        raw = b"".join([sizes, *parts])
        packet = struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)
        self.stream.write(packet)
        at, self.at = self.at, self.at + len(packet)
        return at, len(packet)


def read_packet(uri: str, name: str, at: int, size: int, n: int) -> list[bytes]:
    """The n parts of a packet."""
    packet = Store(uri).read_at(name, at, size)
    raw = pa.decompress(memoryview(packet)[8:], struct.unpack_from("<q", packet)[0], codec="zstd", asbytes=True)
    out, here = [], 8 * n
    for k in struct.unpack_from(f"<{n}q", raw):
        out.append(raw[here : here + k])
        here += k
    return out


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Regroup the rows of a task into blocks of about limit bytes (one long text may exceed it)."""
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, t in rows_of(batch):
            if ids and held + len(t) > limit:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if ids:
        yield ids, texts
