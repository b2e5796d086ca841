"""Streams: bounded ingestion of point files and incremental rebuilds of tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.features import changes, signatures


def chunked(spark: SparkSession, path: str, schema: StructType | str, files: int = 16) -> DataFrame:
    """A stream of Parquet files, at most `files` of them a batch: memory follows the batch, not the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def state(spark: SparkSession, uri: str, before: int | None = None) -> DataFrame | None:
    """(path, signature) of the newest state, or of the newest before a batch; None where there is none."""
    found = [b for b in _batches(spark, uri) if before is None or b < before]
    return spark.read.parquet(f"{uri}/batch={max(found)}") if found else None


def _batches(spark: SparkSession, uri: str) -> list[int]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(uri)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    complete = [s.getPath() for s in system.listStatus(root) if system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return [int(p.getName().removeprefix("batch=")) for p in complete]


def rebuild(now: DataFrame, uri: str, batch: int, build: Callable[[DataFrame], None], config: str = "") -> DataFrame:
    """Hand the rows of new and changed tiles to `build`, store the new state, and return what happened: (path, state).

    now(path, fingerprint, ...) holds all rows of every tile it mentions; other tiles keep their signature.
    A batch reads the state before its own number and overwrites its own, so that a repeat gives the same.
    """
    spark = now.sparkSession
    signed = signatures(now, config)
    old = state(spark, uri, batch)
    if old is None:
        old = spark.createDataFrame([], signed.schema)
    decided = changes(signed, old)
    build(now.join(decided.where("state <> 'restore'").select("path"), "path", "left_semi"))
    kept = old.join(signed.select("path"), "path", "left_anti")
    signed.unionByName(kept).write.mode("overwrite").parquet(f"{uri}/batch={batch}")
    return decided


def incremental(stream: DataFrame, uri: str, checkpoint: str, build: Callable[[DataFrame, int], None], config: str = "") -> StreamingQuery:
    """rebuild() of each batch of a stream of (path, fingerprint, ...); build gets the rows and the batch's number and must be idempotent in it."""

    def each(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            rebuild(rows, uri, batch, lambda changed: build(changed, batch), config)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_lines(progress: DataFrame) -> DataFrame:
    """Run events (kind, message, done, total) as lines of JSON; null fields stay out."""
    return progress.select(F.to_json(F.struct("kind", "message", "done", "total")).alias("value"))
