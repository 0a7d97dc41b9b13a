"""Streaming sources and fault-tolerant sinks.

Sinks write under the shared checkpoint folder (``spark.checkpoint.dir``) and
are idempotent per micro-batch: a retried batch overwrites its own
``_batch=<id>`` folder, so executor or driver restarts never duplicate rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..session import scratch_path
from ..sources.tables import table_path


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a file stream (schema taken from the batch reader;
    a glob because a file stream needs a directory or pattern)."""
    schema = spark.read.parquet(table_path(sf_dir, name)).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(os.path.join(sf_dir, f"{name}.parque[t]"))


def _run(writer, checkpoint: str, available_now: bool = True):
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    q.awaitTermination()
    ex = q.exception()
    if ex is not None:
        raise RuntimeError(str(ex))
    return q


def run_append(df: DataFrame, out: str | None = None, partition_by: list[str] | None = None,
               checkpoint: str | None = None) -> str:
    """Append-mode stream to a parquet folder (exactly-once file sink)."""
    spark = df.sparkSession
    out = out or scratch_path(spark, "out")
    ckpt = checkpoint or scratch_path(spark, "ckpt")
    w = df.writeStream.format("parquet").outputMode("append").option("path", out)
    if partition_by:
        w = w.partitionBy(*partition_by)
    _run(w, ckpt)
    return out


def run_upsert(df: DataFrame, out: str | None = None, checkpoint: str | None = None,
               key_cols: list[str] | None = None, compact_every: int | None = None) -> str:
    """Update-mode aggregation -> one delta folder per micro-batch (idempotent
    overwrite); ``read_upserted`` returns the latest row per key.  With
    ``key_cols`` and ``compact_every``, every n-th batch also folds all deltas
    into a snapshot so readers stop re-reading old deltas."""
    spark = df.sparkSession
    out = out or scratch_path(spark, "upsert")
    ckpt = checkpoint or scratch_path(spark, "ckpt")

    def write_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))
        if compact_every and key_cols and batch_id > 0 and batch_id % compact_every == 0:
            compact_upserts(batch.sparkSession, out, key_cols, upto=batch_id)

    _run(df.writeStream.outputMode("update").foreachBatch(write_batch), ckpt)
    return out


def _latest_snapshot(spark: SparkSession, out: str):
    try:
        m = spark.read.parquet(os.path.join(out, "_manifest"))
    except AnalysisException:
        return None
    return m.agg(F.max("snapshot_id")).first()[0]


def _upsert_rows(spark: SparkSession, out: str) -> DataFrame:
    """Newest snapshot (as batch = its id) plus the deltas written after it."""
    deltas = spark.read.option("basePath", out).parquet(os.path.join(out, "_batch=*"))
    snap = _latest_snapshot(spark, out)
    if snap is None:
        return deltas
    base = spark.read.parquet(os.path.join(out, f"_snapshot={snap}")) \
        .withColumn("_batch", F.lit(snap).cast(deltas.schema["_batch"].dataType))
    return base.unionByName(deltas.where(F.col("_batch") > snap))


def read_upserted(spark: SparkSession, out: str, key_cols: list[str]) -> DataFrame:
    """Latest version of each key (partial aggregation by key)."""
    d = _upsert_rows(spark, out)
    vals = [c for c in d.columns if c not in key_cols and c != "_batch"]
    agg = d.groupBy(*key_cols).agg(F.max_by(F.struct(*vals), F.col("_batch")).alias("_v"))
    return agg.select(*key_cols, *[F.col(f"_v.{c}").alias(c) for c in vals])


def compact_upserts(spark: SparkSession, out: str, key_cols: list[str], upto: int) -> None:
    """Write the latest row per key over batches <= ``upto`` as
    ``_snapshot=<upto>``, then record it in ``_manifest``.  The snapshot is
    complete before the manifest names it, so readers never see half of it;
    nothing is deleted, and a retry rewrites the same snapshot."""
    d = _upsert_rows(spark, out).where(F.col("_batch") <= upto)
    vals = [c for c in d.columns if c not in key_cols and c != "_batch"]
    latest = d.groupBy(*key_cols).agg(F.max_by(F.struct(*vals), F.col("_batch")).alias("_v")) \
        .select(*key_cols, *[F.col(f"_v.{c}").alias(c) for c in vals])
    latest.write.mode("overwrite").parquet(os.path.join(out, f"_snapshot={upto}"))
    spark.createDataFrame([(upto,)], "snapshot_id long").write.mode("append") \
        .parquet(os.path.join(out, "_manifest"))


def run_top_n(df: DataFrame, order_cols, n: int, out: str | None = None, checkpoint: str | None = None) -> str:
    """Keep the newest ``n`` rows seen so far (S7): each micro-batch unions its
    rows with the previous top-n (at most n rows) and writes version
    ``_batch=<id>``."""
    spark = df.sparkSession
    out = out or scratch_path(spark, "topn")
    ckpt = checkpoint or scratch_path(spark, "ckpt")

    def write_batch(batch: DataFrame, batch_id: int):
        # Micro-batch ids are consecutive and every batch writes a version, so
        # the previous state is exactly folder batch_id - 1 (at most n rows);
        # a retried batch overwrites its own folder.
        s = batch.sparkSession
        prev = None
        if batch_id > 0:
            try:
                prev = s.read.schema(batch.schema).parquet(os.path.join(out, f"_batch={batch_id - 1}"))
            except AnalysisException as e:  # the stream started later than batch 0 (fresh sink)
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        rows = batch if prev is None else prev.unionByName(batch)
        rows.orderBy(*order_cols).limit(n).write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))

    _run(df.writeStream.foreachBatch(write_batch), ckpt)
    return out


def read_latest_version(spark: SparkSession, out: str) -> DataFrame:
    d = spark.read.option("basePath", out).parquet(os.path.join(out, "_batch=*"))
    last = d.agg(F.max("_batch")).first()[0]
    return d.where(F.col("_batch") == last).drop("_batch")
