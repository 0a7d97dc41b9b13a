"""Shared helpers: staged tables, row keys, bounded slices of Arrow batches."""

from __future__ import annotations

import pickle

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table

SLICE_BYTES = 2 << 20  # text handled at once inside a task


def stage(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once to the shared folder (``spark.checkpoint.dir``) and
    read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{kind}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_key(text: Column) -> Column:
    """Content key of a text; null and empty texts share one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Slices of ``batch`` holding about ``limit`` bytes of ``column`` each (at
    least one row): the memory of a task follows the slice, not the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)
    pa.default_memory_pool().release_unused()


def shipped(spark: SparkSession, value):
    """``value`` broadcast by value: tasks need no install of its classes.  Read it with ``received``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    return pickle.loads(shared.value)


def carried(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): the other columns of each row as one struct, whatever their names."""
    others = [docs[f"`{c}`"].alias(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("string").alias("none")]
    return docs.select(F.struct(*others).alias("row"), docs[f"`{text_col}`"].alias("text"))


def unpacked(df: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` from (row, text)."""
    return df.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
