"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import new_table


#: Spark's own switch for dropping a query's shuffle files when the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and fixes row placement.

    The shuffle files of the job are of no use after it and go at once.
    """
    spark = df.sparkSession
    path, before = new_table(spark, name), spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize has written, without a job; nothing may read them afterwards."""
    shared.discard(*tables)


#: Bytes of the Arrow batches that tasks exchange with their Python workers.
BATCH = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session sends Arrow batches of bounded size from now on: a task's memory follows them, in the executor and in its worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty); other columns, whatever their names, are left out."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of a string column, so that a task's memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        first = 0
        while first < len(values):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def partition_offsets(totals: DataFrame, part: str, size: str, out: str, by: list[str] | None = None) -> DataFrame:
    """The sum of `size` over smaller parts. totals has one row for each part (and value of `by`), so it is as small as the list of partitions."""
    from pyspark.sql import Window

    window = Window.partitionBy(*(by or [])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(size).over(window), F.lit(0)).cast("long")).drop(size)


def sized_join(rows: DataFrame, small: DataFrame, on: list[str], most: int = 1_000_000) -> DataFrame:
    """An inner join that broadcasts `small` if it has at most `most` (narrow) rows, and shuffles both sides beyond."""
    held = materialize(small, "offsets")
    return rows.join(F.broadcast(held) if held.count() <= most else held, on)


#: Bits of a filter of ids for each id, and at most.
FILTER_BITS, MOST_BITS = 12, 1 << 28


def id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of a column of ids (longs) as 64-bit words, and its number of hashes: FILTER_BITS for each id, 32 MB at most.

    More ids than that holds only let more rows through. Words are put together in Spark.
    """
    n = max(1, ids.count())
    size = min(MOST_BITS, max(1 << 16, 1 << (FILTER_BITS * n - 1).bit_length()))
    hashes = int(np.clip(round(0.7 * size / n), 1, 4))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0), size, hashes).ravel()
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    words = ids.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out, hashes


def _places(ids: pa.Array, size: int, hashes: int) -> np.ndarray:
    """Places of each id's bits in a filter."""
    x = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (h[:, None] + np.arange(hashes, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)


def among(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose `on` is one of `ids` (a table of that column, each once). A filter of the ids leaves out nearly all other rows before both sides meet by a shuffle, at every size."""
    words, hashes = id_filter(ids)
    held = rows.sparkSession.sparkContext.broadcast(words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            at = _places(batch.column(on), len(table) << 6, hashes)
            yield batch.filter(pa.array(((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)))

    return rows.mapInArrow(keep, rows.schema).join(ids.hint("merge"), on)


def utf8_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def column_texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(name).to_pylist()
