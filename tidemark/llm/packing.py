"""Packing by power-of-two decomposition: each document is cut into pieces whose lengths are powers of two.

A document of n ids gives n // 1024 pieces of 1024 ids and one piece for each binary digit of the rest, longest
first. Pieces of one length form one bucket, and each piece is a sequence of its own: no sequence crosses
documents, and none needs padding.

Defined cases: a null or empty text has only the end id, one piece of length 1. Very long texts are encoded whole.
Pieces of one length are numbered in the order of their partition and row. Repeated rows, equal doc_ids
included, are packed one by one. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import materialize, partition_id, partition_offsets, read_documents, sized_join, small_batches, texts
from .tokens import default_tokenizer, encoder, ragged

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, part int, nth long"


def decompose(n_tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The owner, start and length of each piece; longest is a power of two."""
    bits = longest.bit_length() - 1
    full = n_tokens // longest
    digits = (n_tokens[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    counts = full + digits.sum(axis=1)
    owner = np.repeat(np.arange(len(n_tokens)), counts)
    place = ragged(np.zeros(len(counts), dtype=np.int64), counts)
    length = np.full(len(owner), longest, dtype=np.int64)
    rest = place >= full[owner]
    row, bit = np.nonzero(digits)
    length[rest] = 1 << (bits - 1 - bit)
    ends = np.cumsum(length)
    return owner, ends - length - np.repeat(np.cumsum(n_tokens) - n_tokens, counts), length


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, longest: int = 1024) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    sequence_id counts through the buckets from the shortest length to the longest; offset is 0.
    """
    path = tokenizer or default_tokenizer()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), partition_id()
        seen = np.zeros(longest.bit_length(), dtype=np.int64)
        for batch in small_batches(batches, "text"):
            ids, n = encode.encode(batch.column("text"))
            first = np.cumsum(n + 1) - (n + 1)
            all_ids = np.full(int((n + 1).sum()), end_id, dtype="<u4")
            all_ids[ragged(first, n)] = ids
            owner, start, length = decompose(n + 1, longest)
            raw = memoryview(all_ids.tobytes())
            at = 4 * (first[owner] + start)
            crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(at.tolist(), (4 * length).tolist(), strict=True)]
            bucket = np.log2(length).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            counts = np.bincount(bucket, minlength=len(seen))
            nth = np.empty(len(order), dtype=np.int64)
            nth[order] = ragged(seen, counts)
            seen += counts
            doc_id = batch.column("doc_id").take(pa.array(owner))
            yield pa.record_batch([doc_id, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array((n + 1)[owner]), pa.array(bucket), pa.array(np.full(len(owner), part, dtype=np.int32)), pa.array(nth)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "part", "nth"])

    cut = materialize(texts(docs).mapInArrow(pieces, _PIECES), "pieces")
    totals = cut.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    within = partition_offsets(totals, "part", "n", "before_part", by=["bucket"])
    below = partition_offsets(totals.groupBy("bucket").agg(F.sum("n").alias("n")), "bucket", "n", "before_bucket")
    base = within.join(below, "bucket").select("bucket", "part", (F.col("before_part") + F.col("before_bucket")).alias("base"))
    return sized_join(cut, base, ["bucket", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket")


def op10_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir))
