"""Repeated byte strings by prefix-free parsing.

A rolling hash picks trigger bytes: a place is a trigger if its hash is the least of some `span` places in a row.
Between triggers lie phrases. Every string of `length` bytes has a trigger at least span - 1 bytes after its start
that depends on the string's own bytes only, so equal strings start equally far before their first such trigger.
A phrase with its look-ahead (all bytes of the strings that start in it) is a word of the dictionary; the parse
is the sequence of those words. The full method sorts the suffixes of dictionary and parse into the corpus order; only
the equality of strings of `length` bytes is asked for here, so hash grouping takes the place of both suffix arrays:

1. Words are grouped by their core, the bytes that all strings starting in the phrase contain. A core that occurs
   once has no repeated string; a core whose words are all equal has only repeated strings.
2. In other groups equal words repeat wholly, and of every distinct word one occurrence is opened into its strings,
   which are grouped by hash. Copies are never opened or paired, so the work follows the distinct words.

Words and strings are told apart by two 64-bit hashes, that of their core and their own, so two different ones are
taken for equal only if both agree.

Defined cases: null and empty texts, and texts shorter than `length`, keep all bytes. Very long texts are taken whole. Equal rows repeat each
other wholly. A text that repeats within itself counts too. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import discard, materialize, read_documents, small_batches, texts
from .tokens import column_bytes, ragged
from .words import _BYTE, _powers, mix

#: Bytes of a removed string and of a reported passage (about 50 words), and of the rolling hash.
LENGTH, PASSAGE, GRAM = 400, 300, 12


def window_span(length: int) -> int:
    """The widest power of two for which a string holds a trigger of its own, and the triggers it depends on."""
    span = 1
    while 3 * 2 * span + GRAM - 4 < length:
        span *= 2
    return span


class Hashes:
    """Hashes of any byte ranges of a buffer by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def triggers(data: np.ndarray, size: int, span: int) -> np.ndarray:
    """Trigger places in the first `size` bytes; data has some bytes more."""
    places = size - GRAM + 1
    if places < span:
        return np.zeros(0, np.int64)
    eight = np.ndarray((places,), "<u8", data, strides=(1,))
    four = np.ndarray((places,), "<u4", data, 8, strides=(1,))
    h = (eight * np.uint64(0x9E3779B97F4A7C15) + four * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
    h = ((h >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
    least, k = h, 1
    while k < span:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    edge = np.zeros(span - 1, np.uint32)
    most, k = np.concatenate([edge, least, edge]), 1
    while k < span:
        most = np.maximum(most[:-k], most[k:])
        k *= 2
    return np.flatnonzero(most == h)


def dictionary_words(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text's number, first string's start in the text, number of strings, core hash, word hash) of each phrase."""
    span, size = window_span(length), int(offsets[-1])
    p = triggers(data, size, span)
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    before = np.append(-1, p[:-1])
    owner = np.searchsorted(offsets, p, side="right") - 1
    low = np.maximum(before - span + 2, offsets[owner])
    high = np.minimum(p - span + 1, offsets[owner + 1] - length)
    ok = low <= high
    p, owner, low, high = p[ok], owner[ok], low[ok], high[ok]
    hashes = Hashes(data[:size])
    core = hashes.of(p - span + 1, p - 2 * span + 2 + length)
    with np.errstate(over="ignore"):
        word = mix(hashes.of(low, high + length) + (p - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return owner, low - offsets[owner], high - low + 1, core, word


_WORDS = "u long, start int, n int, core long, word long"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that equal rows share."""
    return texts(docs).withColumn("u", F.xxhash64("doc_id", "text"))


def _words(keyed: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            data, offsets = column_bytes(batch.column("text"))
            owner, start, n, core, word = dictionary_words(data, offsets, length)
            u = batch.column("u").to_numpy()[owner] if len(owner) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(u), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(word.view(np.int64))], names=["u", "start", "n", "core", "word"])

    return keyed.where(F.octet_length("text") >= length).select("u", "text").mapInArrow(cut, _WORDS)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """u, first, last of runs of starts whose strings occur elsewhere; u is the key of equal rows."""
    spark, keyed = docs.sparkSession, _keyed(docs)
    cores = _words(keyed, length).groupBy("core").agg(F.count("*").alias("c"), F.min("word").alias("a"), F.max("word").alias("b"))
    cores = materialize(cores.where("c > 1").select("core", (F.col("a") != F.col("b")).alias("mixed")), "cores")
    again = materialize(_words(keyed, length).join(cores, "core"), "words")
    whole = again.where("not mixed").select("u", "start", "n")
    mixed = again.where("mixed")
    distinct = materialize(mixed.groupBy("core", "word").agg(F.count("*").alias("c"), F.min(F.struct("u", "start", "n")).alias("at")), "distinct-words")
    copied = mixed.join(distinct.where("c > 1").select("core", "word"), ["core", "word"]).select("u", "start", "n")
    opened = distinct.select("at.u", F.struct("at.start", "at.n", "core", (F.col("c") == 1).alias("single")).alias("w"))
    opened = opened.groupBy("u").agg(F.collect_list("w").alias("w"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            for u, text, some in zip(batch.column("u").to_pylist(), batch.column("text").to_pylist(), batch.column("w"), strict=True):
                data = np.frombuffer(text.encode("utf-8"), np.uint8)
                w = some.values
                start, n = w.field("start").to_numpy().astype(np.int64), w.field("n").to_numpy().astype(np.int64)
                at = ragged(start, n)
                h = Hashes(data).of(at, at + length)
                core, single = np.repeat(w.field("core").to_numpy(), n), np.repeat(w.field("single").to_numpy(zero_copy_only=False), n)
                yield pa.record_batch([pa.array(np.full(len(at), u)), pa.array(at.astype(np.int32)), pa.array(core), pa.array(h.view(np.int64)), pa.array(single)], names=["u", "start", "core", "string", "single"])

    texts_once = keyed.select("u", "text")
    found = opened.join(texts_once, "u")
    strings_of = materialize(found.select("u", "text", "w").mapInArrow(strings, "u long, start int, core long, string long, single boolean"), "strings")
    # an equal row's strings appear twice at one place: counted once
    shared = strings_of.groupBy("core", "string").agg(F.min(F.struct("u", "start")).alias("a"), F.max(F.struct("u", "start")).alias("b"))
    shared = materialize(shared.where("a != b").select("core", "string"), "shared-strings")
    alone = strings_of.where("single").join(shared, ["core", "string"]).select("u", "start", F.lit(1).alias("n"))
    spans = whole.unionByName(copied).unionByName(alone)
    out = materialize(spans.select("u", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")), "repeats")
    discard(cores, again, distinct, strings_of, shared)
    return out


def merged(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered byte runs, ends exclusive."""
    order = np.argsort(first, kind="stable")
    start, end = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + length)
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats_passage.

    Only strings of `length` bytes are removed; repeats_passage also tells of shorter ones, of `passage` bytes, that
    start elsewhere too. A string that is removed has such a passage, so strings are looked for in those texts only.
    """
    marked = materialize(repeated_spans(docs, passage).select("u").distinct(), "passages")
    some = materialize(_keyed(docs).join(marked, "u").select("doc_id", "text"), "passage-texts")
    spans = repeated_spans(some, length).groupBy("u").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    discard(some)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for doc, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                data = text.encode("utf-8")
                if not runs.is_valid:
                    rows.append((doc, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                start, end = merged(runs.values.field("first").to_numpy(), runs.values.field("last").to_numpy(), length)
                kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))
                rows.append((doc, len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)] + [batch.column("marked")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats_passage"])

    told = marked.join(spans, "u", "left").withColumn("marked", F.lit(True))
    joined = _keyed(docs).join(told, "u", "left").select("doc_id", "text", "runs", F.col("marked").isNotNull().alias("marked"))
    return joined.mapInArrow(take, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats_passage boolean")


def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir))
