"""Interleaved document sequences: ordered text and media references, with payloads resolved by digest.

HTML is parsed into an ordered array of elements, text or media reference; an element's position counts the
elements of its document, and a figure's caption stays with its reference. References name a payload by digest;
the payload store is joined by that digest. Payloads are kept losslessly as 8-bit mono WAV samples.

Defined cases: a null or empty text has a payload of 64 zero bytes. Equal texts share a digest and so all
values; equal digests meet once, so there are no ties. Very long texts are one payload. Repeated rows give repeated
results. References without a payload keep their row, with nulls. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import materialize, new_table, read_documents, small_batches, texts

BLOCK, RATE, SCHEME = 64, 8000, "media:"
_ELEMENTS = "doc_id long, elements array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Sequence(HTMLParser):
    """Text blocks and media references in page order; a figcaption goes to the figure's last reference."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.held: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("img", "audio", "video", "source") and (ref := dict(attrs).get("src")):
            self.flush()
            self.out.append({"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt") or None})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag not in ("a", "b", "i", "em", "span", "strong", "sup", "sub", "u", "small"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            media = next((x for x in reversed(self.out) if x["kind"] == "media"), None)
            if media:
                media["caption"] = " ".join("".join(self.caption).split()) or media["caption"]
            self.caption = None
        elif tag not in ("a", "b", "i", "em", "span", "strong", "sup", "sub", "u", "small"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.held if self.caption is None else self.caption).append(data)


def parse_sequence(page: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(page)
    parser.close()
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.out)]


def interleave(pages: DataFrame) -> DataFrame:
    """doc_id and its ordered elements, from columns doc_id and html."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            rows = [parse_sequence(x) for x in batch.column("html").to_pylist()]
            kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "elements"])

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(parse, _ELEMENTS)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def to_wav(payload: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    (size,) = struct.unpack_from("<I", media, 40)
    return media[44 : 44 + size]


def features(payload: bytes) -> str:
    """Of unsigned 8-bit samples: mean, root mean square and zero crossings about the middle, peak, distinct values."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={x.sum() / len(x):.4f};rms={np.sqrt((x * x).sum() / len(x)):.4f};zc={crossings};peak={int(np.abs(x).max())};distinct={len(np.unique(x))}"


def digest_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def store_payloads(docs: DataFrame, path: str) -> None:
    """The payload store: digest and media bytes, from columns digest and text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            media = [to_wav(padded(x.encode())) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("digest"), pa.array(media, pa.binary())], names=["digest", "media"])

    docs.select("digest", "text").mapInArrow(encode, "digest string, media binary").write.option("compression", "zstd").parquet(path)


def payload_features(media: DataFrame) -> DataFrame:
    """One row of values for each stored digest, from the bytes read back."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            rows = []
            for digest, x in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                p = from_wav(x)
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(x), hashlib.sha256(x).hexdigest(), features(p)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.mapInArrow(decode, _FEATURES)
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns if c != "digest"])


def resolve(elements: DataFrame, values: DataFrame) -> DataFrame:
    """The media references of `elements`, each with its payload's values; positions and captions stay with them."""
    refs = elements.select("doc_id", F.explode("elements").alias("e")).where("e.kind = 'media'")
    refs = refs.select("doc_id", F.col("e.position").alias("position"), F.col("e.caption").alias("caption"), F.regexp_replace("e.ref", f"^{SCHEME}", "").alias("digest"))
    return refs.join(values.hint("merge"), "digest", "left")


def op3_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(read_documents(spark, sf_dir)).withColumn("digest", digest_of(F.col("text")))
    path = new_table(spark, "media")
    store_payloads(docs, path)
    values = materialize(payload_features(spark.read.schema("digest string, media binary").parquet(path)), "media-values")
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.replace(text, F.lit("\n"), F.lit("</p><p>"))  # each line is a text element before the reference
    page = F.concat(F.lit("<p>"), text, F.lit(f'</p><figure><img src="{SCHEME}'), F.col("digest"), F.lit('"><figcaption>'), F.octet_length("text").cast("string"), F.lit("</figcaption></figure>"))
    found = resolve(interleave(docs.select("doc_id", page.alias("html"))), values)
    return found.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")
