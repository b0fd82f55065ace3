"""Line hashing: lines that occur in many places stay at their earliest place and go from the others.

A line is normalised (lower case, white space runs as one space, ends trimmed) and hashed; equal digests are
grouped globally, and the occurrence with the smallest (doc_id, start) stays. Offsets are code points of the
original text, end exclusive, without the line end. Repeated lines that follow one another form a paragraph, whose
length in words tells a passage from a short stock line.

Defined cases: null and empty texts have no lines to remove. Lines of fewer than `min_words` words are never
removed; with 1 every line with a word counts. Very long texts and lines are taken whole. Rows that repeat doc_id
and text rank as one: a line stays in both or goes from both. Rows that share a doc_id alone are one document, whose
lines are told apart by their start. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import materialize, read_documents, small_batches, texts

MIN_WORDS = 5
_UNITS = "doc_id long, nth long, start long, end long, n_words long, digest binary"


#: The units of a text: its lines, or the sentences of its lines.
LINES, SENTENCES = r"[^\n]+", r"[^.!?\n]+[.!?]*"


def line_units(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = LINES) -> DataFrame:
    """doc_id, nth (among these), start, end, n_words, digest of each line (or other unit) of at least min_words words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(unit).finditer
        for batch in small_batches(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                nth = 0
                for m in find(text):
                    words = m.group().lower().split()
                    if len(words) >= min_words:
                        rows.append((doc, nth, m.start(), m.end(), len(words), hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()))
                        nth += 1
            kinds = [*[pa.int64()] * 5, pa.binary()]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "nth", "start", "end", "n_words", "digest"])

    return texts(docs).mapInArrow(cut, _UNITS)


def occurrences(units: DataFrame) -> DataFrame:
    """The units that occur in several places, with the first place and whether this one goes."""
    first = units.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    first = materialize(first.where("n > 1").select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")), "first-lines")
    # both sides are plain scans, so that Spark can split the partition of a very common line
    return units.join(first, "digest").withColumn("removed", F.expr("doc_id <> first_doc_id or start <> first_start"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line to remove: doc_id, start, end, first_doc_id, first_start."""
    found = occurrences(materialize(line_units(docs, min_words), "lines"))
    return found.where("removed").select("doc_id", "start", "end", "first_doc_id", "first_start")


def _runs(found: DataFrame) -> DataFrame:
    """Repeated units that follow one another, as one paragraph: doc_id, n, words, first_doc_id, spans to remove."""
    found = found.dropDuplicates(["doc_id", "start", "digest"])
    island = F.col("nth") - F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "start"))
    spans = F.collect_list(F.when(F.col("removed"), F.struct("start", "end")))
    return found.withColumn("island", island).groupBy("doc_id", "island").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.min("first_doc_id").alias("first_doc_id"), spans.alias("spans"))


def line_report(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """A row for each document: its lines, those that occur elsewhere too, those to remove with their offsets, and in words
    its longest paragraph of repeated lines and its longest passage of repeated sentences (which need not be whole lines)."""
    units = materialize(line_units(docs, min_words), "lines")
    runs = _runs(occurrences(units))
    told = runs.groupBy("doc_id").agg(F.sum("n").alias("n_repeated"), F.max("words").alias("longest_repeat"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.min("first_doc_id").alias("first_doc_id"))
    passages = _runs(occurrences(materialize(line_units(docs, 1, SENTENCES), "sentences"))).groupBy("doc_id").agg(F.max("words").alias("longest_passage"))
    lines = units.select("doc_id", "start", "digest").distinct().groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    out = texts(docs).select("doc_id").join(lines, "doc_id", "left").join(told, "doc_id", "left").join(passages, "doc_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", count(F.col("n_lines")).alias("n_lines"), count(F.col("n_repeated")).alias("n_repeated"), count(F.size(F.coalesce("spans", F.array()))).alias("n_removed"), count(F.col("longest_repeat")).alias("longest_repeat"), count(F.col("longest_passage")).alias("longest_passage"), F.coalesce(shown, F.lit("")).alias("removed_spans"), "first_doc_id")


def remove_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The documents without the given lines (and the line end that follows, or comes before a last line), with the spans taken."""
    spans = lines.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    held = docs.join(spans, "doc_id", "left")

    def take(text: str | None, spans: list | None) -> str | None:
        if not text or not spans:
            return text
        cuts = [(s["start"], s["end"]) for s in spans]
        return "".join(text[a:b] for a, b in zip([0, *[e + 1 for _, e in cuts]], [*[s for s, _ in cuts], len(text)], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            at = batch.schema.get_field_index("text")
            new = [take(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return held.mapInArrow(run, held.schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_documents(spark, sf_dir))


def op9_every_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(read_documents(spark, sf_dir), min_words=1)


def op9_long_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(read_documents(spark, sf_dir))


#: Of lines of five words or more.
OP9_LONG_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM cut
), placed AS (
  SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM numbered
), units AS (
  SELECT doc_id, start, start + length(line) AS "end", trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS unit FROM placed
), kept AS (
  SELECT * FROM units WHERE unit <> '' AND length(unit) - length(replace(unit, ' ', '')) + 1 >= 5
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start FROM kept WINDOW w AS (PARTITION BY unit ORDER BY doc_id, start)
)
SELECT doc_id, start, "end", first_doc_id, first_start FROM ranked WHERE doc_id <> first_doc_id OR start <> first_start
"""

#: Of every line with a word, whatever its length; white space as Python takes it.
OP9_EVERY_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM cut
), placed AS (
  SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM numbered
), units AS (
  SELECT doc_id, start, start + length(line) AS "end", trim(regexp_replace(lower(line), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS unit FROM placed
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start FROM units WHERE unit <> '' WINDOW w AS (PARTITION BY unit ORDER BY doc_id, start)
)
SELECT doc_id, start, "end", first_doc_id, first_start FROM ranked WHERE doc_id <> first_doc_id OR start <> first_start
"""

#: A row for each document, over every line with a word.
OP9_SQL = OP9_EVERY_SQL.split(", ranked AS (")[0] + r"""
, ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start, count(*) OVER (PARTITION BY unit) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY start) AS nth, length(unit) - length(replace(unit, ' ', '')) + 1 AS n_words
  FROM units WHERE unit <> '' WINDOW w AS (PARTITION BY unit ORDER BY doc_id, start)
), again AS (
  SELECT *, doc_id <> first_doc_id OR start <> first_start AS removed, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS island FROM ranked WHERE n > 1
), runs AS (
  SELECT doc_id, sum(n_words) AS words FROM again GROUP BY doc_id, island
), longest AS (
  SELECT doc_id, max(words) AS words FROM runs GROUP BY doc_id
), told AS (
  SELECT doc_id, count(*) AS n_repeated, count(*) FILTER (removed) AS n_removed, min(first_doc_id) AS first_doc_id,
         string_agg(start || ':' || "end", ',' ORDER BY start) FILTER (removed) AS removed_spans
  FROM again GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_lines FROM ranked GROUP BY doc_id
), sentences AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*') AS xs FROM documents
), said AS (
  SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS k FROM sentences
), spoken AS (
  SELECT doc_id, k, trim(regexp_replace(lower(x), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS unit FROM said
), twice AS (
  SELECT *, count(*) OVER (PARTITION BY unit) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth, length(unit) - length(replace(unit, ' ', '')) + 1 AS n_words FROM spoken WHERE unit <> ''
), parts AS (
  SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS island FROM twice WHERE n > 1
), stretches AS (
  SELECT doc_id, sum(n_words) AS words FROM parts GROUP BY doc_id, island
), passages AS (
  SELECT doc_id, max(words) AS passage FROM stretches GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(l.words, 0)::BIGINT AS longest_repeat, coalesce(passage, 0)::BIGINT AS longest_passage, coalesce(removed_spans, '') AS removed_spans, first_doc_id
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN told t USING (doc_id) LEFT JOIN longest l USING (doc_id) LEFT JOIN passages USING (doc_id)
"""
