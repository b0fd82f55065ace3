"""Every corpus query and pipeline stage over tables with nulls, repeated rows, long texts and clashing columns, and over empty tables."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import media, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, key string, node string, part string, u string, start string, label string, score string"
LONG = "a long text of many words, ten of them here " * 40_000  # over one slice of 1 MB
ROWS = [(1, "same text of a few words here"), (1, "same text of a few words here"), (2, "same text of a few words here"), (3, None), (4, ""), (5, " \n\t"), (6, LONG), (7, "x"), (8, "mail bob.12@mail.example.com\nnow\nnow"), (None, "a row without an id"), (9, None)]
NAMES = [n for n in queries.queries() if n.startswith("op")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")
    for kind in ("odd", "empty"):
        few = [] if kind == "empty" else ROWS
        docs = spark.createDataFrame([(i, t, None if i == 2 else "en", "s", len(t or "")) + ("clash",) * 8 for i, t in few], DOCS)
        docs.write.parquet(f"{top}/{kind}/documents.parquet")
        labels = [] if kind == "empty" else [(1, 0, None), (2, 1, 1), (6, None, 0), (None, 1, 1), (8, 0, 0)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/{kind}/labels.parquet")
        items = [] if kind == "empty" else [(1, "same text of a few words here"), (2, None), (3, ""), (None, "nothing of the kind")]
        spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")).write.parquet(f"{top}/{kind}/benchmark.parquet")
        pages = [] if kind == "empty" else [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", ""), (3, "w", "<b>" * 50 + f"<article><p>{LONG}</article>")]
        spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).write.parquet(f"{top}/{kind}/pages.parquet")
    return f"file://{top}"


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, tables, name):
    rows = queries.queries()[name](spark, f"{tables}/odd").collect()
    n = int(name[2:].split("_")[0])
    if n == 2:
        assert sorted((r.page_id or 0) for r in rows) == [0, 1, 1, 2, 3]
    elif n == 5:
        assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 1)}
    elif n == 10:
        assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.doc_id for r in rows} == {i for i, _ in ROWS}
    elif n == 12:  # no term is in 30 documents
        assert {(r.lang, r.source, r.part, r["item"], r["value"], r["rank"]) for r in rows} == set()
    elif n == 13:
        assert {(r.word, r.form, r.root, r.n_near, r.form_n) for r in rows if r.word == "example"} == {("example", None, "example", 0, None)} or not rows
    elif name in ("op9_every_line_dedup", "op9_long_line_dedup"):
        assert (2, 0) in {(r.doc_id, r.start) for r in rows}
    else:
        assert sorted((r.doc_id or 0) for r in rows) == sorted((i or 0) for i, _ in ROWS)
    if n == 3:
        for r in rows:
            text = next(t for i, t in ROWS if i == r.doc_id) or ""
            p = media.padded(text.encode())
            w = media.to_wav(p)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest(), media.features(p))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tables, name):
    assert queries.queries()[name](spark, f"{tables}/empty").count() == 0


def test_stages(spark, tables):
    for kind in ("odd", "empty"):
        docs = spark.read.parquet(f"{tables}/{kind}/documents.parquet")
        found = {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"{tables}/{kind}")
            assert name == "packing" or out.columns == docs.columns
            found[name] = sorted((r.doc_id or 0) for r in out.select("doc_id").collect())
        if kind == "empty":
            assert not any(found.values())
        else:
            every = sorted((i or 0) for i, _ in ROWS)
            assert found["near_dedup"] == [i for i in every if i != 2] and found["decontamination"] == [i for i in every if i not in (1, 2)] and found["pii"] == every
            assert set(found["packing"]) == set(every)
