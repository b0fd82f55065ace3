"""Source divergence audit: how far the words of a source lie from those of the other sources of its language.

Terms are counted inside tasks: those of at most 16 bytes are packed into one or two unsigned words, sorted by radix
and counted in runs, longer ones in buckets sorted by bytes (`packed`). Spark adds up the counts, keeps the terms
that enough documents of a language hold, and smooths each group's counts to integer shares of a thousand million.
The distances of all pairs of sources are added up by blocks of terms.

Defined cases: null text, lang and source are ''. A row is a document, also one that repeats another. A group
without terms has the shares of smoothing alone; a language without kept terms gives pairs with the value 0 and no
terms. Texts are read whole, in slices of rows, a term of any length counts. Ties go by the item's UTF-8 bytes. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packed
from ._base import bounded, materialize, read_documents, small_batches
from .tokens import column_bytes, ragged

#: Documents of a language that hold a kept term, what is added to each count, the shares' total, ranks of the part `term`.
LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows of a block of terms, cells of a table of shares in a task; memory, not results, depends on them.
BLOCK, CELLS = 100_000, 1 << 21

#: Bytes of terms: ASCII letters, and every byte of a character beyond ASCII.
_TERM, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER[65:91] += 32


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            data, offsets = column_bytes(batch.column("text"))
            data = _LOWER[data]
            starts, lengths, owner = packed.spans(_TERM[data[: offsets[-1]]], offsets)
            lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            for r in packed.count(data, starts, lengths, group[owner], owner):
                ends = np.append(0, np.cumsum(r.length)).astype(np.int32)
                term = pa.StringArray.from_buffers(len(r.n), pa.py_buffer(ends), pa.py_buffer(data[ragged(r.start, r.length)]))
                l, s = np.divmod(r.group, max(1, len(source.dictionary)))  # noqa: E741
                yield pa.record_batch([lang.dictionary.take(pa.array(l)), source.dictionary.take(pa.array(s)), term, pa.array(r.n), pa.array(r.owners)], names=["lang", "source", "term", "n", "docs"])

    named = bounded(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return named.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), exactly: decimals of 38 digits."""
    return (F.expr("1L") + F.call_function("div", (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + SMOOTH * kept).cast("decimal(20,0)"))).cast("long")


def _distances(pdf: pd.DataFrame) -> pd.DataFrame:
    """lang, a, b, value over one block of terms of a language, for a before b. Rows without a term give each group's share of an absent term."""
    whole = pdf["term"].isna()
    names = pdf.loc[whole, "source"].to_numpy()
    order = np.argsort(names)
    names, base = names[order], pdf.loc[whole, "p"].to_numpy(np.int64)[order]
    rows = pdf.loc[~whole]
    term, _ = pd.factorize(rows["term"])
    source, p, sums = np.searchsorted(names, rows["source"].to_numpy()), rows["p"].to_numpy(np.int64), np.zeros((len(names), len(names)), np.int64)
    by = np.argsort(term, kind="stable")
    term, source, p = term[by], source[by], p[by]
    step, most = max(1, CELLS // max(1, len(names))), int(term[-1]) + 1 if len(term) else 0
    for first in range(0, most, step):
        lo, hi = np.searchsorted(term, [first, first + step])
        table = np.repeat(base[:, None], min(step, most - first), axis=1)
        table[source[lo:hi], term[lo:hi] - first] = p[lo:hi]
        for i in range(len(names) - 1):
            sums[i, i + 1 :] += np.abs(table[i + 1 :] - table[i]).sum(axis=1)
    a, b = np.triu_indices(len(names), 1)
    return pd.DataFrame({"lang": np.full(len(a), pdf["lang"].iloc[0], object), "a": names[a], "b": names[b], "value": sums[a, b]})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources of the language, and the terms that a source has more of."""
    by_term = Window.partitionBy("lang", "term")
    every = term_counts(docs).select("*", F.sum("docs").over(by_term).alias("held"), F.sum("n").over(by_term).alias("n_lang"), F.min("source").over(by_term).alias("_first"))
    kept = materialize(every.where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "n_lang", (F.col("source") == F.col("_first")).alias("first")), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("first").alias("kept"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = materialize(groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("total"), zero("total_lang"), zero("kept")), "groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q"))

    blocks = max(1, -(-kept.count() // BLOCK))
    absent = F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(0)
    whole = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), absent.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = shares.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")).unionByName(whole)
    sums = dealt.groupBy("lang", "block").applyInPandas(_distances, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pair = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_documents(spark, sf_dir))


OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
 c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
 k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
 l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d),
 gn AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total FROM g LEFT JOIN c USING (lang, source) LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
 p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + {SMOOTH})::HUGEINT) // (gn.total + {SMOOTH} * l.v) AS p, 1 + ({SCALE} * (k.n + {SMOOTH})::HUGEINT) // (l.total + {SMOOTH} * l.v) AS q
  FROM gn JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
 SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
