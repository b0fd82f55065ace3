"""Text quality by positive-unlabelled learning.

Each document becomes counts of kinds of characters, of words, of words and word pairs that repeat. Trusted
documents (label 1, not held out) are the positives, all documents the unlabelled text; labels 0 are not used. A
first model tells positives from unlabelled text in one half of the documents. In the other half the share of
positives among the unlabelled is estimated where its scores are highest: the least ratio of both tails, with a bound
on its error (best bin estimate). Then a logistic model minimises the non-negative unbiased risk

    prior * E_positive[l(f)] + max(0, E_unlabelled[l(-f)] - prior * E_positive[l(-f)])

by Newton steps over all documents; where the second term falls below zero, a step goes back up along it alone. Each
step is one pass over the table of counts, which adds up sums in Spark; the driver gets a number for each two
features.

Defined cases: null and empty texts count nothing, and their features are those of the corpus's mean. Without
trusted rows every score is 0.5. Very long texts are taken whole, in one slice of a batch. Repeated rows count
each, and get equal scores. An empty table gives an empty result. Labels, lang, source and doc_id are no inputs of a
score; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import materialize, read_documents, small_batches, texts
from .tokens import column_bytes
from .toxicity import held_out
from .words import SOLID, mix, words

#: What a mean text weighs in each share (bytes, words), the ridge and what of it is shared by the positives, Newton steps, how far back a step goes, bins of scores.
WEIGHT, RIDGE, RIDGE_ALL, STEPS, BACK, BINS = 30.0, 1e-3, 5.0, 14, 0.5, 1000
#: The chance that the bound on the prior's error fails.
DELTA = 0.1

_KINDS = ["A-Z", "a-z", "beyond ASCII", "digits", "space", "line ends", "sentence marks", "exclamation and question marks", "brackets and bars", "other signs", "controls"]
_SETS = [range(65, 91), range(97, 123), range(128, 256), range(48, 58), b" ", b"\n\r", b".,;:'\"-", b"!?", b"|<>{}[]()=_\\/~^", b"#$%&*@+`", [*range(9), 9, 11, 12, *range(14, 32), 127]]
_CLASS = np.zeros((256, len(_SETS)))
for _k, _s in enumerate(_SETS):
    _CLASS[list(_s), _k] = 1
#: Columns of counts: bytes, words, the kinds of bytes, then words like the one before, words and word pairs seen before in the text, capital words.
_BYTES, _WORDS, _FIRST = 0, 1, 2
_WORD_KINDS = 3
COUNTS = _FIRST + len(_SETS) + _WORD_KINDS
FEATURES = 2 * (COUNTS - _FIRST + 2) + 1


def _repeats(key: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many keys of each owner stand earlier in it."""
    order = np.lexsort((key, owner))
    k, o = key[order], owner[order]
    return np.bincount(o[1:][(k[1:] == k[:-1]) & (o[1:] == o[:-1])], minlength=n)


def text_counts(values: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text."""
    data, offsets = column_bytes(values)
    n, size = len(values), int(offsets[-1])
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * 256 + data[:size], minlength=256 * n).reshape(n, 256) @ _CLASS
    h, of, count = words(values, SOLID)
    same = np.append(False, (h[1:] == h[:-1]) & (of[1:] == of[:-1])) if len(h) else np.zeros(0, bool)
    inner = of[1:] == of[:-1]
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inner]
    seen = [np.bincount(of[same], minlength=n), _repeats(h, of, n), _repeats(pairs, of[1:][inner], n)]
    return np.column_stack([np.diff(offsets), count, kinds, *seen]).astype(np.int64)


def count_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, positive, half, counts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            c = text_counts(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), COUNTS).cast(pa.list_(pa.int64()))], names=["doc_id", "counts"])

    marked = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out()).distinct().withColumn("trusted", F.lit(True))
    counted = texts(docs).mapInArrow(run, "doc_id long, counts array<long>")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return counted.join(marked, "doc_id", "left").select("doc_id", F.coalesce("trusted", F.lit(False)).alias("positive"), F.coalesce(half, F.lit(False)).alias("half"), "counts")


def _table(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("counts").flatten().to_numpy().reshape(batch.num_rows, COUNTS).astype(np.float64)


@dataclass
class Model:
    means: np.ndarray  # of the counts, over all documents
    weights: np.ndarray | None = None  # None: no trusted rows
    prior: float = 0.5

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Logarithms of smoothed shares (and one) against the corpus's, their squares, and a constant."""
        per = np.where(np.arange(COUNTS) < COUNTS - _WORD_KINDS, _BYTES, _WORDS)[_FIRST:]
        rate = (self.means[_FIRST:] + 1e-9) / (self.means[per] + 1e-6) + 1e-3
        share = (counts[:, _FIRST:] + WEIGHT * rate) / (counts[:, per] + WEIGHT)
        long = (counts[:, _BYTES] + WEIGHT) / (counts[:, _WORDS] + WEIGHT * (self.means[_WORDS] + 1e-6) / (self.means[_BYTES] + 1e-6))
        x = np.clip(np.column_stack([np.log1p(share / rate) - math.log(2), np.log(long * (self.means[_WORDS] + 1e-6) / (self.means[_BYTES] + 1e-6)), np.log1p(counts[:, _WORDS]) / 3 - 2]), -4, 4)
        return np.column_stack([x, x * x / 4, np.ones(len(x))])

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return np.clip(self.features(counts) @ self.weights, -30, 30)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), 0.5) if self.weights is None else 1 / (1 + np.exp(-self.logits(counts)))


def _sums(table: DataFrame, parts: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """parts(counts, positive) has sums over rows: added up in tasks, then by place in Spark; `size` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += parts(_table(batch), batch.column("positive").to_numpy(zero_copy_only=False))
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], names=["at", "v"])

    out = np.zeros(size)
    for r in table.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out


def _logistic_sums(model: Model) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of unlabelled text (all rows) and of positives: rows, sum of l(f) and of l(-f), of x, of x s(f), of x x' s(f) s(-f)."""

    def parts(counts: np.ndarray, positive: np.ndarray) -> np.ndarray:
        x = model.features(counts)
        f = np.clip(x @ model.weights, -30, 30)
        s = 1 / (1 + np.exp(-f))
        out = []
        for use in (slice(None), positive):
            a, b = x[use], s[use]
            out += [np.array([len(a), np.logaddexp(0, -f[use]).sum(), np.logaddexp(0, f[use]).sum()]), a.sum(axis=0), a.T @ b, ((a * (b * (1 - b))[:, None]).T @ a).ravel()]
        return np.concatenate(out)

    return parts


_EACH = 3 + 2 * FEATURES + FEATURES**2


def _split(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """l(f), l(-f), x, x s(f), x x' s(f) s(-f) as means."""
    n = max(1.0, sums[0])
    return sums[1] / n, sums[2] / n, sums[3 : 3 + FEATURES] / n, sums[3 + FEATURES : 3 + 2 * FEATURES] / n, sums[3 + 2 * FEATURES :].reshape(FEATURES, FEATURES) / n


def _ridge(positives: float) -> np.ndarray:
    keep = np.full(FEATURES, RIDGE + RIDGE_ALL / max(1.0, positives))
    keep[-1] = 1e-6
    return keep


def fit_against_unlabelled(table: DataFrame, model: Model) -> None:
    """Weights that tell positives from unlabelled text, both of equal weight."""
    model.weights = np.zeros(FEATURES)
    for _ in range(STEPS // 2):
        sums = _sums(table, _logistic_sums(model), 2 * _EACH)
        (_, _, _, us, uh), (_, _, px, ps, ph) = _split(sums[:_EACH]), _split(sums[_EACH:])
        keep = _ridge(sums[_EACH])
        step = np.linalg.solve(0.5 * (uh + ph) + np.diag(keep), 0.5 * (us - (px - ps)) + keep * model.weights)
        model.weights = model.weights - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-3:
            break


def estimate_prior(table: DataFrame, model: Model) -> float:
    """The share of positives in unlabelled text: the least ratio of the tails of the scores of both, with the bound on its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = np.minimum((model.scores(_table(batch)) * BINS).astype(np.int64), BINS - 1)
                total += np.stack([np.bincount(at, minlength=BINS), np.bincount(at[batch.column("positive").to_numpy(zero_copy_only=False)], minlength=BINS)])
        yield pa.record_batch([pa.array(np.arange(BINS)), pa.array(total[0]), pa.array(total[1])], names=["at", "u", "p"])

    tails = np.zeros((2, BINS))
    for r in table.mapInArrow(run, "at long, u long, p long").groupBy("at").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect():
        tails[:, r["at"]] = r.u, r.p
    return best_bin(*tails)


def best_bin(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """Of histograms of the scores of both."""
    n_u, n_p = unlabelled.sum(), positive.sum()
    if not n_u or not n_p:
        return 0.5
    u, p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positive[::-1]) / n_p
    error = math.sqrt(math.log(4 / DELTA) / (2 * n_u)) + math.sqrt(math.log(4 / DELTA) / (2 * n_p))
    some = p > 0
    best = int(np.argmin((u[some] + error) / p[some] + error))
    return float(np.clip(u[some][best] / p[some][best], 0.01, 0.99))


def minimise_risk(table: DataFrame, model: Model) -> None:
    """Newton steps on the non-negative unbiased risk; the weights of the least risk on the way stay."""
    model.weights = np.zeros(FEATURES)
    model.weights[-1] = math.log(model.prior / (1 - model.prior))
    best, best_risk = model.weights, math.inf
    for _ in range(STEPS):
        sums = _sums(table, _logistic_sums(model), 2 * _EACH)
        (_, u_neg, _, us, uh), (p_pos, p_neg, px, ps, _) = _split(sums[:_EACH]), _split(sums[_EACH:])
        keep = _ridge(sums[_EACH])
        curve = uh + np.diag(keep)
        down, second = us - model.prior * ps, u_neg - model.prior * p_neg  # the second term and its gradient
        risk = model.prior * p_pos + max(0.0, second) + 0.5 * float(keep @ model.weights**2)
        if risk < best_risk:
            best, best_risk = model.weights, risk
        if second >= 0:
            step = np.clip(np.linalg.solve(curve, model.prior * (ps - px) + down + keep * model.weights), -2, 2)
        else:
            step = -BACK * np.clip(np.linalg.solve(curve, down), -1, 1)
        model.weights = model.weights - step
        if np.abs(step).max() < 1e-3:
            break
    model.weights = best


def fit(table: DataFrame) -> Model:
    """A model of a table that count_table() gives (written, as it is read many times)."""
    whole = _sums(table, lambda counts, positive: np.append(counts.sum(axis=0), [len(counts), positive.sum()]), COUNTS + 2)
    model = Model(whole[:COUNTS] / max(1.0, whole[COUNTS]))
    if whole[COUNTS + 1] == 0:
        return model
    fit_against_unlabelled(table.where("half"), model)
    model.prior = estimate_prior(table.where("not half"), model)
    minimise_risk(table, model)
    return model


def score_table(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of a table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(_table(batch)))], names=["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double")


def op11_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialize(count_table(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")), "text-counts")
    model = fit(table)
    return score_table(table, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
