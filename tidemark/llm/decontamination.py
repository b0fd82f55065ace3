"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks.

Words are hashed to DIMS terms; their document frequencies are counted over all documents. A randomised SVD of the
TF-IDF passages of all documents gives a latent space in one pass: the sketch A'A Omega is summed over all partitions,
and the singular vectors and values come from it and Omega alone (Nystroem). Every document is then cut into overlapping windows of
about each item's length (window lengths grow with the longest item), and every window is compared with every item of that length by cosine in the whitened
space. Candidates are checked on the words themselves: the longest common subsequence of the item and the window
with its surroundings, and whether the item's answer (its last sentence) is there too.

Defined cases: null and empty texts and items have no words and match nothing. Repeated rows match alike; a
document is matched with an item once, at its best window, the first of equally good ones. Very long texts are cut into
windows like others. Items are taken in blocks, so that what a task holds
of them is bounded. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bounded, partition_id, read_documents, small_batches, texts
from .tokens import ragged
from .words import ALNUM, words

#: Terms, latent dimensions, extra ones of the sketch, passage length in words, items in a block.
DIMS, RANK, EXTRA, PASSAGE, BLOCK_ITEMS = 8192, 128, 8, 64, 4096
#: Passages whose part of the sketch is summed at a time, tasks of the sketch for each core, rows of a slice of it.
HELD, TASKS, SLICE = 8192, 4, 64
#: Least cosine of a candidate; least share of an item's words in order, alone and together with its answer.
COSINE, LCS_ALONE, LCS_WITH_ANSWER = 0.45, 0.75, 0.6
SCALES = [8, 12, 16, 24, 36, 56, 80, 120, 180, 272, 408, 612, 920]
QUARTER = 4
#: Quarters that are taken together at least.
QUARTERS = 1024


def _terms(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, owner, n = words(values, ALNUM)
    return h, (h % np.uint64(DIMS)).astype(np.int64), owner, n


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many documents each term occurs; the last number is that of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in small_batches(batches, "text", 1 << 20):
            _, term, owner, n = _terms(batch.column("text"))
            seen = np.zeros((len(n), DIMS), bool) if len(n) <= 512 else None
            if seen is not None:
                seen[owner, term] = True
                total[:DIMS] += seen.sum(axis=0)
            else:
                total[:DIMS] += np.bincount(np.unique(owner * DIMS + term) % DIMS, minlength=DIMS)
            total[DIMS] += len(n)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in texts(docs).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most DIMS + 1 rows
        out[r.term] = r.n
    return out


def _passages(values: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, term, weight) of blocks of passages; each passage has length 1."""
    _, term, owner, n = _terms(values)
    within = ragged(np.zeros(len(n), np.int64), n)
    fresh = (within % PASSAGE == 0)
    passage = np.cumsum(fresh) - 1
    if len(term):
        key, tf = np.unique(passage * DIMS + term, return_counts=True)
        passage, term = key // DIMS, key % DIMS
        weight = np.sqrt(tf) * idf[term]
        weight /= np.sqrt(np.bincount(passage, weight * weight) + 1e-12)[passage]
        yield passage, term, weight.astype(np.float32)


def _sketched(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], omega: np.ndarray) -> np.ndarray:
    """A'A omega of blocks of passages. A's rows are short and its columns long enough once HELD rows are held, so both products go row by row."""
    total, held, rows = np.zeros(omega.shape, np.float64), [], 0

    def add() -> None:
        passage, term, weight, y = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(term, kind="stable")
        passage, term, weight = passage[order], term[order], weight[order]
        at = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)).tolist()
        for lo, hi in zip(at, at[1:], strict=False):
            total[term[lo]] += weight[lo:hi] @ y.take(passage[lo:hi], axis=0)

    for passage, term, weight in blocks:
        at = np.append(np.flatnonzero(np.append(True, passage[1:] != passage[:-1])), len(passage)).tolist()
        y = np.empty((len(at) - 1, omega.shape[1]), np.float32)
        for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
            np.dot(weight[lo:hi], omega.take(term[lo:hi], axis=0), out=y[k])
        held.append((rows + passage, term, weight, y))
        rows += len(y)
        if rows >= HELD:
            add()
            held, rows = [], 0
    if held:
        add()
    return total


def latent_space(docs: DataFrame, df: np.ndarray, seed: int = 3) -> np.ndarray:
    """The vectors of the terms, (DIMS, RANK): idf times the right singular vectors over the singular values, of the passages of all documents."""
    n = max(1, int(df[DIMS]))
    idf = np.log((n + 1) / (df[:DIMS] + 1)) + 0.05
    width = RANK + EXTRA
    omega = np.random.default_rng(seed).standard_normal((DIMS, width)).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (block for batch in small_batches(batches, "text", 1 << 18) for block in _passages(batch.column("text"), idf))
        total = _sketched(blocks, omega).astype(np.float32)
        at = [k for k in range(0, DIMS, SLICE) if total[k : k + SLICE].any()]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([partition_id()] * len(at), pa.int64()), pa.array([total[k : k + SLICE].tobytes() for k in at], pa.binary())], names=["slice", "part", "m"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at in enumerate(batch.column("slice").to_pylist()):
                part = np.frombuffer(batch.column("m")[k].as_buffer(), np.float32).reshape(SLICE, width)
                out[at] = out.get(at, 0.0) + part.astype(np.float64)
        yield pa.record_batch([pa.array(list(out), pa.int64()), pa.array([m.tobytes() for m in out.values()], pa.binary())], names=["slice", "m"])

    # a task's part is of fixed size, so there are no more tasks than the cores need
    tasks = max(32, TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    parts = texts(docs).select("text").coalesce(tasks).mapInArrow(sketch, "slice long, part long, m binary")
    parts = parts.repartition(DIMS // SLICE, "slice").sortWithinPartitions("slice", "part")  # sums in one order
    y = np.zeros((DIMS, width))
    for r in parts.mapInArrow(summed, "slice long, m binary").collect():  # a matrix of fixed size in DIMS / SLICE rows
        y[r["slice"] : r["slice"] + SLICE] = np.frombuffer(bytes(r.m)).reshape(SLICE, width)
    return _vectors(y, omega, idf)


def _vectors(y: np.ndarray, omega: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The latent vectors of the terms from y = A'A omega: A'A is taken as y (omega'y)^-1 y'."""
    core, turn = np.linalg.eigh((omega.T @ y + y.T @ omega) / 2)
    some = core > 1e-6 * core.max()  # the others of a small corpus hold nothing but what float32 leaves open
    vectors, sigma, _ = np.linalg.svd(y @ (turn * np.where(some, 1 / np.sqrt(np.where(some, core, 1)), 0)), full_matrices=False)
    top = sigma[:RANK] ** 2
    sigma = np.sqrt(top + 0.05 * top.mean() + 1e-12)  # directions of a small corpus that hold nothing stay small
    return (idf[:, None] * (vectors[:, :RANK] / sigma)).astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def scales_to(longest: int) -> list[int]:
    """SCALES, carried on by half as much again until they reach the longest item."""
    out = list(SCALES)
    while out[-1] < longest:
        out.append(out[-1] * 3 // 2 // QUARTER * QUARTER)
    return out


@dataclass
class Items:
    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    counts: list[Counter]
    scales: list[int]
    scale: np.ndarray
    vectors: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True) + 1e-20)


def answer_of(text: str) -> str:
    """The last sentence, or if it has under three words the last fifth of all words, three at least."""
    parts = [p for p in re.split(r"[.!?\n]+", text) if p.strip()]
    if parts and len(parts[-1].split()) >= 3:
        return parts[-1]
    every = text.split()
    return " ".join(every[-max(3, len(every) // 5) :])


def prepare(rows: list[tuple[int, str]], space: np.ndarray) -> Items:
    found = [(i, t) for i, t in rows if t and t.strip()]
    h, term, owner, n = _terms(pa.array([t for _, t in found], pa.string()))
    use = [k for k in range(len(found)) if n[k]]
    cut = np.split(h, np.cumsum(n)[:-1]) if len(n) else []
    answers, _, m = words(pa.array([answer_of(t) for _, t in found], pa.string()), ALNUM)
    answer_cut = np.split(answers, np.cumsum(m)[:-1]) if len(m) else []
    vectors = np.zeros((len(found), RANK), np.float32)
    np.add.at(vectors, owner, space[term])
    sizes = np.array([n[k] for k in use], float)
    scales = scales_to(int(sizes.max(initial=1)))
    scale = np.abs(np.log(np.array(scales)[None, :] / np.maximum(sizes, 1)[:, None])).argmin(axis=1) if use else np.zeros(0, int)
    return Items([found[k][0] for k in use], [cut[k].tolist() for k in use], [answer_cut[k].tolist() for k in use], [Counter(cut[k].tolist()) for k in use], scales, scale, _unit(vectors[use]))


def _window_sums(levels: list[np.ndarray], rows: np.ndarray, length: int) -> np.ndarray:
    """The sums of `length` rows of levels[0] from each of `rows` on; levels[k] has the sums of 2 ** k rows."""
    out, done = np.zeros((len(rows), RANK), np.float32), 0
    for k in range(length.bit_length()):
        if length >> k & 1:
            out += levels[k].take(rows + done, axis=0)
            done += 1 << k
    return out


def _near(term: np.ndarray, n: np.ndarray, space: np.ndarray, items: Items) -> dict[tuple[int, int], list[tuple[float, int, int]]]:
    """(value, item): (cosine, first word, end) of the value's windows near the item. Quarters are taken in blocks that stay in the cache."""
    quarters = -(-n // QUARTER)
    q0 = np.cumsum(quarters) - quarters
    grid = np.full((int(quarters.sum()) + 1, QUARTER), DIMS, np.int64)
    grid.reshape(-1)[ragged(q0 * QUARTER, n)] = term
    table = np.concatenate([space, np.zeros((1, RANK), np.float32)])
    scales = []
    for s in np.unique(items.scale).tolist():
        length, step = items.scales[s] // QUARTER, max(1, items.scales[s] // QUARTER // 4)
        counts = np.where(quarters > 0, 1 + np.maximum(0, -(-(quarters - length) // step)), 0)
        doc = np.repeat(np.arange(len(n)), counts)
        low = ragged(np.zeros(len(counts), np.int64), counts) * step
        low = np.maximum(0, np.minimum(low, quarters[doc] - length))
        mine = np.flatnonzero(items.scale == s)
        scales.append((length, doc, low, np.minimum(low + length, quarters[doc]), q0[doc] + low, mine, np.ascontiguousarray(items.vectors[mine].T)))
    reach = max(x[0] for x in scales)
    size = max(QUARTERS, 4 * reach)
    out: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for at in range(0, len(grid), size):
        part = grid[at : at + size + reach]
        levels = [table.take(part[:, 0], axis=0)]
        for k in range(1, QUARTER):
            levels[0] += table.take(part[:, k], axis=0)
        for k in range(reach.bit_length() - 1):
            levels.append(levels[k][: -(1 << k)] + levels[k][1 << k :])
        for length, doc, low, high, place, mine, vectors in scales:
            some = slice(*np.searchsorted(place, [at, at + size]))
            rows, whole = place[some] - at, high[some] - low[some] == length
            if whole.all():
                w = _window_sums(levels, rows, length)
            else:  # values shorter than the window
                w = np.empty((len(rows), RANK), np.float32)
                w[whole] = _window_sums(levels, rows[whole], length)
                ends = np.stack([rows[~whole], rows[~whole] + (high[some] - low[some])[~whole]], axis=1)
                w[~whole] = np.add.reduceat(levels[0], ends.ravel(), axis=0)[::2]
            norm = np.sqrt(np.einsum("ij,ij->i", w, w) + 1e-20)
            cos = w @ vectors
            hit = np.flatnonzero(cos.max(axis=1) >= COSINE * norm)
            cos = cos[hit] / norm[hit, None]
            for r, c in zip(*(x.tolist() for x in np.nonzero(cos >= COSINE)), strict=True):
                k = some.start + hit[r]
                out.setdefault((int(doc[k]), int(mine[c])), []).append((float(cos[r, c]), int(low[k]) * QUARTER, int(high[k]) * QUARTER))
    return out


def _in_common(item: Counter, seen: set[int]) -> int:
    """The item's words that are seen, which bounds the subsequence from above."""
    return sum(map(item.__getitem__, item.keys() & seen))


def matches(values: pa.Array, space: np.ndarray, items: Items) -> list[tuple[int, int, float, float, bool]]:
    """(value's number, item's number, cosine, share of the item in order, answer found) of all matches."""
    h, term, owner, n = _terms(values)
    if not len(h) or not items.ids:
        return []
    start, out, of, every = np.cumsum(n) - n, [], -1, set()
    for (d, i), found in sorted(_near(term, n, space, items).items()):
        item, answer, best = items.words[i], items.answers[i], None
        if d != of:
            of, every = d, set(h[start[d] : start[d] + n[d]].tolist())
        if _in_common(items.counts[i], every) < LCS_WITH_ANSWER * len(item):
            continue
        for cosine, low, high in found:
            around = max(items.scales[items.scale[i]], len(item)) // 2
            region = h[start[d] + max(0, low - around) : start[d] + min(int(n[d]), high + around)].tolist()
            if _in_common(items.counts[i], set(region)) < LCS_WITH_ANSWER * len(item):
                continue
            share = lcs(item, region) / len(item)
            hit = bool(answer) and lcs(answer, region) >= 0.8 * len(answer)
            if (share >= LCS_ALONE or hit and share >= LCS_WITH_ANSWER) and (best is None or (share, cosine) > (best[3], best[2])):
                best = (d, i, cosine, share, hit)
        if best:
            out.append(best)
    return out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in the order of their ids."""
    held: list[tuple[int, str]] = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append((r.item_id, r.text))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it contains: doc_id, item_id, cosine, lcs_share, answer_found."""
    spark = docs.sparkSession
    kind = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"
    space = latent_space(docs, document_frequencies(docs))
    out = None
    for rows in _blocks(benchmark, BLOCK_ITEMS):
        items = prepare(rows, space)

        def search(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text", 1 << 19):
                found = matches(batch.column("text"), space, items)
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.record_batch([ids, pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()), pa.array([f[4] for f in found], pa.bool_())], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_found"])

        one = texts(docs).mapInArrow(search, kind)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], kind)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that contain no benchmark item."""
    space, out = latent_space(docs, document_frequencies(docs)), docs
    for rows in _blocks(benchmark, BLOCK_ITEMS):
        items = prepare(rows, space)

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in small_batches([whole], "text", 1 << 19):
                    value = batch.column("text")
                    found = {f[0] for f in matches(value.fill_null("") if value.null_count else value, space, items)}
                    yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)], pa.bool_()))

        out = bounded(out).mapInArrow(keep, docs.schema)
    return out


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
