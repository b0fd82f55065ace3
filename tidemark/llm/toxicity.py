"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the letters of all documents. Tokens that mix letters with look-alike
signs, repeat a letter three times or more, or stand as single characters in a row become a lattice: each
written character may be one of several letters, or nothing if it repeats or separates. Viterbi decoding under
the character model and the channel's costs restores a word. Plain tokens that make up a telling word when set
together (two tokens, or a row of short ones) are that word if the channel's space is likelier than words of their own,
so only such joins are weighed. The restored text is scored by a logistic
model of the presence of words and of their beginnings of 3 to 7 letters (so that other forms of a telling word count),
learnt from labelled rows that are not held out.

Defined cases: null and empty texts have no words and get the model's base score. Without labelled rows of both
kinds the score is the labels' smoothed rate for every text. Very long texts are taken whole. Repeated rows give repeated results, ties in the
choice of words go by the word. An empty table gives an empty result. Labels, lang, source and doc_id are not
inputs of a score; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bounded, column_texts, read_documents, small_batches, texts

#: Labelled rows of each kind that are fitted at most, the least log-likelihood ratio of a kept word, letters of a short piece.
TRAIN_ROWS, LEAST_LLR, PIECE = 3000, 25.0, 2
#: Letters of the beginnings of words that count as signs of their own, and the mark after one.
BEGINNINGS, MARK = (3, 4, 5, 6, 7), "*"
HELD_OUT = 5
_NONE: set[str] = set()

# Letters that a written sign may stand for
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "*": "aeiou",
}
SEPARATORS = " ._*-~^'"
#: Channel costs (negative natural logarithms): a look-alike, a dropped repeat in a run of three or more and of two, a dropped separator.
SIGN, REPEAT, DOUBLE, SEPARATOR = 1.0, 0.5, 6.0, 0.3

LETTERS = 28  # 0: outside of a word, 1-26: a-z, 27: any other letter
_SIGNS = re.escape("".join(LOOKALIKES))
_MIXED = re.compile(rf"[^\W\d_][{_SIGNS}._~^'-]+[^\W\d_]|(?:^|[^\w])[{_SIGNS}]+[^\W\d_]|[^\W\d_][013457@$]+$")
_LONG = re.compile(r"([^\W\d_])\1\1")
_WORDS = re.compile(r"[^\W\d_]+")
_ROW = re.compile(r"(?<!\S)(?:\w|[@$!|+*€£])(?:[ ._*-]+(?:\w|[@$!|+*€£])(?!\w)){2,}(?!\S)")
_STOPS = ".,;:!?\"'"
_EDGES = ".,;:!?\"'()[]{}<>#%&*-_/\\|$~^+=`…»«“”’"


def letter_codes(text: str) -> np.ndarray:
    """Of lower-cased text: 0 for what is no letter, 1-26, 27."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(len(x), np.int64)
    low = (x >= 97) & (x <= 122)
    out[low] = x[low] - 96
    out[(x >= 0xC0) & (x != 0xD7) & (x != 0xF7)] = 27
    return out


def trigram_counts(docs: DataFrame) -> DataFrame:
    """trigram, n over all texts: letters of words with their edges, each word with two marks before and one after."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in small_batches(batches, "text", 2 << 20):
            x = letter_codes("  " + "\n ".join(column_texts(batch, "text")).lower() + " ")
            c = x[2:]
            tri = x[:-2] * LETTERS**2 + x[1:-1] * LETTERS + c
            total += np.bincount(tri[(c > 0) | (x[1:-1] > 0)], minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["trigram", "n"])

    return texts(docs).mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    costs: np.ndarray  # of a letter after two letters
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    lexicon: frozenset[str] = frozenset()  # words that are known to count, looked for in pieces too
    memo: dict[str, str] = field(default_factory=dict)
    told: dict[str, set[str]] = field(default_factory=dict)  # by token: its signs that have a weight

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "told": {}}

    def restore(self, written: str) -> str:
        if written not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[written] = decode(written, self.costs)
        return self.memo[written]


def language_costs(counts: np.ndarray, words: list[str] = (), share: float = 0.01) -> np.ndarray:
    """Negative log probabilities of trigrams, backing off to bigrams and letters; each given word adds a share of all counts."""
    n = counts.astype(np.float64).reshape(LETTERS, LETTERS, LETTERS) + 0.0
    extra = max(50.0, share * n.sum() / max(1, len(words)))
    for w in words:
        c = [0, 0, *letter_codes(w).tolist(), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            n[a, b, d] += extra
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + LETTERS)
    two = (n.sum(axis=0) + 20 * one) / (n.sum(axis=(0, 2))[:, None] + 20)
    three = (n + 20 * two[None]) / (n.sum(axis=2)[:, :, None] + 20)
    return -np.log(three)


def decode(written: str, costs: np.ndarray) -> str:
    """The most likely word behind what is written: Viterbi over states of the last two letters and the last written sign."""
    states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
    for at, c in enumerate(written):
        repeat = REPEAT if c * 3 in written[max(0, at - 2) : at + 3] else DOUBLE
        letters = [(c, 0.0)] if c.isalpha() else [(x, SIGN) for x in LOOKALIKES.get(c, "")]
        new: dict[tuple[int, int, str], tuple[float, str]] = {}

        def put(key: tuple[int, int, str], cost: float, text: str, new: dict = new) -> None:
            if key not in new or (cost, text) < new[key]:
                new[key] = (cost, text)

        for (a, b, last), (cost, text) in states.items():
            for x, extra in letters:
                k = ord(x) - 96 if "a" <= x <= "z" else 27
                put((b, k, c), cost + extra + float(costs[a, b, k]), text + x)
            if last == c and text:
                put((a, b, c), cost + repeat, text)
            if c in SEPARATORS or not letters:
                put((a, b, last), cost + SEPARATOR, text)
        states = new
    return min((cost + float(costs[a, b, 0]), text) for (a, b, _), (cost, text) in states.items())[1] if states else ""


def word_cost(word: str, costs: np.ndarray) -> float:
    c = [0, 0, *letter_codes(word).tolist(), 0]
    return float(sum(costs[a, b, d] for a, b, d in zip(c, c[1:], c[2:], strict=False)))


@lru_cache(4)
def _starts(lexicon: frozenset[str]) -> frozenset[str]:
    return frozenset(w[:k] for w in lexicon for k in range(1, len(w) + 1))


def joined_words(tokens: list[str], model: Model) -> set[str]:
    """Known words that stand in pieces: two tokens, or a row of short ones, that the channel's space divides more likely than words of their own."""
    out, n, starts = set(), len(tokens), _starts(model.lexicon)
    for i in [i for i, token in enumerate(tokens) if token in starts]:
        piece = tokens[i]
        for k in range(i + 1, n):
            piece += tokens[k]
            if piece not in starts:
                break
            if piece in model.lexicon:
                apart = sum(word_cost(t, model.costs) for t in tokens[i : k + 1])
                if word_cost(piece, model.costs) + SEPARATOR * (k - i) < apart:
                    out.add(piece)
            if len(tokens[k]) > PIECE or len(tokens[i]) > PIECE:
                break
    return out


def token_words(token: str, model: Model) -> set[str]:
    """The words of a lower-cased token, with those that the channel restores."""
    out = set()
    if token.isalpha():
        out.add(token)
        if _LONG.search(token):
            out.add(model.restore(token))
        return out
    word = token.strip(_EDGES)
    if word.isalpha():
        out.add(word)
        if word != token and _MIXED.search(token.rstrip(_STOPS)):
            out.add(model.restore(token.rstrip(_STOPS)))
    elif word:
        out.update(_WORDS.findall(word))
        if _MIXED.search(token):
            out.add(model.restore(token.rstrip(".,;:?\"'")))
    if word and _LONG.search(word):
        out.add(model.restore(word))
    return out


def row_words(low: str, model: Model) -> set[str]:
    """The restored words of the rows of single signs of a lower-cased text."""
    return {model.restore(m.group()) for m in _ROW.finditer(low)}


def restored_words(text: str, model: Model) -> set[str]:
    """The distinct words of a text, with those that the channel restores."""
    low = text.lower()
    tokens = low.split()
    out: set[str] = joined_words(tokens, model) if model.lexicon else set()
    for token in set(tokens):
        out |= token_words(token, model)
    return out | row_words(low, model)


def signs(words: set[str]) -> set[str]:
    """The words, and their beginnings with a mark after them."""
    return words | {w[:k] + MARK for w in words for k in BEGINNINGS if len(w) > k}


def _tripled(low: str) -> list[str]:
    """The letters that stand three times in a row, three of each."""
    x = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return [c * 3 for c in map(chr, np.unique(x[2:][(x[2:] == x[1:-1]) & (x[2:] == x[:-2])]).tolist()) if _WORDS.match(c)]


def told_signs(text: str, model: Model) -> set[str]:
    """The signs of a text that have a weight: those of restored_words. Plain words that begin like no such sign are passed over, other tokens looked at once while they are remembered."""
    low, told, weights = text.lower(), model.told, model.weights
    if not told:  # all signs of a word begin with its first three letters
        told[""] = {w.removesuffix(MARK)[: BEGINNINGS[0]] for w in weights}
    heads = told[""]

    def weighed(words: set[str]) -> set[str]:
        some = {w for w in words if w[: BEGINNINGS[0]] in heads}
        return signs(some) & weights.keys() if some else some

    tokens, repeats = low.split(), _tripled(low)
    out = weighed(row_words(low, model) | (joined_words(tokens, model) if model.lexicon else set()))
    distinct = set(tokens)
    repeating = {t for t in distinct for r in repeats if r in t} if repeats else ()
    for token in distinct:
        plain = token if token.isalpha() else token.rstrip(_STOPS)
        if plain[: BEGINNINGS[0]] not in heads and plain.isalpha() and token not in repeating:
            continue  # its one word
        found = told.get(token)
        if found is None:
            if len(told) > 100_000:
                told.clear()
                told[""] = heads
            found = told[token] = weighed(token_words(token, model)) or _NONE
        if found:
            out |= found
    return out


def _llr(n_tox: int, n_clean: int) -> Column:
    """The log-likelihood ratio of a word's presence (n_toxic, n_clean texts) and the label."""
    n, total = F.col("n_toxic") + F.col("n_clean"), float(n_tox + n_clean)

    def term(seen: Column, of: int, every: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen * total / (of * every))).otherwise(0.0)

    return sum((term(F.col(c), of, n) + term(of - F.col(c), of, total - n) for c, of in (("n_toxic", n_tox), ("n_clean", n_clean))), F.lit(0.0))


def _logistic(owner: np.ndarray, sign: np.ndarray, y: np.ndarray, signs: int, ridge: float = 0.5, steps: int = 60, block: int = 512) -> np.ndarray:
    """Ridge logistic regression by Newton steps of y on the presence of signs (pairs of row and sign); the last weight is the constant's.

    Signs that are in the same rows, as a word and its beginnings often are, have the same weight: m of them are one column
    of sqrt(m), which gives the same steps. Rows are bits, a block of them at a time as floats.
    """
    order = np.argsort(sign, kind="stable")
    of = np.split(owner[order], np.cumsum(np.bincount(sign, minlength=signs))[:-1]) if signs else []
    groups: dict[bytes, int] = {}
    group = np.array([*(groups.setdefault(np.unique(rows).tobytes(), len(groups)) for rows in of), len(groups)])
    root = np.sqrt(np.bincount(group))
    x = np.zeros((len(y), len(root)), bool)
    x[owner, group[sign]] = x[:, -1] = True
    w, keep = np.zeros(len(root)), np.full(len(root), ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        curve, slope = np.diag(keep), -keep * w
        for at in range(0, len(y), block):
            part = x[at : at + block] * root
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += (y[at : at + block] - p) @ part
            part *= np.sqrt(p * (1 - p) + 1e-9)[:, None]
            curve += part.T @ part
        move = np.clip(np.linalg.solve(curve, slope) / root, -2, 2)
        w += move * root
        if np.abs(move).max() < 1e-4:
            break
    return (w / root)[group]


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    return F.crc32(F.col(doc_id).cast("string")) % HELD_OUT == 0


def fit(docs: DataFrame, labels: DataFrame, corpus_counts: np.ndarray | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """Count the character model over all docs and learn word weights from labelled rows that are not held out."""
    if corpus_counts is None:
        corpus_counts = np.zeros(LETTERS**3, np.int64)
        for r in trigram_counts(docs).collect():  # at most 28 ** 3 rows
            corpus_counts[r.trigram] = r.n
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).where(~held_out())
    rate = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    prior = math.log((rate.get(True, 0) + 0.5) / (rate.get(False, 0) + 0.5))
    model = Model(language_costs(corpus_counts), {}, prior)
    if not rate.get(True) or not rate.get(False):
        return model
    picked = None
    for kind in (True, False):
        one = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        picked = one if picked is None else picked.unionByName(one)
    # picked has at most 2 * train_rows rows of two small columns
    sample = texts(docs).join(F.broadcast(picked), "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in small_batches(batches, "text"):
            for text, toxic in zip(column_texts(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(signs(restored_words(text, model)) | {""})  # "" counts the texts
        every = list(seen[True] | seen[False])
        yield pa.record_batch([pa.array(every, pa.string()), pa.array([seen[True][w] for w in every], pa.int64()), pa.array([seen[False][w] for w in every], pa.int64())], names=["word", "n_toxic", "n_clean"])

    counted = sample.mapInArrow(words, "word string, n_toxic long, n_clean long").groupBy("word").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    whole = counted.where("word = ''").first()
    if whole is None or not whole.n_toxic or not whole.n_clean:
        return model
    n_tox, n_clean = whole.n_toxic, whole.n_clean
    told = counted.where("word <> ''").where(_llr(n_tox, n_clean) >= LEAST_LLR)  # far fewer than the words of the sample
    chosen = {r.word: r.n_toxic * n_clean > r.n_clean * n_tox for r in told.orderBy("word").collect()}
    toxic_words = [w for w, t in chosen.items() if t and not w.endswith(MARK)]
    model.costs, model.lexicon, chosen = language_costs(corpus_counts, toxic_words), frozenset(toxic_words), list(chosen)
    index = {w: i for i, w in enumerate(chosen)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [sorted(index[w] for w in signs(restored_words(t, model)) if w in index) for t in column_texts(batch, "text")]
            yield pa.record_batch([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    rows = sample.mapInArrow(vectors, "toxic boolean, found array<int>").toArrow()  # bounded like picked
    y, found = rows.column("toxic").to_numpy().astype(float), rows.column("found").combine_chunks()
    w = _logistic(np.repeat(np.arange(len(y)), found.value_lengths().to_numpy()), found.flatten().to_numpy(), y, len(chosen))
    model.weights = {c: float(v) for c, v in zip(chosen, w, strict=False) if abs(v) > 1e-3}
    model.bias = float(w[-1]) + prior - math.log(n_tox / n_clean)  # the sample has its own rate
    return model


def score(text: str, model: Model) -> float:
    z = model.bias + sum(sorted(model.weights[w] for w in told_signs(text, model)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array([score(t, model) for t in column_texts(batch, "text")], pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array([score(t or "", model) < least for t in batch.column("text").to_pylist()], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
