"""Spelling variants: words of the corpus, and the common word that each rare one is a slip of.

Words are counted inside tasks (`packed`), as Latin-1 bytes. Every pair of words at one edit shares two of three
parts: their first letters, their last ones, or some of both; so words are dealt out by these parts, and no pair is
missed. The words of a group are the bits of position indexes: for each position and letter, which words have it
there. A word runs over its group 64 words at a time: the set of words that agree so far, and the sets that agree but
for one replaced, one further or one missing letter, all move one position a step, the last two against an index that
is shifted by one. A pair that shares several parts counts in the first only. Groups over BLOCK words are dealt out in blocks, against
each of which all their words run.

Defined cases: a null or empty text has no words, and a text is read whole, words of any length too. A null doc_id is
written as nothing before the colon. A row is a document, also one that repeats another: its words count again. Among
near words of one n, the first in code-point order is the form. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from ._base import bounded, materialize, read_documents, small_batches
from .tokens import column_bytes, ragged

#: Letters of a word and its occurrences at least, times that a form is more frequent, one run in so many that loses a letter.
LEAST_LENGTH, LEAST_N, TIMES, DROP = 7, 2, 10, 31
#: Words of a block of a large group, and rows and bytes that a task handles together; memory, not results, depends on them.
BLOCK, ROWS, BYTES = 2048, 1 << 16, 4 << 20
#: Pairs of a word and 64 others that are worked on at once.
PAIRS = 1 << 17
#: Bytes of a run after which zlib takes over.
LONG_RUN = 64

_LETTER, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER[65:91] += 32
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial of zlib's crc32."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1)).astype(np.uint32)
    return x


_CRC = _crc_table()


def run_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, going on from its seed (the crc32 of what stands before it)."""
    order = np.argsort(-lengths, kind="stable")
    at, n, state = starts[order], lengths[order], seeds[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-n, -LONG_RUN, side="left"))
    most = int(n[long]) if long < len(n) else 0
    for k in range(most):
        alive = slice(long, int(np.searchsorted(-n, -k, side="left")))
        s = state[alive]
        state[alive] = _CRC[(s ^ data[at[alive] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(n), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), int(seeds[i]))
    return out


def latin_words(values: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The corpus words of a column of texts as Latin-1 bytes, with their starts and lengths: A-Z lower-cased, one in DROP without a letter, seven letters or more."""
    data, offsets = column_bytes(values)
    size = int(offsets[-1])
    data = _LOWER[data[:size]]
    lead = data == _LEAD
    starts, lengths, owner = packed.spans(_LETTER[data] | lead | np.append(False, lead[:-1]), offsets)
    leads = np.append(0, np.cumsum(lead))
    use = lengths - (leads[starts + lengths] - leads[starts]) >= LEAST_LENGTH
    starts, lengths, owner = starts[use], lengths[use], owner[use]
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], dtype=np.uint32)
    h = run_crcs(data, starts, lengths, seeds[owner]).astype(np.int64)
    at = ragged(starts, lengths)
    code = np.where(np.append(False, lead[:-1])[at], data[at] + np.uint8(0x40), data[at])[~lead[at]]
    lengths = lengths - (leads[starts + lengths] - leads[starts])
    first = np.cumsum(lengths) - lengths
    hit = h % DROP == 0
    keep = np.ones(len(code), bool)
    keep[first[hit] + h[hit] % lengths[hit]] = False
    code, lengths = code[keep], lengths - hit
    first = np.cumsum(lengths) - lengths
    use = lengths >= LEAST_LENGTH
    return packed.padded(code), first[use], lengths[use]


def latin_strings(code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Slices of Latin-1 bytes as an Arrow column."""
    code = code[ragged(starts, lengths)]
    wide = code >= 0xC0
    ends = np.cumsum(1 + wide)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = np.where(wide, code - np.uint8(0x40), code)
    out[ends[wide] - 2] = _LEAD
    cuts = np.append(0, np.cumsum(lengths))
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(np.append(0, ends)[cuts].astype(np.int32)), pa.py_buffer(out))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all words that occur LEAST_N times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            code, starts, lengths = latin_words(batch.column("text"), batch.column("doc_id"))
            none = np.zeros(len(starts), np.int64)
            for r in packed.count(code, starts, lengths, none, none):
                yield pa.record_batch([latin_strings(code, r.start, r.length), pa.array(r.n)], names=["word", "n"])

    named = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


# Parts of words. A pair's shorter word has m letters, the other m or m + 1; one edit leaves p first and s last letters
# alike with p + s >= m - 1. With a = 2 m // 3: p >= a (FRONT), or s >= a (BACK), or p and s are both m - a or more (ENDS).
FRONT, BACK, ENDS = 0, 1, 2


def _parts(words: DataFrame) -> DataFrame:
    """m, kind, part of each word: as the shorter (or equally long) and as the longer word of a pair."""
    size = F.char_length("word")
    x = words.withColumn("m", F.explode(F.array(size, size - 1))).where(F.col("m") >= LEAST_LENGTH)
    a = (2 * F.col("m") / 3).cast("int")
    front, back = lambda n: F.left("word", n), lambda n: F.right("word", n)
    parts = [(FRONT, front(a)), (BACK, back(a)), (ENDS, F.concat(front(F.col("m") - a), back(F.col("m") - a)))]
    return x.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.xxhash64(p).alias("part")) for k, p in parts]))).select("word", "n", "m", "x.kind", "x.part")


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latin-1 bytes of all words one after the other, each word's start and length."""
    data, offsets = column_bytes(words)
    data = data[: offsets[-1]]
    lead = data == _LEAD
    leads = np.append(0, np.cumsum(lead))
    code = np.where(np.append(False, lead[:-1]), data + np.uint8(0x40), data)[~lead] if len(data) else data
    cuts = offsets - leads[offsets]
    return code, cuts[:-1], np.diff(cuts)


def _letter_class(code: np.ndarray) -> np.ndarray:
    """0: no letter (after a word's end), 1-26: a-z, 27-90: U+00C0 to U+00FF."""
    return np.where(code >= 0xC0, code - np.uint8(0xC0 - 27), np.where(code >= 97, code - np.uint8(96), np.uint8(0)))


def near_pairs(letters: np.ndarray, lengths: np.ndarray, member_lane: np.ndarray, member_bit: np.ndarray, member: np.ndarray, query: np.ndarray, query_lane: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) words at one edit, of lengths m and m or m + 1, by bit-sliced position indexes.

    letters: a row of m + 2 letter classes for each word. A lane holds 64 members; (query, query_lane) are the runs
    of a word over a lane.
    """
    lanes = int(member_lane.max()) + 1 if len(member_lane) else 0
    table = np.full((lanes, 64), -1, np.int64)
    table[member_lane, member_bit] = member

    def index(at: int) -> np.ndarray:
        """The members of each lane with each letter at a position."""
        out = np.zeros((91, lanes), np.uint64)
        row = np.arange(lanes)
        letter = np.where(table >= 0, letters[table, at], np.uint8(0))
        for bit in range(64):
            out[letter[:, bit], row] |= np.uint64(1 << bit)
        return out

    def members(condition: np.ndarray) -> np.ndarray:
        bits = np.where(table >= 0, condition[table], False)
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)

    short, long = members(lengths == m)[query_lane], members(lengths == m + 1)[query_lane]
    of_m = lengths[query] == m  # these meet members of m and m + 1 letters, the longer ones those of m letters
    same = short | long  # agree so far
    replaced, further, missing = np.zeros_like(same), np.zeros_like(same), np.zeros_like(same)
    further |= same  # the member's first letter is the further one
    found = np.zeros_like(same)
    before, here, after = None, index(0), index(1)
    for at in range(m + 1):
        if not (same.any() or replaced.any() or further.any() or missing.any()):
            break
        letter = letters[query, at]
        agree = here[letter, query_lane]
        new_missing = same if before is None else (missing & before[letter, query_lane]) | same
        replaced = (replaced & agree) | (same & ~agree)
        same = same & agree
        further = (further & after[letter, query_lane]) | same
        missing = new_missing
        if at == m - 1:
            found = np.where(of_m, (replaced & short) | (further & long), np.uint64(0))
        before, here, after = here, after, index(at + 2) if at + 2 < letters.shape[1] else np.zeros_like(after)
    found |= np.where(of_m, np.uint64(0), missing & short)
    rows = np.flatnonzero(found)
    pair, bit = np.nonzero(np.unpackbits(found[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[rows[pair]], table[query_lane[rows[pair]], bit]


def _alike(code: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, step: int) -> np.ndarray:
    """Whether the n letters from places a and b on, forwards or backwards, are alike."""
    out = np.ones(len(a), bool)
    for k in range(n):
        out &= code[a + step * k] == code[b + step * k]
    return out


def _group_near(words: pa.Array, n: np.ndarray, m: int, kind: int, group: np.ndarray, role: np.ndarray) -> pa.RecordBatch | None:
    """word, n_near, form_n, form of the words of groups (numbers that never fall) of one m and kind that have near words there.

    role 0: a word is both member and query of its group; 1: member; 2: query.
    """
    code, starts, lengths = _codes(words)
    width = m + 2
    place = np.arange(width)[None, :]
    letters = np.where(place < lengths[:, None], _letter_class(np.append(code, np.uint8(0)))[np.minimum(starts[:, None] + place, len(code))], np.uint8(0))
    is_member, queries = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    size = np.bincount(group[is_member], minlength=int(group[-1]) + 1)
    lanes_of = -(-size // 64)
    first_lane = np.cumsum(lanes_of) - lanes_of
    inside = np.arange(len(is_member)) - (np.cumsum(size) - size)[group[is_member]]
    lane = first_lane[group[is_member]] + inside // 64
    runs = lanes_of[group[queries]]
    ends = np.cumsum(runs)
    q_out, v_out, done = [], [], 0
    while done < len(queries):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
        query = np.repeat(queries[done:upto], runs[done:upto])
        at = ragged(first_lane[group[queries[done:upto]]], runs[done:upto])
        done = upto
        if not len(at):
            continue
        low, high = int(at.min()), int(at.max()) + 1
        use = slice(int(np.searchsorted(lane, low)), int(np.searchsorted(lane, high)))
        q, v = near_pairs(letters, lengths, lane[use] - low, inside[use] % 64, is_member[use], query, at - low, m)
        q_out.append(q)
        v_out.append(v)
    q, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (q_out, v_out))
    a = 2 * m // 3
    front, back = _alike(code, starts[q], starts[v], a, 1), _alike(code, starts[q] + lengths[q] - 1, starts[v] + lengths[v] - 1, a, -1)
    ends_alike = _alike(code, starts[q], starts[v], m - a, 1) & _alike(code, starts[q] + lengths[q] - 1, starts[v] + lengths[v] - 1, m - a, -1)
    here = (front, back & ~front, ends_alike & ~front & ~back)[kind]
    q, v = q[here], v[here]
    if not len(q):
        return None
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((pa.compute.rank(words, "ascending", tiebreaker="dense").to_numpy(), -n))] = np.arange(len(words))
    order = np.lexsort((rank[v], q))
    q, v = q[order], v[order]
    at = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    return pa.record_batch([words.take(pa.array(q[at])), pa.array(np.diff(np.append(at, len(q)))), pa.array(n[v[at]]), words.take(pa.array(v[at]))], names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, block: int = BLOCK, most_rows: int = ROWS) -> DataFrame:
    """word, n_near, form_n, form: how many words are one edit away, and the most frequent of them. words: word, n, each word once."""
    parts = _parts(words)
    key = ["m", "kind", "part"]
    large = parts.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    x = parts.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    one = F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("role")))
    own = F.array(F.struct(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role")))
    runs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(2).alias("role")))
    x = x.withColumn("x", F.explode(F.when(F.col("blocks") == 1, one).otherwise(F.concat(own, runs)))).select("word", "n", *key, "x.block", "x.role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """The results of all whole groups held; of the last one, unless it ends here, the queries so far, whose members stay."""
            nonlocal held, rows, size
            t = pa.Table.from_batches(held).combine_chunks()
            if not t.num_rows:
                return
            cols = {c: t.column(c).to_numpy() for c in ("m", "kind", "part", "block", "role", "n")}
            change = np.append(True, np.any([cols[c][1:] != cols[c][:-1] for c in ("m", "kind", "part", "block")], axis=0))
            group = np.cumsum(change) - 1
            tail = int(np.flatnonzero(change)[-1])
            stay, end = np.arange(0), len(group)
            if not last:
                if cols["role"][tail] == 0:  # at most BLOCK rows: they wait for the rest
                    stay, end = np.arange(tail, len(group)), tail
                else:
                    stay = tail + np.flatnonzero(cols["role"][tail:] == 1)
                    end = len(group) if cols["role"][-1] == 2 else tail
            use = np.flatnonzero((np.bincount(group)[group] > 1)[:end])  # a word alone has no near one
            words, group, cols = t.column("word").combine_chunks().take(pa.array(use)), group[use], {c: x[use] for c, x in cols.items()}
            section = np.flatnonzero(np.append(True, (cols["m"][1:] != cols["m"][:-1]) | (cols["kind"][1:] != cols["kind"][:-1]))) if len(use) else use
            for lo, hi in zip(section, np.append(section[1:], len(use))[: len(section)], strict=True):
                got = _group_near(words.slice(lo, hi - lo), cols["n"][lo:hi], int(cols["m"][lo]), int(cols["kind"][lo]), np.cumsum(np.diff(group[lo:hi], prepend=group[lo]) > 0), cols["role"][lo:hi])
                if got is not None:
                    yield got
            held = t.take(pa.array(stay)).to_batches() if len(stay) else []
            rows = size = len(stay)

        for batch in small_batches(batches, "word"):
            for at in range(0, batch.num_rows, most_rows):
                held.append(batch.slice(at, most_rows))
                rows += held[-1].num_rows
                size += held[-1].nbytes
                if rows >= most_rows or size >= BYTES:
                    yield from flush(last=False)
        if held:
            yield from flush(last=True)

    dealt = x.repartition("m", "kind", "part", "block").sortWithinPartitions("m", "kind", "part", "block", "role")
    found = bounded(dealt).mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.word").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: each step doubles the reach. A form is TIMES as frequent, so a chain has fewer than 20 links."""
    reach = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(reach.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reach = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            break
    return reach


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialize(vocabulary(docs), "words")
    near = materialize(near_words(words), "near-words")
    is_form: Column = F.col("form_n") >= TIMES * F.col("n")
    every = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    root = roots(every.where("form is not null"))
    return every.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_documents(spark, sf_dir))
