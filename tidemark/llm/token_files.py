"""Token ids on disk, compressed by Re-Pair grammars.

Documents are encoded in ascending doc_id order and cut into shards of a bounded number of ids. In each shard
the most frequent pairs of neighbouring ids are replaced by new ids (nonterminals), and again among the new
ids, until no pair is frequent. A shard stores its rules, the length of each rule's expansion, and the shortened sequence, so
that a reader finds any range of ids by its running expansion lengths and expands only what it needs.

A round replaces many pairs that do not overlap (the counts are taken anew in each round) where Re-Pair in its first
form replaces one; the grammar and what it decodes to are of the same kind.

Defined cases: a null or empty text has only the end id. A very long text goes over as many shards as it needs; of
equally frequent pairs that overlap the one of the higher bucket of hashes is replaced first. Rows with equal doc_ids are kept, in the order of their
texts. An empty table gives no shards and an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import new_table, partition_id, partition_offsets, read_documents, sized_join, small_batches, texts
from .tokens import default_tokenizer, encoder, ragged

#: Ids in a shard at most (one longer document is a shard of its own), least count of a replaced pair, bits of a bucket (they follow the places counted).
SHARD_IDS, LEAST, BUCKETS, LEAST_BITS = 1 << 20, 8, 20, 10
_SHARDS = "part int, shard int, base long, rounds array<int>, rules binary, expansion binary, sequence binary, width int, doc_ids array<long>, lengths array<long>, before long, n_ids long"


def grammar(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The shortened sequence, rules (two ids each; rule k is the id base + k), expansion lengths, rules of each round.

    It ends when no pair of neighbours occurs `least` times. A round replaces every frequent pair wherever no more
    frequent one overlaps it, so the most frequent pair goes wherever it stands (in a run of one id, every second time).
    A round makes pairs with new ids only and takes others away, so a pair that is rare once stays rare: only `live`
    places, those of frequent pairs and beside new ids, are counted again.
    """
    seq = ids.astype(np.uint32)
    rules, lengths, made = np.zeros((0, 2), dtype=np.uint32), np.zeros(0, dtype=np.int64), []
    live = np.arange(len(seq) - 1)
    while len(live):
        # a pair in a bucket of too few is too rare itself; a bucket counts for one of its pairs, others are sorted
        bits = min(BUCKETS, max(LEAST_BITS, len(live).bit_length()))
        left, right = seq[live], seq[live + 1]
        h = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64)
        some = np.flatnonzero((np.bincount(h, minlength=1 << bits) >= least)[h])
        at, pair, value = live[some], h[some], left[some].astype(np.uint64) << np.uint64(32) | right[some]
        pairs = np.zeros(1 << bits, dtype=np.uint64)
        pairs[pair] = value
        other = np.flatnonzero(pairs[pair] != value)
        others, which = np.unique(value[other], return_inverse=True)
        pair[other] = len(pairs) + which
        pairs = np.append(pairs, others)
        n = np.bincount(pair, minlength=len(pairs))
        frequent = np.flatnonzero(n >= least)
        if not len(frequent):
            break
        frequent = frequent[np.argsort(n[frequent], kind="stable")]
        rank = np.zeros(len(n), dtype=np.int32)
        rank[frequent] = np.arange(1, len(frequent) + 1)
        r = rank[pair]
        often = np.flatnonzero(r)
        at, r = at[often], r[often]
        again = np.zeros(len(seq), dtype=bool)
        again[at] = True
        # in a run of one id each second occurrence overlaps the one before it
        follows = np.flatnonzero((at[1:] - at[:-1] == 1) & (r[1:] == r[:-1])) + 1
        if len(follows):
            begins = np.flatnonzero(np.append(True, np.diff(follows) != 1))
            nth = ragged(np.zeros(len(begins), dtype=np.int64), np.diff(np.append(begins, len(follows))))
            r[follows[nth % 2 == 0]] = 0
        around = np.zeros(len(seq) + 2, dtype=np.int32)
        around[at + 1] = r
        best = np.flatnonzero((r > around[at]) & (r > around[at + 2]))
        at, r = at[best], r[best]
        use = np.bincount(r, minlength=len(frequent) + 1) > 1  # a rule for one place saves nothing
        used = use[r]
        at, pair = at[used], (np.cumsum(use) - 1)[r[used]]
        if not len(at):
            break
        new = pairs[frequent[use[1:]]]
        new = np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        size = np.concatenate([np.ones(1, dtype=np.int64), lengths])
        whole = size[np.maximum(new.astype(np.int64) - base + 1, 0)].sum(axis=1)
        seq[at] = base + len(rules) + pair
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        again[np.maximum(at - 1, 0)] = again[at] = True
        seq, live = seq[keep], np.flatnonzero(again[keep])
        live = live[: np.searchsorted(live, len(seq) - 1)]
        lengths, rules = np.append(lengths, whole), np.concatenate([rules, new])
        made.append(len(new))
    return seq, rules, lengths, made


def expand(seq: np.ndarray, base: int, rules: np.ndarray, made: list[int]) -> np.ndarray:
    """The ids of a sequence. For one longer than the rules each rule is spelt once and then looked up."""
    if len(seq) <= len(rules) or not len(rules):
        return _undo(seq, base, rules, made)
    spelt = np.concatenate([np.arange(base, dtype=np.uint32), _undo(np.arange(base, base + len(rules), dtype=np.uint32), base, rules, made)])
    size, end = np.ones(base + len(rules), dtype=np.int64), base
    for n in made:
        size[end : end + n] = size[rules[end - base : end - base + n]].sum(axis=1)
        end += n
    return spelt[ragged((np.cumsum(size) - size)[seq], size[seq])]


def _undo(seq: np.ndarray, base: int, rules: np.ndarray, made: list[int]) -> np.ndarray:
    """The ids of a sequence: the last round's rules are undone first."""
    end = len(rules)
    for n in reversed(made):
        at = np.flatnonzero((seq >= base + end - n) & (seq < base + end))
        rule = rules[seq[at].astype(np.int64) - base]
        counts = np.ones(len(seq), dtype=np.int64)
        counts[at] = 2
        place = np.cumsum(counts) - counts
        seq = np.repeat(seq, counts)
        seq[place[at]], seq[place[at] + 1] = rule[:, 0], rule[:, 1]
        end -= n
    return seq


def read_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """The shard's ids from start to stop, expanding only the symbols that cover them."""
    seq = np.frombuffer(shard["sequence"], dtype=f"<u{shard['width']}").astype(np.uint32)
    rules = np.frombuffer(shard["rules"], dtype="<u4").reshape(-1, 2)
    lengths = np.frombuffer(shard["expansion"], dtype="<u4").astype(np.int64)
    base, counts = shard["base"], np.ones(len(seq), dtype=np.int64)
    if len(lengths):
        counts = np.where(seq < base, 1, lengths[np.maximum(seq.astype(np.int64) - base, 0)])
    ends = np.cumsum(counts)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    before = int(ends[a - 1]) if a else 0
    return expand(seq[a:b], base, rules, list(shard["rounds"]))[start - before : stop - before]


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Write the shards of all documents, in ascending doc_id order, as rows of Parquet files."""
    file = tokenizer or default_tokenizer()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(file), partition_id()
        base = encode.tokenizer.get_vocab_size()
        held: list[tuple[int, np.ndarray]] = []
        count = before = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count, before, number
            ids = np.concatenate([x for _, x in held])
            seq, rules, lengths, made = grammar(ids, base)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            row = {"part": part, "shard": number, "base": base, "rounds": made, "rules": rules.astype("<u4").tobytes(), "expansion": lengths.astype("<u4").tobytes(), "sequence": seq.astype(f"<u{width}").tobytes(), "width": width, "doc_ids": [d for d, _ in held], "lengths": [len(x) for _, x in held], "before": before, "n_ids": len(ids)}
            before, number, held, count = before + len(ids), number + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in small_batches(batches, "text"):
            ids, n = encode.encode(batch.column("text"))
            end = np.cumsum(n)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), (end - n).tolist(), end.tolist(), strict=True):
                if held and count + b - a + 1 > shard_ids:
                    yield flush()
                held.append((doc, np.append(ids[a:b], np.uint32(end_id))))
                count += b - a + 1
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int64()), ("rounds", pa.list_(pa.int32())), ("rules", pa.binary()), ("expansion", pa.binary()), ("sequence", pa.binary()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("before", pa.int64()), ("n_ids", pa.int64())])
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, _SHARDS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                whole = read_range(shard, 0, shard["n_ids"])
                n = np.array(shard["lengths"], dtype=np.int64)
                end = np.cumsum(n)
                raw = memoryview(whole.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
                yield pa.record_batch([pa.array(shard["doc_ids"], pa.int64()), pa.array(np.full(len(n), shard["part"], dtype=np.int32)), pa.array(shard["before"] + end - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "within", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(_SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = partition_offsets(totals, "part", "n", "base")
    rows = shards.mapInArrow(decode, "doc_id long, part int, within long, n_tokens long, ids_crc32 long")
    return sized_join(rows, base, ["part"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table(spark, "token-files")
    write_token_files(read_documents(spark, sf_dir), path)
    return read_token_files(spark, path)
