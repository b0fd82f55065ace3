"""MinHash near-duplicates with tensored banding.

A document's set has its distinct shingles of `shingle` words. Two small collections of GROUPS minhash tuples of
ROWS hashes are computed; a table's key combines one tuple of the first collection with one of the second, so 120
tables of 5 hashes need only 56 minhashes, about the square root of what as many independent tables would take.
Two sets of similarity 0.8 share no table with probability (1 - 0.8 ** 3) ** 12 + (1 - 0.8 ** 2) ** 10, about
0.0002; sets of 0.85 with 0.00002.

Documents with equal sets are one class. Among classes, links are confirmed on the full sets:

1. In a table's group of at most SMALL members all pairs are candidates, in a larger one each member with the group's
   smallest, its pivot. Candidates pass two exact bounds (the sizes, and the number of differing parity bits, which
   cannot exceed the number of differing shingles). Each document's nearest candidate is compared first, the rest
   only if the components still differ.
2. A larger group that still holds several components is divided exactly, without meeting all its pairs: each member
   becomes its difference from a reference document, and members that link must share one of the first shingles of
   their differences, rarest first. Those shingles are the keys of new groups, whose members are paired where their
   differences can still share enough shingles; of a group beyond LARGE again each member with a pivot, and so on.

No pair of a group is lost on the way, only pairs that share no table are not seen. Components are found by large
and small stars over the links of components, so that later turns see only what is new.

Defined cases: null and empty texts and texts of white space have empty sets and link with nothing, equal ones
neither. Texts with fewer words than `shingle` have their whole sequence as one shingle; very long texts are taken
whole. Repeated rows are one class, and rows of other texts under one doc_id share its component. Equally near
candidates go by the smaller doc_id. A row without a doc_id joins the component of its set and is kept only if there is
none. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import among, bounded, discard, materialize, read_documents, small_batches, texts
from .tokens import ragged
from .words import SOLID, mix, words

#: Tuples and hashes in a tuple of both collections; parity words; members of a small table group and of a new group
#: that are paired within; seconds of a first in a part; tuples of the first collection whose tables are made at a time;
#: buckets of keys for each partition.
GROUPS, ROWS, PARITY, SMALL, LARGE, PART, TUPLES, BUCKETS = (12, 10), (3, 2), 16, 16, 1024, 256, 4, 8
HASHES = GROUPS[0] * ROWS[0] + GROUPS[1] * ROWS[1]
_SEEDS = np.random.default_rng(99).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "doc_id long, n long, s1 long, s2 long, tuples binary, parity array<long>"


def shingle_sets(values: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each value, sorted, one value after the other, and their number."""
    h, _, n = words(values, SOLID)
    first = np.cumsum(n) - n
    counts = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    end = np.cumsum(counts)
    with np.errstate(over="ignore"):
        every = np.zeros(max(0, len(h) - shingle + 1), np.uint64)  # also those over the ends of values, which are left out
        for k in range(shingle):
            every = mix(every * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(every)] + np.uint64(k + 1))
        at, short = ragged(first, counts), np.flatnonzero((n > 0) & (n < shingle))
        if len(short):
            at[end[short] - 1] = 0
        key = every[at] if len(every) else np.zeros(len(at), np.uint64)
        for size in np.unique(n[short]).tolist():
            of = short[n[short] == size]
            one = np.zeros(len(of), np.uint64)
            for k in range(size):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + h[first[of] + k] + np.uint64(k + 1))
            key[end[of] - 1] = one
    for lo, hi in zip((end - counts).tolist(), end.tolist(), strict=True):
        if hi - lo > 1:
            key[lo:hi].sort()
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    new[(end - counts)[counts > 0]] = True
    return key[new], np.diff(np.append(0, np.cumsum(new))[np.append(0, end)])


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """For each document the size of its set, two hashes of the whole set, the tuples of both collections packed, and parity bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 18):  # whose sets stay in the cache
            key, n = shingle_sets(batch.column("text"), shingle)
            some = n > 0
            rows, doc = (np.cumsum(n) - n)[some], np.repeat(np.arange(len(n)), n)
            sums, mins = np.zeros((2, len(n)), np.uint64), np.zeros((len(_SEEDS), len(n)), np.uint64)
            bit = (mix(key) >> np.uint64(54)).astype(np.int64) % (PARITY * 64)
            parity = np.bincount(doc * (PARITY * 64) + bit, minlength=len(n) * PARITY * 64).reshape(len(n), PARITY * 64)
            if len(key):
                v, u = np.empty_like(key), np.empty_like(key)
                with np.errstate(over="ignore"):
                    for k in range(2):
                        sums[k, some] = np.add.reduceat(mix(key + _SEEDS[k]), rows)
                    for k, seed in enumerate(_SEEDS):
                        np.multiply(key, seed, out=v)
                        np.right_shift(v, np.uint64(31), out=u)
                        np.bitwise_xor(v, u, out=v)
                        mins[k, some] = np.minimum.reduceat(v, rows)
            with np.errstate(over="ignore"):
                tuples, at = [], 0
                for groups, rows_of in zip(GROUPS, ROWS, strict=True):
                    part, t = mins[at : at + groups * rows_of].reshape(groups, rows_of, -1), np.zeros((groups, len(n)), np.uint64)
                    for k in range(rows_of):
                        t = mix(t * np.uint64(0x9E3779B97F4A7C15) + part[:, k])
                    tuples.append(t)
                    at += groups * rows_of
            bits = np.packbits((parity & 1).astype(np.uint8), axis=1).view("<i8") if len(n) else np.zeros((0, PARITY), np.int64)
            both = np.concatenate(tuples).T.tobytes()
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(0, 8 * sum(GROUPS) * len(n) + 1, 8 * sum(GROUPS), dtype=np.int32)), pa.py_buffer(both)])
            listed = pa.ListArray.from_arrays(np.arange(0, bits.size + 1, PARITY, dtype=np.int32), bits.ravel())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), packed, listed], names=["doc_id", "n", "s1", "s2", "tuples", "parity"])

    return texts(docs).mapInArrow(sign, _SIGNED)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes but the smallest ones, of links a, b between different nodes.

    Large and small stars in turn: each node's neighbours are tied to the least of them, until all edges lead to a
    component's smallest node. The edges shrink with each turn. links is read twice.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select("u", F.col("m").alias("v")).unionByName(tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.distinct(), "small-stars")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _labelled(df: DataFrame, label: DataFrame | None, node: str, name: str) -> DataFrame:
    """df with the component of the column `node`; a node without a label is a component of its own."""
    if label is None:
        return df.withColumn(name, F.col(node))
    found = label.select(F.col("node").alias(node), F.col("component").alias("_c"))
    return df.join(found, node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")


def _relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The labels after new links: only the links' components are looked at again."""
    ends = _labelled(_labelled(links.select("a", "b"), label, "a", "x"), label, "b", "y").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    ends = materialize(ends.distinct(), "links")
    if ends.isEmpty():
        return label
    new = components(ends)
    if label is None:
        return new
    moved = label.join(new.select(F.col("node").alias("component"), F.col("component").alias("_n")), "component", "left").select("node", F.coalesce("_n", "component").alias("component"))
    return materialize(moved.unionByName(new), "labels")


def _repeated(classes: DataFrame, lefts: range) -> DataFrame:
    """key, node: a row for each class and table of the given tuples of the first collection, if its key has another row.

    Nearly all keys occur once. They are dealt out packed, a row for all keys of a batch that belong to one bucket, and
    those of a bucket are sorted in numpy, so that only repeated ones become rows.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, table = min(BUCKETS * parts, 1 << 16), mix(np.arange(1, GROUPS[0] * GROUPS[1] + 1, dtype=np.uint64))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tuples = np.frombuffer(b"".join(batch.column("tuples").to_pylist()), np.uint64).reshape(-1, sum(GROUPS))
            with np.errstate(over="ignore"):
                key = np.concatenate([mix(tuples[:, i] * np.uint64(0x9E3779B97F4A7C15) + tuples[:, GROUPS[0] + j] + table[i * GROUPS[1] + j]) for i in lefts for j in range(GROUPS[1])])
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)
            order, counts = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)
            some = np.flatnonzero(counts)
            ends = np.append(0, 8 * np.cumsum(counts[some])).astype(np.int32)
            packed = [pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(x[order])]) for x in (key, np.tile(batch.column("node").to_numpy(), len(key) // batch.num_rows))]
            yield pa.record_batch([pa.array(some), *packed], names=["bucket", "keys", "nodes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []

        def found() -> pa.RecordBatch:
            key, node = (np.concatenate([np.frombuffer(x[k], kind) for x in held]) for k, kind in enumerate((np.uint64, np.int64)))
            order = np.argsort(key)
            key, node = key[order], node[order]
            same = key[1:] == key[:-1]
            some = np.append(same, False) | np.append(False, same)
            return pa.record_batch([pa.array(key[some].view(np.int64)), pa.array(node[some])], names=["key", "node"])

        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != of and held:
                    yield found()
                    held = []
                of = bucket
                held.append([batch.column(c)[k].as_buffer() for c in ("keys", "nodes")])
        if held:
            yield found()

    dealt = bounded(classes).select("node", "tuples").mapInArrow(pack, "bucket long, keys binary, nodes binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(meet, "key long, node long"), "repeated")


def _grouped(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """key, c, node, n, bits and the group's smallest member p of the groups of two members and more.

    The join is a merge at any size, as both sides grow with the input. p is joined to the groups, of which there are fewer than members.
    """
    side = classes.select("node", "n", F.col("parity")[0].alias("bits"))
    pivots = side.groupBy("node").agg(F.min(F.struct("node", "n", "bits")).alias("p"))  # several if a doc_id has other texts
    groups = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c > 1")
    groups = materialize(groups.join(pivots.hint("merge"), "node").drop("node"), "groups")
    out = materialize(rows.join(groups.hint("merge"), "key").join(side, "node"), "members")
    discard(groups)
    return out


def _bound(a: str, b: str, bits: str) -> str:
    """The exact bounds: sizes, and differing parity bits against the largest symmetric difference."""
    return f"100 * least({a}n, {b}n) >= 80 * greatest({a}n, {b}n) and 9 * ({bits}) <= {a}n + {b}n"


def _apart(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """The pairs of different components."""
    return materialize(_labelled(_labelled(pairs, label, "a", "ca"), label, "b", "cb").where("ca <> cb").select("a", "b"), "pairs")


def _mixed(now: DataFrame) -> DataFrame:
    """a, b: the members b of groups with several components; a is the root of the group's largest component, or what is given as a."""
    counts = now.groupBy("key", "component").agg(F.count("*").alias("c"))
    groups = counts.groupBy("key").agg(F.max(F.struct("c", -F.col("component"))).alias("m"), F.count("*").alias("k")).where("k > 1").select("key", (-F.col("m.col2")).alias("root"))
    reference = "a" if "a" in now.columns else "root"
    return materialize(now.join(groups, "key").select(F.col(reference).alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "families")


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, far: the pairs that pass the exact bounds with all parity bits."""
    side = classes.select("node", F.struct("n", "parity").alias("x"))
    found = pairs.join(side.select(F.col("node").alias("a"), "x"), "a").join(side.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
    differ = " + ".join(f"bit_count(x.parity[{k}] ^ y.parity[{k}])" for k in range(PARITY))
    return found.where(_bound("x.", "y.", differ)).select("a", "b", (F.expr(differ) / F.expr("x.n + y.n")).alias("far"))


def candidates(members: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, far: pairs a < b that pass the bounds; of a group of at most SMALL members all, of a larger one each member with the pivot."""
    small = members.where(F.col("c") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("node", "n", "bits"))).alias("g"))
    pairs = f"flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, {SMALL}), y -> y.node <> x.node and {_bound('x.', 'y.', 'bit_count(x.bits ^ y.bits)')}), y -> struct(x.node as a, y.node as b))))"
    near = small.select(F.explode(F.expr(pairs)).alias("x")).select("x.a", "x.b")
    star = members.where(F.col("c") > SMALL).where("node <> p.node").where(_bound("p.", "", "bit_count(p.bits ^ bits)")).select(F.col("p.node").alias("a"), F.col("node").alias("b"))
    return _sketched(near.unionByName(star).distinct(), classes)


def compared(pairs: DataFrame, partners: DataFrame, shingle: int, deltas: bool = False) -> DataFrame:
    """a, b, linked, n_a, n_b of the pairs, from the full sets; with deltas also the shingles that only one of them has.

    The texts are sorted by the first of a pair, so its set is made once; a first with many seconds is dealt out.
    """
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    seconds = pairs.join(heads, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    firsts = heads.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    rows = seconds.unionByName(firsts).join(partners, "node")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", "role").select("a", "part", "role", "node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sets = None, []
        for batch in small_batches(batches, "text"):
            key, n = shingle_sets(batch.column("text"), shingle)
            end, out = np.cumsum(n).tolist(), []
            for a, part, role, node, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "node")), [0, *end], end, strict=False):
                own = key[lo:hi]
                if (a, part) != of:
                    of, sets = (a, part), []
                if not role:
                    sets.append(own.copy())  # several if rows with other texts repeat its doc_id
                    continue
                for head in sets:
                    at = np.searchsorted(head, own)
                    at[at == len(head)] = 0
                    both = int((head[at] == own).sum()) if len(head) else 0
                    linked = both > 0 and 100 * both >= 80 * (len(head) + len(own) - both)
                    out.append((a, node, linked, len(head), len(own), np.setxor1d(head, own, assume_unique=True).view(np.int64) if deltas else None))
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["a", "b", "linked", "n_a", "n_b", "delta"])

    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return rows.mapInArrow(compare, "a long, b long, linked boolean, n_a long, n_b long, delta array<long>")


def _links(pairs: DataFrame, partners: DataFrame, shingle: int) -> DataFrame:
    return compared(pairs, partners, shingle).where("linked").select("a", "b")


def divided(family: DataFrame, classes: DataFrame, partners: DataFrame, label: DataFrame | None, shingle: int) -> tuple[DataFrame, DataFrame | None]:
    """New groups of the members b of families about a reference a, and the labels after links to the references.

    A member is taken as its difference from the reference, d shingles that only one of both has. If x and y link,
    their differences share (d of x + d of y - (|x| + |y|) / 9) / 2 shingles at least; so a shingle stands among the
    first ones of both, in any one order, rarest first here (prefix filtering). The member with the smaller
    difference needs few first ones (short), the other more (long); members of the reference's component (near) need
    no partners of their own kind. Each such shingle makes a group. Shingles that occur once in a family, or in near
    members only, take the first places and make no group, which leaves few of a family of copies with changes of
    their own.
    """
    found = compared(family, partners, shingle, deltas=True).withColumn("v", F.xxhash64("delta"))
    found = materialize(found.dropDuplicates(["a", "b", "v"]), "differences")  # v tells rows of one doc_id apart
    label = _relabelled(label, found.where("linked").select("a", "b"))
    found = _labelled(_labelled(found.where("size(delta) > 0"), label, "a", "ca"), label, "b", "cb").withColumn("near", F.col("ca") == F.col("cb"))
    d = F.size("delta")
    # 18 times the least overlap with a partner outside the reference's component (so further from it than a link),
    # with any partner, and with one whose difference is no smaller
    outside, any_of, longer = 9 * d + F.col("n_a") - F.col("n_b") + 1, 9 * d + 8 - F.col("n_a") - F.col("n_b"), 18 * d - F.expr("n_b * 18 div 8")
    rest = lambda x: d - F.greatest(F.lit(1), F.ceil(x / 18))
    found = found.withColumn("long", rest(F.when(F.col("near"), outside).otherwise(F.least(any_of, outside)))).withColumn("short", rest(F.when(F.col("near"), F.greatest(longer, outside)).otherwise(longer)))
    found = materialize(found.select("a", "b", "v", "near", "long", "short", d.alias("d"), F.explode("delta").alias("e")), "difference-shingles")
    often = found.groupBy("a", "e").agg(F.count("*").alias("f"), F.sum((~F.col("near")).cast("int")).alias("out")).where("f > 1 and out > 0")
    order = Window.partitionBy("a", "b", "v").orderBy("f", "e")
    of = Window.partitionBy("a", "b", "v")
    placed = found.join(often, ["a", "e"]).withColumn("place", F.row_number().over(order) - 1 + F.col("d") - F.count("*").over(of))
    kept = placed.where("place <= greatest(long, short)").select(F.xxhash64("a", "e").alias("key"), F.col("b").alias("node"), "d", "place", "near", F.expr("place <= long").alias("long"), F.expr("place <= short").alias("short"))
    kept = materialize(kept, "placed")
    discard(found)
    open_ = kept.groupBy("key").agg(F.expr("count_if(short)").alias("s"), F.expr("count_if(long)").alias("l"), F.expr("count_if(not near)").alias("o"), F.count("*").alias("c"), F.min("node").alias("pivot"), F.max("node").alias("high")).where("s > 0 and l > 0 and o > 0 and pivot <> high").select("key", "pivot", "c")
    kept = kept.join(open_, "key").join(classes.select("node", "n", F.col("parity")[0].alias("bits")), "node")
    return materialize(kept, "divided"), label


def shared_pairs(rows: DataFrame) -> DataFrame:
    """a, b of members of a new group of at most LARGE whose differences can share enough shingles from this place on; of a larger one each member with the pivot."""
    small = rows.where(F.col("c") <= LARGE)
    cols = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "bits", "d", "place", "near")]
    both = small.where("short").select("key", *cols("y")).join(small.where("long").select("key", *cols("x")), "key")
    both = both.where("y_node <> x_node and (y_d < x_d or y_d = x_d and y_node < x_node) and not (y_near and x_near)").where(_bound("y_", "x_", "bit_count(y_bits ^ x_bits)"))
    both = both.where("18 * least(x_d - x_place, y_d - y_place) >= 9 * (x_d + y_d) - x_n - y_n").select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    star = rows.where(F.col("c") > LARGE).where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return both.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    spark = docs.sparkSession
    signs = materialize(signed(docs, shingle), "signatures")
    best = signs.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "tuples", "parity")).alias("m"))
    # each class becomes many rows: dealt out, a task sorts few of them
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = materialize(best.select("n", "s1", "s2", F.col("m.doc_id").alias("node"), "m.tuples", "m.parity").repartition(n, "node"), "classes")
    slim = materialize(signs.select("doc_id", "n", "s1", "s2"), "sets")
    discard(signs)
    # some tables at a time, so that few keys are on disk at once; no group has keys of two tables
    parts = [_repeated(classes, range(at, at + TUPLES)) for at in range(0, GROUPS[0], TUPLES)]
    members = _grouped(reduce(DataFrame.unionByName, parts), classes)
    discard(*parts)
    found = materialize(candidates(members, classes), "candidates")
    large = materialize(members.where(F.col("c") > SMALL).select("key", "node"), "large-groups")
    discard(members)
    nodes = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    partners = materialize(among(texts(docs).withColumnRenamed("doc_id", "node"), materialize(nodes, "nodes"), "node"), "partners")
    # first each document's nearest candidate: the links found make most of the others needless
    first = materialize(found.groupBy("b").agg(F.min(F.struct("far", "a")).alias("m")).select("b", F.col("m.a").alias("first")), "nearest")
    label = _relabelled(None, _links(first.select(F.col("first").alias("a"), "b"), partners, shingle))
    label = _relabelled(label, _links(_apart(found.join(first, "b").where("a <> first").select("a", "b"), label), partners, shingle))
    # each large group that holds several components, about the root of its largest one
    family = _mixed(_labelled(large, label, "node", "component"))
    while not family.isEmpty():
        rows, label = divided(family, classes, partners, label, shingle)
        pairs = _apart(_sketched(shared_pairs(rows), classes).select("a", "b"), label)
        label = _relabelled(label, _links(pairs, partners, shingle))
        left = rows.where(F.col("c") > LARGE).where("node <> pivot").select("key", F.col("pivot").alias("a"), "node")
        family = _mixed(_labelled(left, label, "node", "component"))
        discard(rows)
    discard(partners)
    ids = _labelled(classes.select("n", "s1", "s2", "node"), label, "node", "component_id").drop("node")
    ids = materialize(ids.groupBy("n", "s1", "s2").agg(F.min("component_id").alias("component_id")), "components")
    discard(classes)
    out = slim.join(ids, ["n", "s1", "s2"], "left")
    found = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(found == F.col("doc_id"), found.isNull()).alias("kept"))


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), shingle=2)
