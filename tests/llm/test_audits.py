"""Quality, source divergence and spelling variants against SQL, brute force and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packed, quality, source_divergence, spelling
from tidemark.llm.tokens import column_bytes

DOCS = "doc_id long, text string, lang string, source string"


def clashing(df):
    for c in ("term", "n", "docs", "p", "q", "kept", "word", "m", "kind", "part", "block", "counts", "half", "positive", "value", "rank", "first", "total"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_packed_counts_equal_a_counter():
    r = random.Random(4)
    alphabet = "abÀé日"
    texts = [" ".join("".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40]) if r.random() < 0.5 else r.randint(1, 3))) for _ in range(r.randint(0, 60))) for _ in range(40)] + ["", "x" * 5000, "x" * 5000 + " " + "x" * 4999, "\x00a\x00a"]
    groups = np.array([i % 3 for i in range(len(texts))])
    data, offsets = column_bytes(pa.array(texts))
    inside = (data[: offsets[-1]] > 64) & (data[: offsets[-1]] != 127)
    starts, lengths, owner = packed.spans(inside, offsets)
    want, held = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        for w in re.findall(rb"[^\x00-\x40\x7f]+", t.encode()):
            want[w, groups[i]] += 1
            held[w, groups[i]].add(i)
    got = {}
    for x in packed.count(data, starts, lengths, groups[owner], owner):
        for s, n, g, k, d in zip(*x, strict=True):
            key = data[s : s + n].tobytes(), g
            assert key not in got
            got[key] = (k, d)
    assert got == {k: (n, len(held[k])) for k, n in want.items()}


def divergence_rows(spark, rows, **kw):
    df = source_divergence.divergence(clashing(spark.createDataFrame(rows, DOCS)), **kw)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_source_divergence_equals_sql(spark, tmp_path):
    r = random.Random(9)
    vocab = ["the", "The", "naïve", "straße", "日本語", "internationalisation", "a" * 17, "b" * 40, "ÀB", "x", "y", "tie1", "tie2"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(r.choice(vocab[: 8 + 5 * (i % 4)]) for _ in range(r.randint(5, 40))) + r.choice(["", ".", "\x7f?", "\x00z"]), r.choice(["en", "en", "de", None]), r.choice(["s1", "s2", "s3", None])) for i in range(500)]
    rows += [(600, None, "en", "no text"), (601, "", "fr", "a"), (602, "1 2", "fr", "b"), (603, "rare", "fr", "c"), (1, rows[1][1], rows[1][2], rows[1][3]), (None, "the the", "en", "s1")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    rel = c.sql(source_divergence.OP12_SQL)
    at = [rel.columns.index(x) for x in ("lang", "source", "part", "item", "value", "rank")]
    want = sorted(tuple(x[i] for i in at) for x in rel.fetchall())
    assert divergence_rows(spark, rows) == want and {x[2] for x in want} == {"pair", "term"}
    assert [x for x in want if x[0] == "fr"] == [("fr", a, "pair", b, 0, k) for a, bs in (("a", "bc"), ("b", "ac"), ("c", "ab")) for k, b in enumerate(bs, 1)]
    assert divergence_rows(spark, []) == []


def test_source_divergence_in_many_blocks(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(f"t{chr(97 + r.randrange(26))}{chr(97 + r.randrange(20))}" for _ in range(30)), "en", f"s{i % 7}") for i in range(300)]
    want = divergence_rows(spark, rows, least_docs=3)
    monkeypatch.setattr(source_divergence, "BLOCK", 20)
    assert divergence_rows(spark, rows, least_docs=3) == want and len(want) > 50


def brute_words(docs):
    c = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= 2}


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute_variants(docs):
    c = brute_words(docs)
    near = {w: [v for v in c if abs(len(v) - len(w)) <= 1 and edit(w, v) == 1] for w in c}
    form = {w: min(near[w], key=lambda v: (-c[v], v)) if near[w] else None for w in c}
    form = {w: f if f and c[f] >= 10 * c[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), c[form[w]] if form[w] else None) for w, n in c.items()}


def slips(seed, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcéÿ×") for _ in range(r.choice([7, 7, 8, 9, 10, 13, 20, 40]))) for _ in range(n)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "Straßen", "ÀÈÌÒÙÜÖ"]
    words = []
    for w in base:
        times = r.choice([2, 3, 40, 500])
        words += [w] * times
        for _ in range(r.randint(0, 6)):
            k, x = r.randrange(len(w)), r.choice("abcé")
            words += [r.choice([w[:k] + w[k + 1 :], w[:k] + x + w[k:], w[:k] + x + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])] * r.choice([1, 2, 3, 30])
    r.shuffle(words)
    return [(i, " ".join(words[i::200])) for i in range(200)]


def test_spelling_variants_equal_brute_force(spark):
    docs = slips(1) + [(700, "planting " * 900 + "plantin " * 40 + "plantix " * 3), (900, None), (901, ""), (902, "short run"), (903, "UPPERCASE uppercase-UPPERCASE_uppercase"), (None, "noidword noidword noidword"), (5, "repeated repeated"), (5, "repeated repeated"), (904, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 3001 + " " + "z" * 3001), (905, "日本語テキスト日本語 naïveté naïveté İstanbulİstanbul")]
    rows = [(i, t, "en", "s") for i, t in docs]
    got = spelling.variants(clashing(spark.createDataFrame(rows, DOCS)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(docs)
    found = list(map(tuple, got.collect()))
    assert len(found) == len(want) and set(found) == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] != x[2] for x in want if x[1])
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("block", "rows"), [(4, 1 << 16), (16, 10), (2048, 10)])
def test_near_words_of_large_groups(spark, block, rows):
    r = random.Random(2)
    words = sorted({"prefix" + "".join(r.choice("ab") for _ in range(r.randint(2, 7))) + r.choice(["suffix", ""]) for _ in range(400)})
    df = spark.createDataFrame([(w, (7 * i) % 50 + 2) for i, w in enumerate(words)], "word string, n long")
    n = {w: (7 * i) % 50 + 2 for i, w in enumerate(words)}
    want = set()
    for w in words:
        near = [v for v in words if edit(w, v) == 1]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want.add((w, len(near), n[best], best))
    got = list(map(tuple, spelling.near_words(df, block, rows).collect()))
    assert set(got) == want and len(got) == len(want)


def test_long_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(18)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w18" for i in range(18)}


def test_crcs_of_runs():
    data = np.frombuffer(b"abc" + b"x" * 100 + b"dd", np.uint8)
    starts, lengths = np.array([0, 3, 103, 0]), np.array([3, 100, 2, 0])
    seeds = np.array([zlib.crc32(b"12:"), 0, zlib.crc32(b":"), 77], dtype=np.uint32)
    assert spelling.run_crcs(data, starts, lengths, seeds).tolist() == [zlib.crc32(data[s : s + n].tobytes(), int(k)) for s, n, k in zip(starts, lengths, seeds, strict=True)]


def good_and_bad(seed, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(500)]
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 200))]
        kind = i % 8
        if kind == 0:
            yield " ".join(x.upper() + "!!" for x in w), 0
        elif kind == 1:
            yield " ".join([w[0]] * len(w)), 0
        else:
            yield ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)) + ".", 1


def test_quality_of_held_out_texts(spark):
    made = list(good_and_bad(5, 1200))
    odd = [None, "", " ", "\n", "x", "word " * 60_000]
    texts = [t for t, _ in made] + odd
    docs = clashing(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS))
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(made) if i % 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    table = quality.count_table(docs, labels).cache()
    model = quality.fit(table)
    assert abs(model.prior - 0.75) < 0.08
    got = {r.doc_id: r.score for r in quality.score_table(table, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert got[len(made)] == got[len(made) + 1]  # null and empty
    assert got[len(texts) - 1] < 0.3  # one word over and over
    unseen = [i for i in range(len(made)) if zlib.crc32(str(i).encode()) % 5 == 0 or i % 2 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(made[i][1]) for i in unseen]) > 0.98
    none = quality.fit(quality.count_table(docs, labels.where("false")).cache())
    assert {r.score for r in quality.score_table(table, none).collect()} == {0.5}
    empty = quality.count_table(docs.where("false"), labels)
    assert quality.score_table(empty, quality.fit(empty)).count() == 0


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(0)
    for prior in (0.2, 0.5, 0.9):
        p, n = rng.beta(6, 2, 20_000), rng.beta(2, 6, 20_000)
        u = np.where(rng.random(20_000) < prior, rng.beta(6, 2, 20_000), n)
        h = lambda x: np.histogram(x, quality.BINS, (0, 1))[0]
        assert abs(quality.best_bin(h(u), h(p)) - prior) < 0.05


def test_rows_among_ids(spark):
    from tidemark.llm import _base

    ids = [i * 7919 - 5000 for i in range(3000)]
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(-6000, 6000)] + [(None, "no id")], "node long, text string")
    got = {r.node for r in _base.among(rows, spark.createDataFrame([(i,) for i in ids], "node long"), "node").collect()}
    assert got == {i for i in ids if -6000 <= i < 6000}
    words, hashes = _base.id_filter(spark.createDataFrame([(i,) for i in ids], "node long"))
    at = _base._places(pa.array(range(10**6, 10**6 + 50_000)), len(words) << 6, hashes)
    assert ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1).mean() < 0.02
    assert _base.among(rows, spark.createDataFrame([], "node long"), "node").count() == 0
