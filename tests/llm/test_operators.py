"""The corpus operators against brute force, round trips and held-out accuracy, with the odd cases of each."""

from __future__ import annotations

import hashlib
import json
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, html_extraction, line_dedup, media, near_dedup, packing, pii, pii_model, substring_dedup, token_files, tokens, toxicity

DOCS = "doc_id long, text string"
ODD = ["", None, " ", "\n\n", "x", "a  b", "word " * 3000, "é ñ ß 日本 \U0001f600", "a\t\tb\x00c", "same text here", "same text here"]


def docs_of(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    if extra:  # columns whose names the operators use inside
        for c in ("part", "key", "digest", "u", "start", "n", "label", "score", "node"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(n, seed=0, words=400):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(words)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(30, 120))) + "." for _ in range(n)]


def whole_ids(texts, end):
    t = tokens.encoder(tokens.default_tokenizer()).tokenizer
    return [np.array([*e.ids, end], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_library():
    r = random.Random(0)
    texts = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "a\n \nb", "x　 y", "don't  's", "<|endoftext|> a", "x" * 100] + ["".join(r.choice(" \n\tab'.1é\x1c\x85　") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    e = tokens.encoder(tokens.default_tokenizer())
    for _ in range(2):  # the second time from the table
        ids, n = e.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.tolist() for x in e.whole(texts)]


def test_packing(spark):
    rows = packing.pack(docs_of(spark, ODD, extra=True)).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    for i, ids in enumerate(whole_ids(ODD, 0)):
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0) and r.length & (r.length - 1) == 0 and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(empty(spark)).count() == 0


def test_token_files(spark, tmp_path):
    texts = ODD + prose(20)
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs_of(spark, texts, extra=True).repartition(3), path, shard_ids=500)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, path).collect())
    want, at = [], 0
    for i, ids in enumerate(whole_ids(texts, 2)):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    token_files.write_token_files(empty(spark), path + "-empty")
    assert token_files.read_token_files(spark, path + "-empty").count() == 0


@pytest.mark.parametrize("ids", [np.zeros(0), np.array([5]), np.zeros(3000), np.tile([1, 2, 3], 900), np.random.default_rng(0).zipf(1.4, 20000) % 500])
def test_grammar_round_trip(ids):
    ids = ids.astype(np.uint32)
    seq, rules, lengths, made = token_files.grammar(ids, 60000)
    assert (token_files.expand(seq, 60000, rules, made) == ids).all()
    left = Counter(zip(seq.tolist(), seq[1:].tolist(), strict=False))  # only runs of one symbol count an occurrence twice
    assert all(n < token_files.LEAST for pair, n in left.items() if pair[0] != pair[1]) and len(seq) <= len(ids)
    shard = {"sequence": seq.astype("<u4").tobytes(), "width": 4, "rules": rules.astype("<u4").tobytes(), "expansion": lengths.astype("<u4").tobytes(), "base": 60000, "rounds": made}
    for a, b in ((0, len(ids)), (7, 40), (len(ids) // 2, len(ids) - 3)):
        if 0 <= a < b <= len(ids):
            assert (token_files.read_range(shard, a, b) == ids[a:b]).all()


def test_media(spark):
    docs = media.texts(docs_of(spark, ODD, extra=True)).withColumn("digest", media.digest_of(F.col("text")))
    path = media.new_table(spark, "media-test")
    media.store_payloads(docs, path)
    values = media.payload_features(spark.read.parquet(path))
    for r in docs.join(values, "digest").collect():
        p = media.padded(r.text.encode())
        assert len(p) % 64 == 0 and len(p) > 0 and (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    page = '<p>one <b>two</b></p><figure><img src="media:abc" alt=x><figcaption>first &amp; best</figcaption></figure>three<img src="media:none"><script>no</script>'
    got = media.parse_sequence(page)
    assert [(e["position"], e["kind"], e["text"] or e["ref"], e["caption"]) for e in got] == [(0, "text", "one two", None), (1, "media", "media:abc", "first & best"), (2, "text", "three", None), (3, "media", "media:none", None)]
    elements = media.interleave(spark.createDataFrame([(1, page), (2, None)], "doc_id long, html string"))
    known = spark.createDataFrame([("abc", 64)], "digest string, payload_bytes long")
    assert sorted((r.doc_id, r.position, r.caption, r.payload_bytes) for r in media.resolve(elements, known).collect()) == [(1, 1, "first & best", 64), (1, 3, None, None)]


def test_line_dedup(spark):
    line = "this line is long enough to count"
    texts = [f"{line}\nown words in this very line here", f"x\n  THIS line is  long enough to count\nend", None, "", "a b\na b", f"{line}\n{line}"]
    got = sorted(tuple(r) for r in line_dedup.repeated_lines(docs_of(spark, texts, extra=True)).collect())
    assert got == [(1, 2, 38, 0, 0), (5, 0, 33, 0, 0), (5, 34, 67, 0, 0)]
    lines = line_dedup.repeated_lines(docs_of(spark, texts))
    assert {r.doc_id: r.text for r in line_dedup.remove_lines(docs_of(spark, texts), lines).collect()} == {0: texts[0], 1: "x\nend", 2: None, 3: "", 4: "a b\na b", 5: ""}
    assert line_dedup.repeated_lines(empty(spark)).count() == 0


def brute_removal(rows, length):
    counts = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                hit[k : k + length] = b"\x01" * length
        kept = bytes(x for x, c in zip(b, hit) if not c)
        out.append((i, len(b), len(b) - len(kept), sum(hit[k] and not (k and hit[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    r = random.Random(3)
    w = lambda n, a="abcdefgh ": "".join(r.choice(a) for _ in range(n))
    base = w(2500)
    texts = [None, "", base, base, base[:1500] + "X" + base[1501:], w(200) + base[700:1100] + w(300), w(200) + base[700:1099] + w(300), "a" * 900, "ab" * 600, w(500) * 3, "é" * 300 + w(400), w(399)]
    for _ in range(15):
        x = list(base[r.randint(0, 1000) : r.randint(1500, 2500)])
        for _ in range(r.randint(0, 5)):
            x[r.randrange(len(x))] = r.choice("xyz")
        texts.append("".join(x))
    got = sorted(tuple(x) for x in substring_dedup.remove_repeats(docs_of(spark, texts, extra=True)).collect())
    rows = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    passages = {r[0] for r in brute_removal(rows, substring_dedup.PASSAGE) if r[2]}
    assert got == [(*r, r[0] in passages) for r in brute_removal(rows, 400)]
    assert {r[0] for r in got if r[2]} < passages
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def brute_components(texts, k):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(spark, k):
    r = random.Random(k)
    texts = ODD + prose(6, seed=k)
    for t in texts[-6:-2]:
        for _ in range(6):
            w = t.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "changed" + str(r.randint(0, 99))
            texts.append(" ".join(w))
    got = sorted(tuple(x) for x in near_dedup.near_duplicates(docs_of(spark, texts, extra=True), k).collect())
    assert got == brute_components(texts, k)


@pytest.mark.parametrize(("k", "large"), [(2, 3), (5, 1024)])
def test_near_dedup_divides_large_groups(spark, monkeypatch, k, large):
    """Families of copies of copies, in groups that are all large."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "PART", 4)
    r = random.Random(k)
    texts = prose(3, seed=k, words=60)
    for t in list(texts[:2]):
        for _ in range(20):
            w = r.choice([t, r.choice(texts)]).split()
            for _ in range(r.randint(0, 5 if k == 2 else 3)):
                at, how = r.randrange(len(w)), r.random()
                if how < 0.4:
                    w[at] = r.choice(["of", "and", f"x{r.randint(0, 9)}"])
                elif how < 0.7 and len(w) > 5:
                    del w[at]
                else:
                    w.insert(at, f"new{r.randint(0, 20)}")
            texts.append(" ".join(w))
    got = sorted(tuple(x) for x in near_dedup.near_duplicates(docs_of(spark, texts), k).collect())
    assert got == brute_components(texts, k)


def test_near_dedup_repeats_and_missing_ids(spark):
    text = " ".join(prose(1, seed=1))
    rows = [(5, text), (5, text), (7, text), (None, text), (None, "alone here"), (9, None), (9, "")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == {(5, 5, True), (7, 5, False), (None, 5, False), (None, None, True), (9, 9, True)}


def test_near_dedup_empty(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["op9_line_dedup", "op9_long_line_dedup"])
def test_line_reports_equal_their_sql(spark, tmp_path, name):
    import duckdb

    from tidemark.llm import queries

    texts = ["Les.\nown words\none two three four five\nsix", "les. \n\n\u3000\nOWN\u00a0 words", None, "", "one two three four five\nsix\nseven", "a\x1cb\na b\nA  B", "same text here", "same text here"]
    docs_of(spark, texts, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    for path in (f"{tmp_path}/documents.parquet/*.parquet", "/root/testdata/sf0.001/documents.parquet"):
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{path}'")
        df = queries.queries()[name](spark, path.split("/documents")[0])
        want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key) and want


def test_every_line_dedup_equals_its_sql(spark, tmp_path):
    import duckdb

    from tidemark.llm import queries

    name, texts = "op9_every_line_dedup", ["Les.\nown words\n長い行です長い行です", "les. \n\n\u3000\nOWN\u00a0 words", None, "", "長い行です長い行です\n\u3000\n \nLes.", "a\x1cb\na b"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 5, 0, 0), (1, 9, 19, 0, 5), (4, 0, 10, 0, 15), (4, 15, 19, 0, 0), (5, 4, 7, 5, 0)]
    for path in (f"{tmp_path}/documents.parquet/*.parquet", "/root/testdata/sf0.001/documents.parquet"):
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        rows = queries.queries()[name](spark, path.split("/documents")[0]).collect()
        assert sorted(tuple(r) for r in rows) == sorted(duck.sql(queries.oracle_sql()[name]).fetchall()) and rows


def test_decontamination(spark):
    items = prose(30, seed=5) + ["", None, "one two three"]
    texts = prose(150, seed=6) + ODD
    r = random.Random(1)
    planted = {}
    for i in range(20):
        w = items[i].split()
        if i % 2:  # a paraphrase: every eighth word differs
            w = [x if k % 8 else "other" for k, x in enumerate(w)]
        own = texts[i * 3].split()
        at = r.randrange(len(own))
        texts[i * 3] = " ".join(own[:at] + w + own[at:])
        planted[i * 3] = i
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs_of(spark, texts, extra=True), bench).collect()}
    recall = len(got & set(planted.items())) / len(planted)
    brute = {(d, i) for d, t in enumerate(texts) for i, q in enumerate(items) if q and t and q.strip() in t}
    assert recall >= 0.9 and brute <= got and len({d for d, _ in got} - set(planted)) == 0
    assert decontamination.contaminated(empty(spark), bench).count() == 0
    assert decontamination.contaminated(docs_of(spark, texts[:3]), bench.limit(0)).count() == 0


def test_decontamination_at_the_thresholds(spark):
    """Items of 12 to 2,000 words, their words replaced or spread out down to the checker's least shares, against a search of all regions."""
    r = random.Random(8)
    vocab = sorted({w for t in prose(40, seed=9) for w in t.split()})
    items = [" ".join(r.choice(vocab) for _ in range(n - 4)) + ". " + " ".join(r.choice(vocab) for _ in range(4)) + "." for n in [12, 18, 22, 26, 30, 45, 46, 65, 90] * 5 + [300, 4000, 4000]]
    texts, planted = prose(120, seed=10), []
    for d, i in enumerate(list(range(len(items))) * 2):
        w = items[i].split()
        m, keep = len(w) - len(decontamination.answer_of(items[i]).split()), 0.78 if d % 3 else 0.66
        gone = set(r.sample(range(len(w) if keep > 0.75 or m < 4 else m), int(len(w) * (1 - keep))))
        w = [x if k not in gone else " ".join(r.choices(vocab, k=1 + d % 2)) for k, x in enumerate(w)]
        own = texts[d].split()
        at = r.randrange(len(own))
        texts[d] = " ".join(own[:at] + w + own[at:])
        planted.append((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    brute = set()
    for d, i in planted:
        item, answer = items[i].lower().replace(".", "").split(), decontamination.answer_of(items[i]).lower().rstrip(".").split()
        words = texts[d].lower().replace(".", "").split()
        for at in range(0, max(1, len(words) - len(item)), max(1, len(item) // 8)):
            region = words[at : at + 2 * len(item)]
            share = decontamination.lcs(item, region) / len(item)
            if share >= 0.75 or share >= 0.6 and decontamination.lcs(answer, region) >= 0.8 * len(answer):
                brute.add((d, i))
    assert len(brute) >= 80 and len(brute & got) >= 0.9 * len(brute)
    assert {p for p in brute if len(items[p[1]].split()) > 1024} <= got
    assert all(decontamination.scales_to(n)[-1] >= n for n in (1, 920, 921, 5000))


def test_logistic_in_bounded_memory():
    """Weights solve the ridge equations of the dense table, equal signs share them, and no dense table of floats is held."""
    rng = np.random.default_rng(2)
    base = rng.random((3000, 300)) < 0.03
    seen = np.concatenate([base, base, base, base], axis=1)  # words and three beginnings
    y = (base[:, :5].any(axis=1) ^ (rng.random(3000) < 0.05)).astype(float)
    owner, sign = np.nonzero(seen)
    tracemalloc.start()
    w = toxicity._logistic(owner, sign, y, 1200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    p = 1 / (1 + np.exp(-(seen @ w[:-1] + w[-1])))
    assert np.abs((y - p) @ seen - 0.5 * w[:-1]).max() < 1e-3 and np.allclose(w[:300], w[900:1200]) and peak < seen.size * 8 / 2


def test_windows_of_a_long_text():
    """Cosines of a long text's last windows are exact, whatever stands before, and what is held of it is bounded."""
    rng = np.random.default_rng(4)
    space = (rng.standard_normal((decontamination.DIMS, decontamination.RANK)) + 0.1).astype(np.float32)
    vocabulary = np.array([f"w{i}" for i in range(20000)])
    item = " ".join(vocabulary[rng.integers(0, 20000, 40)]) + "."
    items = decontamination.prepare([(7, item), (8, "few words of an item that is not there at all.")], space)
    long, short = " ".join([*vocabulary[rng.integers(0, 20000, 300_000)], item]), " ".join(item.split()[:33])
    tracemalloc.start()
    got = decontamination.matches(pa.array(["", short, long, item]), space, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i) for d, i, *_ in got] == [(1, 0), (2, 0), (3, 0)] and peak < 110e6
    for d, text in ((1, short), (2, long), (3, item)):
        _, term, _, n = decontamination._terms(pa.array([text]))
        padded = np.append(term, np.full(-n[0] % 4, decontamination.DIMS))
        table = np.concatenate([space, np.zeros((1, decontamination.RANK))]).astype(float)
        tail = padded[-400:]  # quarters of the end, where the item stands
        exact = []
        for length in (min(36, len(padded)),):
            for low in range(0, len(tail) - length + 1, 4):
                w = table[tail[low : low + length]].sum(axis=0)
                exact.append(w @ items.vectors[0].astype(float) / np.sqrt(w @ w))
        assert min(abs(np.array(exact) - next(g[2] for g in got if g[0] == d))) < 1e-6


def test_lcs():
    assert decontamination.lcs([1, 2, 3, 4], [9, 2, 3, 9, 4]) == 3 and decontamination.lcs([1, 1, 2], [1, 2, 1]) == 2


BASE = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {0: True, 1: all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else True, 2: 12 <= len(digits) <= 19 and pii.luhn(digits), 3: 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_patterns():
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choice(["1", "2", "25", "4111111111111111", "a", "@", "b.c", ".", "-", " ", "+", "(", ")", "é", "a@b.co", "10.0.0.1", "+1 (555) 555-0000"]) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_gradients_and_decoding():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 120, (3, 7)).astype(np.uint8), rng.integers(0, 4, (3, 7))
    p = {k: v.astype(np.float64) for k, v in pii_model.start_params(3, 4).items()}
    _, g = pii_model.loss_and_grads(p, x, y)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert abs((pii_model.loss_and_grads(up, x, y)[0] - pii_model.loss_and_grads(down, x, y)[0]) / 2e-3 - g[k][at]) < 1e-4 + 0.02 * abs(g[k][at])
    s = rng.standard_normal((5, 1, 3))
    t = rng.standard_normal((3, 3))
    best = max(np.ndindex(3, 3, 3, 3, 3), key=lambda q: sum(s[i, 0, k] for i, k in enumerate(q)) + sum(t[a, b] for a, b in zip(q, q[1:], strict=False)))
    assert pii_model.viterbi(s, t, np.array([5]))[0].tolist() == list(best)


def test_pii(spark):
    r = random.Random(9)
    value = lambda: r.choice([f"bob.{r.randint(10, 99)}@mail.example.com", f"10.{r.randint(0, 255)}.3.4", "4111111111111111", f"+1 (555) 555-{r.randint(1000, 9999)}"])
    texts = [f"{p} {value()} {p}" for p in prose(120, seed=3)] + ODD
    docs = docs_of(spark, texts, extra=True)
    params = pii.fit(docs)
    got = {x.doc_id: x for x in pii.find_personal_data(docs, params).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and set(filter(None, pii.joined(base).split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
    counts = {k: [0, 0] for k in range(4)}  # found of written variants with another seed, set into plain text
    for (v, kind), p in zip(pii.variants(160, seed=77), prose(160, seed=33), strict=True):
        at, t = len(p) + 1, f"{p} {v} {p}"
        spans = set(pii.base_spans(t)) | set(pii.added_spans(t, pii.model_labels(params, t), pii.base_spans(t)))
        counts[kind][0] += any(k == kind and s < at + len(v) and e > at for s, k, e in spans)
        counts[kind][1] += sum(not (k == kind and s < at + len(v) and e > at) for s, k, e in spans)
    assert all(found >= 30 and other <= 8 for found, other in counts.values()), counts
    held = [(f"{p} {value()} {p}", len(p) + 1) for p in prose(40, seed=33)]
    found = sum(pii.model_labels(params, t)[at + 4] > 0 for t, at in held)
    assert found >= 32  # held-out accuracy of the model alone
    masked = {x.doc_id: x.text for x in pii.mask_personal_data(docs.select("doc_id", "text"), params).collect()}
    assert all(not pii.base_spans(t or "") for t in masked.values()) and masked[121] is None
    long_text = "plain words here " * 3000 + "bob.12@mail.example.com " + "more plain words " * 3000
    assert len(pii.model_labels(params, long_text)) == len(long_text)
    assert pii.find_personal_data(empty(spark), pii.fit(empty(spark))).count() == 0


def test_toxicity(spark):
    r = random.Random(4)
    bad = ["idiot", "moron", "scum"]
    clean, texts, labels = prose(400, seed=12), [], []
    for i, p in enumerate(clean):
        w = p.split()
        if i % 5 == 0:
            w[r.randrange(len(w))] = r.choice(bad)
        texts.append(" ".join(w))
        labels.append((i, int(i % 5 == 0)))
    docs = docs_of(spark, texts + ODD, extra=True)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score_documents(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(texts) + len(ODD) and np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    for written in ("1d10t", "id!ot", "m0r0n", "i d i o t", "s.c.u.m", "iiidiottt"):
        assert toxicity.score(f"and {written} of", model) > 0.5, written
    assert toxicity.score("3rd 1st 2nd x100 of 10 a1b2", model) < 0.5
    kept = {x.doc_id for x in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    # in pieces that are no words of their own
    assert toxicity.joined_words(["of", "idi", "ot", "and"], model) == {"idiot"} == toxicity.joined_words(["id", "io", "t"], model)
    assert toxicity.score("of idi ot and", model) > 0.5 and toxicity.score("idioticness", model) > toxicity.score("ididioness", model)
    none = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= toxicity.score("anything", none) <= 1 and toxicity.score_documents(empty(spark), none).count() == 0


def test_decoding_equals_a_search_of_all_paths():
    """Every path through the lattice of a written word, against Viterbi."""
    rng = np.random.default_rng(3)
    costs = toxicity.language_costs(rng.integers(0, 200, toxicity.LETTERS**3))

    def paths(written, at, text, last, cost):
        if at == len(written):
            yield cost, text
            return
        c = written[at]
        repeat = toxicity.REPEAT if c * 3 in written[max(0, at - 2) : at + 3] else toxicity.DOUBLE
        letters = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SIGN) for x in toxicity.LOOKALIKES.get(c, "")]
        for x, extra in letters:
            yield from paths(written, at + 1, text + x, c, cost + extra)
        if last == c and text:
            yield from paths(written, at + 1, text, c, cost + repeat)
        if c in toxicity.SEPARATORS or not letters:
            yield from paths(written, at + 1, text, last, cost + toxicity.SEPARATOR)

    for written in ("1d10t", "m0r0nnn", "$.c.u.m", "a**b", "!!!", "l33t$", "_-_", "xx@@66"):
        found = [(cost + toxicity.word_cost(text, costs), text) for cost, text in paths(written, 0, "", "", 0.0)]
        got = toxicity.decode(written, costs)
        assert abs(min(c for c, t in found if t == got) - min(found)[0]) < 1e-9, written


def test_field_decoding_equals_a_search_of_all_labellings():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        u, t = rng.standard_normal((n, 2)), rng.standard_normal((2, 2))
        value = lambda q: sum(u[i, k] for i, k in enumerate(q)) + sum(t[a, b] for a, b in zip(q, q[1:], strict=False))  # noqa: B023, E731
        assert html_extraction.viterbi(u, t).tolist() == list(max(np.ndindex(*[2] * n), key=value))


def test_html_blocks_of_open_elements():
    texts = lambda page: [b[0] for b in html_extraction.leaf_blocks(page)]
    assert texts("<html><head><title>t</title><body><article><p>Hello there") == ["Hello there"]
    assert texts("<html><head><meta charset=x><script>x</script><p>Hello") == ["Hello"]
    assert texts("<body><button>b<p>para</p></body>") == ["para"]
    assert texts("<select><option>a<option>b<div>text</div>") == ["text"]
    assert texts("<p>a<script>var x</script>b <style>y</style>c</p>") == ["ab c"]
    assert texts("<button>ok</button><p>x</p><select><option>a</select>y") == ["x", "y"]
    page = '<article><h1>T</h1><p>main</p><div class="comments"><p>mine</p></div><div class="ad">buy</div></article>'
    assert html_extraction.landmark_labels(html_extraction.leaf_blocks(page)).tolist() == [1, 1, 0, 0]


def test_html(spark):
    body = " ".join(prose(3, seed=8))
    page = f'<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>home page</a></li></ul></nav><article><h1>Some title</h1><p>{body}<p>A &amp; B  <b>x</b>y</article><footer>&copy; me</footer></body></html>'
    pages = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", ""), (4, "x", "</b><p"), (5, "y", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    model = html_extraction.fit(pages, templates=150)
    got = {r.page_id: r for r in html_extraction.extract(pages, model).collect()}
    want = " ".join(f"Some title {body} A & B xy".split())
    assert got[1].text == got[5].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == "" and len(got) == 5
    rng, right, total = np.random.default_rng(99), 0, 0
    for _ in range(60):  # held-out layouts
        blocks, y = html_extraction.template_blocks(html_extraction.template_page(prose(20, seed=1), rng))
        right += int((html_extraction.viterbi(html_extraction._unary(model[0], html_extraction.block_features(blocks)), model[1]) == y).sum())
        total += len(y)
    assert right / total > 0.97
    assert html_extraction.extract(pages.limit(0), html_extraction.fit(pages.limit(0), templates=20)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(7)
    items, texts = prose(5, seed=71), prose(60, seed=70)
    w = texts[0].split()
    w[3] = "changed"
    texts.append(" ".join(w))  # a near copy of 0
    texts.append(texts[1] + " " + items[2])  # a leak
    texts += [p + " idiot and moron" for p in prose(40, seed=72)]
    texts.append(texts[2] + " call bob.12@mail.example.com now")  # a near copy of 2 with personal data
    labels = [(i, int("idiot" in t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf)
    got = {x.doc_id for x in out.collect()}
    comp = brute_components([t if "idiot" not in t else None for t in texts], 5)
    want = {i for i, t in enumerate(texts) if "idiot" not in t and comp[i][3] and not any(q in t for q in items)}
    assert got == want and 60 not in got and 61 not in got
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == json.dumps(["toxicity", "near_dedup", "decontamination", "pii", "packing"])
