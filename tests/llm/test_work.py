"""Work that is passed over because it cannot tell (plain words in toxicity, keys that occur once in near_dedup), and work that is not: the latent space."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import decontamination, near_dedup, toxicity
from tidemark.llm._base import materialize


def test_told_signs_are_those_of_all_words(monkeypatch):
    """The same signs as from all restored words, though tokens that cannot have one are not taken apart."""
    r = random.Random(7)
    lexicon = ["idiot", "stupid", "moron", "scum"]
    weights = dict.fromkeys([*lexicon, "idi*", "mor*", "stupi*", "of"], 1.0)
    costs = toxicity.language_costs(np.ones(toxicity.LETTERS**3, np.int64), lexicon)
    model = toxicity.Model(costs, weights, -1.0, frozenset(lexicon))
    signs = "idiotstupmrncw013457@$!|*.~^'-_ ,;:?\"()#éßİÀª²\n\t"
    texts = ["", "of", "an idi ot of mo ron", "i d i o t", "IDIOTS! and (m0r0n), scuuum", "iiidiot.", "s.c.u.m", "ﬁne of", "&&& *** ßßß"]
    for _ in range(3000):
        w = r.choice(lexicon)
        w = "".join(r.choice([c, c, c, 3 * c, c.upper(), c + r.choice(".*_- "), r.choice("0134$@!")]) for c in w)
        texts.append(r.choice(["", "(", '"', "of ", "A "]) + w + r.choice(["", ".", "!!", ")", " x", "***", "?"]))
        texts.append("".join(r.choice(signs) for _ in range(r.randint(0, 40))))
    for text in texts:
        assert toxicity.told_signs(text, model) == toxicity.signs(toxicity.restored_words(text, model)) & weights.keys(), text
    seen, taken = [], toxicity.token_words
    monkeypatch.setattr(toxicity, "token_words", lambda token, model: seen.append(token) or taken(token, model))
    model = toxicity.Model(costs, weights, -1.0, frozenset(lexicon))
    for _ in range(2):
        assert toxicity.score("the plain words, and others; an idiotic one and m0r0n", model) > toxicity.score("the plain words, and others", model)
    assert sorted(seen) == ["idiotic", "m0r0n"]


def test_only_repeated_keys_become_rows(spark):
    """A few tuples of two collections, equal in some nodes; of other keys no row is made."""
    r = random.Random(3)
    rows = [(i, [r.randrange(40) for _ in range(sum(near_dedup.GROUPS))]) for i in range(120)] + [(7, [1] * sum(near_dedup.GROUPS)), (500, [1] * sum(near_dedup.GROUPS))]
    packed = pa.table({"node": [i for i, _ in rows], "tuples": pa.array([np.array(t, np.uint64).tobytes() for _, t in rows], pa.binary())})
    classes = materialize(spark.createDataFrame(packed), "packed-classes")
    lefts = range(4, 8)
    got: dict[int, list[int]] = {}
    for x in near_dedup._repeated(classes, lefts).collect():
        got.setdefault(x.key, []).append(x.node)
    want: dict[tuple, list[int]] = {}
    for i, t in rows:
        for a in lefts:
            for b in range(near_dedup.GROUPS[1]):
                want.setdefault((a, b, t[a], t[near_dedup.GROUPS[0] + b]), []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_sets_of_short_and_long_values():
    """Equal to plain loops over words, for values of fewer words than a shingle too."""
    values = ["", "a", "a b", "  ", "a b c", "x y z w v u", "a b a b a b a", "B  b", "q"]
    for k in (1, 2, 3, 5):
        key, n = near_dedup.shingle_sets(pa.array(values), k)
        words = [v.lower().split() for v in values]
        sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
        assert n.tolist() == [len(s) for s in sets]
        cut = np.split(key, np.cumsum(n)[:-1])
        assert all((np.diff(c.astype(object)) > 0).all() for c in cut)
        for s, c in zip(sets, cut, strict=True):
            for t, d in zip(sets, cut, strict=True):
                assert len(set(c.tolist()) & set(d.tolist())) == len(s & t)


def test_latent_space_is_of_all_documents(spark):
    """Its singular values and vectors are those of the passages of 20,000 documents, counted by hand."""
    count, dims = 20_000, decontamination.DIMS
    docs = spark.range(count).selectExpr("id as doc_id", "concat('w', id % 41, ' v', id % 7, if(id % 1000 = 0, ' rare', '')) as text")
    df = decontamination.document_frequencies(docs)
    assert df[dims] == count
    values = pa.array([f"w{i % 41} v{i % 7}" + " rare" * (i % 1000 == 0) for i in range(count)])
    _, term, owner, _ = decontamination._terms(values)
    assert (df[:dims] == np.bincount(term, minlength=dims)).all()
    idf = np.log((count + 1) / (df[:dims] + 1)) + 0.05
    used = np.unique(term)
    a = np.zeros((count, len(used)))
    a[owner, np.searchsorted(used, term)] = idf[term]
    a /= np.sqrt((a * a).sum(axis=1, keepdims=True))
    values, vectors = np.linalg.eigh(a.T @ a)
    top = np.zeros(decontamination.RANK)
    top[: len(used)] = values[::-1]
    space = decontamination.latent_space(docs, df) / idf[:, None]
    some = int((values > 1e-4 * values.max()).sum())
    size = 1 / np.sqrt((space * space).sum(axis=0))
    assert np.allclose(size[:some] ** 2, (top + 0.05 * top.mean())[:some], rtol=1e-3)
    unit = (space * size)[:, :some]
    assert np.allclose((unit[used] * top[:some]) @ unit[used].T, a.T @ a, atol=1e-3 * values.max())
    assert np.allclose(np.delete(unit, used, axis=0), 0, atol=1e-3)
