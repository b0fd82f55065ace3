"""Which windows of a text the tagger is run on: what it adds must not depend on it."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tidemark.llm import pii
from tidemark.llm import pii_model as nn

TEXTS = ["\n" * 300 + "kersa at lomin.org" + "\n" * 300, "\n" * 200 + "k" * 500 + " at lomin.org" + "x" * 700 + "\n" * 90, "\n" * 500 + "cat lomin.org", "\n" * 500 + "k at lomin dot\ned", "", "\n" * 700 + "7531 8642" + "\n" * 9, "ka@lomin.org"]


@pytest.fixture
def marked(monkeypatch):
    """A tagger for which all but line ends is an address."""
    end = nn.codes("\n")[0]
    monkeypatch.setattr(nn, "unary", lambda params, x: x)
    monkeypatch.setattr(nn, "viterbi", lambda x, trans, valid: (x != end).astype(np.int8))


def added(texts):
    return [pii.added_spans(t, y, []) for t, y in zip(texts, pii._label_texts({"trans": None}, texts), strict=True)]


def test_windows_left_out_add_nothing(marked, monkeypatch):
    got = added(TEXTS)
    assert got[:3] == [[(300, 0, 318)], [(200, 0, 1413)], []]
    monkeypatch.setattr(pii, "_SIGN", re.compile("(?s)."))
    assert added(TEXTS) == got
