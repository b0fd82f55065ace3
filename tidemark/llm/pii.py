"""Personal data by fixed patterns and a character-level BiLSTM-CRF.

The patterns' spans always stay. The model is trained from labelled spans: the patterns' matches in a bounded
sample of documents, and the same values in written variants that the patterns do not accept. It is decoded over
overlapping windows of the whole text; where windows overlap, each character takes the label of the window in
which it lies further inside. A decoded span is added if it overlaps no pattern span and has the digits of its kind,
or an @ or the word at with a host and a dot after it. So every added span holds a digit, or such an at; windows with one
are decoded, and then each window that a labelled run reaches into, as far as runs go. What is added is the same as if all
windows were decoded.

Defined cases: null and empty texts have no spans. Very long texts are windows like others. Equal scores of labels
go to the first label, a character equally far inside two windows to the later one. Repeated rows give
repeated results. An empty table gives an empty result; a sample without matches gives a model trained on the
written variants alone. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii_model as nn
from ._base import bounded, read_documents, small_batches, texts

KINDS = ("email", "ip", "card", "phone")
#: Documents from which training spans are taken at most, and written variants.
TRAIN_DOCS, VARIANTS = 300, 1600
WINDOW, OVERLAP, TRAIN_WINDOW, TOGETHER = 256, 64, 64, 256

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_BASE_SIGN = re.compile(r"[0-9@]")
#: An @ or the word at, before a host and a dot (written or not); the group is the dot.
_AT = r"(?:@|\bat\b)(?=[\s)\]}>]*+[^\s.@()\[\]{}<>]++[\s(\[{<]*+(\.|dot\b))"
_ADDRESS = re.compile(_AT, re.IGNORECASE)
#: What every added span holds one of: see added_spans().
_SIGN = re.compile(rf"[0-9@]|{_AT}", re.IGNORECASE)
#: Digits of an added span of each kind, at least and at most.
_DIGITS = [(0, 12), (4, 12), (12, 19), (7, 15)]


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the patterns, each in time linear in the text.

    What matches from the first character of a run of local or digit characters fails from each later one too,
    so only the first is tried.
    """
    out = []
    end = low = 0
    at = text.find("@")
    while at >= 0:
        local = len(text[low:at]) - len(text[low:at].rstrip(_LOCAL))
        if local and (m := _DOMAIN.match(text, at)):
            out.append((at - local, 0, m.end()))
            end = m.end()
        low = max(end, at + 1)
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def variants(n: int, seed: int = 11) -> list[tuple[str, int]]:
    """Values of each kind in forms that people write, most of them outside the patterns."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            local = pick(word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}")
            at, dot = pick(("@", "."), (" @ ", "."), (" (at) ", "."), ("@", " dot "), ("[@]", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " dot "), ("@", " . "))
            value = local + at + word() + dot + pick(word(), "com", "org", "net", "co")
        elif kind == 1:
            value = pick(".", " . ", "[.]", "(.)", "-").join(str(rng.integers(0, 256)) for _ in range(4))
        elif kind == 2:
            value = pick("", " ", "-", ".", "/", "_", " - ").join(digits(k) for k in pick((4, 4, 4, 4), (4, 6, 5)))
        else:
            value = pick(f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"00{digits(2)} {digits(3)} {digits(7)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)} {digits(6)}", f"0{digits(3)}/{digits(7)}")
        out.append((value, kind))
    return out


def training_windows(sample: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Character codes and labels (0: none, 1 + kind) of windows about spans, variants set into plain text, and plain text."""
    rng, half = np.random.default_rng(seed), TRAIN_WINDOW // 2
    rows: list[tuple[str, list[tuple[int, int, int]]]] = []
    plain = [t for t in sample if len(t) > TRAIN_WINDOW] or ["the quick brown fox jumps over the lazy dog, and then it sleeps. " * 4]
    for text in sample:
        for start, kind, end in base_spans(text)[:4]:
            low = max(0, start - int(rng.integers(4, half)))
            rows.append((text[low : low + TRAIN_WINDOW], [(s - low, k, e - low) for s, k, e in base_spans(text) if s < low + TRAIN_WINDOW and e > low]))
    for value, kind in variants(VARIANTS, seed):
        text = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, len(text) - TRAIN_WINDOW + 1))
        before = int(rng.integers(0, half))
        head = text[at : at + before] + " "
        rows.append(((head + value + " " + text[at + before : at + TRAIN_WINDOW])[:TRAIN_WINDOW], [(len(head), kind, len(head) + len(value))]))
    for _ in range(len(rows)):
        text = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, len(text) - TRAIN_WINDOW + 1))
        cut = text[at : at + TRAIN_WINDOW]
        rows.append((cut, base_spans(cut)))
    x, y = np.full((len(rows), TRAIN_WINDOW), nn.PAD, np.uint8), np.zeros((len(rows), TRAIN_WINDOW), np.int64)
    for i, (text, spans) in enumerate(rows):
        x[i, : len(text)] = nn.codes(text)[:TRAIN_WINDOW]
        for start, kind, end in spans:
            y[i, max(0, start) : min(len(text), end)] = 1 + kind
    return x, y


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> nn.Params:
    """Train from the patterns' spans in at most train_docs documents, those of the smallest hash."""
    found = texts(docs).where(F.col("text").rlike("[0-9]|@")).select(F.xxhash64("text").alias("h"), F.col("text"))
    bound = [r.h for r in found.select("h").orderBy("h").limit(train_docs).collect()]  # hashes first: few texts reach the driver
    rows = found.where(F.col("h") <= bound[-1]).distinct().collect() if bound else []
    x, y = training_windows(sorted(r.text for r in rows))
    return nn.train(x, y, labels=1 + len(KINDS))


def model_labels(params: nn.Params, text: str) -> np.ndarray:
    """Labels of a text's characters: windows decoded, then reconciled."""
    return _label_texts(params, [text])[0]


def _label_texts(params: nn.Params, some: list[str]) -> list[np.ndarray]:
    coded = [nn.codes(t) for t in some]
    out = [np.zeros(len(c), np.int8) for c in coded]
    step = WINDOW - OVERLAP
    counts = [max(1, -(-(len(c) - OVERLAP) // step)) for c in coded]
    todo = set()  # (text, window)
    for i, text in enumerate(some):
        hot = np.array([m.start() for m in _SIGN.finditer(text)], np.int64)
        first, last = np.maximum(0, (hot - WINDOW) // step), np.minimum(counts[i] - 1, hot // step)
        todo.update((i, k) for k in {k for a, b in zip(first.tolist(), last.tolist(), strict=True) for k in range(a, b + 1)})
    done: set[tuple[int, int]] = set()
    while todo:
        jobs = []  # (text, window start, window end, first kept, last kept, window)
        for i, k in sorted(todo):
            low, n = k * step, len(coded[i])
            jobs.append((i, low, min(low + WINDOW, n), low + OVERLAP // 2 if k else 0, low + step + OVERLAP // 2 if k < counts[i] - 1 else n, k))
        done |= todo
        todo = set()
        jobs.sort(key=lambda j: j[2] - j[1])
        for at in range(0, len(jobs), TOGETHER):
            part = jobs[at : at + TOGETHER]
            valid = np.array([j[2] - j[1] for j in part])
            x = np.full((len(part), int(valid.max())), nn.PAD, np.uint8)
            for r, (i, low, high, *_) in enumerate(part):
                x[r, : high - low] = coded[i][low:high]
            labels = nn.viterbi(nn.unary(params, x), params["trans"], valid)
            for r, (i, low, _, a, b, k) in enumerate(part):
                out[i][a:b] = labels[r, a - low : b - low]
                # a run at the edge of what is kept may go on in the next window
                todo.update(w for w, edge in (((i, k - 1), a), ((i, k + 1), b - 1)) if 0 <= w[1] < counts[i] and out[i][edge])
        todo -= done
    return out


def _address_within(text: str, start: int, end: int) -> bool:
    """Whether an at, a host and a dot lie in a span; words that the span cuts do not count."""
    return any(m.end(1) <= end for m in _ADDRESS.finditer(text, start, end + 1))


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of one label, trimmed, that overlap no pattern span and have what their kind must have: digits, or for addresses an at, a host and a dot."""
    if not labels.any():
        return []
    edges = np.flatnonzero(np.diff(labels)) + 1
    out = []
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(labels)], strict=True):
        if kind := int(labels[start]):
            value = text[start:end]
            start += len(value) - len(value.lstrip())
            end = start + len(value.strip())
            least, most = _DIGITS[kind - 1]
            fits = least <= len(_digits(value)) <= most and (kind > 1 or _address_within(text, start, end))
            if fits and not any(s < end and start < e for s, _, e in base):
                out.append((start, kind - 1, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, params: nn.Params) -> DataFrame:
    """A row for each document: counts and digest of the patterns' spans, and all spans."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            some = batch.column("text").to_pylist()
            base = [base_spans(t) if _BASE_SIGN.search(t) else [] for t in some]
            labels = _label_texts(params, some)
            spans = [b + added_spans(t, y, b) for t, y, b in zip(some, labels, base, strict=True)]
            counts = [pa.array([sum(k == n for _, k, _ in b) for b in base], pa.int64()) for n in range(len(KINDS))]
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            yield pa.record_batch([batch.column("doc_id"), *counts, pa.array(digest), pa.array([joined(s) for s in spans])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return texts(docs).mapInArrow(find, _FOUND)


def mask_personal_data(docs: DataFrame, params: nn.Params) -> DataFrame:
    """docs with every span in text replaced by <kind>; all columns stay, n_chars follows the text if it is there."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in small_batches(batches, "text"):
            values = whole.column("text").to_pylist()
            some = [t or "" for t in values]
            labels = _label_texts(params, some)
            for i, (t, y) in enumerate(zip(some, labels, strict=True)):
                base = base_spans(t) if _BASE_SIGN.search(t) else []
                spans = sorted(base + added_spans(t, y, base), key=lambda s: (s[0], -s[2]))
                if spans:
                    parts, at = [], 0
                    for start, kind, end in spans:
                        if start >= at:
                            parts += [t[at:start], f"<{KINDS[kind]}>"]
                        at = max(at, end)
                    values[i] = "".join([*parts, t[at:]])
            place = whole.schema.get_field_index("text")
            yield whole.set_column(place, whole.schema.field(place), pa.array(values, whole.schema.field(place).type))

    out = bounded(docs).mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return find_personal_data(docs, fit(docs))
