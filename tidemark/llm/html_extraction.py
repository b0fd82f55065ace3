"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: text between block-level tags, with the tags, classes and ids above it. Each
block has sparse features of its ancestors and its text; the field has two labels, main and other, and transitions
between neighbours. It is trained on labelled pages: a bounded, hash-chosen sample of the table in which landmark
elements mark the article, and pages laid out from templates whose labels are known, with the same texts. Pages
are decoded by Viterbi; the text of a page is its main blocks in page order.

Defined cases: null or empty html gives an empty text, and so does a page without blocks. Unclosed, unopened and
unknown tags are tolerated: flow content ends an open head, title or control. Very long pages are parsed whole. Pages
with equal hashes train together; of equally likely labellings that with the earlier "other" is taken. Repeated rows give repeated results. An empty table gives an empty result. Columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bounded, small_batches

#: Pages of the table and template pages that are fitted at most; hashed features.
TRAIN_PAGES, TEMPLATES, FEATURES = 150, 350, 1 << 13

# Element names of HTML
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "ins", "del", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HIDDEN = {"script", "style", "template", "noscript", "title", "head", "svg", "math", "iframe", "object", "select", "option", "textarea", "button"}
#: Elements that show nothing and interrupt no word; those that end, if left open, where flow content begins.
UNSEEN, OPEN = {"script", "style", "template", "noscript"}, {"head", "title", "button", "select", "option", "optgroup"}
#: Words of classes and ids that name what is not the article, where a page's landmarks label its blocks.
BESIDE = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "comment", "comments", "responses", "discussion", "notice", "cookie", "consent", "alert", "related", "share", "social", "subscribe", "newsletter", "widget", "sidebar", "menu", "nav", "navbar", "breadcrumb", "footer", "form"}
LANDMARKS, ASIDE = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "dialog", "menu"}


class _Blocks(HTMLParser):
    """Leaf blocks: (text, ancestors' names, their class and id words, share of characters inside links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.out: list[tuple[str, tuple[str, ...], tuple[str, ...], float]] = []
        self.held: list[str] = []
        self.linked = self.links = 0
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            names = tuple(dict.fromkeys(n for n, _ in self.stack if n not in INLINE))
            marks = tuple(dict.fromkeys(w for _, ws in self.stack for w in ws))
            self.out.append((text, names, marks, min(1.0, self.linked / len(text))))
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNSEEN:
            self.stack.append((tag, ()))
            self.hidden += 1
            return
        if tag not in INLINE:
            self.flush()
            if tag in VOID:
                return
            ends = () if tag in HIDDEN else OPEN  # flow content is in no head and no unclosed control
            while self.stack and ((top := self.stack[-1][0]) in INLINE or top == "p" or top in ends or top == tag and tag in ("li", "option", "button", "title")):
                self._pop()
        elif tag in VOID:
            return
        words = re.findall(r"[a-z]+", " ".join(v.lower() for k, v in attrs if k in ("class", "id", "role", "itemprop") and v))
        self.stack.append((tag, tuple(words)))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.hidden -= tag in HIDDEN
        self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE and tag not in UNSEEN:
            self.flush()
        if any(n == tag for n, _ in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[tuple[str, tuple[str, ...], tuple[str, ...], float]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


def block_features(blocks: list) -> list[np.ndarray]:
    """Hashed feature numbers of each block."""
    out, last = [], None
    for text, names, marks, linked in blocks:
        size = len(text)
        words = ["bias", f"size:{min(9, size.bit_length())}", f"link:{int(linked * 4)}", f"end:{text[-1] in '.!?…:'}", f"near:{names[-1] if names else ''}", f"comma:{min(3, text.count(','))}"]
        words += [f"tag:{n}" for n in names] + [f"mark:{m}" for m in marks]
        words += [f"same:{last == names}", f"sign:{'©' in text}", f"long:{size > 80}{linked > 0.5}"]
        out.append(np.array([zlib.crc32(w.encode()) % FEATURES for w in words]))
        last = names
    return out


def _unary(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    return np.array([weights[f].sum(axis=0) for f in features])


def viterbi(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    best, back = unary[0], []
    for u in unary[1:]:
        step = best[:, None] + trans
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + u
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def train(pages: list[tuple[list[np.ndarray], np.ndarray]], epochs: int = 12, rate: float = 0.3, ridge: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by stochastic gradient steps on the log likelihood (AdaGrad)."""
    w, t = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    gw, gt, rng = np.full((FEATURES, 2), 1e-2), np.full((2, 2), 1e-2), np.random.default_rng(seed)
    lse = np.logaddexp
    for _ in range(epochs):
        for k in rng.permutation(len(pages)):
            features, y = pages[k]
            u = _unary(w, features)
            n = len(u)
            a, b = u.copy(), np.zeros((n, 2))
            for i in range(1, n):
                a[i] += lse(a[i - 1, 0] + t[0], a[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                v = u[i + 1] + b[i + 1]
                b[i] = lse(t[:, 0] + v[0], t[:, 1] + v[1])
            z = lse(*a[-1])
            miss = -np.exp(a + b - z)
            miss[np.arange(n), y] += 1
            dt = np.zeros((2, 2))
            if n > 1:
                dt -= np.exp(a[:-1, :, None] + t + (u[1:] + b[1:])[:, None, :] - z).sum(axis=0)
                np.add.at(dt, (y[:-1], y[1:]), 1)
            rows = np.concatenate(features)
            step = np.repeat(miss, [len(f) for f in features], axis=0)
            np.add.at(gw, rows, step * step)
            np.add.at(w, rows, rate * step / np.sqrt(gw[rows]) - rate * ridge * w[rows])
            gt += dt * dt
            t = t + rate * dt / np.sqrt(gt)
    return w, t


def landmark_labels(blocks: list) -> np.ndarray | None:
    """1 for blocks inside an article or main element and in nothing beside it, by element or by name, if the page has any."""
    y = np.array([int(bool(LANDMARKS & set(n)) and not ASIDE & set(n) and not BESIDE & set(m)) for _, n, m, _ in blocks])
    return y if y.any() else None


def template_page(texts: list[str], rng: np.random.Generator) -> str:
    """A page of the given texts in one of many layouts; main text stands between \x01 and \x02 in every main block."""
    pick = lambda *x: x[rng.integers(len(x))]
    some = lambda a, b: " ".join(texts[rng.integers(len(texts))].split()[: int(rng.integers(a, b))])
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{some(1, 4)}</a></li>' for i in range(n)) + "</ul>"
    side = [
        lambda: f"<nav>{links(rng.integers(3, 8))}</nav>",
        lambda: f'<div class="{pick("nav", "menu", "navbar", "breadcrumb", "topnav")}">{links(rng.integers(3, 8))}</div>',
        lambda: f'<div class="{pick("ad", "ads", "advert", "sponsored", "promo", "banner")}">{some(3, 25)}</div>',
        lambda: f'<div class="{pick("cookie", "notice", "consent", "alert", "cookie-notice")}"><p>{some(5, 25)}</p><button>ok</button></div>',
        lambda: f"<form><label>{some(1, 4)}</label><input name=q><p>{some(2, 8)}</p></form>",
        lambda: f'<{pick("aside", "div class=sidebar", "div id=related", "section class=widget")}><h3>{some(1, 4)}</h3><p>{some(5, 40)}</p>{links(rng.integers(1, 5))}',
    ]
    close = lambda x: x + "</" + x[1:].split(">")[0].split(" ")[0] + ">" if x.startswith(("<aside", "<div class=sidebar", "<div id", "<section class=w")) else x
    comments = lambda: f'<{(k := pick("section", "div"))} class="{pick("comments", "comment-list", "responses", "discussion")}"><h3>{some(1, 3)}</h3>' + "".join(f'<div class="comment"><b>{some(1, 3)}</b><p>{some(5, 60)}</p></div>' for _ in range(rng.integers(1, 5))) + f"</{k}>"
    body, where = pick(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post" class="entry">', "</div>"), ('<div class="article-body">', "</div>"), ('<div class="story">', "</div>"), ("<main><article>", "</article></main>")), []
    where.append(f"<h1>\x01{some(2, 10)}\x02</h1>")
    for _ in range(rng.integers(1, 9)):
        kind = rng.integers(10)
        if kind == 0:
            where.append(f"<h2>\x01{some(1, 6)}\x02</h2>")
        elif kind == 1:
            where.append("<ul>" + "".join(f"<li>\x01{some(2, 15)}\x02</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
        elif kind == 2:
            where.append(f"<blockquote>\x01{some(4, 40)}\x02</blockquote>")
        elif kind == 3:
            where.append(close(side[rng.integers(2, 6)]()))
        else:
            where.append(f"<p>\x01{some(1, 120)}\x02</p>")
    head = pick("", f"<header><h1>{some(1, 4)}</h1><p>{some(2, 10)}</p></header>", f'<div class="header">{some(1, 8)}</div>', f'<div id="masthead"><p>{some(2, 8)}</p></div>')
    foot = pick(f"<footer>&copy; {some(2, 20)}</footer>", f'<div class="footer"><p>{some(3, 25)}</p></div>', f'<div id="footer">&copy; {some(2, 12)}</div>')
    before, after = [close(side[rng.integers(6)]()) for _ in range(rng.integers(0, 4))], [close(side[rng.integers(6)]()) for _ in range(rng.integers(0, 3))]
    if rng.integers(2):
        after.insert(0, comments())
    elif rng.integers(3) == 0:
        where.append(comments())
    return f"<html><head><title>{some(2, 8)}</title></head><body>{head}{''.join(before)}{body[0]}{''.join(where)}{body[1]}{''.join(after)}{foot}</body></html>"


def template_blocks(page: str) -> tuple[list, np.ndarray]:
    blocks = leaf_blocks(page)
    y = np.array([int("\x01" in b[0]) for b in blocks])
    return [(b[0].replace("\x01", "").replace("\x02", "") or ".", *b[1:]) for b in blocks], y


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, templates: int = TEMPLATES, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Train on at most train_pages pages of the table, those of the smallest hash, and on template pages."""
    keyed = pages.where(F.length("html") > 0).select(F.xxhash64("html").alias("h"), "html")
    bound = [r.h for r in keyed.select("h").orderBy("h").limit(train_pages).collect()]
    rows = sorted(r.html for r in keyed.where(F.col("h") <= bound[-1]).distinct().collect()) if bound else []
    found, texts = [], []
    for html in rows:
        blocks = leaf_blocks(html)
        y = landmark_labels(blocks) if blocks else None
        texts += [" ".join(b[0].split(None, 130)[:130]) for b in blocks if len(b[0]) > 40]  # templates take fewer words
        if y is not None:
            found.append((block_features(blocks), y))
    rng = np.random.default_rng(seed)
    texts = texts or ["the quick brown fox jumps over the lazy dog, and then it sleeps under the old tree."]
    for _ in range(templates):
        blocks, y = template_blocks(template_page(texts, rng))
        found.append((block_features(blocks), y))
    return train(found)


def main_text(html: str, model: tuple[np.ndarray, np.ndarray]) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    labels = viterbi(_unary(model[0], block_features(blocks)), model[1])
    return " ".join(b[0] for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            found = [main_text(x, model) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_crf_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
