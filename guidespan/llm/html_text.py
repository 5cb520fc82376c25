"""Main text of web pages by a bidirectional LSTM over the sequence of text blocks.

A page becomes its sequence of leaf blocks. Each block is read as the mean vector of the different words of its whole tag path (tag
names, class and id words), the mean vector of its hashed words, and a few numbers; the two directions of the network let every block
be judged by the whole page. The blocks judged to be the article are joined.

The pages have no labels, so the network is trained on weak ones: a bounded sample of pages whose own tags (article, nav, footer,
...) tell what is what, each also rewritten in several layouts: with plain containers and usual class names instead of those tags, and
with sidebars, forms, notices and reader comments put in. Part of the path words are left out at random in training, so that the
network learns to use the neighbours and the words too. Where no page's tags tell, the layouts are made of plain sentences instead.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidespan.llm.common import pieces

#: Pages that the network is fitted on at most, the longest taken for that, and the layouts made of each.
SAMPLE, SAMPLE_CHARS, LAYOUTS = 240, 30_000, 6
HASH_BITS, PATH_WIDTH, WORD_WIDTH, NUMBERS, HIDDEN = 12, 16, 8, 6, 16
EPOCHS, BATCH, RATE, DROP = 12, 48, 0.012, 0.15

SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "textarea", "select", "button"}
#: What may stand in the head of a page; any other tag, and any text, ends it.
IN_HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
#: Tags that an opening tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Blocks that close an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_part = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    text: str
    path: list[str]
    linked: int = 0  # characters within links
    near: list[str] | None = None  # class and id words of the innermost container that has any
    row: tuple | None = None  # its numbers for the network, once they are made


class Blocks(HTMLParser):
    """The leaf blocks of a page, in its order. Never fails on broken markup; an unclosed tag lasts to the end of what holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0
        self.open: dict[str, int] = {}  # how often each path word is open, in the order of the stack

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                near = next((words[1:] for _, words in reversed(self.stack) if len(words) > 1), [])
                self.blocks.append(Block(text, list(self.open), self.linked, near))
            self.parts, self.linked = [], 0

    def pop(self, tag: str) -> None:
        """Close the innermost open tag of this name and all within it; nothing if none is open."""
        while self.open.get(f"t:{tag}"):
            gone, words = self.stack.pop()
            self.silent -= gone in SILENT
            self.links -= gone == "a"
            for word in words:
                if self.open[word] == 1:
                    del self.open[word]
                else:
                    self.open[word] -= 1
            if gone == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and self.open.get("t:head"):
            self.pop("head")
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            if tag == "hr":
                self.flush()
            return
        if tag not in INLINE and tag not in SILENT:
            self.flush()
            if tag in ENDS_P and self.open.get("t:p"):
                self.pop("p")
            elif tag in CLOSES and self.stack and self.stack[-1][0] in CLOSES[tag]:
                self.pop(self.stack[-1][0])
        words = [f"t:{tag}"]
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                words += [f"c:{w}" for w in _part.findall(value.lower())]
            elif name in ("hidden", "aria-hidden"):
                words.append("c:hidden")
        self.stack.append((tag, words))
        for word in words:
            self.open[word] = self.open.get(word, 0) + 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE and tag not in SILENT:
            self.flush()
        self.pop(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.pop("head")
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


# Weak labels and layouts for training.

OUTSIDE = {"nav", "aside", "footer", "form", "dialog", "menu"}
BAD_CLASSES = {
    "nav": ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "links", "pagination", "pager"],
    "header": ["header", "masthead", "site-header", "top", "branding", "logo"],
    "footer": ["footer", "copyright", "legal", "bottom", "site-footer", "colophon"],
    "aside": ["sidebar", "widget", "related", "recommended", "more", "aside", "tags", "popular"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sponsor"],
    "notice": ["cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "banner", "warning", "gdpr"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact"],
    "comments": ["comments", "comment", "comment-list", "replies", "reply", "respond", "discussion", "responses"],
    "share": ["share", "social", "sharing", "follow"],
}
BAD_WORDS = {w for names in BAD_CLASSES.values() for name in names for w in name.split("-")}
GOOD_CLASSES = ["article", "content", "post", "entry", "story", "article-body", "post-content", "entry-content", "main", "text", "body"]


def weak_label(block: Block) -> int | None:
    """1 for the article, 0 for what stands around it, as the tags tell; None if they don't."""
    tags = [w[2:] for w in block.path if w[:2] == "t:"]
    if any(t in OUTSIDE for t in tags) or any(w[2:] in BAD_WORDS for w in block.path if w[:2] == "c:"):
        return 0
    if "article" in tags or "main" in tags:
        return 1
    return 0 if "header" in tags else None


def _near(path: list[str]) -> list[str]:
    """The class words of the innermost tag in a path that has any."""
    near: list[str] = []
    for word in reversed(path):
        if word[:2] == "c:":
            near.append(word)
        elif near:
            break
    return near


def _block(text: str, path: list[str], linked: int = 0) -> Block:
    return Block(text, list(dict.fromkeys(path)), linked, _near(path))


def layout(page: list[tuple[Block, int]], spare: list[str], rng: random.Random, short: bool = True) -> list[tuple[Block, int]]:
    """The blocks of a page in another layout, with other parts put in. spare: texts to fill these with. short: put short paragraphs in, and menus that
    only place, links and words tell.
    """
    style = rng.choice(["tags", "classes", "plain"])
    # The wrapper of the whole page may well have a class, or a tag, that elsewhere names the article.
    wrapper = ["t:div", *(f"c:{w}" for w in rng.choice(GOOD_CLASSES).split("-"))]
    body = ["t:html", "t:body"] + rng.choice([[], ["t:div", "c:wrapper"], ["t:div", "c:page"], ["t:div", "c:container", "t:div"], wrapper, wrapper, ["t:main"], ["t:table", "t:tr"]])
    cell = body[-1] == "t:tr"
    good = {"tags": rng.choice([["t:article"], ["t:main", "t:article"], ["t:main"], ["t:article", "t:section"]]), "classes": ["t:div", *(f"c:{w}" for w in rng.choice(GOOD_CLASSES).split("-"))], "plain": rng.choice([["t:div"], ["t:div", "t:div"], []])}[style]
    good = ["t:td", *good] if cell else good

    def part(kind: str) -> list[tuple[Block, int]]:
        own = (["t:td"] if cell else []) + ["t:" + (kind if style == "tags" and kind in ("nav", "header", "footer", "aside", "form") else rng.choice(["div", "section", "ul" if kind in ("nav", "share") else "div"]))]
        if style != "tags" or kind not in ("nav", "header", "footer", "aside", "form") or rng.random() < 0.5:
            own += [f"c:{w}" for w in rng.choice(BAD_CLASSES[kind]).split("-")]
        elif style == "plain" and kind in ("nav", "footer", "header"):
            own = own[:-1]
        if short and style == "plain" and kind in ("nav", "footer", "header", "share") and rng.random() < 0.4:  # nothing but place, links and words tells
            own = ["t:td"] if cell else rng.choice([["t:div"], ["t:ul"], []])
        inner_of = rng.choice([[], [], ["t:ul"], ["t:div", "c:" + rng.choice(["item", "inner", "row", "list", "box", "comment" if kind == "comments" else "block"])]])
        out = []
        if kind in ("nav", "footer", "share") and rng.random() < 0.25:  # links in one block, with line breaks between
            text = " ".join(" ".join(rng.choice(spare).split()[: rng.randint(1, 3)]) for _ in range(rng.randint(2, 7)))
            return [(_block(text, body + own, int(len(text) * rng.uniform(0.8, 1))), 0)]
        for _ in range({"nav": rng.randint(2, 7), "comments": rng.randint(1, 6), "aside": rng.randint(1, 5), "share": 2}.get(kind, rng.randint(1, 2))):
            words = rng.choice(spare).split()
            long = kind == "comments" or kind in ("aside", "notice") and rng.random() < 0.3
            n = rng.randint(5, 60) if long else rng.randint(1, 8)
            text = " ".join(words[:n])
            link = kind in ("nav", "aside", "footer", "share") and not long and rng.random() < 0.8
            inner = ["t:li", "t:a"] if link else rng.choice([["t:p"], [], ["t:div"], ["t:span"], ["t:li"]])
            if kind == "form":
                inner = rng.choice([["t:label"], ["t:p"], []])
            out.append((_block(text, body + own + inner_of + inner, len(text) if link else 0), 0))
        return out

    article = []
    for block, label in page:
        if label:
            tail = [w for w in block.path[-4:] if w[:2] == "t:" and w[2:] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td", "b", "ul", "ol", "figcaption")]
            if rng.random() < 0.2:
                tail = rng.choice([["t:blockquote", "t:p"], ["t:ul", "t:li"], ["t:h2"], ["t:div"], ["t:pre"], ["t:figure", "t:figcaption"]])
            article.append((_block(block.text, body + good + tail, block.linked), 1))
    for _ in range(rng.choice([0, 1, 1, 2]) if short else 0):  # short paragraphs, at the end too
        text = " ".join(rng.choice(spare).split()[: rng.randint(1, 4)]).strip(".,;:!? ")
        if text and article:
            at = rng.choice([len(article), len(article), rng.randint(1, len(article))])
            article.insert(at, (_block(text.capitalize() + rng.choice([".", ".", "!", "?", ""]), body + good + rng.choice([["t:p"], ["t:p"], ["t:div"], ["t:h2"]])), 1))
    cut = sorted(rng.sample(range(len(article) + 1), min(len(article) + 1, 2)))
    for kind in rng.choice([[], [], ["ad"], ["share"], ["aside"], ["form"], ["notice"], ["comments"], ["comments"], ["share", "comments"]]) if article else []:  # parts within the article
        inside = [(Block(b.text, list(dict.fromkeys(body + good + b.path)), b.linked, b.near or _near(good)), 0) for b, _ in part(kind)]
        at = len(article) if kind == "comments" or kind == "share" and rng.random() < 0.6 else cut[0]
        article[at:at] = inside
    before = [x for kind in ("notice", "header", "nav", "ad", "aside") if rng.random() < 0.55 for x in part(kind)]
    after = [x for kind in ("share", "aside", "comments", "form", "ad", "nav", "notice", "footer") if rng.random() < 0.5 for x in part(kind)]
    return before + article + after


# The network.


def _ids(block: Block, cache: dict[str, int]) -> tuple[list[int], list[int], list[float]]:
    def number(word: str) -> int:
        n = cache.get(word)
        if n is None:
            if len(cache) > 500_000:
                cache.clear()
            n = cache[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS)
        return n

    words = block.text.lower().split()
    path = [*block.path, *(f"n:{w}" for w in block.near or [])] or ["t:none"]
    n = len(block.text)
    return [number(w) for w in path], [number(w) for w in words], [np.log1p(n) / 8, np.log1p(len(words)) / 6, block.linked / n, float(block.text[-1] in ".!?…:;»\"'"), sum(map(block.text.count, ".,;:!?")) / n * 10, len(words) < 6]


class Batch:
    """Pages of blocks as arrays: blocks in a row, and the places of each page's blocks, forth and back, padded."""

    def __init__(self, pages: list[list[Block]], cache: dict[str, int], drop: random.Random | None = None):
        for page in pages:
            for block in page:
                block.row = block.row or _ids(block, cache)
        rows = [block.row for page in pages for block in page]
        path = [[i for i in p if drop.random() > DROP] or p[-1:] for p, _, _ in rows] if drop else [p for p, _, _ in rows]
        size = lambda lists: np.array([len(x) for x in lists])
        self.path, self.n_path = np.array([i for p in path for i in p]), size(path)
        words = [w for _, w, _ in rows]
        self.word, self.n_word = np.array([i for w in words for i in w]), size(words)
        self.numbers = np.array([x for _, _, x in rows], np.float32)
        length = np.array([len(p) for p in pages])
        first, steps = np.cumsum(length) - length, np.arange(length.max())[:, None]
        self.real = steps < length
        self.forth = np.where(self.real, first + steps, 0)
        self.back = np.where(self.real, first + length - 1 - steps, 0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self):
        rng = np.random.default_rng(0)
        size = 1 << HASH_BITS
        width = PATH_WIDTH + WORD_WIDTH + NUMBERS
        n = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {"path": n(size, PATH_WIDTH, scale=0.3), "word": n(size, WORD_WIDTH, scale=0.1), "out": n(2 * HIDDEN + width, scale=0.1), "bias": np.zeros(1, np.float32)}
        for d in ("forth", "back"):
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1
            self.w |= {f"{d}_x": n(width, 4 * HIDDEN, scale=width**-0.5), f"{d}_h": n(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), f"{d}_b": b}

    def inputs(self, b: Batch) -> np.ndarray:
        mean = lambda table, flat, n: np.add.reduceat(table[flat], np.cumsum(n) - n, axis=0) / n[:, None]
        return np.concatenate([mean(self.w["path"], b.path, b.n_path), mean(self.w["word"], b.word, b.n_word), b.numbers], axis=1).astype(np.float32)

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """States (steps, pages, HIDDEN) of one direction over inputs (steps, pages, width)."""
        steps, pages = x.shape[:2]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        z_in = x @ self.w[f"{d}_x"] + self.w[f"{d}_b"]
        out, kept = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_in[t] + h @ self.w[f"{d}_h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            last_c, last_h = c, h
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
            if keep:
                kept.append((i, f, o, g, last_c, c, last_h))
        return out, kept

    def back(self, x, kept, d_out, d: str, grad) -> np.ndarray:
        """Gradients of one direction; returns that of its inputs."""
        wx, wh = self.w[f"{d}_x"], self.w[f"{d}_h"]
        d_x = np.empty_like(x)
        d_h = d_c = np.zeros_like(d_out[0])
        g_x, g_h, g_b = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(self.w[f"{d}_b"])
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, last_c, c, last_h = kept[t]
            d_h = d_h + d_out[t]
            tc = np.tanh(c)
            d_c = d_c + d_h * o * (1 - tc * tc)
            z = np.concatenate([d_c * g * i * (1 - i), d_c * last_c * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
            g_x += x[t].T @ z
            g_h += last_h.T @ z
            g_b += z.sum(axis=0)
            d_x[t] = z @ wx.T
            d_h, d_c = z @ wh.T, d_c * f
        grad |= {f"{d}_x": g_x, f"{d}_h": g_h, f"{d}_b": g_b}
        return d_x

    def logits(self, b: Batch) -> np.ndarray:
        x = self.inputs(b)
        out = np.empty((len(x), 2 * HIDDEN), np.float32)
        for k, (d, order) in enumerate((("forth", b.forth), ("back", b.back))):
            out[order[b.real], k * HIDDEN : (k + 1) * HIDDEN] = self.run(x[order], d)[0][b.real]
        return np.concatenate([out, x], axis=1) @ self.w["out"] + self.w["bias"]

    def fit(self, pages: list[list[tuple[Block, int]]], seed: int = 0) -> None:
        """Train on pages of labelled blocks, with Adam's step sizes."""
        drop, cache, moments, step = random.Random(seed), {}, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}, 0
        pages = [p for p in pages if p]
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            drop.shuffle(pages)
            for s in range(0, len(pages), BATCH):
                part = pages[s : s + BATCH]
                b = Batch([[x for x, _ in p] for p in part], cache, drop)
                y = np.array([label for p in part for _, label in p], np.float32)
                x = self.inputs(b)
                states, kept = np.empty((len(x), 2 * HIDDEN), np.float32), {}
                for k, (d, order) in enumerate((("forth", b.forth), ("back", b.back))):
                    out, kept[d] = self.run(x[order], d, keep=True)
                    states[order[b.real], k * HIDDEN : (k + 1) * HIDDEN] = out[b.real]
                full = np.concatenate([states, x], axis=1)
                g = (_sigmoid(full @ self.w["out"] + self.w["bias"]) - y) / len(y)
                grad = {"out": full.T @ g, "bias": np.array([g.sum()])}
                d_full = g[:, None] * self.w["out"]
                d_in = d_full[:, 2 * HIDDEN :].copy()
                for k, (d, order) in enumerate((("forth", b.forth), ("back", b.back))):
                    d_out = np.where(b.real[:, :, None], d_full[order][:, :, k * HIDDEN : (k + 1) * HIDDEN], 0)
                    d_x = self.back(x[order], kept[d], d_out, d, grad)
                    d_in[order[b.real]] += d_x[b.real]
                for name, flat, n, lo, hi in (("path", b.path, b.n_path, 0, PATH_WIDTH), ("word", b.word, b.n_word, PATH_WIDTH, PATH_WIDTH + WORD_WIDTH)):
                    each = np.repeat(d_in[:, lo:hi] / n[:, None], n, axis=0)
                    grad[name] = np.stack([np.bincount(flat, c, 1 << HASH_BITS) for c in each.T], axis=1)
                step += 1
                for name, value in self.w.items():
                    m, v = moments[name]
                    m += 0.1 * (grad[name] - m)
                    v += 0.001 * (grad[name] ** 2 - v)
                    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def extract(self, htmls: list[str | None], cache: dict[str, int]) -> list[str]:
        """The main text of each page."""
        pages = [blocks_of(h) for h in htmls]
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        out = [""] * len(pages)
        while order:  # pages of similar length together
            size = max(1, min(128, 40_000 // len(pages[order[-1]])))
            part, order = order[-size:], order[:-size]
            logits = iter(self.logits(Batch([pages[k] for k in part], cache)).tolist())
            for k in part:
                out[k] = " ".join(b.text for b, x in [(b, next(logits)) for b in pages[k]] if x > 0)
        return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Tagger:
    """Fit on SAMPLE pages at most, by a hash of the id, of SAMPLE_CHARS characters at most (extraction takes all, whole)."""
    rows = pages.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("_hash"), F.col(html_col).cast("string").alias("_html")).where(F.length("_html").between(1, SAMPLE_CHARS))
    # The ids first, so that no task sends SAMPLE whole pages.
    picked = rows.select("_hash").distinct().orderBy("_hash").limit(SAMPLE)
    # Of an id that several rows have, the least page.
    got = rows.join(F.broadcast(picked), "_hash").groupBy("_hash").agg(F.min("_html").alias("_html")).collect()
    return fit_pages([h for _, h in sorted(map(tuple, got))])


def _made_pages(texts: list[str], rng: random.Random, count: int = 120) -> list[list[tuple[Block, int]]]:
    """Pages of a heading and paragraphs each, their words dealt from texts: for tables in which no page's own tags tell the article."""
    words = [w for t in texts for w in t.split()] or ["word"]
    deal = lambda n: " ".join(rng.choice(words) for _ in range(n)).strip(".,;:!? ")
    sentence = lambda: deal(rng.randint(6, 16)).capitalize() + rng.choice([".", ".", ".", "!", "?"])
    pages = []
    for _ in range(count):
        page = [(_block(deal(rng.randint(2, 7)).capitalize() or "A", ["t:html", "t:body", "t:h1"]), 1)]
        page += [(_block(" ".join(sentence() for _ in range(rng.randint(1, 6))), ["t:html", "t:body", rng.choice(["t:p", "t:p", "t:div"])]), 1) for _ in range(rng.randint(2, 8))]
        pages.append(page)
    return pages


def fit_pages(htmls: list[str]) -> Tagger:
    """Train on pages whose tags tell the article, and their layouts; without any such page, on layouts of made ones."""
    rng, known, seen = random.Random(0), [], []
    for html in htmls:
        blocks = blocks_of(html)
        seen += [b.text for b in blocks]
        labelled = [(b, weak_label(b)) for b in blocks]
        labelled = [(b, label) for b, label in labelled if label is not None]
        if any(label for _, label in labelled):
            known.append(labelled)
    tagger = Tagger()
    if known:
        spare = [b.text for page in known for b, _ in page]
        tagger.fit(2 * known + [layout(page, spare, rng) for page in known for _ in range(LAYOUTS)])
    else:
        made = _made_pages(seen, rng)
        tagger.fit([layout(page, [b.text for p in made for b, _ in p], rng, short=False) for page in made for _ in range(12)])
    return tagger


def main_text(pages: DataFrame, tagger: Tagger, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return id, url, text and n_chars (code points) of every page, from the whole html.

    Character references are decoded, white space in a block becomes one space, blocks are joined by one space in their order.
    Null and empty pages, and pages without article, have the empty text. Repeated rows are rows of their own; an empty table gives
    an empty result; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("_html"), F.col(url_col))
    kinds = [rows.schema[0].dataType, rows.schema[2].dataType]
    arrow = [to_arrow_type(k) for k in kinds]
    sent = pages.sparkSession.sparkContext.broadcast(tagger)  # the weights, of fixed size

    def run(batches):
        cache: dict[str, int] = {}
        for ids, htmls, urls in pieces(batches):
            texts = sent.value.extract(htmls, cache)
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow[0]), pa.array(urls, arrow[1]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {kinds[0].simpleString()}, `{url_col}` {kinds[1].simpleString()}, text string, n_chars long")
