"""Main-text extraction: a recurrent block labeller over the leaves of a page.

A page is read into blocks: runs of text between block-level tags, each with its tag path. A
bidirectional LSTM in numpy reads, block by block, a vector of the tag path and of the hashed
words, so every block is labelled in the context of the whole page. It is fitted on a bounded
sample of pages, and broadcast to label all pages. The labels to learn are weak ones, from an order
of elements that the network isn't told (``markup_label``); it sees hashed tags, pairs of tags and
names, and how near to the block what sort of element is. The sample is varied, with part of the
markup hidden, so that neighbours and words count too.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the labeller is fitted on at most; all of them where there are fewer.
SAMPLE_PAGES = 300
#: Characters that are read to learn from at most, and blocks that are kept of them. All pages are labelled.
SAMPLE_CHARS = 20_000_000
SAMPLE_BLOCKS = 20_000
#: Blocks of a sequence in training, longer pages make several; labelling reads pages whole.
TRAIN_BLOCKS = 120
HIDDEN = 12
TAG_DIMS, PAIR_DIMS, NAME_DIMS, WORD_DIMS = 48, 48, 24, 24
BATCH_BLOCKS = 40_000

# Element classes of HTML.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
#: Elements whose text is a block of its own, also within a paragraph.
EMBED = frozenset("audio canvas noscript object select svg template video".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements in these that hold HTML again, and HTML tags that end them.
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s"
    " small span strong strike sub sup table tt u ul var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption head html legend option optgroup td th tr tbody thead tfoot".split())
BOILER = frozenset("head nav header footer aside form menu button dialog search fieldset select".split())
MAIN = frozenset(("article", "main"))
_BOILER_WORDS = (
    "nav menu header footer sidebar side aside advert ads ad banner promo sponsor sponsored cookie consent notice alert popup modal"
    " newsletter subscribe signup login form comment comments disqus reply replies discussion share sharing social related recommended"
    " breadcrumb breadcrumbs pagination pager toolbar widget copyright legal gdpr privacy skip masthead topbar bottombar tags rating search"
).split()
_BOILER_CLASS = re.compile(r"(?<![a-z])(?:" + "|".join(_BOILER_WORDS) + r")(?![a-z])")
_MAIN_CLASS = re.compile(r"(?<![a-z])(?:article|content|post|entry|story|main|body|text)(?![a-z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|<(?![A-Za-z/!]))*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[^\W_]+")
#: Paths that a worker remembers at most.
PATHS = 20_000


class Element(NamedTuple):
    """An open element as features see it."""

    tag: str
    names: str = ""
    hidden: bool = False


def _element(tag: str, attributes: str) -> Element:
    if not attributes.strip(" /\t\r\n"):
        return Element(tag, hidden=tag == "template")
    names, hidden = [], tag == "template"
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label") and tag not in ("html", "body"):  # those speak of the whole page
            names.append(_CAMEL.sub(" ", entities.unescape(value)).lower())
        hidden = hidden or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and bool(_HIDDEN_STYLE.search(value)))
    return Element(tag, " ".join(names), hidden)


class Path:
    """A node of the tree of tag paths: an element within another path. Equal paths are one object.

    What is known of a path is made from its parent's as it opens, so deep nesting costs no more.
    """

    __slots__ = ("parent", "element", "children", "top", "nodes", "depth", "unseen", "boiler", "main", "inside", "dims", "near")

    def __init__(self, parent: Path | None = None, element: Element | None = None):
        self.parent, self.element = parent, element
        self.children: dict[Element, Path] = {}
        self.dims: np.ndarray | None = None
        self.top = parent.top if parent else self
        self.nodes = 0  # of the tree, at its top
        if parent is None:
            self.depth, self.unseen, self.boiler, self.main, self.inside = 0, False, False, False, False
            self.near = (-1, -1, -1, -1, -1)
            return
        self.depth = parent.depth + 1
        self.unseen = parent.unseen or element.hidden or element.tag == "head"
        boiler_word, main_word = (bool(r.search(element.names)) if element.names else False for r in (_BOILER_CLASS, _MAIN_CLASS))
        boiler = element.hidden or element.tag in BOILER or boiler_word
        # within an article its own header is no boilerplate, and nothing outside it counts
        if parent.inside:
            self.inside, self.main = True, True
            self.boiler = parent.boiler or (boiler and (element.tag != "header" or bool(element.names)))
        else:
            self.inside = element.tag in MAIN
            self.main = self.inside or parent.main or main_word
            self.boiler = not self.inside and (parent.boiler or boiler)
        marks = (element.tag in BOILER and element.tag != "header", boiler_word, element.tag in MAIN, main_word, element.tag == "a")
        self.near = tuple(self.depth if m else at for m, at in zip(marks, parent.near, strict=True))

    def within(self, element: Element) -> Path:
        found = self.children.get(element)
        if found is None:
            found = self.children[element] = Path(self, element)
            self.top.nodes += 1
        return found

    def of(self, elements: Iterable[Element]) -> Path:
        path = self
        for e in elements:
            path = path.within(e)
        return path

    def elements(self) -> list[Element]:
        out, path = [], self
        while path.element is not None:
            out.append(path.element)
            path = path.parent
        return out[::-1]

    def counts(self) -> np.ndarray:
        """Hashed tags, pairs of tags and names on the path."""
        if self.dims is None:
            above = [self]
            while above[-1].parent is not None and above[-1].parent.dims is None:
                above.append(above[-1].parent)
            for path in reversed(above):
                if path.parent is None:
                    path.dims = np.zeros(TAG_DIMS + PAIR_DIMS + NAME_DIMS, np.float32)
                    continue
                path.dims = path.parent.dims.copy()
                tag, up = path.element.tag, path.parent.element
                path.dims[_bucket(tag, TAG_DIMS)] += 1.0
                path.dims[TAG_DIMS + _bucket(f"{up.tag if up else ''}>{tag}", PAIR_DIMS)] += 1.0
                for n in _NAME.findall(path.element.names):
                    path.dims[TAG_DIMS + PAIR_DIMS + _bucket(n, NAME_DIMS)] += 0.5
        return self.dims

    def vector(self) -> np.ndarray:
        near = [1 / (1 + self.depth - at) if at >= 0 else 0.0 for at in self.near]
        last = self.element.tag if self.element else ""
        return np.concatenate([np.tanh(self.counts()), [*near, self.unseen, last in ("p", "blockquote", "pre")]])


Block = tuple[Path, str]
#: A block and whether it is main text.
Labelled = tuple[Path, str, bool]


def blocks_of(page: str, root: Path | None = None) -> list[Block]:
    """(path, text) of every block with text, in page order; text is decoded and trimmed.

    Content of scripts, styles and other raw elements gives no block; that of embedded ones does, with
    their tag on its path. Unclosed and stray tags are tolerated: a block-level start closes an open
    paragraph, list items and cells close their like, an HTML start closes an open graphic or formula.
    """
    out: list[Block] = []
    top = root or Path()
    stack: list[Path] = []
    opened: Counter[str] = Counter()  # tags on the stack
    spots: list[int] = []  # how many parts there were as each element of the stack opened
    parts: list[str] = []

    def emit(path: Path, pieces: list[str]) -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            out.append((path, text))

    def flush() -> None:
        if parts:
            done = 0
            if embedded and any(opened[t] for t in EMBED):
                for i, p in enumerate(stack):
                    if p.element.tag in EMBED:
                        emit(p.parent, parts[done : spots[i]])
                        done = spots[i]
            emit(stack[-1] if stack else top, parts[done:])
            parts.clear()
            spots[:] = [0] * len(spots) if embedded else spots

    def push(element: Element) -> None:
        stack.append((stack[-1] if stack else top).within(element))
        spots.append(len(parts))
        opened[element.tag] += 1

    def cut(i: int) -> None:
        for p in stack[i:]:
            opened[p.element.tag] -= 1
        del stack[i:], spots[i:]

    def last(tag: str) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i].element.tag == tag), -1) if opened[tag] else -1

    def close(i: int) -> None:
        if any(p.element.tag in BLOCK for p in stack[i:]) or stack[i].element.tag in EMBED and "".join(parts[spots[i] :]).strip():
            flush()
        cut(i)

    def foreign() -> int:
        if any(opened[t] for t in FOREIGN):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].element.tag in HTML_AGAIN:
                    return -1
                if stack[i].element.tag in FOREIGN:
                    return i
        return -1

    def pop_to(tags: tuple[str, ...] | frozenset[str], barrier: frozenset[str]) -> None:
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].element.tag in tags:
                    cut(i)
                    return
                if stack[i].element.tag in barrier:
                    return

    at, size = 0, len(page)
    none: frozenset[str] = frozenset()
    drawn = embedded = False  # whether a graphic or formula, and an embedded element, was opened
    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = name.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                pop_to((tag,), none)
            elif tag in EMBED or tag in FOREIGN:
                if (i := last(tag)) >= 0:
                    close(i)
                    if tag not in ("math", "template"):
                        parts.append(" ")
            else:
                pop_to((tag,), BLOCK)
            continue
        if drawn:
            while tag in BREAKOUT and (i := foreign()) >= 0:
                close(i)
        inside = drawn and foreign() >= 0
        if m[0].endswith("/>") and (inside or tag in FOREIGN):
            if tag == "svg":
                parts.append(" ")
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if inside and not end:
                push(Element(tag, hidden=True))
                continue
            at = end.end() if end else size
            if tag not in ("script", "style", "title"):
                parts.append(" ")
            continue
        if tag in EMBED and tag != "template":
            parts.append(" ")
        drawn, embedded = drawn or tag in FOREIGN, embedded or tag in EMBED
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("option", "optgroup", "hr") and (i := last("select")) >= 0:
                close(i)
            if tag in CLOSES_P:
                pop_to(("p",), frozenset(("button", "td", "th", "table", "caption", "object", "template", "foreignobject", "div", "article", "section", "li", "body")))
            if tag == "li":
                pop_to(("li",), frozenset(("ul", "ol", "menu")))
            elif tag in ("dt", "dd"):
                pop_to(("dt", "dd"), frozenset(("dl",)))
            elif tag in ("td", "th"):
                pop_to(("td", "th"), frozenset(("tr", "table")))
            elif tag == "tr":
                pop_to(("tr",), frozenset(("table",)))
            elif tag == "option":
                pop_to(("option",), frozenset(("select",)))
            elif tag == "body":
                pop_to(("head",), none)
        if tag not in VOID:
            push(_element(tag, m[3] or ""))
    flush()
    return out


def markup_label(path: Path) -> bool:
    """Weak label of a training block: inside the article, and in none of its boilerplate."""
    last = path.element.tag if path.element else ""
    return not path.boiler and (path.main or last in ("p", "h1", "blockquote", "pre"))


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


class Features:
    """Vectors of blocks; what is known of paths and words is remembered within bounds."""

    path_dims = TAG_DIMS + PAIR_DIMS + NAME_DIMS + 7
    dims = path_dims + WORD_DIMS + 6

    def __init__(self) -> None:
        self.root = Path()
        self.paths: dict[Path, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def blocks(self, page: str) -> list[Block]:
        return blocks_of(page, self.root)

    def vectors(self, blocks: list[Block]) -> np.ndarray:
        """(blocks, dims): the path's vector, the shares of hashed words, and text measures."""
        if len(self.words) > 100_000:
            self.words.clear()
        paths, words = self.paths, self.words
        own: dict[Path, int] = {}
        which, rows, at, sizes, dense = [], [], [], [], []
        for path, text in blocks:
            k = own.get(path)
            if k is None:
                if path not in paths:
                    paths[path] = path.vector().astype(np.float32)
                k = own[path] = len(rows)
                rows.append(paths[path])
            which.append(k)
            found = text.lower().split()
            n = len(found)
            at += [words[w] if w in words else words.setdefault(w, _bucket(w, WORD_DIMS)) for w in found]
            sizes.append(n)
            dense.append((n, text.count(".") / n, "|" in text or "©" in text, len(text) / n / 10, (text.count("!") + text.count("?")) / n, text[-1] in ".!?…\"”"))
        out = np.zeros((len(blocks), self.dims), np.float32)
        out[:, : self.path_dims] = np.stack(rows)[which]
        n = np.array(sizes)
        cell = np.repeat(np.arange(len(blocks)), n) * WORD_DIMS + np.array(at)
        counts = np.bincount(cell, minlength=len(blocks) * WORD_DIMS).reshape(-1, WORD_DIMS)
        out[:, self.path_dims : -6] = counts / n[:, None]
        out[:, -6:] = np.array(dense, dtype=float)
        out[:, -6] = np.log1p(out[:, -6]) / 6
        if self.root.nodes > PATHS:  # the tree goes with what is known of it
            self.root, self.paths = Path(), {}
        return out


class BiLstm:
    """Bidirectional LSTM with a logistic output at every step; batches of padded sequences."""

    def __init__(self, dims: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        s = 1 / np.sqrt(hidden)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.uniform(-s, s, (dims, 4 * hidden))
            self.p["u" + d] = rng.uniform(-s, s, (hidden, 4 * hidden))
            self.p["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p["o"] = rng.uniform(-s, s, (2 * hidden, 1))
        self.p["k"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (steps, rows, dims), in reading order of the direction; padding keeps the state."""
        steps, rows, _ = x.shape
        n = self.hidden
        pre = x @ self.p["w" + d] + self.p["c" + d]
        h, c = np.zeros((rows, n)), np.zeros((rows, n))
        hs, memo = np.empty((steps, rows, n)), []
        for t in range(steps):
            z = pre[t] + h @ self.p["u" + d]
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * n], -30, 30)))
            i, f, o = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
            a = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c2 = f * c + i * a
            tc = np.tanh(c2)
            if keep:
                memo.append((i, f, o, a, c, tc, h))
            c = m * c2 + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            hs[t] = h
        return hs, memo

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, mf = self._run(x, mask, "f", keep)
        hb, mb = self._run(x[::-1], mask[::-1], "b", keep)
        both = np.concatenate([hf, hb[::-1]], axis=2)
        z = (both @ self.p["o"])[..., 0] + self.p["k"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), both, mf, mb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        q, both, mf, mb = self.forward(x, mask, keep=True)
        dz = (q - y) * mask / max(1.0, mask.sum())
        g = {"o": np.einsum("trh,tr->h", both, dz)[:, None], "k": np.array([dz.sum()])}
        dboth = dz[..., None] * self.p["o"][:, 0]
        n = self.hidden
        for d, memo, xs, ms, dh_all in (("f", mf, x, mask, dboth[..., :n]), ("b", mb, x[::-1], mask[::-1], dboth[::-1, :, n:])):
            u = self.p["u" + d]
            dpre = np.zeros((*x.shape[:2], 4 * n))
            du = np.zeros_like(u)
            dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
            for t in range(len(memo) - 1, -1, -1):
                i, f, o, a, c, tc, h = memo[t]
                m = ms[t][:, None]
                dh = dh + dh_all[t]
                dht = m * dh
                dct = m * dc + dht * o * (1 - tc**2)
                zi, zf, zo, za = dct * a * i * (1 - i), dct * c * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - a**2)
                dp = np.concatenate([zi, zf, zo, za], axis=1)
                dpre[t] = dp
                du += h.T @ dp
                dh = (1 - m) * dh + dp @ u.T
                dc = (1 - m) * dc + dct * f
            g["w" + d] = np.einsum("trd,trk->dk", xs, dpre, optimize=True)
            g["u" + d] = du
            g["c" + d] = dpre.sum((0, 1))
        return g


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(s) for s in seqs)
    x = np.zeros((steps, len(seqs), seqs[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(seqs)))
    for r, s in enumerate(seqs):
        x[: len(s), r] = s
        mask[: len(s), r] = 1
    return x, mask


# Boilerplate that training pages get more of than they have, as elements around a paragraph.
_EXTRAS = tuple(
    Element(tag, names)
    for tag, names in (
        ("aside", ""), ("form", ""), ("nav", ""), ("header", "site header"), ("section", "comments"), ("div", "comment"), ("ol", "comment list"), ("div", "sidebar"),
        ("div", "notice"), ("div", "cookie banner"), ("div", "ad"), ("div", "advert sponsored"), ("div", "related"), ("div", "share"), ("ul", "menu"), ("div", "newsletter signup"),
        ("footer", ""), ("header", ""),
    )
)
_STAGES = (Element("article"), Element("main"), Element("div", "content"), Element("div", "post body"))
_LISTS = ([Element("ul"), Element("li")], [Element("ol"), Element("li")], [Element("ul"), Element("li"), Element("p")], [Element("dl"), Element("dd")])
_BLANK = ("div", "div", "div", "section", "p", "span", "li")
_TAILS = ((Element("p"),), (), (Element("ul"), Element("li")), (Element("div"),), (Element("label"),), (Element("h2"),), (Element("p"), Element("a")))
_INNER = (Element("section"), Element("div"), Element("blockquote"), Element("ul"), Element("figure"))


def _varied(page: list[Labelled], texts: list[str], rng: np.random.Generator) -> list[Labelled]:
    """A copy of a page with another main element, lists in it, and boilerplate of main-like words in and around it."""
    root = Path()
    stage = _STAGES[rng.integers(len(_STAGES))]
    inner = _INNER[rng.integers(len(_INNER))] if rng.random() < 0.5 else None
    frame = Element("div", "page with sidebar") if rng.random() < 0.2 else None
    # elements that nobody knows, from some block on as if they were never closed
    odd = [Element(f"x{i}") for i in rng.integers(0, 1000, rng.integers(0, 4))]
    since = int(rng.integers(0, len(page)))
    # a run of paragraphs that are items of a list
    first, most = (int(rng.integers(0, len(page))), int(rng.integers(1, 8))) if rng.random() < 0.6 else (0, 0)
    items = _LISTS[rng.integers(len(_LISTS))]
    out = []
    for k, (path, text, label) in enumerate(page):
        own = [stage if e.tag in MAIN else e for e in path.elements()]
        if k >= since and len(own) > 2:
            own[-1:-1] = odd
        at = next((i for i, e in enumerate(own) if e == stage), None)
        if at is not None:
            if own[-1].tag == "h1" and rng.random() < 0.4:
                own[at + 1 : at + 1] = [Element("header")]
            elif inner and rng.random() < 0.7:
                own[at + 1 : at + 1] = [inner]
            if own[-1].tag == "p" and first <= k < first + most:
                own[-1:] = items
                text = _shorter(text, rng)
            if frame:
                own[at:at] = [frame]
        out.append((own, text, label))
    outer = [Element("html"), Element("body")]
    for _ in range(rng.integers(0, 6)):
        extra = _EXTRAS[rng.integers(len(_EXTRAS))]
        at = int(rng.integers(0, len(out) + 1))
        around = out[at][0] if at < len(out) and stage in out[at][0] and extra != Element("header") and rng.random() < 0.6 else outer
        around = around[: next((i + 1 for i, e in enumerate(around) if e == stage), len(around))]
        tail = (*(odd if rng.random() < 0.5 else ()), *_TAILS[rng.integers(len(_TAILS))])
        label = markup_label(root.of((*[e for e in around if e != frame], extra, *tail)))
        for _ in range(rng.integers(1, 4)):
            out.insert(at, ([*around, extra, *tail], texts[rng.integers(len(texts))], label))
    return [(root.of(own), text, label) for own, text, label in out]


def _shorter(text: str, rng: np.random.Generator) -> str:
    """The text or its first words, as an item of a list may have."""
    words = text.split()
    return " ".join(words[: rng.integers(1, len(words) + 1)]) if rng.random() < 0.7 else text


def _disguised(page: list[Labelled], rng: np.random.Generator, plain: bool) -> list[Labelled]:
    """A copy of a page whose elements say nothing: paragraphs alone, or each kind another of the same
    few with a meaningless name. Only their order and the texts are left to tell."""
    root, stands_for = Path(), {}
    at_random = {w: "".join(rng.choice(list("aeinorst"), 5)) for _, text, _ in page for w in text.split()} if rng.random() < 0.5 else {}
    out = []
    for path, text, label in page:
        own = []
        for e in path.elements():
            if e not in stands_for:
                names = "" if plain else f"c{rng.integers(100_000)}"
                stands_for[e] = e if e.tag in ("html", "body", "head") or (e.tag == "a" and rng.random() < 0.5) else Element("p" if plain else _BLANK[rng.integers(len(_BLANK))], names)
            own.append(stands_for[e])
        if plain:
            own = own[: 2 + (len(own) > 2)]
        # whose words may be any
        out.append((root.of(own), " ".join(at_random.get(w.strip(".,;:!?"), w) if w[-1:].isalnum() else w for w in text.split()), label))
    return out


def _hide(page: list[Labelled], tags: frozenset[str]) -> list[Labelled]:
    """A copy of a page without some tags on its paths."""
    root = Path()
    return [(root.of(e for e in path.elements() if e.tag not in tags), text, label) for path, text, label in page]


def _windows(page: list[Labelled], most: int, rng: np.random.Generator) -> list[Labelled]:
    """Runs of a page's blocks, at most ``most`` blocks together."""
    if len(page) <= most:
        return page
    starts = rng.permutation(range(0, len(page), TRAIN_BLOCKS))[: max(1, most // TRAIN_BLOCKS)]
    return [b for s in sorted(starts.tolist()) for b in page[s : s + TRAIN_BLOCKS]]


def fit(pages: list[str], epochs: int = 12, rows: int = 32, rate: float = 0.02, seed: int = 5) -> BiLstm:
    """Train on pages labelled by their markup, as they are, varied and disguised; some copies hide tags.

    Labels are those of the page as it is: a copy is learned with the labels of what it was made from.
    """
    rng = np.random.default_rng(seed)
    features, data = Features(), []
    read = [[(path, text, markup_label(path)) for path, text in b] for b in map(features.blocks, pages) if b]
    each = max(TRAIN_BLOCKS, SAMPLE_BLOCKS // max(1, len(read)))
    read = [_windows(b, each, rng) for b in read]
    texts = [t for b in read for _, t, label in b if label] or ["text"]

    def learn(page: list[Labelled]) -> None:
        x, y = features.vectors([(path, text) for path, text, _ in page]), np.array([label for *_, label in page], dtype=float)
        data.extend((x[i : i + TRAIN_BLOCKS], y[i : i + TRAIN_BLOCKS]) for i in range(0, len(y), TRAIN_BLOCKS))

    for page in read:
        hidden = frozenset(rng.choice(["article", "body", "div", "html", "p", "h1", "main", "section"], 2).tolist())
        learn(page)
        learn(_hide(page, hidden))
        learn(_varied(page, texts, rng))
        learn(_varied(page, texts, rng))
        learn(_hide(_varied(page, texts, rng), frozenset(("html", "body"))))
        learn(_disguised(page, rng, plain=True))
        learn(_disguised(page, rng, plain=False))
    net = BiLstm(Features.dims)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs if data else 0):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][1]) // 8 for i in order], kind="stable")]
        for start in rng.permutation(range(0, len(order), rows)):
            batch = [data[i] for i in order[start : start + rows]]
            x, mask = _padded([b[0] for b in batch])
            y = np.zeros(mask.shape)
            for r, (_, t) in enumerate(batch):
                y[: len(t), r] = t
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def label_pages(net: BiLstm, pages: list[str], features: Features) -> Iterator[tuple[int, list[Block], np.ndarray]]:
    """(position, blocks, probabilities) of each page; pages of similar length share a batch."""
    read = []
    for i, page in enumerate(pages):
        blocks = features.blocks(page)
        if blocks:
            read.append((i, blocks, features.vectors(blocks)))
        else:
            yield i, blocks, np.zeros(0)
    read.sort(key=lambda r: len(r[1]))
    while read:
        longest = len(read[-1][1])
        n = max(1, min(256, BATCH_BLOCKS // longest, len(read)))
        batch, read = read[-n:], read[:-n]
        q = net.forward(*_padded([b[2] for b in batch]))[0]
        for r, (i, blocks, x) in enumerate(batch):
            yield i, blocks, q[: len(x), r]


def main_text(blocks: list[Block], q: np.ndarray) -> str:
    """Blocks labelled as main text, joined; what sits in a head or hidden element never is."""
    kept = [t for (path, t), v in zip(blocks, q, strict=True) if v >= 0.5 and not path.unseen]
    return "\n".join(kept)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> BiLstm:
    """Fit on at most ``sample_pages`` pages: those with the smallest hash, the same on every run, as
    long as they have no more than ``SAMPLE_CHARS`` characters together (the shortest of them where
    even the first has more), and at most ``SAMPLE_BLOCKS`` of their blocks. Pages without id or html
    aren't learned from; of pages that share an id the shortest is.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html")).where("id is not null and length(html) > 0")
    # ids first: whole pages aren't sorted
    sizes = rows.groupBy("id").agg(F.min(F.length("html")).alias("n")).orderBy(F.xxhash64("id"), "id").limit(sample_pages).collect()
    chosen, total = [], 0
    for r in sizes:
        if total + r["n"] <= SAMPLE_CHARS:
            chosen.append((r["id"], r["n"]))
            total += r["n"]
    if sizes and not chosen:
        chosen = [tuple(min(sizes, key=lambda r: r["n"]))]
    if not chosen:
        return fit([])
    ids = pages.sparkSession.createDataFrame(chosen, f"id {pages.schema[id_col].dataType.simpleString()}, n int")
    own = rows.join(F.broadcast(ids), "id").where(F.length("html") == F.col("n"))
    sample = own.groupBy("id").agg(F.min("html").alias("html")).toPandas().sort_values("id")
    return fit(sample["html"].tolist())


def extract(pages: DataFrame, net: BiLstm, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The rows with the page's main text added: blocks in page order, joined by a line feed.

    A null or empty page, or one without main text, gives an empty text. Repeated rows each get a
    row; columns keep their names, and one called ``out_col`` is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for htmls in series:
            out = [""] * len(htmls)
            values = [p or "" for p in htmls]
            for first in range(0, len(values), 512):
                for i, blocks, q in label_pages(shared.value, values[first : first + 512], features):
                    out[first + i] = main_text(blocks, q)
            yield pd.Series(out)

    return pages.withColumn(out_col, run(F.col(f"`{html_col}`")))


def digest(pages: DataFrame) -> DataFrame:
    """Text and length of every page."""
    out = extract(pages.select("page_id", "url", "html"), train(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
