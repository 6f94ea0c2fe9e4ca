"""Main text of web pages from a tree-structured graphical model over the DOM.

A page is a tree of block elements with its text blocks as leaves. Every node is content or not. A node's potential comes
from its features (tag, words of class, id and role, length, share of linked text), an edge's from the states of parent
and child and the sort of child. Sum-product messages go up from the leaves and down from the root, a level of all trees
of a batch at a time, and give exact marginals; text blocks with a content marginal of 1/2 or more are the main text.
Weights are those of a conditional random field: gradients of the exact likelihood of labelled pages, whose marginals
come from the same messages. `labelled_pages` makes labelled pages by rule; any others can be used.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line feed. Null and
empty html give the empty text. Unclosed and stray tags are taken as HTML takes them: a block element ends an open
paragraph, an end tag closes what it finds open. The content of script, style, title and other elements of raw text ends
at their end tag only; that of buttons, drawings and the like ends with the element that holds them, too, and one that is
nowhere closed is taken as empty. Formulas (math) are text.

Whole pages are read, in proportion to their length and nesting. A marginal of just 1/2 is content. Repeated rows each get
a row; nothing is shuffled; an empty table gives none. Columns besides key, url and html are not returned. Keys are integers.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style iframe textarea title noembed noframes xmp".split())
MUTED = frozenset("noscript template svg object select button canvas audio video datalist".split())
ENDS_P = BLOCKS - {"html", "body"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table div section article body html nav aside main".split())
WORDS = {
    "menu": r"nav|menu|breadcrumb|toc|pagination|pager|toolbar|tabs|skip",
    "head": r"header|masthead|banner|logo|topbar|site-title|brand",
    "foot": r"foot|copyright|colophon|legal|imprint",
    "side": r"side|related|recommend|widget|aside|trending|popular|more-|tags|teaser|rail",
    "ad": r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner-ad|dfp|outbrain|taboola)(?:$|[\s_-])",
    "comment": r"comment|reply|replies|disqus|discuss|respond|response|review",
    "notice": r"cookie|consent|notice|popup|modal|alert|newsletter|subscri|signup|paywall|gdpr|overlay|message",
    "share": r"share|social|follow|like-",
    "form": r"form|search|login|contact",
    "main": r"content|article|post|entry|story|main|body|text|page",
}
_WORD = {k: re.compile(v) for k, v in WORDS.items()}
TAGS = "article main section div p h1 h2 h3 h4 li ul ol dl nav header footer aside form fieldset table td th blockquote pre figure figcaption body details address".split()
ROLES = ("navigation", "banner", "contentinfo", "complementary", "main", "search", "dialog", "alert")
NAMES = ["bias", "leaf", *(f"tag:{t}" for t in TAGS), *(f"word:{w}" for w in WORDS), *(f"role:{r}" for r in ROLES), "hidden", "long", "short", "linked", "stop", "copyright", *(f"in:{t}" for t in TAGS), *(f"under:{t}" for t in TAGS), "under main", "wordy"]
_AT = {n: i for i, n in enumerate(NAMES)}

#: A quote opens a value only behind the sign of equality; any other is part of a name.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?|[^>=])*)>?", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


@dataclass
class Page:
    """Nodes in the order in which they begin; a parent comes before its children. Text is None for elements."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    on: list[list[int]] = field(default_factory=list)  # the features that are 1
    text: list[str | None] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    mark: list[bool] = field(default_factory=list)  # labelled content, only read where pages are labelled


def _element_features(tag: str, attrs: str) -> list[int]:
    on = [0]
    if (k := _AT.get(f"tag:{tag}")) is not None:
        on.append(k)
    if attrs and not attrs.isspace():
        words = []
        for name, value in _NAMED.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                words.append(value)
            elif name == "role" and value in ROLES:
                on.append(_AT[f"role:{value}"])
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                on.append(_AT["hidden"])
        if words:
            both = " ".join(words)
            on += [_AT[f"word:{k}"] for k, r in _WORD.items() if r.search(both)]
    return on


def parse(page: str, labelled: bool = False) -> Page:
    """The block tree of a page. With `labelled`, elements that carry data-main are content with all below them."""
    out = Page([-1], [0], [[0]], [None], ["#page"], [False])
    stack: list[tuple[str, int]] = [("#page", 0)]
    opened: dict[str, list[int]] = {}  # where each tag stands in the stack
    scopes: list[int] = []  # where in it lists, tables and sections begin
    muted: list[tuple[str, int]] = []  # open elements without text, and the height of the stack at their start
    n_muted = Counter()
    last_end: dict[str, int] = {}
    pieces: list[str] = []
    linked, in_link, size, pos, n = 0, 0, 0, 0, len(page)

    def close(height: int) -> None:
        while len(stack) > height:
            tag, _ = stack.pop()
            opened[tag].pop()
            if scopes and scopes[-1] == len(stack):
                scopes.pop()
        while muted and muted[-1][1] > height:
            n_muted[muted.pop()[0]] -= 1

    def ends_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last_end[tag] >= pos

    def flush() -> None:
        nonlocal pieces, linked, size
        if pieces:
            joined = "".join(pieces)
            text = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if text:
                up = stack[-1][1]
                words = text.count(" ") + 1
                on = [0, 1, _AT[f"in:{stack[-1][0]}"]] if f"in:{stack[-1][0]}" in _AT else [0, 1]
                on += [_AT["long"]] * (len(text) > 80) + [_AT["short"]] * (len(text) < 25) + [_AT["linked"]] * (2 * linked > size)
                on += [_AT["stop"]] * (text[-1] in ".!?\"'”»:") + [_AT["copyright"]] * ("©" in text or "all rights reserved" in text.lower()) + [_AT["wordy"]] * (words > 25)
                out.parent.append(up)
                out.depth.append(out.depth[up] + 1)
                out.on.append(on)
                out.text.append(text)
                out.tag.append("#text")
                out.mark.append(out.mark[up])
            pieces, linked, size = [], 0, 0

    def take(piece: str) -> None:
        nonlocal linked, size
        if muted:
            return
        pieces.append(piece)
        size += len(piece)
        linked += len(piece) * (in_link > 0)

    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            take(page[pos:])
            break
        if m.start() > pos:
            take(page[pos : m.start()])
        pos, tag = max(m.end(), m.start() + 1), (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1]:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
                pos = n if end is None else end.end()
            take(" ")
        elif tag in MUTED:
            take(" ")
            if m[1]:
                while n_muted[tag]:  # what it holds unclosed ends with it
                    n_muted[(last := muted.pop()[0])] -= 1
                    if last == tag:
                        break
            elif not m[3].endswith("/") and ends_later(tag):
                muted.append((tag, len(stack)))
                n_muted[tag] += 1
        elif tag in BLOCKS:
            flush()
            if m[1]:
                if opened.get(tag):
                    close(opened[tag][-1])
                continue
            in_link = 0
            held = muted[-1][1] if muted else 0  # what a muted element holds does not end what it stands in
            if tag in ENDS_P and stack[-1][0] == "p" and len(stack) > held:
                close(len(stack) - 1)
            if tag in SAME_ENDS:
                at = max((opened[t][-1] for t in SAME_ENDS[tag] if opened.get(t)), default=-1)
                if at >= held and at > (scopes[-1] if scopes else 0):
                    close(at)
            if tag == "hr":
                continue
            up = stack[-1][1]
            out.parent.append(up)
            out.depth.append(out.depth[up] + 1)
            on, above = _element_features(tag, m[3]), stack[-1][0]
            if (k := _AT.get(f"under:{above}")) is not None:
                on.append(k)
            if _AT["word:main"] in out.on[up] or _AT["role:main"] in out.on[up]:
                on.append(_AT["under main"])
            out.on.append(on)
            out.text.append(None)
            out.tag.append(tag)
            out.mark.append(out.mark[up] and "data-side" not in m[3] or "data-main" in m[3] if labelled else False)
            opened.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append((tag, len(out.parent) - 1))
        elif tag == "a":
            in_link = 0 if m[1] else 1
        elif tag in ("br", "img", "input", "wbr"):
            take(" " if tag == "br" else "")
    flush()
    return out


@dataclass
class Model:
    weight: np.ndarray  # of features, towards content
    edge: np.ndarray  # (sort of child: element or text, state of parent, state of child)


def _join(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parents, depths, sorts and the feature pairs (node, feature) of a batch of pages."""
    at = np.cumsum([0, *(len(p.parent) for p in pages)])
    parent = np.concatenate([np.array(p.parent) + a * (np.array(p.parent) >= 0) for p, a in zip(pages, at)])
    depth = np.concatenate([p.depth for p in pages]).astype(np.int64)
    leaf = np.array([t is not None for p in pages for t in p.text], dtype=np.int64)
    node = np.repeat(np.arange(at[-1]), [len(o) for p in pages for o in p.on])
    feat = np.fromiter((f for p in pages for o in p.on for f in o), np.int64, len(node))
    return parent, depth, leaf, node, feat


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(model: Model, tree: tuple, want_edges: bool = False):
    """P(content) of every node, by one pass of messages up and one down; with edges, also the pairs' expected counts."""
    parent, depth, leaf, node, feat = tree
    n = len(parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(node, model.weight[feat], n)
    below, up, down = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
    order = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(cut, cut[1:])]
    edge = model.edge[leaf]  # (n, parent's state, own state)
    for at in reversed(levels[1:]):
        up[at] = _lse(edge[at] + (own + below)[at][:, None, :], 2)
        for s in (0, 1):  # a level of few nodes must not cost a pass over all
            if 16 * len(at) > n:
                below[:, s] += np.bincount(parent[at], up[at, s], n)
            else:
                np.add.at(below[:, s], parent[at], up[at, s])
    for at in levels[1:]:
        p = parent[at]
        rest = own[p] + below[p] + down[p] - up[at]
        down[at] = _lse(edge[at] + rest[:, :, None], 1)
    total = own + below + down
    content = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
    if not want_edges:
        return content
    kids = np.flatnonzero(parent >= 0)
    p = parent[kids]
    joint = edge[kids] + (own[p] + below[p] + down[p] - up[kids])[:, :, None] + (own + below)[kids][:, None, :]
    joint = np.exp(joint - _lse(joint.reshape(len(kids), 4), 1)[:, None, None])
    return content, np.stack([joint[leaf[kids] == k].sum(0) for k in (0, 1)])


def fit(pages: list[str], rounds: int = 150, rate: float = 0.35, ridge: float = 0.3) -> Model:
    """Maximum likelihood of labelled pages (data-main on content elements) by Adam on exact gradients."""
    parsed = [parse(p, labelled=True) for p in pages]
    tree = _join(parsed)
    parent, _, leaf, node, feat = tree
    y = np.array([m for p in parsed for m in p.mark], float)
    # an element is content if it lies in a content element or most of its text does
    size = np.array([len(t or "") for p in parsed for t in p.text], float)
    good, all_ = size * y, size.copy()
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            good[parent[i]] += good[i]
            all_[parent[i]] += all_[i]
    y = np.where(leaf == 1, y, np.maximum(y, 2 * good > all_))
    kids = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (leaf[kids], y[parent[kids]].astype(int), y[kids].astype(int)), 1)
    w = np.zeros(len(NAMES) + 8)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        content, pairs = marginals(Model(w[:-8], w[-8:].reshape(2, 2, 2)), tree, want_edges=True)
        g = np.concatenate([np.bincount(feat, (y - content)[node], len(NAMES)), (seen - pairs).ravel()]) - ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w + rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Model(w[:-8], w[-8:].reshape(2, 2, 2))


def labelled_pages(count: int = 260, seed: int = 3) -> list[str]:
    """Pages of many layouts; data-main marks the article, data-side what does not belong to it inside it."""
    r = random.Random(seed)
    syll = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    para = lambda: " ".join(words(3, 14) + r.choice([".", ".", ".", "!", "?", "", ":", "\u2026", ";", "...", " -"]) for _ in range(r.randint(1, 6)))
    end = lambda: r.choice([".", "", "", "!"])
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b)))
    name = lambda *c: r.choice([f' class="{r.choice(c)}"', f' id="{r.choice(c)}"', f' class="{word()} {r.choice(c)}"'])

    def body() -> str:
        out = [r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"]).format(words(2, 9))] * (r.random() < 0.9)
        for _ in range(r.randint(1, 9)):
            made = [
                lambda: f"<p>{para()}</p>",
                lambda: r.choice([f"<p><strong>{words(2, 8)}{end()}</strong><br>{para()}", f"<p>{para()}<p>{para()}", f"<p><em>{words(2, 5)}</em> {para()} <a href='/{word()}'>{words(1, 3)}</a> {words(2, 5)}{end()}</p>"]),
                lambda: f"<h2>{words(1, 6)}</h2>",
                lambda: f"<ul>{''.join(f'<li>{words(3, 14)}{end()}</li>' for _ in range(r.randint(2, 5)))}</ul>",
                lambda: f"<blockquote><p>{para()}</p></blockquote>",
                lambda: f"<pre>{words(4, 12)}</pre>",
                lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>",
                lambda: f"<p>{words(1, 3)}{end()}</p>",
                lambda: f"<figure><figcaption>{words(3, 9)}{end()}</figcaption></figure>",
                lambda: f"<div>{para()}</div>",
                lambda: f"<div><p>{para()}</p></div>",
            ]
            out.append(r.choices(made, [12, 3, 3, 2, 1, 1, 1, 2, 1, 2, 2])[0]())
        if r.random() < 0.12:
            out = ["<div>", *out[:1], "<div>", *out[1:], "</div></div>"]
        if r.random() < 0.25:
            out.insert(r.randint(1, len(out)), f"<div data-side{name('ad', 'advert', 'sponsored', 'ads', 'promo')}>{para()}</div>")
        if r.random() < 0.2:
            out.append(r.choice([f"<div data-side{name('share', 'social', 'share-buttons')}>{words(1, 4)}</div>", f"<aside data-side{name('related', 'sidebar')}><h3>{words(1, 3)}</h3><ul>{links(2, 5)}</ul></aside>"]))
        if r.random() < 0.12:
            out.append(f"<div data-side{name('newsletter', 'subscribe', 'notice')}><p>{para()}</p></div>")
        return "".join(out)

    def comments() -> str:
        one = lambda: r.choice([f"<li{name('comment')}><p>{para()}</p></li>", f"<div{name('comment', 'reply')}><b>{word()}</b><p>{para()}</p></div>", f'<article class="comment"><p>{para()}</p></article>'])
        return r.choice([f"<section{name('comments', 'discussion')}><h2>{words(1, 3)}</h2>", f"<div{name('comments', 'comment-list', 'disqus', 'replies')}>"]) + "".join(one() for _ in range(r.randint(1, 5)))

    out = []
    for _ in range(count):
        inside = body()
        main = r.choice([f"<article data-main>{inside}</article>", f"<main data-main>{inside}</main>", f"<main><article data-main{name('post', 'entry', 'story')}>{inside}</article></main>", f"<div data-main{name('content', 'article-body', 'post-content', 'entry', 'main', 'story')}>{inside}</div>", f'<div data-main role="main">{inside}</div>', f"<section data-main{name('content', 'article', 'post')}>{inside}</section>", f"<article data-main>{inside}</article>"])
        com = comments()
        com += "</section>" if com.startswith("<section") else "</div>"
        nav = r.choice([f"<nav><ul>{links(3, 8)}</ul></nav>", f"<div{name('menu', 'navbar', 'nav', 'breadcrumb')}><ul>{links(2, 8)}</ul></div>", f'<ul role="navigation">{links(3, 6)}</ul>', f"<table><tr><td{name('leftnav', 'menu')}><a href=/>{words(1, 2)}</a><br><a href=/x>{words(1, 2)}</a></td></tr></table>", f"<nav>{words(1, 3)} <a href='/'>{word()}</a> {para()}</nav>"])
        head = r.choice(["", f"<header><h1>{words(1, 3)}</h1>{nav}<p>{words(2, 6)}</p></header>", f"<header><p>{para()}</p></header>", f'<div role="banner">{words(1, 4)}</div>', f"<div{name('logo', 'topbar', 'site-title')}>{words(1, 3)}</div>", f"<div{name('header', 'masthead', 'banner')}><div>{words(1, 4)}</div></div>"])
        before = [x for x, p in ((head, 0.6), (nav, 0.8), (f"<div{name('ad', 'advertisement', 'sponsor')}>{para()}</div>", 0.4), (f"<div{name('cookie-notice', 'consent', 'alert', 'notice')}><p>{para()}</p></div>", 0.25), (f"<form><label>{words(1, 3)}</label><p>{words(2, 7)}</p><input></form>", 0.2), (f'<div style="display:none"><p>{para()}</p></div>', 0.05), (f'<div role="dialog"><p>{para()}</p></div>', 0.05)) if r.random() < p]
        after = [x for x, p in ((com, 0.35), (f"<aside><h3>{words(1, 3)}</h3><p>{para()}</p><ul>{links(2, 6)}</ul></aside>", 0.3), (f"<div{name('sidebar', 'related', 'widget', 'recommended')}><h3>{words(1, 3)}</h3><p>{para()}</p></div>", 0.3), (f"<section{name('related', 'related-posts', 'recommended', 'more-stories')}><h2>{words(1, 4)}</h2><p>{para()}</p></section>", 0.15), (f'<div role="complementary"><p>{para()}</p></div>', 0.08), (f"<div{name('newsletter', 'subscribe', 'popup')}><p>{para()}</p></div>", 0.15), (f"<div{name('ad', 'ads', 'promo')}>{para()}</div>", 0.2), (r.choice([f"<footer>{r.choice(['&copy; ', '&#169; ', 'Copyright '])}{r.randint(1995, 2026)} {word()}{r.choice(['. All rights reserved.', ' | ', ', ', ' '])}{r.choice(['', para(), words(2, 6)])}</footer>", f"<footer><p>{words(3, 9)}</p><ul>{links(2, 5)}</ul></footer>", f"<div{name('footer', 'copyright')}><p>{para()}</p></div>", f"<footer><div><p>{para()}</p></div></footer>", f'<div role="contentinfo">{words(1, 3)} &middot; {words(1, 3)}</div>', f"<table><tr><td{name('footer', 'legal')}>{words(2, 6)}</td></tr></table>"]), 0.9)) if r.random() < p]
        r.shuffle(before)
        if r.random() < 0.15:
            before, after = before + after[:1], after[1:]
        inner = "".join([*before, main, *after])
        inner = r.choice([inner, inner, f"<div{name('wrapper', 'container', 'page')}>{inner}</div>"])
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title></head><body>{inner}" + r.choice(["</body></html>", ""]))
    return out


def extract(model: Model, pages: list[str]) -> list[str]:
    """The main text of each page."""
    if not pages:
        return []
    parsed = [parse(p) for p in pages]
    content, at, out = marginals(model, _join(parsed)), 0, []
    for p in parsed:
        out.append("\n".join(t for t, c in zip(p.text, content[at : at + len(p.text)]) if t is not None and c >= 0.5))
        at += len(p.text)
    return out


def extract_pages(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars."""
    schema = pa.schema([(key, pa.int64()), (url, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                texts = extract(model, [t or "" for t in part.column(page).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), part.column(url), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return pages.select(key, url, page).mapInArrow(run, f"`{key}` long, `{url}` string, text string, n_chars long")
