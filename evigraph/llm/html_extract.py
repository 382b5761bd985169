"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded over the tree.

A page is read into a tree of its block elements (inline elements only carry text). Every block gets
features: its kind and those of its ancestors, tokens of its class, id and role attributes and of its
ancestors', depth, place among its siblings, and the size, link density and tag density of its subtree.
Boosted trees, fitted to pages that `training_pages` writes from a fixed seed, give the probability that a
block's subtree holds main text. Decoding picks the most probable set of blocks in which no block is
taken without its parent, by dynamic programming from the leaves up; so an excluded ancestor never has
an included descendant.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._common import bound_batches, numbered

# ---------------------------------------------------------------- the tree of blocks

#: HTML's block elements, elements whose content is not markup, and elements that are never text.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form fieldset "
    "blockquote pre figure figcaption address details summary dialog menu center head hgroup search iframe object select option button".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements whose content is no text of the page, skipped where they are closed before the next block: drawings and parts that aren't shown.
DRAWN = frozenset("svg template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open p, and those that end an open element of their own kind.
CLOSES_P = BLOCKS - {"option", "button", "select", "td", "th", "tr"}
CLOSES_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Where the search for an element to end stops.
BARRIER = frozenset("html body table article section main div ul ol dl td th nav aside header footer form".split())

_OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Page:
    """Blocks in page order, with what their features need."""

    __slots__ = ("attrs", "children", "depth", "links", "own", "parent", "segments", "tag", "tags")

    def __init__(self):
        self.tag, self.parent, self.depth, self.attrs = ["#page"], [-1], [0], [""]
        self.children, self.own, self.links, self.tags = [[]], [0], [0], [0]
        self.segments: list[tuple[int, str]] = []

    def add(self, tag: str, parent: int, attrs: str) -> int:
        v = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.attrs.append(attrs)
        self.children.append([])
        self.children[parent].append(v)
        for counts in (self.own, self.links, self.tags):
            counts.append(0)
        return v


class _Finder:
    """Forward searches in one page; what is searched for again is not scanned again, so all searches take linear time."""

    def __init__(self, markup: str):
        self.markup, self.end = markup, len(markup)
        self._next: dict[str, tuple[int, re.Match | None]] = {}
        self.last = markup.rfind(">")
        self.quotes = True

    def find(self, pattern: str, at: int) -> re.Match | None:
        """The first match at or after at."""
        asked, known = self._next.get(pattern, (self.end + 1, None))
        if not (asked <= at and (known is None or known.start() >= at)):
            known = re.compile(pattern, re.IGNORECASE).search(self.markup, at)
            self._next[pattern] = (at, known)
        return known

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at at, quoted values passed over; -1 if there is none.

        If quotes leave a tag open to the end of the page, they are not passed over from there on.
        """
        if at > self.last:
            return -1
        i = at
        while self.quotes:
            m = _STOP.search(self.markup, i)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            i = self.markup.find(m[0], m.end()) + 1
            if i == 0:
                break
        self.quotes = False
        return self.markup.find(">", at)


def parse(markup: str) -> Page:
    """The tree of blocks of a page, in time linear in its length."""
    page, stack, link, at, run = Page(), [0], 0, 0, []
    open_at: dict[str, list[int]] = {"#page": [0]}  # where in the stack the open elements of each kind are
    seek, end_of = _Finder(markup), len(markup)

    def text(raw: str) -> None:
        if raw:
            run.append(raw)
            n = len(raw) - raw.count(" ")
            page.own[stack[-1]] += n
            if link:
                page.links[stack[-1]] += n

    def close_run() -> None:
        if run:
            joined = " ".join(html.unescape("".join(run)).split())
            if joined:
                page.segments.append((stack[-1], joined))
            run.clear()

    def innermost(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    def pop_to(names, stop=frozenset()) -> bool:
        i = innermost(names)
        if i == 0 or (stop and innermost(stop) > i):
            return False
        close_run()
        for v in stack[i:]:
            open_at[page.tag[v]].pop()
        del stack[i:]
        return True

    while at < end_of:
        m = _OPENING.search(markup, at)
        if m is None:
            text(markup[at:])
            break
        text(markup[at : m.start()])
        if m[1]:
            close = markup.find("-->", m.end())
            at = close + 3 if close >= 0 else end_of
            continue
        if m[2]:
            close = markup.find(">", m.end())
            at = close + 1 if close >= 0 else end_of
            continue
        close = seek.tag_end(m.end())
        if close < 0:
            text(markup[m.start() :])
            break
        name, closing, attrs = m[4].lower(), bool(m[3]), markup[m.end() : close]
        at = close + 1
        if name in RAW:
            if not closing:
                ended = seek.find(rf"</{name}(?=[\s/>])[^>]*>", at)
                at = ended.end() if ended else end_of
            continue
        if name in DRAWN:
            if not closing and not attrs.endswith("/"):
                ended, block = seek.find(rf"</{name}\s*>", at), seek.find(_BLOCK_TAG, at)
                if ended and (block is None or ended.start() < block.start()):
                    at = ended.end()
            continue
        if name == "a":
            link = 0 if closing else 1
        elif name == "br":
            run.append(" ")
        if name in BLOCKS:
            if closing:
                if not pop_to({name}, BARRIER - {name} if name in CLOSES_LIKE else frozenset()):
                    close_run()
                link = 0
                continue
            close_run()
            if name in CLOSES_P:
                pop_to({"p"}, BARRIER)
            if name in CLOSES_LIKE:
                pop_to(CLOSES_LIKE[name], BARRIER - CLOSES_LIKE[name])
            if name in ("html", "body") and open_at.get(name):
                continue
            if name == "body":
                pop_to({"head"})
            v = page.add(name, stack[-1], " ".join("".join(x) for x in _ATTRIBUTE.findall(attrs)) if "=" in attrs else "")
            open_at.setdefault(name, []).append(len(stack))
            stack.append(v)
        elif name not in VOID or name == "img":
            page.tags[stack[-1]] += 1
    close_run()
    return page


_BLOCK_TAG = rf"<(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])"


# ---------------------------------------------------------------- features

TAG_GROUPS = {
    g: i
    for i, names in enumerate(
        ("article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table thead tbody tfoot tr td th caption", "nav", "header hgroup", "footer", "aside", "form fieldset search", "blockquote pre figure figcaption", "html body #page center", "head", "select option button", "dialog details summary address iframe object")
    )
    for g in names.split()
}
N_GROUPS = 19
#: Words in class, id and role attributes, by what they hint at.
HINTS = (
    "article content contents post entry main story body text page prose blog news description document",
    "nav menu breadcrumb breadcrumbs navbar navigation toc pagination pager tabs links skip topbar sitemap",
    "header masthead banner logo brand top hero",
    "footer foot bottom copyright legal colophon credits",
    "sidebar aside side widget widgets related recommended recommendations trending popular rail more archive tags",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted dfp banner commercial affiliate outbrain taboola",
    "cookie cookies consent notice alert gdpr popup modal newsletter subscribe subscription privacy overlay warning disclaimer paywall toast",
    "comment comments reply replies disqus discussion respond feedback reviews commentlist thread",
    "share sharing social follow facebook twitter print email byline author meta date",
    "form search login signin signup register contact input subscribe poll vote",
)
_HINT = {w: i for i, words in reversed(list(enumerate(HINTS))) for w in words.split()}
N_HINTS = len(HINTS)
#: Kinds of ancestors that a block is told about.
ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form", "head", "li", "table")
N_FEATURES = N_GROUPS + 2 * N_HINTS + len(ABOVE) + 22


def _hints(attrs: str, known: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
    found = known.get(attrs)
    if found is None:
        found = known[attrs] = tuple({_HINT[t] for t in (x.lower() for x in _TOKENS.findall(attrs)) if t in _HINT})
        if len(known) > 20_000:
            known.clear()
    return found


def features(page: Page, known: dict) -> np.ndarray:
    n = len(page.tag)
    x = np.zeros((n, N_FEATURES), np.float32)
    size, links, tags, blocks = (np.array(a, np.float64) for a in (page.own, page.links, page.tags, [1] * n))
    parent = page.parent
    for v in range(n - 1, 0, -1):
        p = parent[v]
        size[p] += size[v]
        links[p] += links[v]
        tags[p] += tags[v] + 1
        blocks[p] += blocks[v]
    g, h, a = N_GROUPS, N_GROUPS + N_HINTS, N_GROUPS + 2 * N_HINTS
    heads = np.zeros(n)
    paras = np.zeros(n)
    for v in range(n - 1, 0, -1):
        heads[parent[v]] += heads[v] + (page.tag[v][0] == "h" and page.tag[v][1:].isdigit())
        paras[parent[v]] += paras[v] + (page.tag[v] == "p")
    place, same = np.zeros(n), np.zeros(n)
    for v in range(n):
        kids = page.children[v]
        kinds: dict[str, int] = {}
        for c in kids:
            kinds[page.tag[c]] = kinds.get(page.tag[c], 0) + 1
        for i, c in enumerate(kids):
            place[c] = (i + 0.5) / len(kids)
            same[c] = kinds[page.tag[c]]
    for v in range(n):
        x[v, TAG_GROUPS.get(page.tag[v], N_GROUPS - 1)] = 1
        if page.attrs[v]:
            x[v, [g + i for i in _hints(page.attrs[v], known)]] = 1
        p = parent[v]
        if p >= 0:
            np.maximum(x[p, g : g + N_HINTS], x[p, h : h + N_HINTS], out=x[v, h : h + N_HINTS])
            x[v, a : a + len(ABOVE)] = x[p, a : a + len(ABOVE)]
            if page.tag[p] in ABOVE:
                x[v, a + ABOVE.index(page.tag[p])] = 1
    up = np.array([max(p, 0) for p in parent])
    own = np.array(page.own, np.float64)
    deep, kids, whole = np.array(page.depth), np.array([len(c) for c in page.children]), max(size[0], 1.0)
    sib = kids[up]
    longest = np.zeros(n)
    np.maximum.at(longest, up[1:], size[1:])
    # siblings of the same kind and hints: how many, and their mean size
    alike, typical = np.zeros(n), np.zeros(n)
    for v in range(n):
        groups: dict[tuple, list[int]] = {}
        for c in page.children[v]:
            groups.setdefault((page.tag[c], page.attrs[c]), []).append(c)
        for members in groups.values():
            alike[members] = len(members)
            typical[members] = size[members].mean()
    b = a + len(ABOVE)
    for i, column in enumerate(
        (
            np.log1p(size), np.log1p(own), links / np.maximum(size, 1), tags / np.maximum(size, 1), size / whole, size / np.maximum(size[up], 1), deep, kids, sib, place, same,
            np.log1p(blocks), np.log1p(heads), np.log1p(paras), paras[up], heads[up], np.log1p(size / np.maximum(blocks, 1)), longest[up] / whole, alike, np.log1p(typical),
            links[up] / np.maximum(size[up], 1), np.log1p(whole),
        )
    ):
        x[:, b + i] = column
    return x


# ---------------------------------------------------------------- boosted trees


class Boosted:
    """Gradient-boosted complete binary trees of fixed depth for log loss, on binned features."""

    def __init__(self, n_trees: int = 40, depth: int = 5, rate: float = 0.25, bins: int = 48, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.n_bins, self.l2 = n_trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, k = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.n_bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        width = self.n_bins
        flat = binned + np.arange(k) * width
        nodes, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.threshold, self.value = np.zeros((self.n_trees, nodes), np.int64), np.full((self.n_trees, nodes), np.inf, np.float32), np.zeros((self.n_trees, leaves))
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(n, self.base)
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, p * (1 - p) + 1e-6
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, m = 2**level - 1, 2**level
                key = ((at - first)[:, None] * (k * width) + flat).ravel()
                sums = [np.bincount(key, weights=np.repeat(w, k), minlength=m * k * width).reshape(m, k, width).cumsum(axis=2) for w in (grad, hess)]
                (gl, hl), (gt, ht) = sums, (s[:, :1, -1:] for s in sums)
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                best = gain.reshape(m, -1).argmax(axis=1)
                for node in range(m):
                    j, c = divmod(int(best[node]), width)
                    if gain[node, j, c] > 1e-3 and c < len(cuts[j]):
                        self.feature[t, first + node], self.threshold[t, first + node] = j, cuts[j][c]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[t, at]] > self.threshold[t, at])
            leaf = at - nodes
            g, h = np.bincount(leaf, weights=grad, minlength=leaves), np.bincount(leaf, weights=hess, minlength=leaves)
            self.value[t] = self.rate * g / (h + self.l2)
            f += self.value[t][leaf]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.n_trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            f += self.value[t][at - (2**self.depth - 1)]
        return f


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """The most probable choice of blocks with no block chosen below one that is not; the page itself is chosen."""
    n = len(page.tag)
    take, skip = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    with_, without = take.copy(), skip.copy()
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        with_[p] += max(with_[v], without[v])
        without[p] += without[v]
    chosen = [True] * n
    for v in range(1, n):
        chosen[v] = chosen[page.parent[v]] and bool(with_[v] > without[v])
    return chosen


def main_text(page: Page, chosen: list[bool]) -> str:
    return "\n".join(text for v, text in page.segments if chosen[v])


# ---------------------------------------------------------------- pages to learn from

_MARK = "⁣"  # stands before each word of main text in a training page; invisible separator


class _Writer:
    """Writes one random page; main text is marked, so that the label of every block can be read off."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.words = ["".join(rng.choice(("th", "er", "an", "re", "is", "on", "de", "le", "um", "so", "ti", "ka")) for _ in range(rng.randint(1, 4))) for _ in range(80)]

    def prose(self, low: int, high: int, main: bool) -> str:
        out = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        out = [w + self.r.choice((",", ".", "", "", "", "", "", "")) for w in out]
        if self.r.random() < 0.1:
            out = [f"<b>{w}</b>" if self.r.random() < 0.1 else w for w in out]
        if main and self.r.random() < 0.2:
            out = [f'<a href="/{w}">{w}</a>' if self.r.random() < 0.08 else w for w in out]
        return " ".join(_MARK + w if main else w for w in out)

    def links(self, tag: str = "") -> str:
        r, n = self.r, self.r.randint(2, 9)
        items = [f'<a href="/{i}">{self.prose(1, 3, False)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.75 else " | ".join(items)

    def junk(self, kind: str) -> str:
        r, p = self.r, lambda a, b: self.prose(a, b, False)
        named = lambda *names: r.choice(("class", "class", "id")) + f'="{r.choice(names)}"'
        paragraphs = lambda a, b, lo, hi: "".join(f"<p>{p(lo, hi)}</p>" for _ in range(r.randint(a, b)))
        if kind == "nav":
            return r.choice((f"<nav>{self.links()}</nav>", f"<nav {named('menu', 'navbar', 'main-nav')}>{self.links()}</nav>", f"<div {named('menu', 'nav', 'top-menu', 'breadcrumbs', 'navigation')}>{self.links()}</div>", f"<ul {named('menu', 'nav', 'pagination')}>" + "".join(f"<li><a href='#'>{p(1, 2)}</a></li>" for _ in range(4)) + "</ul>"))
        if kind == "header":
            inner = r.choice((f"<h1>{p(1, 4)}</h1>", f"<p>{p(2, 8)}</p>", f"<div {named('logo', 'brand')}>{p(1, 3)}</div>", f"<a href='/'>{p(1, 3)}</a>")) + (self.junk("nav") if r.random() < 0.5 else "")
            return r.choice((f"<header>{inner}</header>", f"<header {named('site-header', 'masthead')}>{inner}</header>", f"<div {named('header', 'masthead', 'top-banner')}>{inner}</div>"))
        if kind == "footer":
            inner = r.choice((f"&copy; {p(1, 3)} &middot; {p(4, 20)}", paragraphs(1, 3, 3, 25), self.links(), f"<p>&copy; {p(2, 12)}</p>{self.links()}"))
            return r.choice((f"<footer>{inner}</footer>", f"<footer {named('site-footer')}>{inner}</footer>", f"<div {named('footer', 'page-footer', 'copyright', 'bottom')}>{inner}</div>"))
        if kind == "aside":
            inner = r.choice((f"<h3>{p(1, 4)}</h3>{self.links()}", f"<h2>{p(1, 3)}</h2>{paragraphs(1, 4, 5, 40)}", p(5, 40), paragraphs(1, 3, 8, 50)))
            return r.choice((f"<aside>{inner}</aside>", f"<aside {named('sidebar', 'related', 'widget')}>{inner}</aside>", f"<div {named('sidebar', 'side', 'widget', 'related', 'right-rail', 'recommended')}>{inner}</div>", f"<section {named('related', 'sidebar', 'trending')}>{inner}</section>"))
        if kind == "ad":
            inner = r.choice((p(3, 30), f"<p>{p(3, 30)}</p>", f"<a href='#'>{p(2, 10)}</a>", f"<h4>{p(1, 4)}</h4><p>{p(5, 25)}</p>"))
            tag = r.choice(("div", "div", "div", "aside", "section", "p"))
            return f"<{tag} {named('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'advertisement', 'banner-ad', 'ad-banner')}>{inner if tag != 'p' else p(3, 30)}</{tag}>"
        if kind == "notice":
            inner = r.choice((p(5, 40), f"<p>{p(5, 40)}</p>", f"<p>{p(5, 40)}</p><button>{p(1, 2)}</button>", f"{p(5, 30)} <a href='#'>{p(1, 2)}</a>"))
            tag = r.choice(("div", "div", "section", "dialog", "p"))
            return f"<{tag} {named('cookie', 'cookie-banner', 'notice', 'consent', 'alert', 'newsletter', 'popup', 'gdpr', 'subscribe', 'disclaimer', 'cookie-notice')}>{inner if tag != 'p' else p(5, 40)}</{tag}>"
        if kind == "form":
            inner = f"<label>{p(1, 4)}</label><input name='q'>" + r.choice(("", f"<p>{p(3, 15)}</p>")) + f"<button>{p(1, 2)}</button>" + r.choice(("", f"<select><option>{p(1, 1)}</option><option>{p(1, 1)}</option></select>"))
            form = r.choice((f"<form>{inner}</form>", f"<form {named('search', 'login', 'signup', 'contact-form')}>{inner}</form>"))
            return form if r.random() < 0.6 else f"<div {named('search', 'signup', 'login-box')}>{form}</div>"
        if kind == "share":
            return f"<div {named('share', 'social', 'sharing', 'follow')}>{self.links() if r.random() < 0.7 else p(2, 6)}</div>"
        one = lambda: r.choice((f"<div class='comment'><p>{p(5, 60)}</p></div>", f"<div class='comment'><b>{p(1, 2)}</b>: {p(5, 60)}</div>", f"<li><p>{p(5, 60)}</p></li>", f"<p>{p(5, 60)}</p>", f"<article class='comment'><header>{p(1, 2)}</header><p>{p(5, 50)}</p></article>"))
        inner = (f"<h3>{p(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6))) + (self.junk("form") if r.random() < 0.2 else "")
        tag = r.choice(("div", "section", "ol", "div"))
        return f"<{tag} {named('comments', 'comment-list', 'comments-section', 'discussion', 'responses', 'disqus-thread', 'replies', 'reader-comments')}>{inner}</{tag}>"

    def article(self) -> str:
        r, m = self.r, lambda a, b: self.prose(a, b, True)
        out, tiny = [], r.random() < 0.15
        if r.random() < 0.8:
            title = f"<h1>{m(1, 4) if tiny else m(2, 12)}</h1>"
            out.append(r.choice((title, title, title, f"<header>{title}</header>", f"<h2>{m(2, 10)}</h2>", f"<header>{title}<p>{m(3, 20)}</p></header>")))
        long = r.random() < 0.3
        for _ in range(r.choice((1, 1, 2, 3)) if tiny else r.randint(8, 25) if long else r.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = r.random()
            length = r.random()
            text = m(1, 4) if length < 0.12 or tiny else m(2, 10) if length < 0.3 else m(8, 120)
            if kind < 0.62:
                out.append(f"<p>{text}</p>" if r.random() < 0.85 else r.choice((f"<p>{text}", f"<p><b>{text}<br>", f"<p><b>{text}<br></p>", f"<p><i>{text}</p>")))
            elif kind < 0.7:
                out.append(f"<h{r.randint(2, 4)}>{m(1, 8)}</h2>" if r.random() < 0.1 else f"<h2>{m(1, 8)}</h2>")
            elif kind < 0.77:
                tag = r.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{m(2, 20)}</li>" for _ in range(r.randint(2, 7))) + f"</{tag}>")
            elif kind < 0.82:
                out.append(r.choice((f"<blockquote>{text}</blockquote>", f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>")))
            elif kind < 0.86:
                out.append(f"<figure><img src='x.png'><figcaption>{m(2, 15)}</figcaption></figure>")
            elif kind < 0.9:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m(1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.95:
                out.append(f"<div>{text}</div>" if r.random() < 0.6 else f"<section><h3>{m(1, 5)}</h3><p>{text}</p></section>")
            else:
                out.append(text)
        if r.random() < 0.35:
            for _ in range(r.randint(1, 2)):
                out.insert(r.randint(0, len(out)), self.junk(r.choice(("ad", "ad", "share", "aside", "notice", "form", "nav"))))
        if r.random() < 0.12:
            out.append(self.junk(r.choice(("comments", "footer"))))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = self.article() if r.random() < 0.97 else ""
        shell = r.random()
        if shell < 0.45:
            body = f"<article>{body}</article>" if r.random() < 0.7 else f"<article class='{r.choice(('post', 'entry', 'story'))}'>{body}</article>"
        elif shell < 0.6:
            body = f"<main>{body}</main>"
        elif shell < 0.85:
            body = f"<div {r.choice(('class', 'id'))}='{r.choice(('content', 'post', 'entry-content', 'article-body', 'main', 'story', 'post-content', 'text'))}'>{body}</div>"
        elif shell < 0.95:
            body = f"<div>{body}</div>"
        if r.random() < 0.3:
            body = f"<main>{body}{self.junk('aside') if r.random() < 0.4 else ''}{self.junk('comments') if r.random() < 0.3 else ''}</main>"
        before = [self.junk(k) for k in ("header", "nav", "ad", "notice", "form", "aside", "share") if r.random() < (0.45 if k in ("header", "nav", "ad") else 0.22)]
        after = [self.junk(k) for k in ("comments", "aside", "ad", "notice", "share", "nav", "form", "footer") if r.random() < (0.75 if k == "footer" else 0.25)]
        body = "".join(before[-2:]) + body + "".join(after[:2]) if r.random() < 0.25 else body
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            body = f"<div{r.choice(('', ' class=wrapper', ' id=page', ' class=container', ' class=row'))}>{body}</div>"
        r.shuffle(before)
        sep = r.choice(("", "\n", "<!-- x -->", "\n  "))
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{sep.join(before)}{body}{sep.join(after)}{end}"


def training_pages(n: int, seed: int = 11) -> Iterator[tuple[Page, np.ndarray]]:
    """n pages, and for each block whether its subtree holds main text."""
    rng = random.Random(seed)
    for _ in range(n):
        page = parse(_Writer(rng).page())
        y = np.zeros(len(page.tag))
        for v, text in page.segments:
            if _MARK in text:
                while v >= 0:
                    y[v] = 1
                    v = page.parent[v]
        yield page, y


@lru_cache(maxsize=2)
def trained(n_pages: int = 2400, seed: int = 11) -> Boosted:
    """The model; the same on every machine, as pages and fit have no other input."""
    known: dict = {}
    pairs = [(features(page, known), y) for page, y in training_pages(n_pages, seed)]
    return Boosted().fit(np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]))


# ---------------------------------------------------------------- the operator


def extract(pages: list[str], model: Boosted, known: dict) -> list[str]:
    """Main text of each page of a small list; all blocks are scored together."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    parts = [features(t, known) for t in trees]
    logits = np.split(model.logit(np.concatenate(parts)), np.cumsum([len(x) for x in parts])[:-1])
    return [main_text(t, decode(t, z)) for t, z in zip(trees, logits, strict=True)]


def extract_text(pages: DataFrame, html_col: str = "html", at_once: int = 64) -> DataFrame:
    """Adds text (main text, blocks joined by one line feed, empty if none) and n_chars (its code points) to every row.

    A null page counts as empty. White space is what Unicode calls so, no-break spaces included. Script, style and title are dropped,
    as are svg and template; formulas (math) and what canvas and noscript hold are text like other text. Repeated rows give repeated results, an empty table gives an empty result;
    columns named text or n_chars are replaced, the html column is dropped, other columns are kept.
    """
    bound_batches(pages.sparkSession)
    kept = pages.drop(*[c for c in ("text", "n_chars") if c != html_col])
    rest = [c for c in kept.columns if c != html_col]
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            column = batch.column(len(rest))
            out: list[str] = []
            for i in range(0, len(column), at_once):
                out += extract([x.as_py() or "" for x in column[i : i + at_once]], shared.value, known)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*rest, "text", "n_chars"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != html_col)
    return numbered(kept.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html_col}`"))).mapInArrow(run, f"{schema}, text string, n_chars long".lstrip(", "))
