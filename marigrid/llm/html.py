"""Operator 5: main text of web pages, by boosted trees over DOM nodes and a decoding that keeps whole paths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.llm import gbt
from marigrid.llm.common import small_batches

#: Generated pages that the trees are fitted on: the documented bound of the sample.
PAGES = 900
#: Columns that the tokens of class, id and role are hashed to.
HASHED = 64
#: Kinds of block elements; each kind is a feature.
KINDS = {
    "page": "html body", "article": "article", "main": "main", "section": "section", "div": "div center noscript", "p": "p", "title": "h1", "heading": "h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl menu", "item": "li dt dd", "table": "table thead tbody tfoot tr td th caption", "quote": "blockquote pre figure figcaption details summary",
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset dialog", "other": "address hr search",
}
#: Parts of class, id and role tokens.
GOOD = "article content main post entry story text prose body".split()
BAD = "ad ads advert advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright sidebar widget aside related recommended share social cookie consent notice alert popup modal newsletter subscribe signup login search comment comments reply respond disqus discussion form toolbar pagination pager tags skip".split()
#: Pieces of words that notices and closing lines are made of, counted a node.
NOTICES = "© cookie consent gdpr privacy copyright reserved subscribe newsletter disclaimer sponsored impressum datenschutz vorbehalten réservés confidentialité reservados privacidad".split()
#: Names of parts in generated pages.
PARTS = {
    "menu": "menu nav navbar nav-main top-nav main-menu mw-panel mw-head site-nav topbar breadcrumb crumbs toc catlinks categories tag-list pager linklist portlet hamburger",
    "notice": "cookie-notice cookie-bar gdpr gdpr-bar notice consent alert newsletter-signup privacy-popup overlay toast modal paywall",
    "ad": "ad advert sponsored banner promo-unit dfp-slot billboard mpu",
    "share": "share social-links follow-us",
    "related": "related related-posts recommended read-also more-stories teaser trending most-read popular recirc",
    "side": "sidebar widget side rail secondary infobox-links panel",
    "footer": "footer copyright site-footer colophon legal bottom-bar imprint credits",
    "comments": "comments comment-list respond discussion",
    "main": "content post post-content entry-content article-body story prose main-text page-body body-copy mw-content-text",
    "plain": "container wrap inner row col block box lead",
}
#: Sentences of generated notices and closing lines.
SAID = ["We use cookies to improve this site.", "By using this site you accept cookies.", "Read our privacy policy.", "All rights reserved.", "\u00a9 2021", "Copyright 2019", "Subscribe to our newsletter.", "Sponsored"]
#: Elements whose content is never text; without an end tag the first take all that follows, as in browsers, the others nothing.
RAW = "script style title textarea".split()
SKIPPED = [*RAW, *"template svg iframe select button".split()]
_KIND = {t: k for k, (_, tags) in enumerate(KINDS.items()) for t in tags.split()}
_NAMES = list(KINDS)
_FORM, _DIV = _NAMES.index("form"), _NAMES.index("div")
_END_P = {t for t in _KIND if t not in {"html", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}}
#: An open element that such a start tag ends, and what bounds the search for it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# quotes count after an equals sign only; one that is never closed is a character like others
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*+)([^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+)(>)?)", re.S)
# the rest of a page in which a tag's quotes hide its end
_PLAIN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>)?)", re.S)
_SKIP = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIPPED}
_HEAD = re.compile(r"</head\s*>|<body[\s>]", re.I)
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[a-z]+")
_GOOD, _BAD = set(GOOD), set(BAD)


class Page:
    """Block nodes in page order and the runs of text that stand in them; read in time linear in the page's length."""

    __slots__ = ("hashed", "kind", "label", "parent", "runs", "tags", "tokens")

    def __init__(self, html: str, labelled: bool = False):
        self.parent, self.kind, self.tokens, self.tags, self.label = [-1], [0], [(0, 0)], [0], [1]
        self.hashed: list[tuple[int, int]] = []  # node, column of one of its tokens
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters in links
        stack: list[tuple[str, int]] = []
        places: dict[str, list[int]] = {t: [] for t in _KIND}  # of each tag on the stack
        endless: set[str] = set()  # elements without an end tag from here on
        words: list[str] = []
        links, in_link, at = 0, 0, 0

        def flush() -> None:
            nonlocal words, links
            if words:
                text = " ".join(unescape("".join(words)).split())
                if text:
                    self.runs.append((stack[-1][1] if stack else 0, text, min(links, len(text))))
            words, links = [], 0

        def close(names: set[str], bound: set[str]) -> None:
            last = max((places[t][-1] for t in names if places[t]), default=-1)
            if last >= 0 and last >= max((places[t][-1] for t in bound if places[t]), default=-1):
                flush()
                while len(stack) > last:
                    places[stack.pop()[0]].pop()

        def after(tag: str, end: re.Pattern) -> re.Match | None:
            found = None if tag in endless else end.search(html, at)
            if not found:
                endless.add(tag)
            return found

        pattern = _TAG
        for m in iter(lambda: pattern.search(html, at), None):
            if m.start() > at:
                piece = html[at : m.start()]
                words.append(piece)
                if in_link:
                    links += len(piece.strip())
            at = m.end()
            if m[2] is None:
                continue
            if not m[4]:  # it has no end, or a quote hides it
                if pattern is _TAG:
                    pattern, at = _PLAIN, m.start()
                else:
                    words.append(m[0])
                continue
            tag = m[2].lower()
            self.tags[stack[-1][1] if stack else 0] += 1
            if m[1]:
                if tag == "a":
                    in_link = 0
                elif tag == "br":
                    words.append(" ")
                elif tag in _KIND:
                    close({tag}, set())
                continue
            if tag in _SKIP:
                if not m[3].endswith("/") or tag in ("script", "style"):
                    end = after(tag, _SKIP[tag])
                    at = end.end() if end else len(html) if tag in RAW else at
                words.append(" ")
                continue
            if tag == "head":
                end = after(tag, _HEAD)
                if end:
                    at = end.start()
                continue
            if tag in ("a", "br", "input", "img"):
                in_link = tag == "a" or in_link
                words += [" "] * (tag in ("br", "img"))
                continue
            if tag not in _KIND:
                continue
            flush()
            in_link = 0
            if tag in _END_P:
                close({"p"}, {"td", "th", "table"})
            if tag in _ENDS:
                close(*_ENDS[tag])
            if tag == "hr":
                continue
            good = bad = 0
            label = 0
            if m[3]:
                for name, *values in _ATTRIBUTE.findall(m[3]):
                    name = name.lower()
                    if name in ("class", "id", "role"):
                        found = set(_TOKEN.findall("".join(values).lower()))
                        good, bad = good or not found.isdisjoint(_GOOD), bad or not found.isdisjoint(_BAD)
                        self.hashed += [(len(self.kind), zlib.crc32(t.encode()) % HASHED) for t in found]
                    elif labelled and name == "data-y":
                        label = int("".join(values))
            places[tag].append(len(stack))
            stack.append((tag, len(self.kind)))
            self.parent.append(stack[-2][1] if len(stack) > 1 else 0)
            self.kind.append(_KIND[tag])
            self.tokens.append((int(good), int(bad)))
            self.tags.append(1)
            self.label.append(label)
        if at < len(html):
            words.append(html[at:])
        flush()


_BOILER = {_NAMES.index(k) for k in ("nav", "header", "footer", "aside", "form")}
_CORE = {_NAMES.index(k) for k in ("article", "main")}
_P = _NAMES.index("p")


def features(page: Page) -> np.ndarray:
    """A row for each node: kind, tokens, text, links, density, depth, how its siblings compare and where the page's text lies."""
    n, parent, kind = len(page.kind), page.parent, page.kind
    # characters, characters in links, runs, stops, tags, paragraphs, nodes, words of notices and prose (runs that aren't links) of whole subtrees
    sums = [[0, 0, 0, 0, t, int(k == _P), 1, 0, 0] for t, k in zip(page.tags, kind, strict=True)]
    first: list[float] = [float("inf")] * n
    total = 0
    for node, text, link in page.runs:
        s = sums[node]
        s[0] += len(text)
        s[1] += link
        s[2] += 1
        s[3] += text.count(".") + text.count(",")
        low = text.lower()
        s[7] += sum(low.count(w) for w in NOTICES)
        s[8] += len(text) - link if 2 * link < len(text) else 0
        first[node] = min(first[node], total)
        total += len(text)
    own = [s[0] for s in sums]
    depth, children = [0] * n, [0] * n
    # of the node and all above it: good and bad tokens, boilerplate and article elements
    above = [[0, 0, 0, 0] for _ in range(n)]
    place, seen = [0] * n, {}
    for v in range(1, n):
        p, k, (good, bad) = parent[v], kind[v], page.tokens[v]
        up = above[p]
        depth[v] = depth[p] + 1
        above[v] = [up[0] or good, up[1] or bad, up[2] or int(k in _BOILER), up[3] or int(k in _CORE)]
        children[p] += 1
        place[v] = children[p]
        seen[p, k] = seen.get((p, k), 0) + 1
    for v in range(n - 1, 0, -1):
        s, up = sums[v], sums[parent[v]]
        for i in range(9):
            up[i] += s[i]
        if first[v] < first[parent[v]]:
            first[parent[v]] = first[v]
    # the path from the root to ever the child with most prose, and where each node leaves it
    heavy = [0] * n
    for v in range(n - 1, 0, -1):
        if not heavy[parent[v]] or sums[v][8] >= sums[heavy[parent[v]]][8]:
            heavy[parent[v]] = v
    on, v = [False] * n, 0
    on[0] = True
    while heavy[v]:
        v = heavy[v]
        on[v] = True
    leaves = list(range(n))
    for v in range(1, n):
        if not on[v]:
            leaves[v] = leaves[parent[v]]
    chars, linked, runs, stops, tags, paragraphs, nodes, notices, prose = np.array(sums, float).T
    split, rank = np.array(leaves), np.array(depth, float)
    onward = np.array(heavy)[split]
    all_prose = max(float(prose[0]), 1.0)
    up, own, start = np.array(parent), np.array(own, float), np.array(first)
    many = np.array(children, float)
    around = np.maximum(many[up], 1)
    same = np.array([0, *(seen[parent[v], kind[v]] for v in range(1, n))], float)
    beside = (chars[up] - own[up] - chars) / np.maximum(around - 1, 1)
    size = np.maximum(chars, 1)
    start[~np.isfinite(start)] = total
    numbers = [
        *np.array(page.tokens, float).T, *np.array(above, float).T, np.array(depth, float), np.log1p(chars), linked / size, chars / max(total, 1), np.log1p(many), np.log1p(paragraphs),
        chars / np.maximum(runs, 1), stops / size, np.array(place) / around, around, same / around, np.log1p(np.maximum(beside, 0)), start / max(total, 1), np.log1p(chars / np.maximum(tags, 1)), np.log1p(own), nodes,
        np.log1p(notices), notices / size, prose / all_prose, np.array(on, float), rank - rank[split], rank[split], prose[split] / all_prose, np.where(onward > 0, prose[onward], 0) / np.maximum(prose[split], 1), np.arange(n) < onward, np.log1p(prose[onward]) - np.log1p(chars),
    ]
    out = np.zeros((n, len(KINDS) + len(numbers) + HASHED), np.float32)
    out[np.arange(n), kind] = 1
    for j, column in enumerate(numbers, len(KINDS)):
        out[:, j] = column
    if page.hashed:
        node, column = np.array(page.hashed).T
        out[node, len(KINDS) + len(numbers) + column] = 1
    return out


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest choice in which all that stands in a dropped node is dropped."""
    keep, drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    parent = page.parent
    best = keep.copy()
    choice = np.zeros(len(parent), bool)
    for v in range(len(parent) - 1, 0, -1):
        choice[v] = best[v] >= drop[v]
        best[parent[v]] += max(best[v], drop[v])
        drop[parent[v]] += drop[v]
    choice[0] = True
    for v in range(1, len(parent)):
        choice[v] &= choice[parent[v]]
    return choice


def _generated(rng: np.random.Generator) -> str:
    """A random page; data-y says whether a node holds main text. Names of parts are known, hashed or left out."""
    pick = lambda *a: a[rng.integers(len(a))]
    law = rng.random() < 0.12  # its article is about what notices say
    style = pick("named", "named", "named", "hashed", "bare", "mixed")  # how this page names its parts

    ends = [""] * int(pick(6, 12, 25)) + [",", "."] + ["%%%"] * pick(0, 1)  # how often stops occur

    def words(n: int) -> str:
        sizes, last = rng.integers(1, 11, max(1, n)), rng.integers(len(ends), size=max(1, n))
        out = " ".join("etaoinshrd"[:k] + ends[e] for k, e in zip(sizes.tolist(), last.tolist(), strict=True))
        return out.capitalize() + pick(".", ".", "")

    def named(part: str) -> str:
        how = pick("named", "hashed", "bare") if style == "mixed" else style
        if how == "hashed":
            return pick("css", "sc", "jsx", "x", "") + pick("-", "_") + "".join("abcdefghij0123456789"[k] for k in rng.integers(20, size=6))
        return str(pick(*PARTS[part].split())) if how == "named" else ""

    def el(tag: str, inner: str, y: int, part: str = "") -> str:
        name = named(part) if part else named("plain") if style in ("hashed", "mixed") and rng.random() < 0.3 else ""
        attribute = f' {pick("class", "class", "id")}="{name}"' if name else ""
        return f'<{tag}{attribute} data-y="{y}">{inner}' + ("" if tag == "p" and rng.random() < 0.2 else f"</{tag}>")

    def link(n: int) -> str:
        return f'<a href="/x">{words(n)}</a>'

    def links(y: int = 0, tag: str = "ul") -> str:
        return el(tag, "".join(el("li", link(rng.integers(1, 4)), y) for _ in range(rng.integers(3, 9))), y)

    def bar(part: str) -> str:
        between = pick(" ", " | ", " / ", "<br>", "")
        return el(pick("div", "div", "p", "span" if rng.random() < 0.2 else "div"), words(1) * (rng.random() < 0.2) + between.join(link(rng.integers(1, 3)) for _ in range(rng.integers(2, 9))), 0, part)

    def said(n: int) -> str:
        return " ".join([str(pick(*SAID)) for _ in range(rng.integers(1, 3))] + [words(n)] * (rng.random() < 0.7))

    def notice() -> str:
        text = said(rng.integers(3, 30)) if rng.random() < 0.75 else words(rng.integers(8, 40))
        return el(pick("div", "div", "section"), pick(text, el("p", text, 0), el("div", el("p", text, 0), 0)) + pick("", f" {link(2)}", "<button>" + words(1) + "</button>"), 0, "notice")

    def ad() -> str:
        return pick(
            lambda: el("div", words(rng.integers(3, 30)), 0, "ad"), lambda: el(pick("aside", "div"), el(pick("h3", "h4", "p", "div"), words(2), 0) + pick(links, lambda: bar(""))(), 0, pick("related", "side")),
            lambda: el("div", pick(links, lambda: bar(""))(), 0, pick("share", "related")), lambda: el("form", el("p", words(6), 0) + '<input name="q">', 0, "notice"), notice, lambda: el("nav", links(0, "ol"), 0, "menu"),
            lambda: el(pick("p", "div"), words(2) + " " + link(rng.integers(3, 12)), 0, "related"), lambda: bar("menu"),
        )()

    def paragraph() -> str:
        n = int(pick(rng.integers(1, 6), rng.integers(5, 40), rng.integers(20, 120), rng.integers(60, 300)))
        text = words(n)
        if rng.random() < (0.6 if law else 0.03):
            text = pick(said(rng.integers(1, 9)), f"{text} {said(rng.integers(8, 50))}", f"{words(rng.integers(4, 20))} {said(rng.integers(4, 20))} {said(3)}")
        if rng.random() < 0.25:
            text = f"<b>{text}" + pick("</b>", "<br>", "")
        if rng.random() < 0.25:
            text += f' <a href="/y">{words(3)}</a> {words(6)}'
        return el("p", text, 1)

    def block() -> str:
        return pick(paragraph, paragraph, paragraph, paragraph, paragraph, paragraph, lambda: el(pick("h2", "h3"), words(rng.integers(2, 8)), 1), lambda: el("ul", "".join(el("li", words(rng.integers(3, 30)), 1) for _ in range(rng.integers(2, 6))), 1), lambda: el("blockquote", el("p", words(rng.integers(8, 50)), 1), 1), lambda: el("pre", words(12), 1), lambda: el("table", el("tr", "".join(el("td", words(3), 1) for _ in range(3)), 1), 1), lambda: el("figure", "<img src=x>" + el("figcaption", words(8), 1), 1), lambda: el("div", words(rng.integers(20, 90)), 1), lambda: el("section", el("h2", words(4), 1) + paragraph() + paragraph(), 1))()

    clean = rng.random() < 0.5
    body = [el("h1", words(rng.integers(2, 12)), 1)] * (rng.random() < 0.8) + ([paragraph() for _ in range(rng.integers(1, 16))] if clean else [block() for _ in range(rng.integers(1, 18))])
    if not clean and rng.random() < 0.6:
        for _ in range(rng.integers(1, 3)):
            body.insert(int(rng.integers(len(body) + 1)), ad())
    if not clean and rng.random() < 0.2:
        body = [el("header", body[0] + el("p", words(5), 1), 1), *body[1:]]
    if rng.random() < 0.12:  # a note of a line or two
        body = [el("h1", words(rng.integers(1, 7)), 1), *(el("p", pick("", "<b>") + words(rng.integers(1, 9)) + pick("", "<br>"), 1) for _ in range(rng.integers(1, 3)))]
    apart = len(body) > 1 and "<h1" in body[0] and rng.random() < 0.3  # the title stands before the article's element
    title, inner = (body[0], "".join(body[1:])) if apart else ("", "".join(body))
    tag, name = pick(("article", ""), ("article", ""), ("article", "main"), ("main", ""), ("div", "main"), ("div", "main"), ("div", "main"), ("div", "main"), ("section", "main"), ("div", ""), ("div", "plain"), ("td", "main"))
    main = el(tag, (title if tag == "td" else "") + inner, 1, name)
    if apart and tag != "td":
        main = el(pick("main", "div", "div", "section"), title + main, 1, pick("", "main", "plain"))
    for _ in range(rng.integers(0, 3)):
        if tag != "td":
            main = el(pick("main", "div", "div", "section"), main, 1, pick("", "main", "plain"))
    if rng.random() < 0.35:
        comment = lambda: el(pick("div", "li", "article"), el("p", words(2), 0) * (rng.random() < 0.5) + el("p", words(rng.integers(4, 90)), 0), 0, "comments")
        kept, style = style, "named"  # comments can't be told by their shape alone
        talk = el(pick("section", "div", "ol"), el("h3", words(2), 0) + "".join(comment() for _ in range(rng.integers(1, 9))), 0, "comments")
        style = kept
        main = main + talk if rng.random() < 0.7 else main.removesuffix(f"</{tag}>") + talk + f"</{tag}>"
    heading = lambda: el(pick("h2", "h3", "div", "p"), words(rng.integers(1, 4)), 0)
    side = [lambda: el("nav", links(), 0, pick("", "", "menu")), lambda: el("header", el("h1", words(2), 0) * (rng.random() < 0.3) + el("p", words(3), 0) + links(), 0, pick("", "menu")), lambda: el("div", links(), 0, "menu"), ad, ad, notice, lambda: bar("menu"), lambda: el("div", heading() + links() + el("p", words(rng.integers(5, 40)), 0), 0, "side"), lambda: el("aside", heading() + pick(links(), el("p", words(rng.integers(5, 60)), 0)), 0, pick("", "side")), lambda: el("div", "".join(el("div", heading() + links(), 0, pick("", "menu")) for _ in range(rng.integers(1, 4))), 0, "menu")]
    before = "".join(pick(*side)() for _ in range(rng.integers(1, 4)))
    last = lambda: pick(words(8), el("p", said(6), 0), said(4), links() + el("p", said(4), 0), el("div", bar("") + el("p", said(3), 0), 0), el("ul", "".join(el("li", said(5), 0) for _ in range(rng.integers(1, 4))), 0))
    after = "".join(pick(*side)() for _ in range(rng.integers(0, 3))) + pick("", el("footer", last(), 0, pick("", "footer")), el("div", last(), 0, "footer"), el("div", last(), 0, "footer"))
    if tag == "td":
        before, after = "<table data-y=1><tr data-y=1>" + el("td", before, 0, pick("side", "menu")), "</tr></table>" + after
    return f"<html data-y=1><head><title>{words(4)}</title><style>p{{margin:0}}</style></head><body data-y=1>{before}{main}{after}<script>var t='</p>'</script></body></html>"


_MODEL: dict[int, gbt.Trees] = {}


def train(pages: int = PAGES, seed: int = 3) -> gbt.Trees:
    """The trees, fitted on ``pages`` generated pages of many layouts; no input is read."""
    if pages not in _MODEL:
        rng = np.random.default_rng(seed)
        made = [Page(_generated(rng), labelled=True) for _ in range(pages)]
        _MODEL[pages] = gbt.fit(np.concatenate([features(p) for p in made]), np.concatenate([p.label for p in made]).astype(float))
    return _MODEL[pages]


def texts(htmls: list[str | None], model: gbt.Trees) -> list[str]:
    """The main text of each page: its kept blocks, one line each."""
    out: list[str] = []
    for s in range(0, len(htmls), 64):
        pages = [Page(h or "") for h in htmls[s : s + 64]]
        margins = np.split(model.margin(np.concatenate([features(p) for p in pages])), np.cumsum([len(p.kind) for p in pages])[:-1])
        for p, m in zip(pages, margins, strict=True):
            kept = decode(p, m)
            out.append("\n".join(text for node, text, _ in p.runs if kept[node]))
    return out


def extract(pages: DataFrame, model: gbt.Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    ``text`` is the article's blocks in page order, one line each, character references decoded and white space
    made single blanks. Elements without an end tag and unclosed quotes lose no text but in scripts, styles, titles and
    text areas, which take the rest of the page, as in browsers. Null, empty and unreadable html gives an empty text; null ids and urls and repeated rows
    stay; other columns are ignored. Whole pages are read; there is no shuffle.
    """
    small_batches(pages.sparkSession)
    model = model or train()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html")).mapInArrow(work, "page_id long, url string, text string, n_chars long")
