"""Main text of web pages by wrappers that are inferred for each host (operator 1).

A page is a stream of tokens: tags that open and close blocks, and text
slots. A wrapper is a union-free regular expression over such streams, built
of tokens, optional groups and repeated groups. Inference folds a stream's
adjacent repeats into repeated groups, then aligns the streams of a host one
after the other: tokens that only one side has become optional, groups are
aligned inside, and slots collect how much text, and how much of it in links,
they hold, and whether it is the same on all pages. Tags balance, so a group
is kept as a node with its children.

What is the same on all pages of a host is template; the group with most of
what varies outside links holds the content. Inside it, tags tell what goes
around the text; names of classes and ids are a hint only, which groups with
an article, a title or most of the text disregard. Wrappers merge in any
order, so a host's streams are merged within partitions, then in a tree.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, materialize
from .url_rules import url_host

#: A quote opens a string only after = and white space; elsewhere a tag ends at its next >.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=)*+(?:>|\Z)|[^<]+|<",
    re.S,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Words of a class or id name; longer numbers are taken to differ from page to page.
WORD = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+(?![a-z]))(?:\d{1,2}(?!\d))?")

# Kinds of HTML elements.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "xmp", "math", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Parts of forms: what they hold is no text; the latter ones are words of a text where they stand in one outside any form.
CONTROLS = {"select", "option", "optgroup", "datalist", "meter", "progress"}
WORDED, TEXTS = {"button", "label", "output"}, {"p", "li", "td", "th", "dt", "dd", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption"}
#: What an opening tag ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Up to where an opening block ends a paragraph, and what a closing tag of a lesser block doesn't reach over.
AROUND_P = {"article", "aside", "td", "th", "table", "li", "section", "div", "body"}
WALLS, OVER_WALLS = {"article", "main", "body", "table"}, {"html", "body", "article", "main", "table", "div", "section"}
AROUND = {"nav", "header", "footer", "aside", "form", "fieldset", "menu", "dialog", "head", "search"}
AROUND_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "status"}
HEADINGS, PROSE, TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "pre", "blockquote"}, {"h1", "article", "main"}
#: Short texts that stand for what follows them; they are content where they are the same on all pages as well.
CAPTIONS = HEADINGS | {"dt", "th", "caption", "figcaption", "summary", "legend"}
#: Elements of which a run of siblings is one repeated group, whatever they hold.
ITEMS = {"p", "li", "tr", "td", "th", "dt", "dd", "tbody", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "#"}

# Words of class and id names that hint at what goes around a page's text.
REMARKS = {
    "comment", "comments", "commentlist", "commenter", "reply", "replies", "respond", "response", "responses", "discussion", "discussions", "disqus", "review", "reviews", "feedback", "remark", "remarks",
    "testimonials", "guestbook", "opinions", "reactions", "kommentar", "kommentare", "commentaire", "commentaires", "comentario", "comentarios", "avis",
}
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adslot", "banner", "banners", "promo", "promos", "promoted", "promotion", "sponsor", "sponsored", "sponsors", "werbung", "anzeige", "publicite", "publicidad"}
NOTICES = {"alert", "alerts", "consent", "cookie", "cookies", "copyright", "disclaimer", "gdpr", "login", "modal", "newsletter", "notice", "notices", "notification", "notifications", "paywall", "popup", "signup", "subscribe", "subscription", "toast"}
MENUS = {
    "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "menu", "menus", "nav", "navbar", "navigation", "pager", "paging", "pagination", "related", "recommended", "recommendations", "search",
    "share", "sharing", "sidebar", "sidebars", "skip", "social", "toc", "toolbar", "topbar", "widget", "widgets",
}
NOISE = REMARKS | ADVERTS | NOTICES | MENUS
#: Words that a group's name may have besides, without telling what it is.
PLAIN_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "desktop", "fb", "footer", "form", "full", "global", "group", "holder", "icons", "inner", "item", "items", "left",
    "link", "links", "list", "main", "mobile", "outer", "page", "panel", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "sticky", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
#: Words that tell whose remarks, adverts and the like they are.
OWNERS = {"article", "blog", "customer", "customers", "entry", "news", "post", "product", "reader", "readers", "story", "user", "users"}
#: Words after which a name tells what a group is made for, not what it is.
MADE_FOR = {"no", "has", "with", "without"}
#: Names that sections of prose have as well, and words of names whose header is a part of the content.
SUBJECTS = NOTICES - {"cookie", "cookies", "consent", "gdpr", "newsletter", "popup", "paywall"} | {"discussion", "discussions", "header", "menu", "menus", "navigation", "promotion", "related", "responses", "search", "social"}
HEADED = {"article", "entry", "post", "story", "section", "chapter"}
HIDDEN = {"hidden", "visually-hidden", "is-hidden"}
CONTENT_NAMES = {"article", "content", "entry", "post", "story", "main", "body", "text"}
#: A group is gone into while one of its children has so much of its text outside links; groups with more than LINKED in links and no paragraphs are menus.
HELD, LINKED = 0.6, 0.5
#: Pages with different texts (a slot remembers so many) from which on an equal text of so many words is template, and the
#: least share of a host's text that has to vary for that; in a content group template is less than half of the text.
ALIKE, ALIKE_WORDS, VARYING = 3, 4, 1 / 3
#: Words up to which a text that is the same on all pages is short.
SHORT = 12
#: Deepest block of a tree, as browsers bound it too: what is deeper stays as blocks side by side.
DEEPEST = 100
#: Children of a group from which on those of one page only are told by their tags alone; cells of an exact alignment.
WIDEST, CELLS = 256, 1 << 22


class Node:
    """label, children, whether it is optional or repeated, and how many turns it has on a page, at least and at most, and
    the checksum and words of its last turn's text (None if it varies, or isn't a block's own); for its own slots: characters in and out of links, the checksum of their text (None if it varies), and some pages that have
    them (by checksums of all that they say)."""

    __slots__ = ("children", "label", "linked", "mark", "optional", "plain", "repeated", "same", "seen", "tail", "turns", "words")

    def __init__(self, label: str, children=None, optional=False, repeated=False, plain=0, linked=0, same=0, seen=(), words=0, turns=(1, 1), tail=None):
        self.label, self.children, self.optional, self.repeated, self.plain, self.linked = label, children if children is not None else [], optional, repeated, plain, linked
        self.same, self.seen, self.words, self.turns, self.tail, self.mark = same, seen, words, turns, tail, 0

    def dump(self) -> list:
        return [self.label, int(self.optional), int(self.repeated), self.plain, self.linked, self.same, list(self.seen), self.words, [c.dump() for c in self.children], list(self.turns), self.tail]

    @staticmethod
    def load(x: list) -> Node:
        return Node(x[0], [Node.load(c) for c in x[8]], bool(x[1]), bool(x[2]), x[3], x[4], x[5], tuple(x[6]), x[7], tuple(x[9]), x[10] and tuple(x[10]))

    def expression(self) -> str:
        """The wrapper as a regular expression; # is a text slot."""
        inner = "#" if self.label == "#" else f"<{self.label}>" + "".join(c.expression() for c in self.children) + f"</{self.tag}>"
        mark = "*" if self.optional and self.repeated else "?" if self.optional else "+" if self.repeated else ""
        return f"({inner}){mark}" if mark else inner

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]


def _names(tag: str) -> tuple[str, bool, bool]:
    """An element's role, class and id names (their words joined by -), whether it is hidden, and whether it is an advert by name."""
    found = {}
    for k, a, b, c in ATTRIBUTE.findall(tag[NAME.match(tag).end() :]):
        found.setdefault(k.lower(), html.unescape(a or b or c))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or INVISIBLE.search(found.get("style", ""))
    role = found.get("role", "").lower().strip()
    names = list(filter(None, ("-".join(WORD.findall(x)).lower() for x in f"{found.get('class', '')} {found.get('id', '')}".split())))
    return ".".join(dict.fromkeys([*([f"role={role}"] if role else []), *names])), bool(hidden) or bool(HIDDEN.intersection(names)), bool(ADVERTS.intersection(names))


def blocks(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """A page's tree of blocks, with a slot for each run of text, and the texts of its slots in page order."""
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]
    # How many of a name are open, in all and since each open wall.
    opened, within = Counter({"html": 1}), [Counter({"html": 1})]
    texts: list[tuple[Node, str]] = []
    run: list[str] = []
    plain = linked = anchors = 0
    # An inline element that isn't text: its name, how many of that name are open in it, and the blocks around it.
    out_name, out_open, out_depth = "", 0, 0

    def flush() -> None:
        nonlocal plain, linked
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            slot = Node("#", plain=plain, linked=linked)
            stack[-1][1].children.append(slot)
            texts.append((slot, text))
        plain = linked = 0

    def cut(k: int) -> None:
        nonlocal out_name
        for name, _ in reversed(stack[k:]):
            if name in WALLS:
                within.pop()
            opened[name] -= 1
            within[-1][name] -= 1
        del stack[k:]
        if out_name and len(stack) < out_depth:
            out_name = ""

    def close(names: set[str], upto: set[str]) -> None:
        while any(opened[x] for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in upto:
                    return
                if stack[k][0] in names:
                    cut(k)
                    break
            else:
                return

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<" or token[1:2] not in "/!?" and not token[1:2].isalpha():
            if not out_name:
                run.append(token)
                bare = len(token.strip())
                plain, linked = plain + (0 if anchors else bare), linked + (bare if anchors else 0)
            continue
        if token[1] in "!?":
            if token.startswith("<![CDATA[") and not out_name:
                run.append(token[9:].removesuffix("]]>"))
            continue
        name, closing = NAME.match(token)[1].lower(), token[1] == "/"
        if name in RAW:
            if not closing and not token.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                run.append(" ")
            continue
        if name not in BLOCK:
            if name in VOID:
                if not out_name:
                    run.append(" " if name in ("br", "hr", "img") else "")
                    if name == "hr":
                        flush()
                continue
            if out_name:
                if name == out_name:
                    out_open += -1 if closing else 1
                    if not out_open:
                        out_name = ""
                continue
            if not closing:
                control = name in CONTROLS or name in WORDED and (opened["form"] or opened["fieldset"] or stack[-1][0] not in TEXTS)
                hidden = control or len(token) > len(name) + 2 and any(_names(token)[1:])
                if hidden:
                    out_name, out_open, out_depth = name, 1, len(stack)
                    run.append(" ")
            if name == "a":
                anchors = 0 if closing or out_name else 1
            continue
        if not out_name:
            flush()
        if closing:
            if (opened if name in OVER_WALLS else within[-1])[name] and name != "html":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        cut(k)
                        break
                    if stack[k][0] in WALLS and name not in OVER_WALLS:
                        break
            anchors = 0
            continue
        if name == "html":
            continue
        anchors = 0
        if name not in ("legend", "summary"):
            close({"p"}, AROUND_P)
        if name in ENDS:
            close(*ENDS[name])
        label, hidden, _ = _names(token)
        node = Node(f"{name}.{label}" if label else name)
        if hidden or out_name:
            node.label += ".hidden"
        stack[min(len(stack), DEEPEST) - 1][1].children.append(node)
        stack.append((name, node))
        opened[name] += 1
        within[-1][name] += 1
        if name in WALLS:
            within.append(Counter())
    flush()
    told = zlib.crc32("\n".join(t for _, t in texts).encode("utf-8", "replace"))
    for slot, text in texts:
        slot.same, slot.seen, slot.words = zlib.crc32(text.encode("utf-8", "replace")), (told,), text.count(" ") + 1
    return root, texts


def _union(a: tuple, b: tuple) -> tuple:
    return a if a == b else tuple(sorted({*a, *b})[:ALIKE])


def merge(a: Node, b: Node) -> Node:
    """The wrapper that fits whatever a or b, of the same label, fits on different pages."""
    same = a.same if a.same == b.same else None
    return Node(a.label, align(a.children, b.children), a.optional or b.optional, a.repeated or b.repeated, a.plain + b.plain, a.linked + b.linked, same, _union(a.seen, b.seen), max(a.words, b.words), (min(a.turns[0], b.turns[0]), max(a.turns[1], b.turns[1])), a.tail if a.tail == b.tail else None)


def join(a: Node, b: Node) -> Node:
    """The wrapper that fits a or b, which follow each other on a page: their texts are the same if both are."""
    same = zlib.crc32(f"{a.same} {b.same}".encode()) if a.same is not None and b.same is not None else None
    return Node(a.label, align(a.children, b.children, join), a.optional or b.optional, a.repeated or b.repeated, a.plain + b.plain, a.linked + b.linked, same, _union(a.seen, b.seen), a.words + b.words, (a.turns[0] + b.turns[0], a.turns[1] + b.turns[1]), b.tail)


def alike(a: Node, b: Node) -> bool:
    """Whether siblings of one label can be turns of one repeated group: items are, others if they hold much the same."""
    if a.label != b.label:
        return False
    if a.tag in ITEMS:
        return True
    x, y = ({c.label for c in n.children} for n in (a, b))
    return 2 * len(x & y) >= len(x | y)


def fold(children: list[Node]) -> list[Node]:
    """Adjacent repeats of one node or of a sequence of up to eight become a repeated group of their merged nodes."""
    out = list(children)
    for width in range(1, 9):
        k = 0
        while k + 2 * width <= len(out):
            first = out[k : k + width]
            if width > 1 and len({c.label for c in first}) == 1 or not all(map(alike, first, out[k + width : k + 2 * width])):
                k += 1
                continue
            end = k + 2 * width
            while end + width <= len(out) and all(map(alike, first, out[end : end + width])):
                end += width
            merged = first
            for at in range(k + width, end, width):
                merged = [join(x, y) for x, y in zip(merged, out[at : at + width], strict=True)]
            for x in merged:
                x.repeated = True
            out[k:end] = merged
            k += width
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence; of very long lists, of one in which the k-th of a label meets the k-th."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [(k, k) for k in range(lo)], [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    n, m, pairs = len(a), len(b), []
    if n * m > CELLS:
        turn, where = Counter(), {}
        for j, label in enumerate(b):
            where[label, turn[label]] = j
            turn[label] += 1
        turn = Counter()
        tails, back, last = [], {}, []
        for i, label in enumerate(a):
            j = where.get((label, turn[label]))
            turn[label] += 1
            if j is None:
                continue
            k = int(np.searchsorted(tails, j)) if tails else 0
            tails[k : k + 1], last[k : k + 1] = [j], [(i, j)]
            back[i, j] = last[k - 1] if k else None
        step = last[-1] if last else None
        while step:
            pairs.append(step)
            step = back[step]
        pairs.reverse()
    elif n and m:
        number = {label: k for k, label in enumerate({*a, *b})}
        x, y = np.array([number[t] for t in a]), np.array([number[t] for t in b])
        best = np.zeros((n + 1, m + 1), np.int32)
        for i in range(n - 1, -1, -1):  # what follows i and j has best[i, j] in common
            row = np.maximum(best[i + 1, :-1], np.where(y == x[i], best[i + 1, 1:] + 1, 0))
            best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
        i = j = 0
        while i < n and j < m:
            if a[i] == b[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1, j] >= best[i, j + 1]:
                i += 1
            else:
                j += 1
    return [*ends[0], *((i + lo, j + lo) for i, j in pairs), *ends[1]]


def align(a: list[Node], b: list[Node], both=None) -> list[Node]:
    """Longest common sequence of labels; what only one side has becomes optional."""
    both = both or merge
    left, right = [x.label for x in a], [y.label for y in b]
    if left == right:
        return [both(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*_common(left, right), (len(a), len(b))]:
        for lone in [*a[i:p], *b[j:q]]:
            lone.optional = True
            out.append(lone)
        if p < len(a):
            out.append(both(a[p], b[q]))
        i, j = p + 1, q + 1
    return _narrow(fold(out))


def _narrow(children: list[Node]) -> list[Node]:
    """Names that are made for one page each would let a group grow with the host: beyond WIDEST, tags alone tell them apart."""
    if len(children) <= WIDEST:
        return children
    for c in children:
        if len(c.seen) < 2 and c.label != c.tag and len({s for x in c.children for s in x.seen}) < 2:
            c.label = c.tag
    return fold(children)


def folded(node: Node) -> Node:
    if node.children and all(c.label == "#" for c in node.children):
        node.tail = zlib.crc32(" ".join(str(c.same) for c in node.children).encode()), sum(c.words for c in node.children)
    node.children = fold([folded(c) for c in node.children])
    return node


#: What a group's place in the host's wrapper tells of a page's group: its slots are content, or it is left out; if
#: it is a menu on the host's pages as a whole, each page's own links decide; its last turn on a page may be template.
KEPT, OUT, MENU, TAIL = 1, 2, 4, 8


class Judge:
    """Decides which groups of a wrapper hold content.

    Sums are of characters outside links that aren't template: what varies
    over the host's pages, or all where fewer than ALIKE different pages tell.
    """

    def __init__(self, wrapper: Node):
        self.wrapper = wrapper
        self.sums: dict[int, tuple[int, int]] = {}
        self.tags: dict[int, set[str]] = {}
        self.known: dict[tuple, bool] = {}
        varying, every = self._varying(wrapper)
        self.varies = varying >= VARYING * every > 0
        self._sum(wrapper)
        self.total = self.sums[id(wrapper)][0]

    def _varying(self, node: Node) -> tuple[int, int]:
        """Characters out of links that differ from page to page, and all."""
        sums = [(node.plain if node.same is None else 0, node.plain), *(self._varying(c) for c in node.children if c.tag not in ("nav", "aside", "head"))]
        return sum(v for v, _ in sums), sum(e for _, e in sums)

    def template(self, slot: Node, of: Node) -> bool:
        """Whether a slot says the same on all of the host's pages; never the short texts that stand for what follows."""
        return self.varies and slot.same is not None and len(slot.seen) >= ALIKE and slot.words >= ALIKE_WORDS and of.tag not in CAPTIONS

    def _sum(self, node: Node) -> None:
        plain = linked = 0
        held: set[str] = set()
        for c in node.children:
            if c.label == "#":
                if not self.template(c, node):
                    plain, linked = plain + c.plain, linked + c.linked
                continue
            self._sum(c)
            held |= self.tags[id(c)] | {c.tag, *(x for x in c.label.split(".")[1:] if x.startswith("role="))}
            if c.tag not in ("nav", "aside", "head") and "hidden" not in c.label.split(".")[1:]:
                p, q = self.sums[id(c)]
                plain, linked = plain + p, linked + q
        self.sums[id(node)], self.tags[id(node)] = (plain, linked), held

    def around(self, node: Node, inside: str) -> bool:
        key = (id(node), inside)
        if key not in self.known:
            self.known[key] = self._around(node, inside)
        return self.known[key]

    def _around(self, node: Node, inside: str) -> bool:
        """Whether a group goes around the content; inside: the tag of the content group it is in, if any.

        Tags and roles tell it, but not of what holds most of the page's
        text. Names tell it where all their words do, and where only some do
        of lesser groups; they never tell it of groups that hold a title or
        an article, nor of bodies, mains and headings.
        """
        tag, *names = node.label.split(".")
        if tag == "body":
            return False
        if HIDDEN.intersection(names):
            return True
        if tag == "main" or "role=main" in names:
            return False
        held = self.sums[id(node)][0]
        most = 2 * held > self.total > 0
        if tag == "article" or "role=article" in names:
            return not most and (inside == "article" or bool(_hints(names)[0] & (REMARKS | ADVERTS)))
        if any(x[5:] in AROUND_ROLES for x in names if x.startswith("role=")):
            return True
        if tag in HEADINGS or inside and tag in PROSE and not _hints(names)[0] & ADVERTS:
            return False
        titled = bool(self.tags[id(node)] & TITLES or "role=main" in self.tags[id(node)])
        section = self.tags[id(node)] & HEADINGS and self.tags[id(node)] & PROSE and self.prose(node)
        sure, maybe = _hints(names)
        if inside and sure | maybe <= {"header"} and (tag == "header" or sure | maybe and HEADED.intersection(re.split(r"[.-]", node.label))):
            return False
        if tag in AROUND and not (tag == "footer" and inside == "blockquote"):
            return tag in ("nav", "aside", "head") or not (most or titled and tag == "form")
        if inside and sure and sure <= SUBJECTS - REMARKS - {"related", "promotion"} and self.varied(node):
            return False
        if inside and section and sure and sure <= SUBJECTS and (tag == "section" or tag == "div" and "section" in names):
            return False
        if sure:
            return not titled and (not most or bool(sure & (REMARKS | ADVERTS | {"sidebar", "cookie", "cookies", "consent", "gdpr"})))
        return bool(maybe) and not titled and not section and 4 * held <= self.total

    def varied(self, node: Node) -> bool:
        """Whether a group holds a paragraph that differs from page to page, and not by its links."""
        return self.varies and any(c.label != "#" and (c.tag in PROSE and any(x.label == "#" and x.same is None and x.plain > x.linked and x.words >= ALIKE_WORDS for x in c.children) or self.varied(c)) for c in node.children)

    def prose(self, node: Node) -> bool:
        """Whether a group holds a paragraph with text."""
        key = (id(node), None)
        if key not in self.known:
            self.known[key] = any(c.label != "#" and not self.around(c, node.tag) and (c.tag in PROSE and any(x.label == "#" for x in c.children) or self.prose(c)) for c in node.children)
        return self.known[key]

    def text(self, node: Node, inside: str) -> tuple[int, int]:
        """Characters of a group's slots out of and in links, without what goes around the content."""
        plain = linked = 0
        for c in node.children:
            if c.label == "#":
                p, q = (0, 0) if self.template(c, node) else (c.plain, c.linked)
            else:
                p, q = (0, 0) if self.around(c, inside or "body") else self.text(c, inside)
            plain, linked = plain + p, linked + q
        return plain, linked

    def is_menu(self, node: Node) -> bool:
        if node.tag not in ("ul", "ol", "dl", "table", "div", "section"):
            return False
        plain, linked = self.text(node, "body")
        return linked > LINKED * (plain + linked) and not self.prose(node)

    def fixed(self, node: Node) -> bool:
        """Whether all that a group or slot says is the same on all of the host's pages."""
        if node.label == "#":
            return self.varies and node.same is not None and len(node.seen) >= ALIKE
        return bool(node.children) and all(map(self.fixed, node.children))

    def said(self, node: Node) -> int:
        return node.words if node.label == "#" else sum(map(self.said, node.children))

    def paragraphs(self, node: Node) -> bool:
        """Whether a group is or holds a run of paragraphs."""
        return node.tag in PROSE and node.repeated or node.label != "#" and any(map(self.paragraphs, node.children))

    def titled(self, node: Node) -> bool:
        return not node.repeated and node.label != "#" and (node.tag == "h1" or "h1" in self.tags[id(node)])

    def remarks(self, node: Node) -> bool:
        """Whether a group is, or holds little else than, like blocks without headings, more on one page than on another."""
        item = lambda c: c.repeated and c.tag in ("div", "article", "section") and not self.tags[id(c)] & HEADINGS and (c.optional or c.turns[0] != c.turns[1] or c.turns[0] > ALIKE)
        if node.label == "#" or node.tag not in ("div", "section", "article") or "h1" in self.tags[id(node)]:
            return False
        if item(node):
            return True
        told = [(sum(self.text(c, "body")), item(c)) for c in node.children if c.label != "#" and c.tag not in AROUND | HEADINGS and not self.fixed(c)]
        every = sum(t for t, _ in told)
        return every > 0 and 4 * sum(t for t, is_item in told if is_item) >= 3 * every

    def keep(self, node: Node, inside: str, strict: bool | None = None) -> None:
        """Marks a content group and what it holds. In articles and mains links tell nothing; strict: whether template goes.

        A text that is the same on all pages goes only if it stands apart, in
        no paragraph, heading or list, or if it is short and nothing that varies
        follows it, also as the last turn of a repeated group. Remarks go that follow a run of paragraphs or a title's group, with nothing but their like after them.
        """
        if strict is None:
            varying, every = self._varying(node)
            strict = 2 * varying >= every
        node.mark = KEPT
        own = "blockquote" if node.tag == "blockquote" else inside
        groups = node.tag not in TEXTS
        out = {id(c) for c in node.children if c.label != "#" and self.around(c, own)}
        if self.varies and groups:
            for k in range(len(node.children) - 1, 0, -1):
                c = node.children[k]
                if id(c) in out or self.fixed(c):
                    continue
                if not self.remarks(c) or not any(id(e) not in out and (self.paragraphs(e) or self.titled(e) and e.tag != "h1" and self.prose(e)) for e in node.children[:k]):
                    break
                out.add(id(c))
        last = max((k for k, c in enumerate(node.children) if id(c) not in out and not self.fixed(c)), default=-1)
        for k, c in enumerate(node.children):
            apart = c.label == "#" or c.tag not in TEXTS | {"ul", "ol", "dl", "table", "figure"}
            if id(c) in out or strict and groups and self.fixed(c) and (apart or k > last and self.said(c) <= SHORT):
                c.mark = OUT
            elif c.label == "#":
                c.mark = KEPT
            else:
                self.keep(c, inside, strict)
                if inside == "body" and self.is_menu(c):
                    c.mark = KEPT | MENU
                if k == last and strict and groups and self.varies and c.repeated and c.tail and c.tail[1] <= SHORT and any(len(x.seen) >= ALIKE for x in c.children):
                    c.mark |= TAIL

    def _named(self, node: Node, found: list[Node]) -> list[Node]:
        for c in node.children:
            if c.label != "#" and not self.around(c, ""):
                if _is_content(c.label):
                    found.append(c)
                else:
                    self._named(c, found)
        return found

    def _titles(self, node: Node, chosen: set[int]) -> bool:
        """Marks titles that stand beside the way down to the chosen groups; whether one of them is in here."""
        if id(node) in chosen:
            return True
        on_way = [c for c in node.children if c.label != "#" and self._titles(c, chosen)]
        if on_way:
            first = next(k for k, c in enumerate(node.children) if c is on_way[0])
            for c in node.children[:first]:
                if c.tag == "h1" and not any(self.template(x, c) or x.same is not None and len(x.seen) >= 2 and self.varies for x in c.children):
                    self.keep(c, "article")
        return bool(on_way)

    def decide(self) -> Node:
        """The wrapper with its marks.

        Articles and mains hold the content if they have a good part of the
        text; else the group to which one gets by going into the child that
        has most of the text. A title right before it belongs to it.
        """
        found = self._named(self.wrapper, [])
        for k, c in enumerate(found):
            inner = self._named(c, []) if c.tag == "main" or "role=main" in c.label.split(".") else []
            if len(inner) == 1 and not inner[0].repeated and self.text(inner[0], "article")[0] >= HELD * self.text(c, "article")[0] > 0:
                found[k] = inner[0]
        held = [self.text(c, "article") for c in found]
        most = max(map(sum, held), default=0)
        if found and (5 * sum(map(sum, held)) >= self.text(self.wrapper, "")[0] or any(c.tag == "main" for c in found)):
            # Lesser articles without paragraphs, or mostly of links, are teasers.
            chosen = [c for c, (p, q) in zip(found, held, strict=True) if p + q == most or self.prose(c) or 8 * p >= most and q <= LINKED * (p + q)]
            for c in chosen:
                self.keep(c, "article")
        else:
            node = self.wrapper
            while True:
                inner = [(c, self.text(c, "body")[0]) for c in node.children if c.label != "#" and not self.around(c, "")]
                total = self.text(node, "body")[0]
                if sum(t > 0 and self.titled(c) and c.tag != "h1" and self.prose(c) for c, t in inner) == 1:
                    # The title's group is the article, whatever is said about it beside it.
                    total -= sum(t for c, t in inner if self.remarks(c))
                    inner = [(c, t) for c, t in inner if not self.remarks(c)]
                named = [(c, t) for c, t in inner if CONTENT_NAMES.intersection(re.split(r"[.-]", c.label)) and 10 * t >= total > 0]
                best, most = max(named if len(named) == 1 else inner, key=lambda x: x[1], default=(None, 0))
                if best is None or most < HELD * total and len(named) != 1 or not best.children or best.tag not in ("body", "div", "section", "td", "tr", "table", "tbody", "center", "form") or best.repeated and best.tag in ("tr", "td"):
                    break
                node = best
            chosen = [node]
            self.keep(node, "body")
        if not any(c.tag in HEADINGS or "h1" in self.tags[id(c)] for c in chosen):
            self._titles(self.wrapper, set(map(id, chosen)))
        return self.wrapper


def _hints(names: list[str]) -> tuple[set[str], set[str]]:
    """Words of a group's names that hint at what goes around the content: of names that say nothing else, and of others."""
    sure: set[str] = set()
    maybe: set[str] = set()
    for name in names:
        words = [w.rstrip("0123456789") for w in name.split("-")]
        words = words[: next((k for k, w in enumerate(words) if w in MADE_FOR), len(words))]
        if told := NOISE.intersection(words):
            rest = set(words) - NOISE - PLAIN_WORDS
            (maybe if rest - OWNERS or rest and not words[-1] in told | PLAIN_WORDS else sure).update(told)
    return sure, maybe - sure


def _is_content(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in ("article", "main") or "role=main" in names or "role=article" in names


def marks(node: Node) -> list:
    """What extraction needs of a wrapper: label, whether it repeats, mark and children; groups without content are cut off."""
    return [node.label, int(node.repeated), node.mark, [marks(c) for c in node.children] if node.mark != OUT else []]


def _matched(children: list[Node], told: list) -> Iterator[tuple[Node, list | None]]:
    """A page's nodes with those of the wrapper that they are turns of: of several with one label the next that holds much the
    same, in the wrapper's order; a repeated group goes on as long as nothing has come that follows it just once."""
    by_label: dict[str, list[int]] = {}
    for k, t in enumerate(told):
        by_label.setdefault(t[0], []).append(k)
    last: dict[str, int] = {}
    once = [0]  # how many nodes that aren't repeated come before each
    for t in told:
        once.append(once[-1] + (not t[1]))
    reached = -1
    for c in children:
        places = by_label.get(c.label) or by_label.get(c.tag)
        if not places:
            yield c, None
            continue
        best = 0
        if len(places) > 1:
            own = {x.label for x in c.children}

            def fit(k: int) -> float:
                other = {x[0] for x in told[places[k]][3]}
                return len(own & other) / max(1, len(own | other)) if told[places[k]][2] != OUT or c.label == "#" else 0.5

            now = last.get(c.label, -1)
            stays = now >= 0 and told[places[now]][1] and once[max(reached, places[now]) + 1] == once[places[now]]
            ahead = [*([now] if stays else []), *(k for k in range(now + 1, len(places)) if places[k] > reached)]
            ahead = ahead or [*range(max(0, now + (now < 0 or not told[places[now]][1])), len(places))] or [len(places) - 1]
            best = max(ahead, key=lambda k: (fit(k) >= 0.5, -k)) if len(ahead) > 1 and c.label != "#" else ahead[0]
        last[c.label] = best
        reached = max(reached, places[best])
        yield c, told[places[best]]


def _sums(node: Node, told: list) -> tuple[int, int]:
    """Characters of a page's group out of and in links, without what is left out."""
    plain = linked = 0
    for c, t in _matched(node.children, told[3]):
        if t is not None and t[2] != OUT:
            p, q = (c.plain, c.linked) if c.label == "#" else _sums(c, t)
            plain, linked = plain + p, linked + q
    return plain, linked


def _has_prose(node: Node) -> bool:
    return any(c.tag in PROSE and c.children or _has_prose(c) for c in node.children)


def _kept(node: Node, told: list, found: set[int]) -> set[int]:
    turns = list(_matched(node.children, told[3]))
    tails = {id(t): c for c, t in turns if t is not None and t[2] & TAIL}
    for c, t in turns:
        if t is None or t[2] == OUT or tails.get(id(t)) is c:
            continue
        if c.label == "#":
            if t[2] & KEPT and told[2] & KEPT:
                found.add(id(c))
        elif not t[2] & MENU or (lambda p, q: q <= LINKED * (p + q))(*_sums(c, t)) or _has_prose(c):
            _kept(c, t, found)
    return found


def extract(page: str, told: list | None) -> str:
    """The page's text in the content groups of its wrapper, a block after the other.

    A page that has nothing in them is of another make than its host's
    others, and its own groups tell.
    """
    root, texts = blocks(page)
    kept = _kept(root, told, set()) if told else set()
    if not kept and texts:
        own = marks(Judge(folded(blocks(page)[0])).decide())
        kept = _kept(root, own, set())
    return "\n\n".join(text for slot, text in texts if id(slot) in kept)


#: Hosts whose wrappers a task holds at a time, bytes of pages after which it passes them on, and parts of a host's streams that one task merges.
HOSTS, PASSED, FAN_IN = 2000, 32 << 20, 64


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page -> host, stream: the folded streams of a partition's pages, those of a host merged already."""
    found: dict[str, Node] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(v.dump()) for v in found.values()], pa.string())], names=["host", "stream"])

    held = 0
    for batch in by_bytes(batches, 1):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            node = folded(blocks(page or "")[0])
            found[host] = merge(found[host], node) if host in found else node
        held += batch.nbytes
        if len(found) >= HOSTS or held >= PASSED:
            yield out()
            found.clear()
            held = 0
    yield out()


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and part: merges the streams of each into one wrapper."""
    key, wrapper = None, None
    made = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([json.dumps(wrapper.dump())], pa.string())], names=["host", "stream"])
    for batch in batches:
        for host, part, stream in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            node = Node.load(json.loads(stream))
            if wrapper is not None and (host, part) == key:
                wrapper = merge(wrapper, node)
            else:
                if wrapper is not None:
                    yield made()
                key, wrapper = (host, part), node
    if wrapper is not None:
        yield made()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrappers = [Node.load(json.loads(s)) for s in batch.column(1).to_pylist()]
        told = [json.dumps(marks(Judge(w).decide())) for w in wrappers]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.expression() for w in wrappers], pa.string()), pa.array(told, pa.string())], names=["host", "wrapper", "groups"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, groups: for each host its wrapper as an expression, and its groups with what they hold.

    All pages (host, html) take part. Streams are merged within a partition,
    then FAN_IN at most by a task, until each host has one wrapper.
    """
    schema = "host string, stream string"
    streams = materialize(pages.select("host", "html").mapInArrow(_streams, schema))
    while True:
        counts = streams.groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).cast("int").alias("parts"))
        most = counts.agg(F.max("parts").alias("n")).first()["n"] or 1
        part = F.lit(0)
        if most > 1:
            hot = counts.where("parts > 1")  # a row for FAN_IN rows of streams at least
            streams = streams.join(hot, "host", "left")
            part = F.pmod(F.xxhash64("stream"), F.coalesce("parts", F.lit(1)))
        parted = streams.select("host", part.cast("int").alias("part"), "stream").repartition("host", "part").sortWithinPartitions("host", "part", "stream")
        merged = parted.mapInArrow(_inferred, schema)
        if most == 1:
            return merged.mapInArrow(_told, "host string, wrapper string, groups string")
        streams = materialize(merged)


def extract_pages(pages: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    The text is the page's main text: its blocks in page order, joined by two
    line breaks, white space inside a block turned into one space; empty if
    there is none. n_chars counts its code points. A null html is empty; a
    null url, or one without a host, counts among the pages of the empty
    host. Rows that share or lack a page_id are pages of their own; other
    columns are ignored; an empty table gives an empty result.

    Wrappers are broadcast if all of them have at most broadcast_bytes
    characters, else joined by host, where Spark splits hot hosts.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hosted = rows.withColumn("host", url_host(F.col("url")))
    wrappers = materialize(infer_wrappers(hosted)).select("host", "groups")
    size = wrappers.agg(F.sum(F.length("groups") + F.length("host")).alias("n")).first()["n"] or 0
    joined = hosted.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in by_bytes(batches, 2):
            texts = []
            for page, groups in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if groups not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[groups] = json.loads(groups) if groups else None
                texts.append(extract(page or "", known[groups]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "groups").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
