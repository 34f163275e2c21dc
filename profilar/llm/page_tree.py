"""HTML pages as trees of blocks and text runs, with the features of each node.

The tree holds elements that start a new block and, as leaves, the text runs between block boundaries (a line break is one).
Inline elements leave no node unless their class or id names them as something beside the text. Scripts, styles and other
content that is not shown are skipped. Missing end tags are supplied, stray ones ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# fixed values: HTML element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas video audio head title textarea select "
                   "datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
            "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = frozenset("table ul ol dl".split())
# fixed values: words in class, id and role by what they tell
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip sitemap tabs links",
    "head": "header masthead banner topbar logo brand hero",
    "foot": "footer foot bottom copyright legal colophon contentinfo imprint",
    "side": "sidebar side aside widget widgets rail complementary secondary",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog message warning paywall",
    "form": "form search login signin signup subscribe subscription newsletter register contact input",
    "talk": "comment comments commentlist reply replies respond discussion disqus review reviews feedback guestbook",
    "other": "share sharing social related recommended recommendations more popular trending tags tag meta byline author "
             "toolbar tools print rating similar next prev",
    "body": "article content main post entry story body text page prose maincontent articlebody",
}
WORD_KIND = {word: kind for kind, words in NAMES.items() for word in words.split()}
BESIDE = frozenset(NAMES) - {"body"}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)", re.S)
_tag = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_named = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|href)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Nodes in page order: parent (-1: none), feature names, text (None: element) and the label of marked nodes."""

    parent: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)

    def add(self, parent: int, tag: str, features: list[str], text: str | None) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return len(self.parent) - 1


def named_kinds(attributes: str) -> tuple[list[str], bool]:
    """Kinds that class, id and role name, and whether the element is hidden."""
    kinds, hidden = set(), False
    for m in _named.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        elif name != "href":
            kinds.update(WORD_KIND[w] for part in _parts.findall(value) if (w := part.lower()) in WORD_KIND)
    return sorted(kinds), hidden


def text_features(text: str, linked: int, place: str) -> list[str]:
    words = text.count(" ") + 1
    size = "1" if words == 1 else "2-4" if words < 5 else "5-9" if words < 10 else "10-24" if words < 25 else "25-59" if words < 60 else "60+"
    share = linked / len(text)
    return ["text", f"words {size}", "linked " + ("none" if share == 0 else "part" if share < 0.6 else "most"),
            f"in {place}"] + (["stops" if text[-1] in ".!?:;\"'”»" else "goes on"] if words < 10 else []) + (["sign"] if text[0] in "©|•·›»" else [])


def read_page(source: str | None) -> Page:
    """The tree of a page; NULL and empty pages have the root only."""
    page, source = Page(), source or ""
    page.add(-1, "root", ["tag root"], None)
    open_tags: list[tuple[str, int, bool]] = [("root", 0, False)]  # name, node (an inline element: its block's), unseen
    places: dict[str, list[int]] = {}  # of the open tags of a name, in order
    run: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                node = open_tags[-1][1]
                page.add(node, "#text", text_features(text, min(linked, len(text)), page.tag[node]), text)
        linked = 0

    def open_tag(name: str, node: int, unseen: bool) -> None:
        nonlocal links
        places.setdefault(name, []).append(len(open_tags))
        open_tags.append((name, node, unseen))
        links += name == "a"

    def close_to(k: int) -> None:
        nonlocal links
        for name, _, _ in open_tags[k:]:
            places[name].pop()
            links -= name == "a"
        del open_tags[k:]

    def last_open(names, stops=()) -> int:
        """Place of the last open tag of these names, 0 if there is none or a stop comes after it."""
        k = max((places[name][-1] for name in names if places.get(name)), default=0)
        return 0 if any(places[stop][-1] > k for stop in stops if places.get(stop)) else k

    at, raw = 0, None
    while at < len(source):
        if raw:  # only the element's own end tag ends it
            m = re.compile(f"</{raw}\\b[^>]*(?:>|\\Z)", re.I).search(source, at)
            at, raw = (m.end() if m else len(source)), None
            continue
        m = _token.search(source, at)
        piece = source[at:m.start() if m else len(source)]
        if piece and not open_tags[-1][2]:
            run.append(piece)
            linked += len(piece) if links else 0
        if m is None:
            break
        at, token = m.end(), m[0]
        named = _tag.match(token)
        if named is None:
            continue
        name = named[1].lower()
        if token[1] == "/":
            k = last_open((name,))
            if k:
                if page_block(open_tags, k):
                    flush()
                close_to(k)
            elif name == "p":
                flush()
            continue
        if name == "br" or name == "hr":
            flush()
            continue
        if name in VOID:
            continue
        if name in RAW:
            raw = name
            continue
        kinds, hidden = named_kinds(token[named.end():])
        unseen = open_tags[-1][2] or name in UNSEEN or hidden
        if name in INLINE and not (BESIDE.intersection(kinds) or hidden):
            if not token.endswith("/>"):
                open_tag(name, open_tags[-1][1], unseen)
            continue
        flush()
        if name == "body" and (k := last_open(("head",))):
            close_to(k)
            unseen = hidden
        if name in CLOSES_P and (k := last_open(("p",), ("table", "button"))):
            close_to(k)
        elif name in SIBLINGS and (k := last_open(SIBLINGS[name], SCOPES)):
            close_to(k)
        plain = "" if BESIDE.intersection(kinds) else "plain "
        node = page.add(open_tags[-1][1], name, [f"{plain}tag {name}", *(f"named {k}" for k in kinds)], None)
        if not token.endswith("/>"):
            open_tag(name, node, unseen)
    flush()
    return page


def page_block(open_tags: list[tuple[str, int, bool]], k: int) -> bool:
    """Whether closing the elements from ``k`` on ends a block."""
    return open_tags[k - 1][1] != open_tags[-1][1]
