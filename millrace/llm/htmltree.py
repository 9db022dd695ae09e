"""A page's block tree with the features of its nodes: the per-page helper of htmlmain."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|data-y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_MARK = re.compile(r"[.,;:!?]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't text of the page.
SKIPPED = frozenset("script style noscript template head title iframe object svg math canvas select textarea button".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
#: Searched in the source itself: lower() can change a text's length, and with it all places after that.
_ENDS = {t: re.compile("</" + t, re.I | re.A) for t in RAW}
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address header footer nav aside form fieldset details summary center hgroup menu dialog".split()
)
#: An open element of these is closed by a start tag of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAG_GROUPS = [
    {"article", "main"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"},
    {"nav"}, {"header"}, {"footer", "address"}, {"aside"}, {"form", "fieldset", "dialog"}, {"div", "section", "center"}, {"table", "thead", "tbody", "tr", "td", "th"}, {"html", "body"},
]
GOOD = frozenset("article content post entry body main story text prose page articlebody".split())
BAD = frozenset(
    "nav navbar navigation menu sidebar footer header masthead ad ads advert advertisement sponsor sponsored promo promotion banner cookie consent gdpr notice alert share social related recommended widget breadcrumb breadcrumbs pager pagination popup modal newsletter subscribe login signup search form tags meta copyright legal toolbar skip".split()
)
TALK = frozenset("comment comments reply replies respond disqus discussion feedback thread reviews".split())
N_TAGS = len(TAG_GROUPS)
N_FEATURES = N_TAGS * 2 + 24
_GROUP = {t: k for k, g in enumerate(TAG_GROUPS) for t in g}
_SEEN: dict[str, tuple[int, int, int]] = {}


def _kinds(names: str) -> tuple[int, int, int]:
    """Whether the attribute tokens have words that speak for content, for boilerplate, for comments."""
    found = _SEEN.get(names)
    if found is None:
        words = set(_WORD.findall(names.lower()))
        found = int(bool(words & GOOD)), int(bool(words & BAD)), int(bool(words & TALK))
        if len(_SEEN) < 10_000:
            _SEEN[names] = found
    return found


@dataclass
class Page:
    """Block nodes in page order (a parent before its children) and the text pieces with their nodes."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    kinds: list[tuple[int, int, int]] = field(default_factory=lambda: [(0, 0, 0)])
    given: list[int] = field(default_factory=lambda: [-1])
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page()
    open_: list[tuple[str, int]] = [("html", 0)]  # (tag, node of the text inside)
    at, skip, links = 0, 0, 0

    def say(text: str) -> None:
        if text and not skip:
            page.pieces.append((open_[-1][1], html.unescape(text), links > 0))

    def close(to: int) -> None:
        nonlocal skip, links
        while len(open_) > to:
            tag, _ = open_.pop()
            skip -= tag in SKIPPED
            links -= tag == "a"
            if tag in BLOCKS:
                page.pieces.append((open_[-1][1] if open_ else 0, " ", False))

    while m := _TAG.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                say(" ")
            continue
        if tag in ("html", "body"):
            for k in range(len(open_) - 1, 0, -1):  # a body ends a head that was left open
                if open_[k][0] == "head":
                    close(k)
                    break
            if tag == "html":
                continue
        if tag in BLOCKS:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "p":
                    close(k)
                    break
                if open_[k][0] in ("td", "th", "table", "article", "body", "div", "section"):
                    break
        if tag in CLOSES:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if open_[k][0] in ("ul", "ol", "dl", "table"):
                    break
        node = open_[-1][1]
        if tag in BLOCKS and not skip:
            names, y = [], page.given[node]
            for a in _ATTR.finditer(m.group(3)):
                value = a.group(2).strip("\"'")
                if a.group(1).lower() == "data-y":
                    y = int(value == "1")
                else:
                    names.append(value)
            page.parent.append(node)
            page.tag.append(tag)
            page.kinds.append(_kinds(" ".join(names)) if names else (0, 0, 0))
            page.given.append(y)
            page.pieces.append((node, " ", False))
            node = len(page.parent) - 1
        if m.group(3).endswith("/") and tag not in BLOCKS:
            continue
        open_.append((tag, node))
        skip += tag in SKIPPED
        links += tag == "a"
        if tag in RAW:
            end = _ENDS[tag].search(source, at)
            at = end.start() if end else len(source)
    say(source[at:])
    return page


def features(page: Page) -> np.ndarray:
    """A row for each node: tags of itself and above, attribute tokens, depth, density of its subtree, its siblings."""
    n = len(page.parent)
    own = np.zeros((n, 5))  # characters, of them in links, words, marks, nodes
    own[:, 4] = 1
    for node, text, link in page.pieces:
        solid = len(text) - text.count(" ")
        if solid:
            row = own[node]
            row[0] += solid
            row[1] += solid * link
            row[2] += text.count(" ") + 1
            row[3] += len(_MARK.findall(text))
    below, paragraphs = own.copy(), np.zeros(n)
    out = np.zeros((n, N_FEATURES))
    parent = page.parent
    above, kinds_above, depth = np.zeros((n, N_TAGS)), np.zeros((n, 3)), np.zeros(n)
    place, siblings = np.zeros(n), np.zeros(n)
    last = [-1] * n
    before = np.full(n, -1)
    after = np.full(n, -1)
    for i in range(n):
        group = _GROUP.get(page.tag[i])
        if group is not None:
            out[i, group] = 1
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = np.maximum(above[p], out[p, :N_TAGS])
            kinds_above[i] = np.maximum(kinds_above[p], page.kinds[p])
            place[i] = siblings[p]
            siblings[p] += 1
            if last[p] >= 0:
                before[i], after[last[p]] = last[p], i
            last[p] = i
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
        paragraphs[parent[i]] += paragraphs[i] + (page.tag[i] == "p")
    chars = np.maximum(below[:, 0], 1)
    up = np.maximum(np.array(parent), 0)
    out[:, N_TAGS : 2 * N_TAGS] = above
    k = 2 * N_TAGS
    out[:, k : k + 3] = page.kinds
    out[:, k + 3 : k + 6] = kinds_above
    size, link = np.log1p(below[:, 0]), below[:, 1] / chars
    out[:, k + 6] = depth
    out[:, k + 7] = size
    out[:, k + 8] = np.log1p(own[:, 0])
    out[:, k + 9] = link
    out[:, k + 10] = np.log1p(below[:, 2])
    out[:, k + 11] = below[:, 0] / np.maximum(below[:, 2], 1)
    out[:, k + 12] = below[:, 3] / chars
    out[:, k + 13] = below[:, 4] / chars
    out[:, k + 14] = below[:, 0] / np.maximum(below[up, 0], 1)
    out[:, k + 15] = below[:, 0] / max(below[0, 0], 1)
    out[:, k + 16] = place
    out[:, k + 17] = siblings[up] - place
    out[:, k + 18] = siblings
    out[:, k + 19] = np.where(before >= 0, size[before], 0)
    out[:, k + 20] = np.where(after >= 0, size[after], 0)
    out[:, k + 21] = np.where(before >= 0, link[before], 0)
    out[:, k + 22] = np.where(after >= 0, link[after], 0)
    out[:, k + 23] = np.log1p(paragraphs)
    return out


def decode(parent: list[int], p: np.ndarray) -> np.ndarray:
    """Whether each node is content, by the best labelling of the whole tree.

    A node is outside, content or dropped; below outside anything may stand, below content only content or dropped,
    below dropped only dropped. So no content lies in a dropped node, and none of its ancestors is told otherwise.
    """
    n = len(parent)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    outside, content, dropped = list(no), list(yes), list(no)
    for i in range(n - 1, 0, -1):
        q = parent[i]
        outside[q] += max(outside[i], content[i])
        content[q] += max(content[i], dropped[i])
        dropped[q] += dropped[i]
    label = [0] * n
    label[0] = int(content[0] > outside[0])
    for i in range(1, n):
        above = label[parent[i]]
        if above == 0:
            label[i] = int(content[i] > outside[i])
        elif above == 1:
            label[i] = 1 if content[i] >= dropped[i] else 2
        else:
            label[i] = 2
    return np.array(label) == 1


def text_of(page: Page, content: np.ndarray) -> str:
    return " ".join("".join(text for node, text, _ in page.pieces if content[node] or text == " ").split())
