"""Pages as Markdown: the main content of an HTML tree, written with headings, lists, tables, code, quotes, emphasis and links.

The tree is read once a page, in Arrow batches. Main content is what stays when menus, headers, footers, sidebars, forms
and scripts are gone by tag, and then blocks that are mostly links: under <main> or the only <article> where there is one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.batches import by_pieces

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_GONE = {"script", "style", "head", "title", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg"}
_BLOCKS = {"address", "article", "blockquote", "body", "dd", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: A tag that is opened closes these when they are still open directly above it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Deeper tags are read as if they were beside each other.
MOST_DEPTH = 200
#: Blocks of which links are more than this share of the letters are menus.
MOST_LINKED = 0.6
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"([\\`*_\[\]])")
_LEADS = re.compile(r"^(#{1,6}(?=\s)|[-+>](?=\s)|\d+(?=[.)]\s))")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def find(self, tag: str) -> list[Node]:
        out, left = [], [self]
        while left:
            n = left.pop()
            out += [n] if n.tag == tag else []
            left += [c for c in reversed(n.children) if isinstance(c, Node)]
        return out


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:  # a paragraph ends where a block begins, whatever is open inside it
            k = len(self.open) - 1
            while k and self.open[k].tag not in _BLOCKS:
                k -= 1
            if self.open[k].tag == "p":
                del self.open[k:]
        while self.open[-1].tag in _CLOSES.get(tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID and len(self.open) < MOST_DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def read(page: str) -> Node:
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader.root


def _letters(node: Node) -> tuple[int, int]:
    """Letters of a node without white space, and how many of them stand in links."""
    total = linked = 0
    left = [(node, node.tag == "a")]
    while left:
        n, inside = left.pop()
        for c in n.children:
            if isinstance(c, str):
                size = len(_SPACE.sub("", c))
                total, linked = total + size, linked + size * inside
            else:
                left.append((c, inside or c.tag == "a"))
    return total, linked


def main_content(root: Node) -> Node:
    """The tree without what isn't the article; of mostly linked blocks only lists and boxes go, never a paragraph."""
    whole = root.find("main") or (root.find("article") if len(root.find("article")) == 1 else [])
    top = whole[0] if whole else root
    left = [top]
    while left:
        n = left.pop()
        kept: list[Node | str] = []
        for c in n.children:
            if isinstance(c, Node):
                if c.tag in _GONE:
                    continue
                if c.tag in ("ul", "ol", "div", "section", "table"):
                    total, linked = _letters(c)
                    if linked > MOST_LINKED * total:
                        continue
                left.append(c)
            kept.append(c)
        n.children = kept
    return top


def _inline(node: Node) -> str:
    """The words of a node on one line, with emphasis, code and links."""
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(_MARKS.sub(r"\\\1", _SPACE.sub(" ", c)))
        elif c.tag == "br":
            parts.append("\n")
        elif c.tag == "img":
            parts.append(f"![{c.attributes.get('alt', '')}]({c.attributes.get('src', '')})" if c.attributes.get("src") else "")
        elif c.tag == "code":
            text = _SPACE.sub(" ", "".join(_plain(c))).strip()
            parts.append(f"`` {text} ``" if "`" in text else f"`{text}`" if text else "")
        else:
            own = _inline(c)
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*"}.get(c.tag, "")
            core = own.strip()
            if core and c.tag == "a" and c.attributes.get("href"):
                core = f"[{core}]({c.attributes['href'].replace(' ', '%20').replace(')', '%29')})"
            elif core and mark and "\n" not in core:
                core = mark + core + mark
            parts.append(own[: len(own) - len(own.lstrip())] + core + own[len(own.rstrip()) :] if own.strip() else own)
    text = re.sub(r" *\n *", "\n", re.sub(" +", " ", "".join(parts)))
    return text


def _plain(node: Node) -> list[str]:
    return [x for c in node.children for x in ([c] if isinstance(c, str) else _plain(c))]


def _table(node: Node) -> str:
    rows = [[_inline(c).strip().replace("\n", " ").replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.find("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


def _list(node: Node) -> str:
    items, k = [], int(node.attributes.get("start", "1")) if node.attributes.get("start", "1").isdigit() else 1
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            mark = f"{k}. " if node.tag == "ol" else "- "
            body = re.sub(r"\n\n(?= *(?:- |\d+\. ))", "\n", "\n\n".join(blocks(c)))
            items.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            k += 1
        elif body := "\n\n".join(blocks(Node("li", {}, [c]))):  # what stands between the items goes with the one before
            items.append(("  " if items else "- ") + body.replace("\n", "\n  "))
    return "\n".join(items)


def blocks(node: Node) -> list[str]:
    """The Markdown of each block below a node, in order."""
    out: list[str] = []
    loose = Node("span")

    def settle() -> None:
        text = "\n".join(_LEADS.sub(r"\\\1", x) if not x[:1].isdigit() else re.sub(r"^(\d+)([.)])", r"\1\\\2", x) if _LEADS.match(x) else x for x in _inline(loose).strip().split("\n"))
        if text:
            out.append(text)
        loose.children = []

    for c in node.children:
        if isinstance(c, str) or c.tag not in _BLOCKS:
            if isinstance(c, Node) and any(isinstance(x, Node) and x.tag in _BLOCKS for x in c.children):
                settle()
                out.extend(blocks(c))
            else:
                loose.children.append(c)
            continue
        settle()
        if re.fullmatch("h[1-6]", c.tag):
            text = _inline(c).strip().replace("\n", " ")
            made = "#" * int(c.tag[1]) + " " + text if text else ""
        elif c.tag in ("ul", "ol"):
            made = _list(c)
        elif c.tag == "table":
            out.extend(filter(None, (_inline(x).strip() for x in c.children if isinstance(x, Node) and x.tag == "caption")))
            made = _table(c)
        elif c.tag == "pre":
            text = "".join(_plain(c)).strip("\n")
            fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", text)), default=0))
            made = f"{fence}\n{text}\n{fence}" if text else ""
        elif c.tag == "blockquote":
            made = "\n".join(("> " + x).rstrip() for x in "\n\n".join(blocks(c)).split("\n")) if blocks(c) else ""
        elif c.tag == "hr":
            made = "---"
        else:
            out.extend(blocks(c))
            continue
        if made:
            out.append(made)
    settle()
    return out


def page_markdown(page: str | None) -> tuple[str | None, str]:
    """The title (null without one) and the main content as Markdown, blocks apart by an empty line."""
    root = read(page or "")
    titles = root.find("title")
    title = _SPACE.sub(" ", "".join(_plain(titles[0]))).strip() if titles else None
    return title, "\n\n".join(blocks(main_content(root)))


def source_title(html: Column) -> Column:
    """The title of a page as its source has it, with &amp; read and other character references left as they stand; null without one."""
    inside = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    return F.nullif(F.trim(F.replace(inside, F.lit("&amp;"), F.lit("&"))), F.lit(""))


@by_pieces(StructType([StructField("title", StringType()), StructField("markdown", StringType())]))
def normalised(pages: list) -> list:
    """struct(title, markdown) of an HTML page."""
    return [dict(zip(("title", "markdown"), page_markdown(p))) for p in pages]
