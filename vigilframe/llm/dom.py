"""A small tolerant HTML tree: tags, attributes that tell roles, text with decoded character references."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp", "noembed")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}
# an opening tag ends an open element of these, looked for no further out than the container
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
DEPTH = 200  # elements nested deeper stand beside each other at this depth, as in browsers; their text stays
_NUMBER = re.compile("[0-9]+")
_SCOPES = frozenset("table td th caption button html body".split())


class Node:
    """``name``: the tag with its classes and id, their numbers as 0: what tells an element of a template from another."""

    __slots__ = ("children", "marks", "name", "tag")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks = tag, marks
        self.name = f"{tag}.{_NUMBER.sub('0', marks)}" if marks else tag
        self.children: list[Node | str] = []

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def parse(source: str) -> Node:
    """The tree of a page. Unclosed elements end where HTML ends them; text inside scripts, styles and the like is left out."""
    root = Node("#page")
    stack = [root]
    raw = ""
    at, end = 0, len(source)
    while at < end:
        if raw:  # nothing inside counts until its own end tag
            found = re.compile(rf"</{raw}[\s/>]", re.IGNORECASE).search(source, at)
            at = found.start() if found else end
            raw = ""
            continue
        m = _TOKEN.match(source, at)
        if m is None:
            stack[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                stack[-1].children.append(html.unescape(text))
            continue
        tag = tag.lower()
        if m.group(1):
            _close(stack, tag)
            continue
        attributes = m.group(3)
        if tag in _ENDS_P:
            _end(stack, ("p",), _SCOPES)
        if tag in _ENDS:
            _end(stack, *_ENDS[tag])
        marks = ""
        if attributes and attributes != "/":
            marks = " ".join(_role(a) for a in _ATTRIBUTE.finditer(attributes)).strip()
        node = Node(tag, marks)
        stack[-1].children.append(node)
        if tag in _RAW:
            raw = tag
            stack.append(node)
        elif tag not in _VOID and len(stack) < DEPTH and not (attributes.endswith("/") and tag not in BLOCKS):
            stack.append(node)
    return root


def _role(a: re.Match) -> str:
    key, value = a.group(1).lower(), (a.group(2) or a.group(3) or a.group(4) or "").lower()
    if key == "style":
        return "hidden" if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else ""
    return "hidden" if key == "hidden" else value


def _close(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in ("td", "th", "table") and tag not in BLOCKS:  # a stray inline end tag leaves the cell alone
            return


def _end(stack: list[Node], tags: tuple[str, ...], within) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in within:
            return


def walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.nodes())
