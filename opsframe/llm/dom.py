"""A tolerant HTML tree: just enough of the parsing rules to place every text in its element."""

from __future__ import annotations

import html
import re

# Element names by what the HTML standard says of them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg select object math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th", "tbody"), "tbody": ("tr", "td", "th", "thead"),
}
#: Elements that an implied or stray end tag does not reach beyond.
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",)}
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element; ``items`` are its texts and child elements in page order."""

    __slots__ = ("tag", "attributes", "parent", "items")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.items: list[str | Node] = []


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def parse(page: str) -> Node:
    """The page as a tree under a root without tag; the contents of RAW elements and comments are left out."""
    root = at = Node("", "", None)
    depth = 0
    end, position = len(page), 0
    while position < end:
        found = _MARKUP.search(page, position)
        if not found:
            at.items.append(html.unescape(page[position:]))
            break
        if found.start() > position:
            at.items.append(html.unescape(page[position : found.start()]))
        position = found.end()
        closing, tag, raw = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in VOID:
                if tag == "br":
                    at.items.append(Node("br", "", at))
                continue
            limits = SCOPE.get(tag, ())
            node = at
            while node.parent is not None and node.tag != tag and node.tag not in limits:
                node = node.parent
            if node.tag == tag and node.parent is not None:
                while at is not node:
                    at, depth = at.parent, depth - 1
                at, depth = at.parent, depth - 1
            continue
        if found[2] is None and not page.endswith(">", 0, position):
            break  # cut off within a tag
        if tag in CLOSES_P:
            at, depth = _close(at, depth, ("p",), ("", "button", "td", "th", "body", "div", "section", "article", "li"))
        if tag in IMPLIED_END:
            at, depth = _close(at, depth, IMPLIED_END[tag], ("", *SCOPE.get(tag, ("body", "div"))))
        node = Node(tag, raw, at)
        at.items.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, position)
            if not stop:
                break
            close = page.find(">", stop.end())
            position = close + 1 if close >= 0 else end
        elif tag not in VOID and not raw.rstrip().endswith("/"):
            if depth < 400:  # deeper elements become siblings
                at, depth = node, depth + 1
        elif tag not in VOID:
            at, depth = node, depth + 1  # a slash does not close an HTML element
    return root


def _close(at: Node, depth: int, tags: tuple[str, ...], limits: tuple[str, ...]) -> tuple[Node, int]:
    """Leave the nearest open element of ``tags``, unless one of ``limits`` stands between."""
    node, up = at, 1
    while node.parent is not None and node.tag not in tags:
        if node.tag in limits:
            return at, depth
        node, up = node.parent, up + 1
    return (node.parent, depth - up) if node.parent is not None else (at, depth)
