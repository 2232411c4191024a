"""A small DOM of block elements and text blocks, built from one page inside a task."""

from __future__ import annotations

import re
from html import unescape

#: Content of these never is text of the page.
SILENT = frozenset(
    "script style template noscript svg math head title iframe object canvas audio video select textarea button "
    "input datalist".split()
)
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Start tags that end an open element of the given kinds without an end tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("html body table ul ol dl div section article main".split())
INLINE_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACES = re.compile(r"\s+")


class Node:
    """A block element (``tag``) or a text block (``tag`` is "#text")."""

    __slots__ = ("tag", "parent", "names", "hidden", "text", "chars", "linked")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...] = (), hidden: bool = False) -> None:
        self.tag, self.parent, self.names, self.hidden = tag, parent, names, hidden
        self.text = ""
        self.chars = self.linked = 0


def attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    if not raw.strip():
        return (), False
    words: list[str] = []
    hidden = False
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        else:
            words += re.findall(r"[a-z]+", value)
    return tuple(words), hidden


def parse(html: str) -> list[Node]:
    """Nodes in page order, each after its parent; the root comes first."""
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones share their block's node
    parts: list[str] = []
    links = silent = 0
    linked = 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = SPACES.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            node = Node("#text", stack[-1][1])
            node.text, node.chars, node.linked = text, len(text), min(linked, len(text))
            nodes.append(node)
        linked = 0

    def pop() -> None:
        nonlocal links, silent
        tag, _ = stack[-1]
        if tag in BLOCK:
            flush()
        stack.pop()
        links -= tag == "a"
        silent -= tag in SILENT

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            pop()

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            parts.append(piece)
            if links:
                linked += len(piece)

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        if not m[0].endswith(">"):
            break  # the page ends inside a tag
        tag = tag.lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            # An open paragraph ends where a block starts; list items and cells end each other.
            ended = CLOSES.get(tag, set()) | {"p"}
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ended:
                    close_to(depth)
                    break
                if stack[depth][0] in SCOPE:
                    break
            flush()
            names, hidden = attributes(m[3])
            if tag != "hr":
                nodes.append(Node(tag, stack[-1][1], names, hidden))
                stack.append((tag, len(nodes) - 1))
            continue
        if tag in VOID or m[3].endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if tag not in SILENT:
                text(html[at : close.start() if close else end])
            at = close.end() if close else end
            continue
        stack.append((tag, stack[-1][1]))
        links += tag == "a"
        silent += tag in SILENT
    close_to(1)
    flush()
    return nodes
