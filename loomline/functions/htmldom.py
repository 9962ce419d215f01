"""An error-tolerant HTML tree for Arrow functions.

One scanner pass with a single pattern; no page can make it fail. Rules for sloppy markup: a start
tag that cannot stand inside an open `p` closes that `p` together with the inline elements opened
in it; `li`, `dt`/`dd`, `tr`, `td`/`th` and `option` close their predecessor within the nearest
container; an end tag without an open element is ignored; what is still open at the end is closed
there. Contents of script, style and the like are kept as raw text. A character reference counts
with its semicolon only; `&amp` that was cut short stays as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = BLOCK - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "figcaption"}
#: tag -> (tags it closes, containers at which the search stops)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead"}, {"table"}),
    "tfoot": ({"tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_STOPS_P = frozenset("article section div body html td th li blockquote table button main aside footer header nav form figure dd details".split())
_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_REFERENCE = re.compile(r"&(?:#(?:\d+|[xX][\da-fA-F]+)|[a-zA-Z][a-zA-Z\d]*);")
#: What would begin markup if it stood in text.
_OPENS = re.compile(r"<(?=[a-zA-Z/!?]|\Z)")


def decoded(text: str) -> str:
    """text with its character references, those that a semicolon ends, replaced."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


class Text(str):
    """Decoded text that remembers how the page gave it."""

    __slots__ = ("given",)


def _text(given: str) -> str:
    if "&" not in given:
        return given
    text = Text(decoded(given))
    text.given = given
    return text


class Node:
    """An element. `children` holds nodes and strings (text, references decoded) in page order."""

    __slots__ = ("_attrs", "_raw", "children", "parent", "tag")

    def __init__(self, tag: str, raw: str = "", parent: Node | None = None) -> None:
        self.tag, self._raw, self._attrs, self.parent, self.children = tag, raw, None, parent, []

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for m in _ATTRIBUTE.finditer(self._raw):
                value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
                self._attrs.setdefault(m[1].lower(), decoded(value) if "&" in value else value)
        return self._attrs

    def get(self, name: str) -> str | None:
        return self.attrs.get(name) if self._raw else None

    @property
    def classes(self) -> list[str]:
        return (self.get("class") or "").split()

    def elements(self) -> Iterator[Node]:
        """Elements below, in page order."""
        stack = [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.elements() if n.tag in tags), None)

    def text(self, raw: bool = False) -> str:
        """All text below, as it stands; script and style only with `raw`."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif raw or node.tag not in ("script", "style") or node is self:
                stack.extend(reversed(node.children))
        return "".join(out)

    def detach(self) -> None:
        if self.parent:
            at = next(i for i, c in enumerate(self.parent.children) if c is self)
            del self.parent.children[at]
            self.parent = None

    def html(self, outer: bool = True, as_given: bool = False) -> str:
        """The markup; with `as_given` text is written as the page gave it, unless what was between
        two texts is gone, which could make a reference of both."""
        out: list[str] = []
        stack: list = [self] if outer else list(reversed(self.children))
        after_text = False
        while stack:
            x = stack.pop()
            follows, after_text = after_text, isinstance(x, str)
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                if as_given:
                    alone = not follows and not (stack and isinstance(stack[-1], str))
                    given = x.given if alone and isinstance(x, Text) else x.replace("&", "&amp;")
                    out.append(_OPENS.sub("&lt;", given))
                else:
                    out.append(x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            else:
                out.append("<" + x.tag + "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in x.attrs.items()) + ">")
                if x.tag in VOID:
                    continue
                if x.tag in (RAW if as_given else ("script", "style")):
                    out.append("".join(c.given if isinstance(c, Text) else c for c in x.children if isinstance(c, str)))
                    out.append(f"</{x.tag}>")
                    continue
                stack.append((f"</{x.tag}>",))
                stack.extend(reversed(x.children))
        return "".join(out)


def parse(html: str | None) -> Node:
    """The root, a node named `#document`."""
    root = top = Node("#document")
    html, at = html or "", 0
    n = len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            _add_text(top, html[at:])
            break
        if m.start() > at:
            _add_text(top, html[at : m.start()])
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            raw = m[4]
            if tag in _CLOSES_P:
                top = _close(top, {"p"}, _STOPS_P)
            if tag in _CLOSES:
                top = _close(top, *_CLOSES[tag])
            node = Node(tag, raw, top)
            top.children.append(node)
            if tag in RAW:
                end = _raw_end(html, at, tag)
                body = html[at : end[0]]
                if body:
                    node.children.append(_text(body) if tag in ("title", "textarea") else body)
                at = end[1]
            elif tag not in VOID and not (raw.endswith("/") and tag in ("path", "circle", "rect", "use", "g")):
                top = node
        elif m[2]:
            tag, node = m[2].lower(), top
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                top = node.parent
        elif m[1]:
            _add_text(top, m[1])
    return root


def _add_text(node: Node, text: str) -> None:
    text = _text(text)
    if node.children and isinstance(node.children[-1], str):
        node.children[-1] += text
    else:
        node.children.append(text)


def _close(top: Node, tags: set[str], stops: frozenset[str] | set[str]) -> Node:
    node = top
    while node is not None and node.tag not in stops:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return top


_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


def _raw_end(html: str, at: int, tag: str) -> tuple[int, int]:
    m = _RAW_END[tag].search(html, at)
    return (m.start(), m.end()) if m else (len(html), len(html))


_SPACE = re.compile(r"\s+")


def blocks(node: Node, skip: set[int] | None = None) -> list[str]:
    """Texts of the blocks below `node` in page order: white space is one space, ends trimmed,
    empty blocks left out. Nodes whose id() is in `skip` are passed over."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif skip and id(x) in skip:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            held.append("\n")
        elif x.tag in BLOCK:
            flush()
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    flush()
    return out
