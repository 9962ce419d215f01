"""Main text of HTML pages by tree scoring.

Furniture goes first: elements that are never text, menus, page headers and footers, sidebars,
forms, and what class, id or role names as advert, notice, comments and the like. A form or an
element that only its name makes furniture stays, and only furniture in it goes, if it holds the
main element, an article with a quarter of the page's text, or over two thirds of that text with
hardly any article or main text outside; one named for comments must hold the main element or an
article longer than the text outside comments. Names such as has-sidebar and no-comments are of pages. In what is left
every paragraph passes points to its ancestors: one, one more for each comma, up to three for its
length; the parent gets all, the grandparent half, further ones a share that falls with distance.
A container's score is discounted by the share of its text inside links. The best container is
kept, with those of its siblings that score near it or read like paragraphs. Inside it nothing is
dropped but unnamed menus: lists of three and more short links outside article and main. Blocks in page order, white space inside a block as one space, are joined by one space.

Null or empty html, or a page without text, gives an empty text. Nothing is cut. Every row of
pages is extracted by itself, whatever its length; repeated rows repeat. Of containers that score
equally the one with more text counts, then the first. Only page_id, url and html are read, so other
columns do not clash. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.htmldom import BLOCK, Node, blocks, parse
from .common import pieces

SCHEMA = "page_id long, url string, text string, n_chars long, score double"
NEVER = frozenset("script style noscript template svg math canvas iframe object embed audio video map head title link meta base dialog nav menu footer aside form button select textarea input label fieldset option".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status toolbar".split())
#: Words in class or id that name furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disclaimer disqus discussion dropdown footer footnav form gdpr hidden legal login masthead menu menubar message-bar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion rail recommend recommended recommendations related replies reply respond search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription tagcloud teaser toast toolbar topbar tracking warning widget widgets".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_JOINED = re.compile(r"\b(?:side-?bar|cookie-?(?:bar|banner|notice)|comment-?(?:s|list|area|form|thread)|site-?(?:header|footer|nav)|page-?(?:header|footer)|ad-?(?:slot|unit|box|container|wrapper)|top-?bar|nav-?bar)", re.I)
#: Names that tell what a page has or lacks, and names of comments.
_LAYOUT = re.compile(r"(?<!\S)(?:has|with|without|no|not)(?=[-_A-Z])\S*")
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond shoutbox".split())
PARAGRAPH = frozenset("p pre blockquote td li dd dt h2 h3 h4 h5 h6 figcaption".split())
START = {"article": 30.0, "main": 20.0, "section": 3.0, "div": 3.0, "blockquote": 2.0, "td": 2.0, "body": 0.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -5.0}
CONTENT = frozenset("article body content entry main post story text".split())


GOES, NAMED, COMMENT = 1, 2, 3


def furniture(node: Node, inside: bool) -> int:
    """0, or why `node` goes: NAMED and COMMENT only if it does not hold the page's text. `inside`:
    an article or main element stands above it."""
    tag = node.tag
    if tag in NEVER and tag != "form":
        return GOES
    if tag in ("html", "body", "article", "main", "#document"):
        return GOES if tag == "article" and _named(node) & {"comment", "comments", "reply"} else 0
    if tag == "header":
        return 0 if inside else GOES
    named = NAMED if tag == "form" else 0
    if not node._raw:
        return named
    attrs = node.attrs
    role = attrs.get("role", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in ROLES and role != "form":
        return GOES
    style = attrs.get("style")
    if style and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style, re.I):
        return GOES
    if role == "form":
        named = NAMED
    if "class" not in attrs and "id" not in attrs:
        return named
    names, joined = _named(node), _JOINED.findall(_names(node))
    if names & FURNITURE and not (names & {"article", "main"} and not names & {"ad", "ads", "comment", "comments", "sidebar", "related"}) or joined:
        return COMMENT if names & COMMENTS or any(j.lower().startswith("comment") for j in joined) else NAMED
    return named


def _names(node: Node) -> str:
    """Class and id without names of page layouts."""
    return _LAYOUT.sub("", f"{node.get('class') or ''} {node.get('id') or ''}")


def _named(node: Node) -> set[str]:
    return {w.lower() for w in _WORDS.findall(_names(node))}


def strip(root: Node) -> None:
    """Removes furniture below `root` in place."""
    order, at = [(root, False, 0)], 0
    while at < len(order):
        node, inside, _ = order[at]
        kept = []
        for c in node.children:
            why = 0 if isinstance(c, str) else furniture(c, inside)
            if why != GOES:
                kept.append(c)
                if not isinstance(c, str):
                    order.append((c, inside or c.tag in ("article", "main"), why))
        if len(kept) != len(node.children):
            node.children = kept
        at += 1
    if not any(why for _, _, why in order):
        return
    # characters outside links and comments, those in article and main, in the longest article, in main
    sums: dict[int, tuple[int, int, int, int]] = {}
    own: dict[int, int] = {}
    for node, inside, why in reversed(order):
        chars = articles = longest = main = 0
        for c in node.children:
            if isinstance(c, str):
                n = len("".join(c.split()))
                chars, articles = chars + n, articles + n * inside
            else:
                s = sums[id(c)]
                chars, articles, longest, main = chars + s[0], articles + s[1], max(longest, s[2]), max(main, s[3])
        if node.tag == "a":
            chars = articles = 0
        if node.tag == "article":
            longest = max(longest, chars)
        elif node.tag == "main":
            main = max(main, chars)
        own[id(node)] = chars
        sums[id(node)] = (0, 0, longest, main) if why == COMMENT else (chars, articles, longest, main)
    total, in_articles = sums[id(root)][:2]
    goes: set[int] = set()
    for node, _, why in order:
        if why:
            chars, articles, longest, main = sums[id(node)]
            if why == COMMENT:
                stays = main > 0 or longest > total and 2 * longest > own[id(node)]
            else:
                stays = main > 0 or longest > 0 and 4 * longest >= total or 3 * chars > 2 * total and 10 * (in_articles - articles) < total
            if not stays:
                goes.add(id(node))
    if goes:
        for node, _, _ in order:
            node.children = [c for c in node.children if isinstance(c, str) or id(c) not in goes]


def measured(root: Node) -> tuple[list[Node], dict[int, list[int]]]:
    """Elements in page order; by id(): characters of text, of link text, commas, block children."""
    order, at = [root], 0
    while at < len(order):
        order.extend(c for c in order[at].children if not isinstance(c, str))
        at += 1
    sums: dict[int, list[int]] = {}
    for node in reversed(order):
        chars = links = commas = inner = 0
        for c in node.children:
            if isinstance(c, str):
                words = c.split()
                chars += sum(map(len, words)) + max(0, len(words) - 1)
                commas += c.count(",") + c.count("，") + c.count("、")
            else:
                s = sums[id(c)]
                chars, links, commas, inner = chars + s[0], links + s[1], commas + s[2], inner + s[3] + (c.tag in BLOCK)
        sums[id(node)] = [chars, chars if node.tag == "a" else links, commas, inner]
    return order, sums


def best_container(root: Node) -> tuple[list[Node], float]:
    """The best container with the siblings that belong to it, in page order, and its score."""
    order, sums = measured(root)
    points: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for node in order:
        chars, links, commas, inner = sums[id(node)]
        if not (node.tag in PARAGRAPH or node.tag in ("div", "section", "article") and not inner) or chars == 0 or inner and node.tag in ("td", "li", "blockquote"):
            continue
        if node.tag in ("li", "dd", "dt") and links * 2 > chars:
            continue
        gives = (1 + commas + min(chars / 100, 3.0)) * (1 - links / chars) * (1 if chars >= 25 else 0.3)
        above, share = node.parent if node.tag in PARAGRAPH else node, 1.0
        level = 0
        while above is not None and level < 5:
            if above.tag not in ("html", "#document", "p", "span", "b", "i", "em", "strong", "a"):
                nodes[id(above)] = above
                points[id(above)] = points.get(id(above), _start(above)) + gives * share
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
            above = above.parent
    if not points:
        return [root], 0.0
    score = {k: v * (1 - sums[k][1] / max(1, sums[k][0])) for k, v in points.items()}
    best = nodes[max(score, key=lambda k: (score[k], sums[k][0]))]
    top = score[id(best)]
    if best.parent is None:
        return [best], top
    if best.tag in ("body", "article", "main"):
        near = [c for c in best.parent.children if c is best or not isinstance(c, str) and c.tag == best.tag and score.get(id(c), 0) >= max(10, 0.2 * top)]
        return near, top
    out = []
    for c in best.parent.children:
        if isinstance(c, str):
            continue
        chars, links, _, _ = sums[id(c)]
        density = links / max(1, chars)
        if c is best or score.get(id(c), 0) >= max(10, 0.2 * top) or c.tag in PARAGRAPH and chars and density < 0.25 or c.tag == "h1" and chars:
            out.append(c)
    return out, top


def _start(node: Node) -> float:
    return START.get(node.tag, 0.0) + (10.0 if node._raw and _named(node) & CONTENT else 0.0)


def within(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node is not None


def main_text(html: str | None) -> tuple[str, float]:
    root = parse(html)
    strip(root)
    kept, score = best_container(root)
    skip: set[int] = set()
    for top in kept:
        if within(top, ("article", "main")):
            continue
        _, sums = measured(top)
        for node in top.elements():
            if node.tag in ("ul", "ol", "dl", "div", "table") and sums[id(node)][1] > 0.8 * sums[id(node)][0] > 0 and not within(node, ("article", "main")):
                links = [e.text().split() for e in node.elements() if e.tag == "a"]
                if len(links) >= 3 and sum(map(len, links)) <= 3 * len(links):
                    skip.add(id(node))
    return " ".join(b for top in kept for b in blocks(top, skip)), score


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts, scores = zip(*(main_text(h) for h in batch.column("html").to_pylist()), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(scores, pa.float64())], names=["page_id", "url", "text", "n_chars", "score"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the container's score of every row of pages."""
    return pages.select("page_id", "url", "html").mapInArrow(extracted, SCHEMA)
