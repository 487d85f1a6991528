"""Main text of web pages by tree scoring.

A page is read into a tree of elements.  Every paragraph (a block that holds text itself) passes
points for its length and commas to its ancestors, all to the parent, half to the grandparent and
less further up.  A container's points are discounted by the share of its text inside links.  The
best container and those of its siblings that score alike or read like prose are kept (of equal containers the one found
first; an ``article`` around it is kept whole); inside them, menus, forms, notices and the like are left out, known by element, role or a whole
class or id, never by a part of a name.  Blocks that are mostly links are left out where neither ``article`` nor ``main`` holds them.

Character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one space.  Null and empty pages, and pages without text, give the empty text.
Broken markup is read as far as it goes: unclosed elements end with their container.  Repeated
rows come out alike, one row each.  Pages of any length are read whole; an empty table gives an empty result.  Only ``page_id``,
``url`` and ``html`` are read, other columns may have any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from whence.llm.common import batch_of, batches, texts

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = {t: re.compile(rf"</{t}[\s>/]|\Z", re.I) for t in ("script", "style", "textarea", "noscript", "iframe", "title", "svg", "template", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var del label wbr img".split())
#: Elements that are never part of the main text.
_OUT = frozenset("nav footer aside form button select option input textarea script style noscript iframe head title dialog menu object embed canvas audio video svg template fieldset".split())
#: What a paragraph-like element closes when it opens.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SCOPE = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Classes and ids, as whole names, of adverts, menus, headers and footers, sidebars, notices, forms and reader comments.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner ad-banner "
    "nav navbar navigation menu main-menu nav-menu breadcrumb breadcrumbs pagination pager toolbar "
    "masthead site-header page-header footer site-footer page-footer sidebar side-bar "
    "cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice alert popup modal overlay newsletter subscribe signup login "
    "comment comments comment-list comments-area comment-section user-comments reader-comments disqus disqus_thread replies respond".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "items", "out", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.items: list = []  # nodes and strings in page order
        self.score, self.chars, self.linked = 0.0, 0, 0


def _unwanted(tag: str, attrs: str, parent: Node) -> bool:
    if parent.out or tag in _OUT:
        return True
    if tag == "header":
        return not any(p.tag in ("article", "main") for p in _line(parent))
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
    if found.get("role", "").lower() in _ROLES or found.get("aria-hidden") == "true" or "hidden" in found:
        return True
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    return not _NAMES.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split())


def _line(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def parse(page: str) -> Node:
    root = at = Node("#", None, False)
    pos = 0
    while m := _TAG.search(page, pos):
        if m.start() > pos:
            at.items.append(html.unescape(page[pos : m.start()]))
        pos = m.end()
        if m[1]:
            at.items.append(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:  # an end tag closes up to its element, if that is open
            own = next((n for n in _line(at) if n.tag == tag), None)
            at = own.parent if own and own.parent else at
            continue
        closes = _CLOSES.get(tag) or ({"p"} if tag in _BLOCK_ENDS_P else ())
        if closes:
            stop = _SCOPE.get(tag, _BLOCK_ENDS_P)
            for n in _line(at):
                if n.tag in stop or not n.parent:
                    break
                if n.tag in closes:
                    at = n.parent
                    break
        node = Node(tag, at, _unwanted(tag, m[4], at))
        at.items.append(node)
        if tag in _RAW:
            pos = _RAW[tag].search(page, pos).start()
        elif tag not in _VOID and not m[4].endswith("/"):
            at = node
    at.items.append(html.unescape(page[pos:]))
    return root


def _blocks(node: Node, all_out: bool = False) -> Iterator[tuple[Node, str, int]]:
    """(container, text, characters in links) of the blocks of text under a node, in page order."""
    run: list[str] = []
    linked = 0
    stack = [(node, iter(node.items), node, False)]  # element, what is left of it, its block, inside a link
    while stack:
        el, rest, block, link = stack[-1]
        for x in rest:
            if isinstance(x, str):
                run.append(x)
                linked += len(x.strip()) if link else 0
                continue
            if x.out and not all_out:
                continue
            if x.tag == "br":
                run.append(" ")
                continue
            if x.tag in _INLINE:
                stack.append((x, iter(x.items), block, link or x.tag == "a"))
            else:
                if text := _WHITE.sub(" ", "".join(run)).strip():
                    yield block, text, linked
                run, linked = [], 0
                stack.append((x, iter(x.items), x, link))
            break
        else:
            stack.pop()
            if el is block:
                if text := _WHITE.sub(" ", "".join(run)).strip():
                    yield block, text, linked
                run, linked = [], 0


def main_text(page: str) -> str:
    root = parse(page)
    for block, text, linked in _blocks(root):
        for n in _line(block):
            n.chars += len(text)
            n.linked += min(linked, len(text))
        if len(text) < 25 and not block.tag.startswith("h"):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        above = block.parent if block.parent and block.tag not in ("div", "section", "article", "main", "body", "td") else block
        for depth, n in enumerate(_line(above)):
            n.score += points if depth == 0 else points / 2 if depth == 1 else points / (3 * depth)

    def rated(n: Node) -> float:
        return n.score * (1 - n.linked / n.chars) if n.chars else 0.0

    best, stack = root, [root]
    while stack:
        n = stack.pop()
        if rated(n) > rated(best) or best is root and rated(n) > 0 and n is not root:
            best = n
        stack.extend(x for x in n.items if isinstance(x, Node) and not x.out and x.tag not in _INLINE)
    # text written around elements of an article belongs to it
    best = next((n for n in _line(best) if n.tag == "article"), best)
    kept = [best]
    if best.parent and best.tag not in ("article", "main", "body", "html"):
        least = max(10.0, rated(best) / 5)
        kept = []
        for x in best.parent.items:
            if isinstance(x, Node) and not x.out and (x is best or rated(x) >= least or x.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and x.chars and x.linked <= 0.25 * x.chars):
                kept.append(x)
    parts = []
    for n in kept:
        for block, text, linked in _blocks(n):
            if linked > 0.5 * len(text) and block.tag in ("li", "ul", "ol", "div", "td", "section", "dd") and not any(p.tag in ("article", "main") for p in _line(block)):
                continue  # a list of links where no element says that it is the article's
            parts.append(text)
    return " ".join(parts)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [main_text(t) for t in texts(b, "html")]
            yield batch_of(out, (b.column("page_id"), b.column("url"), found, list(map(len, found))))

    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return rows.mapInArrow(part, "page_id long, url string, text string, n_chars long")
