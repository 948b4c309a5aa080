"""Main text of web pages by composite text density.

Every node of the page's tree gets a density: characters per tag, adjusted for the share of them that
stands in links. A node's density sum is the sum over its children; the subtree with the largest sum is
the text. The smallest density on the path from it to the body is the threshold by which other parts
of the page still count as text, where no article element says what belongs together.

What is never text (menus, headers, footers, scripts, ... by element or role; hidden parts) is taken out
before densities are computed. Forms, and the words of class and id (sidebars, notices, reader comments),
only say that a part may not be text. Such a part stays when it holds the page's largest article, stands
under a heading of its own, is a heading, or when parts without many links that have its word hold half of
the text around them, as page wrappers do.

The tree is built leniently: elements that end where another begins are closed there, end tags without
a start are ignored, and a page may stop anywhere. Text between blocks is joined by one line break,
white space inside a block is one space, and line-break elements are white space.

Defined cases: null, empty and text-free pages give an empty text; rows that repeat are answered alike;
an empty table gives no rows. Other columns pass through ``extract`` untouched.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z]+")

# Elements as the HTML standard defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What a start tag closes, up to the nearest of the elements after it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_P_SCOPE = frozenset("table td th caption button object html".split())
_NO_P = BLOCKS - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())

# Parts that are not the article, by element, role, and word of class or id.
NOT_TEXT = frozenset(
    "head script style noscript template nav footer aside button select textarea iframe object embed svg math "
    "canvas dialog menu audio video map title xmp noembed noframes search".split()
)
NOT_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist".split()
)
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo "
    "promoted promotion related recommended recommendations replies reply respond share sharing sidebar signup "
    "skip social sponsor sponsored sponsors subscribe subscription toast toolbar topbar widget widgets".split()
)
_WHOLE = frozenset("html body article main".split())


class _Tree:
    """Nodes in page order: tag, parent, whether left out; texts hang between their nodes."""

    def __init__(self) -> None:
        self.tags = ["#"]
        self.parents = [-1]
        self.out = [False]
        # Words of class and id of nodes that may not be text.
        self.doubted: dict[int, set[str]] = {}
        # (node, None) where an element starts, (node, text) for text, (-1 - node, None) where it ends.
        self.events: list[tuple[int, str | None]] = [(0, None)]


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOT_TEXT:
        return True
    if tag == "header":
        return not in_article
    if not attributes or tag in _WHOLE:
        return False
    own = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role") in NOT_TEXT_ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")))


def _doubt(tag: str, attributes: str, in_article: bool) -> set[str] | None:
    """Words of class and id, of a node by which it may not be text."""
    if tag in _WHOLE or tag in HEADINGS or (not attributes and tag != "form"):
        return None
    own = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    words = set(_WORDS.findall(f"{own.get('class', '')} {own.get('id', '')}"))
    found = words & NOT_TEXT_WORDS - ({"header"} if in_article else set())
    return words if found or tag == "form" or own.get("role") == "form" else None


def parse(page: str) -> _Tree:
    tree = _Tree()
    stack = [0]  # open nodes
    names = ["#"]

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            tree.events.append((-1 - stack.pop(), None))
            names.pop()

    def close_if(which, scope) -> None:
        """Close the outermost open element of ``which`` inside the nearest scope."""
        found = None
        for depth in range(len(names) - 1, 0, -1):
            if names[depth] in which:
                found = depth
            elif names[depth] in scope:
                break
        if found:
            close_to(found)

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            tree.events.append((stack[-1], page[at:stop]))
        if not token:
            break
        at = token.end()
        closing, tag, attributes = token.group(1), token.group(2), token.group(3) or ""
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag in names:
                depth = len(names) - 1 - names[::-1].index(tag)
                # An inline end tag doesn't close the blocks opened since.
                if tag in BLOCKS or not any(name in BLOCKS for name in names[depth + 1 :]):
                    close_to(depth)
            continue
        if tag in _NO_P:
            close_if({"p"}, _P_SCOPE)
        if tag in _CLOSES:
            close_if(*_CLOSES[tag])
        node = len(tree.tags)
        tree.tags.append(tag)
        tree.parents.append(stack[-1])
        parent_out = tree.out[stack[-1]]
        in_article = "article" in names or "main" in names
        tree.out.append(parent_out or _left_out(tag, attributes, in_article))
        if not tree.out[node] and (words := _doubt(tag, attributes, in_article)) is not None:
            tree.doubted[node] = words
        tree.events.append((node, None))
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCKS and tag not in RAW):
            tree.events.append((-1 - node, None))
            continue
        stack.append(node)
        names.append(tag)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else end
            if stop > at and tag == "textarea":
                tree.events.append((node, page[at:stop]))
            at = stop
    close_to(1)
    if tree.doubted:
        _settle(tree)
    return tree


def _settle(tree: _Tree) -> None:
    """Take out the doubted parts that are not the page's text."""
    n = len(tree.tags)
    chars, links = [0] * n, [0] * n
    titles: dict[int, list[str]] = {}
    # The nearest article, link and heading each node stands in.
    scope, in_link, title = [0] * n, [False] * n, [0] * n
    for node in range(1, n):
        up, tag = tree.parents[node], tree.tags[node]
        scope[node] = node if tag in ("article", "main") else scope[up]
        in_link[node] = tag == "a" or in_link[up]
        title[node] = node if tag in HEADINGS else title[up]
    for node, text in tree.events:
        if text is not None and not tree.out[node]:
            chars[node] += len("".join(text.split()))
            if title[node]:
                titles.setdefault(title[node], []).append(text)
    for node in range(n):
        links[node] = chars[node] * in_link[node]
    headed: dict[int, int] = {}  # first heading of a node
    for node in range(n - 1, 0, -1):
        up = tree.parents[node]
        chars[up] += chars[node]
        links[up] += links[node]
        own = node if tree.tags[node] in HEADINGS and node in titles else headed.get(node)
        if own:
            headed[up] = own
    articles = [node for node in range(n) if tree.tags[node] in ("article", "main") and not tree.out[node]]
    largest = max(articles, key=lambda node: (chars[node], -node), default=0)
    marked = largest and 4 * chars[largest] >= chars[0]
    holders = set()
    node = largest
    while node > 0:
        holders.add(node)
        node = tree.parents[node]
    few_links = {node for node in tree.doubted if 2 * links[node] < chars[node]}

    # Text that each such word marks in an article or outside, where words repeat by the outermost part.
    held: dict[tuple[int, str], int] = {}
    reasons = {node: words & NOT_TEXT_WORDS or {"<form>"} for node, words in tree.doubted.items()}
    for node in few_links - holders:
        seen: set[str] = set()
        up = tree.parents[node]
        while up > 0 and scope[up] == scope[node]:
            if up in few_links and up not in holders:
                seen |= reasons[up]
            up = tree.parents[up]
        for word in reasons[node] - seen:
            held[scope[node], word] = held.get((scope[node], word), 0) + chars[node]

    def stays(node: int) -> bool:
        if node in holders and largest:
            return True
        if node not in few_links:
            return False
        around = scope[node]
        if around == 0 and marked:
            return False
        if all(2 * held.get((around, word), 0) >= chars[around] for word in reasons[node]):
            return True
        if node not in headed:
            return False
        words = tree.doubted[node]
        own = set(_WORDS.findall("".join(titles[headed[node]]).lower()))
        return around > 0 or tree.tags[headed[node]] == "h1" or bool(words) and words <= own

    for node in range(1, n):
        if tree.out[tree.parents[node]] or (node in tree.doubted and not stays(node)):
            tree.out[node] = True


def _densities(tree: _Tree) -> tuple[list[float], list[float]]:
    """Composite density and density sum of each node."""
    n = len(tree.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.events:
        if text is not None and not tree.out[node]:
            chars[node] += len("".join(text.split()))
    in_link = [False] * n
    for node in range(1, n):
        in_link[node] = tree.tags[node] == "a" or in_link[tree.parents[node]]
        if in_link[node]:
            link_chars[node] = chars[node]
    for node in range(n - 1, 0, -1):
        if tree.out[node]:
            continue
        up = tree.parents[node]
        chars[up] += chars[node]
        tags[up] += tags[node] + 1
        link_chars[up] += link_chars[node]
        link_tags[up] += link_tags[node] + (tree.tags[node] == "a")
    body = tree.tags.index("body") if "body" in tree.tags else 0
    of_links = link_chars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for node in range(n):
        c, t = chars[node], max(1, tags[node])
        if not c or tree.out[node]:
            continue
        lc, lt = max(1, link_chars[node]), max(1, link_tags[node])
        base = math.log(c / max(1, c - link_chars[node]) * link_chars[node] + of_links * c + math.e)
        # The logarithm's base is 1 on pages without links; one more keeps it a base everywhere.
        density[node] = c / t * max(0.0, math.log(c / lc * t / lt)) / math.log(base + 1)
        if node:
            sums[tree.parents[node]] += density[node]
    return density, sums


def _chosen(tree: _Tree) -> list[int]:
    """Roots of the subtrees that are the text."""
    density, sums = _densities(tree)
    body = tree.tags.index("body") if "body" in tree.tags else 0
    best = max(range(len(sums)), key=lambda node: (sums[node], -node))
    if sums[best] == 0:
        best = body
    path = [best]
    while path[-1] not in (body, 0):
        path.append(tree.parents[path[-1]])
    for node in reversed(path):
        if tree.tags[node] in ("article", "main"):
            # Of nested ones the innermost that still holds the largest subtree.
            inner = [p for p in path if tree.tags[p] == "article"]
            return [inner[0] if inner else node]
    # No element says where the article ends: the path's smallest density decides.
    threshold = min(density[node] for node in path)
    roots, inside = [], [False] * len(tree.tags)
    for node in range(len(tree.tags)):
        up = tree.parents[node]
        if up >= 0 and inside[up]:
            inside[node] = True
        elif node == best or (
            node not in path and not tree.out[node] and up in path and density[node] >= threshold
        ) or (tree.tags[node] in HEADINGS and up in path):
            inside[node] = True
            roots.append(node)
    return roots


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line breaks."""
    tree = parse(page or "")
    roots = set(_chosen(tree))
    blocks: list[str] = []
    pending: list[str] = []
    depth = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(pending)).split())
        pending.clear()
        if text:
            blocks.append(text)

    for node, text in tree.events:
        ending = node < 0
        own = -1 - node if ending else node
        if text is not None:
            if depth and not tree.out[own]:
                pending.append(text)
            continue
        if own in roots and not ending:
            depth += 1
        tag = tree.tags[own]
        if tag in BLOCKS or own in roots:
            flush()
        elif tag == "br" and not ending:
            pending.append(" ")
        if own in roots and ending:
            depth -= 1
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """All other columns, and the main text in place of the markup."""
    kept = [c for c in pages.columns if c not in (html_column, into)]
    schema = pages.select(*kept).schema.add(into, "string")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            last = batch.num_columns - 1
            texts = pa.array([main_text(page.as_py()) for page in batch.column(last)], pa.string())
            columns = [batch.column(i) for i in range(last)] + [texts]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return pages.select(*kept, F.col(html_column)).mapInArrow(scan, schema)
