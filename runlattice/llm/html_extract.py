"""Main text of web pages by minimum-cut labelling.

A page becomes its text blocks in order and the elements around them that say something (by tag, role or name). A linear classifier prices a block by its own text
alone (length, links, tag) and an element by its kind; the prices are capacities to source (content) and sink (boilerplate). Edges are smoothness: blocks and
elements hang on the element around them, neighbours in the page on each other. Content inside boilerplate costs more than any block is worth; boilerplate inside
content costs what speaks for the content. The minimum cut, found by maximum flow, labels all of a page at once.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import ensure_workers_import

#: Fixed values of HTML: elements that start a new block, elements without content, elements whose content is raw text, and what an opening tag closes.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul dd dt li".split())
SCOPE = frozenset("table td th caption button html template".split())
LISTS = frozenset("ul ol menu dl table".split())
#: Elements whose text is never shown as an article's text.
NEVER = frozenset("head title script style noscript template iframe object svg math canvas audio video select option optgroup button textarea noembed noframes datalist".split())

#: Prices of a block's surroundings in favour of content (log odds).
TAG_PRICE = {"article": 3.0, "main": 2.5, "nav": -9.0, "aside": -9.0, "footer": -9.0, "form": -9.0, "fieldset": -3.0, "menu": -9.0, "header": -6.0, "dialog": -9.0, "label": -2.0, "blockquote": 0.3, "address": -1.0}
ROLE_PRICE = {"navigation": -9.0, "banner": -6.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "alert": -9.0, "dialog": -9.0, "main": 2.5, "article": 3.0, "menu": -9.0, "menubar": -9.0, "form": -9.0}
BAD_NAME = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notices?|alerts?|nav\w*|menu\w*|side-?bar\w*|comments?|commentlist|disqus|replies|reply|share\w*|sharing|social\w*|related\w*|recommend\w*|footer\w*|header|masthead|breadcrumbs?|subscri\w*|newsletter\w*|widget\w*|popup\w*|modal\w*|overlay|login|signup|search\w*|pagination|pager|tags?|meta|byline|toolbar|skip\w*|respond)(?:$|[^a-z])")
GOOD_NAME = re.compile(r"(?:^|[^a-z])(?:article\w*|content|post|entry\w*|main|story\w*|body)(?:$|[^a-z])")
BAD_PRICE, GOOD_PRICE, HIDDEN_PRICE = -9.0, 1.0, -20.0
SMOOTH = 0.8
#: What an element's kind weighs against the texts in it, so many short texts don't outvote it.
KIND = 100.0
#: What content inside boilerplate costs: a block, and an element.
INSIDE, INSIDE_ELEMENT = 40.0, 1e5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
SPACES = re.compile(r"\s+")


class Block:
    """A text block: its text, the numbers of its enclosing elements, the holder that it hangs on (-1: none), and link characters."""

    __slots__ = ("text", "path", "holder", "never", "links", "tag")

    def __init__(self, text: str, path: tuple[int, ...], holder: int, never: bool, links: int, tag: str) -> None:
        self.text, self.path, self.holder, self.never, self.links, self.tag = text, path, holder, never, links, tag


class Holder:
    """An element with a price: that, the holder around it (-1: none), and the sum of what speaks for content up to it."""

    __slots__ = ("price", "around", "good")

    def __init__(self, price: float, around: int, good: float) -> None:
        self.price, self.around, self.good = price, around, good


def priced(tag: str, attributes: str, in_article: bool) -> float:
    price = TAG_PRICE.get(tag, 0.0)
    if tag in ("header", "address") and in_article:
        price = 0.0
    if attributes.strip(" /\n\t"):
        names = []
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                names.append(value)
            elif name == "role":
                price += ROLE_PRICE.get(value, 0.0)
            elif name in ("hidden",) or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                price += HIDDEN_PRICE
        joined = " ".join(names)
        if joined:
            if BAD_NAME.search(joined) and tag not in ("body", "html", "article", "main"):
                price += BAD_PRICE
            elif GOOD_NAME.search(joined):
                price += GOOD_PRICE
    return price


def blocks_of(page: str) -> tuple[list[Block], list[Holder]]:
    """Text blocks in page order, and the elements with a price; white space within a block is one blank, character references are decoded."""
    out: list[Block] = []
    holders: list[Holder] = []
    stack: list[tuple[str, int, int, bool, bool]] = []  # tag, number, holder, never shown, in an article
    parts: list[tuple[str, bool]] = []
    count, links = 0, 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = SPACES.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                linked = sum(len(p.strip()) for p, link in parts if link)
                holder = next((x for x in reversed(stack) if x[0] in BLOCK), None)
                at, never = (stack[-1][2], stack[-1][3]) if stack else (-1, False)
                path = tuple(x[1] for x in stack if x[0] in BLOCK)
                out.append(Block(text, path, at, never, linked, holder[0] if holder else ""))
            parts = []

    def pop_to(i: int) -> None:
        nonlocal links
        if any(x[0] in BLOCK for x in stack[i:]):
            flush()
        links -= sum(x[0] == "a" for x in stack[i:])
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append((html.unescape(piece) if "&" in piece else piece, links > 0))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                parts.append((" ", False))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in CLOSED_BY:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSED_BY[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in LISTS:
                    break
        if tag in BLOCK:
            flush()
        if tag == "body" and any(x[0] == "head" for x in stack):
            pop_to(next(i for i, x in enumerate(stack) if x[0] == "head"))
        if tag in VOID:
            if tag == "br":
                parts.append((" ", False))
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if m[3].endswith("/") and tag in ("path", "circle", "rect", "use", "line", "polygon", "g"):
            continue
        last = stack[-1] if stack else ("", 0, -1, False, False)
        count += 1
        never = last[3] or tag in NEVER
        if never and not last[3] and tag not in BLOCK:
            flush()
        at_holder = last[2]
        if price := priced(tag, m[3], last[4]):
            holders.append(Holder(price, at_holder, max(price, 0.0) + (holders[at_holder].good if at_holder >= 0 else 0.0)))
            at_holder = len(holders) - 1
        stack.append((tag, count, at_holder, never, last[4] or tag in ("article", "main")))
        links += tag == "a"
    flush()
    return out, holders


def odds(block: Block) -> float:
    """Log odds that a block is content, by its text and tag alone."""
    if block.never:
        return -50.0
    words = block.text.count(" ") + 1
    n = len(block.text)
    price = min(words, 40) * 0.06 - 0.6
    price -= 4.0 * block.links / n if block.links * 2 > n else 1.0 * block.links / n
    if block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        price += 0.5
    if block.text[:1] in "©" or block.text.lower().startswith(("copyright ", "(c) ")):
        price -= 2.0
    return price


def cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """Labels of a minimum cut: True on the source's side. Dinic's maximum flow; an edge (a, b, forth, back) costs forth if only a is on that side, back if only b is."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        adj[a].append(len(to))
        to.append(b)
        cap.append(forth)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        least = min(source[i], sink[i])
        if source[i] > least:
            link(s, i, source[i] - least, 0.0)
        if sink[i] > least:
            link(i, t, sink[i] - least, 0.0)
    for a, b, forth, back in edges:
        link(a, b, forth, back)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in adj[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            for i in range(nxt[a], len(adj[a])):
                e = adj[a][i]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    nxt[a] = i
                    path.append(e)
                    a = to[e]
                    break
            else:
                if a == s:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]


def smoothness(blocks: list[Block], holders: list[Holder]) -> list[tuple[int, int, float, float]]:
    """Edges between neighbours in the page, weaker the further apart they are in the tree, between next blocks of the same parent, and from blocks and elements to the element around (holders are numbered after the blocks)."""
    edges = []
    n = len(blocks)
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = b.path[-2] if len(b.path) > 1 else 0
        if i:
            a = blocks[i - 1]
            shared = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                shared += 1
            weight = SMOOTH / (1 + abs(len(a.path) + len(b.path) - 2 * shared))
            edges.append((i - 1, i, weight, weight))
        if parent in last_of and last_of[parent] != i - 1:
            edges.append((last_of[parent], i, SMOOTH / 2, SMOOTH / 2))
        last_of[parent] = i
        if b.holder >= 0:
            edges.append((i, n + b.holder, INSIDE, holders[b.holder].good))
    for i, h in enumerate(holders):
        if h.around >= 0:
            edges.append((n + i, n + h.around, INSIDE_ELEMENT, holders[h.around].good))
    return edges


def labelled(page: str) -> list[tuple[Block, float, bool]]:
    """Of each block its own price and the label of the cut."""
    blocks, holders = blocks_of(page)
    if not blocks:
        return []
    own = [odds(b) for b in blocks]
    prices = own + [KIND * h.price for h in holders]
    label = cut([max(p, 0.0) for p in prices], [max(-p, 0.0) for p in prices], smoothness(blocks, holders))
    return list(zip(blocks, own, label))


def main_text(page: str) -> str:
    """The content blocks of a page, one to a line."""
    return "\n".join(b.text for b, _, content in labelled(page) if content)


def extracted(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each page; a null or empty page, or one without content, gives an empty text.

    A map over rows without a shuffle; broken markup is read as browsers do for the common cases and never fails. Other columns
    stay; one named out is replaced.
    """
    ensure_workers_import(pages.sparkSession)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array([main_text(p.as_py() or "") for p in col], pa.string())

    return pages.withColumn(out, text(F.col(f"`{html_column}`").cast("string")))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
