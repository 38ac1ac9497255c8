"""Main text of web pages by wrapper induction.

Pages of one host are parsed to trees, which are aligned one after another by simple tree matching to one tree of slots, the
wrapper. Each block is aligned on its own; only the items of a list and the cells and rows of a table are one node, as they
are one text. A page's text is what stands in its content slots, and what a slot is is decided for the host, not for the page:

- A slot counts its texts over all distinct pages. A text that stands on SHARE of the pages is template.
- A slot counts what the markup of its nodes calls them. Most of them menus, headers, footers, sidebars, notices, adverts,
  forms, scripts or reader comments, or hidden: the slot is no content, though its texts vary. Most of them articles: if a page
  has such slots, only these are read, and template within them takes more support (see Wrapper), so that equal articles of
  one host are not mistaken for template.
- All other slots, whose texts vary, are content.

Hosts of over CHUNK pages are dealt out in parts by page_id; each part has its own wrapper, learned from all of its pages.
A single page, or pages without a host, have wrappers of one page, which know no template.

Defined results: null and empty html give empty text; a page without markup is one block per line run; broken markup is read
as browsers do in the simple cases (implied ends of p, li and table parts, unclosed inline elements, stray end tags); repeated
rows get equal texts and count once for the template; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store, table
from .tokens import groups

CHUNK = 200
#: Characters of html of a part whose trees are kept between learning and reading.
KEPT = 8 << 20
#: Share of the pages on which a template text stands; cells of the tables of simple tree matching, at most.
SHARE, CELLS = 0.8, 2500
PARTS = frozenset("li dt dd tr td th".split())
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("script style noscript template title head nav header footer aside form button select textarea iframe object svg canvas audio video dialog menu".split())
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that name something else than the article.
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail cookie cookies consent gdpr notice notices newsletter subscribe signup popup modal overlay paywall "
    "comment comments respond disqus reply replies menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright related recommended share sharing social widget pagination pager login "
    "search toolbar alert complementary contentinfo dialog".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([A-Za-z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|</?[A-Za-z][^<>]*+(?:>|\Z)",
    re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """An element: its name with class and id, children (nodes and strings) and whether its markup names it as no article."""

    __slots__ = ("tag", "name", "children", "other", "text")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.name, self.children, self.text = tag, tag, [], None
        self.other = tag in SKIPPED
        if attributes.strip():
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (a or b or c).lower()
                if key in ("class", "id", "role"):
                    words = re.split(r"[^a-z0-9]+", value)
                    self.other |= not OTHER.isdisjoint(words) and tag not in ("html", "body", "article", "main")
                    self.name += "." + re.sub(r"\d+", "", value)
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    self.other = True


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length: the stack is searched only for tags that are open."""
    root = Node("html")
    stack = [root]
    open_ = Counter()
    at = 0

    def close(k: int) -> None:
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    def last(tags) -> int:
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in tags)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        end, tag, attributes = m.group(2), m.group(3), m.group(4)
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break  # an inline end does not end a block
            continue
        if tag in ("html", "body"):
            continue
        if tag not in INLINE and tag not in VOID and open_["p"]:
            close(last(("p",)))  # above an open p there is nothing but inline elements
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            if any(open_[t] for t in ends) and stack[k := last(ends | within)].tag in ends:
                while stack[k - 1].tag in ends:  # a cell ends with its row
                    k -= 1
                close(k)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            open_[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def blocks(node: Node, dropped=frozenset()) -> list[str]:
    """Texts of the blocks under node, in order, without the nodes whose ids are in dropped."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            run.append(n)
        elif id(n) in dropped:
            if n.tag not in INLINE:
                flush()
        elif n.tag in INLINE:
            todo.extend(reversed(n.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(n.children))
    flush()
    return out


class Shape:
    """A node for alignment. Parts of one list or table that stand side by side under one name are one shape."""

    __slots__ = ("tag", "name", "nodes", "inside", "content", "children", "key", "size", "weight")

    def __init__(self, node: Node, inside: bool = False):
        self.tag, self.name, self.nodes, self.inside, self.content, self.children = node.tag, node.name, [node], inside, [], []


def shapes(page: Node, articles=frozenset()) -> list[Shape]:
    """All shapes of a page from the top down, its root first. articles: ids of its articles; shapes below them are inside."""
    order = [Shape(page)]
    for s in order:
        run: list[str] = []

        def flush(s=s, run=run):
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                s.content.append(text)

        todo: list = [c for n in reversed(s.nodes) for c in (None, *reversed(n.children))]
        inside = s.inside or any(id(n) in articles for n in s.nodes)
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                run.append(n)
            elif n is None:
                flush()
            elif n.tag in INLINE and not n.other:
                todo.extend(reversed(n.children))
            else:
                flush()
                last = s.content[-1] if s.content else None
                if n.tag in PARTS and isinstance(last, Shape) and last.name == n.name:
                    last.nodes.append(n)
                elif n.tag not in VOID:
                    s.content.append(Shape(n, inside))
        order.extend(c for c in s.content if isinstance(c, Shape))
    for s in reversed(order):
        s.content = [c for c in s.content if isinstance(c, str) or c.size]
        s.children = [c for c in s.content if isinstance(c, Shape)]
        s.size = sum(len(c) if isinstance(c, str) else c.size for c in s.content)
        s.weight = 1 + sum(c.weight for c in s.children)
        s.key = hash((s.name, *[c if isinstance(c, str) else c.key for c in s.content]))
    return order


class Slot:
    """Aligned shapes of the pages of a part: how many pages have each text here, how many have any, and on how many the
    markup names it as something else than the article, or as an article."""

    __slots__ = ("tag", "name", "children", "votes", "total", "nodes", "others", "articles")

    def __init__(self, tag: str, name: str):
        self.tag, self.name, self.children, self.votes, self.total = tag, name, [], Counter(), 0
        self.nodes = self.others = self.articles = 0


def likeness(slot: Slot, shape: Shape, memo: dict) -> int:
    """Simple tree matching: the size of the largest common ordered tree, in which equal texts count threefold."""
    if shape.key in slot.votes:
        return 3 * shape.weight
    if not slot.children or not shape.children:
        return 1
    at = id(slot), id(shape)
    if at not in memo:
        memo[at] = 1 + sum(likeness(a, b, memo) for a, b in align(slot.children, shape.children, memo))
    return memo[at]


def align(slots: list[Slot], own: list[Shape], memo: dict) -> list[tuple[Slot, Shape]]:
    """Slots and shapes of one name in an order that both lists have: first by texts that stand once in each, and between
    these by simple tree matching; lists too long for that are paired name by name."""
    names = {s.name for s in slots} & {s.name for s in own}
    label = lambda s: s.name if s.name in names else s.tag  # noqa: E731  a name that only one side has is compared by its tag
    a, b = list(map(label, slots)), list(map(label, own))
    labels = set(a) & set(b)
    slots, own = [s for s, x in zip(slots, a) if x in labels], [s for s, x in zip(own, b) if x in labels]
    a, b = [x for x in a if x in labels], [x for x in b if x in labels]
    if len(slots) == len(own) == 1:
        return [(slots[0], own[0])]
    once: dict[int, int] = {}
    for j, s in enumerate(own):
        once[s.key] = -1 if s.key in once else j
    found: dict[int, int] = {}
    for i, s in enumerate(slots):
        for k in s.votes.keys() & once.keys():
            if once[k] >= 0:
                found[once[k]] = -1 if once[k] in found else i
    # the longest rising run of these
    tails: list[int] = []
    ends: list[int] = []
    before: dict[int, int] = {}
    for j in sorted(found):
        if (i := found[j]) >= 0:
            at = bisect_left(tails, i)
            before[j] = ends[at - 1] if at else -1
            tails[at : at + 1], ends[at : at + 1] = [i], [j]
    fixed, j = [], ends[-1] if ends else -1
    while j >= 0:
        fixed.append((found[j], j))
        j = before[j]
    out: list[tuple[Slot, Shape]] = []
    i0 = j0 = 0
    for i, j in [*reversed(fixed), (len(slots), len(own))]:
        out += between(slots[i0:i], own[j0:j], a[i0:i], b[j0:j], memo)
        if i < len(slots):
            out.append((slots[i], own[j]))
        i0, j0 = i + 1, j + 1
    return out


def between(slots: list[Slot], own: list[Shape], a: list[str], b: list[str], memo: dict) -> list[tuple[Slot, Shape]]:
    """The same of lists without fixed pairs; a and b are what they are called."""
    m, n = len(slots), len(own)
    if not m or not n:
        return []
    if m == n == 1:
        return [(slots[0], own[0])] if a == b else []
    if m * n > CELLS:
        out, at = [], 0
        places: dict[str, list[int]] = {}
        for i, x in enumerate(a):
            places.setdefault(x, []).append(i)
        for s, x in zip(own, b):
            p = places.get(x, [])
            if (k := bisect_left(p, at)) < len(p):
                out.append((slots[p[k]], s))
                at = p[k] + 1
        return out
    inner = [[likeness(s, t, memo) if x == y else 0 for t, y in zip(own, b)] for s, x in zip(slots, a)]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        above, row, left = best[i], best[i + 1], 0
        for j, x in enumerate(inner[i]):
            left = row[j + 1] = max(above[j + 1], left, above[j] + x) if x else max(above[j + 1], left)
    out, i, j = [], m, n
    while i and j:
        if inner[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + inner[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((slots[i], own[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


class Wrapper:
    """The slots of a part, from all of its distinct pages.

    A text is template where it stands on SHARE of the pages that have the node around it, on two at least (three if there are as
    many pages). Within articles it takes three distinct articles, and a page that would lose over half of an article is a
    near copy of others, not a bearer of template: it keeps that article whole.
    """

    def __init__(self):
        self.root, self.pages, self.articles, self.of = Slot("html", "html"), set(), set(), {}

    def learn(self, page: Node) -> list[Shape]:
        """Takes a page in; its shapes."""
        found = articles_of(page)
        marked = frozenset(map(id, found))
        order = shapes(page, marked)
        if order[0].key in self.pages or not order[0].size:
            return order  # copies of a page say nothing about its template
        self.pages.add(order[0].key)
        inside = {id(n): s for s in order for n in s.nodes}
        text = tuple(inside[id(n)].key for n in found if id(n) in inside)
        fresh = not text or text not in self.articles
        self.articles.add(text)
        memo: dict = {}
        slots = {id(order[0]): self.root}
        todo = [(self.root, order[0])]
        while todo:
            slot, shape = todo.pop()
            pairs = {id(b): a for a, b in align(slot.children, shape.children, memo)}
            taken = set(map(id, pairs.values()))
            new: dict[int, list[Slot]] = {}
            last = 0
            for c in shape.children:
                if id(c) in pairs:
                    last = id(pairs[id(c)])
                else:
                    pairs[id(c)] = Slot(c.tag, c.name)
                    new.setdefault(last, []).append(pairs[id(c)])
            if new:
                slot.children = new.get(0, []) + [x for s in slot.children for x in (s, *(new.get(id(s), ()) if id(s) in taken else ()))]
            for c in shape.children:
                slots[id(c)] = pairs[id(c)]
                todo.append((pairs[id(c)], c))
        for s in order:
            if id(s) not in slots:
                continue
            slot, own = slots[id(s)], not marked.isdisjoint(map(id, s.nodes))
            slot.nodes, slot.others, slot.articles = slot.nodes + 1, slot.others + s.nodes[0].other, slot.articles + own
            if fresh or not s.inside and not own:
                slot.votes[s.key] += 1
                slot.total += 1
        self.of[order[0].key] = [slots.get(id(s)) for s in order]
        return order

    def text(self, page: Node, order: list[Shape] | None = None) -> str:
        """The content slots of a page that was learned. order: its shapes, where they are at hand."""
        order = shapes(page, frozenset(map(id, articles_of(page)))) if order is None else order
        slots = self.of.get(order[0].key)
        if slots is None:
            return ""
        at = {id(s): slot for s, slot in zip(order, slots, strict=True) if slot is not None}
        dropped = {id(n) for s in order if id(s) in at and 2 * at[id(s)].others > at[id(s)].nodes for n in s.nodes}
        is_article = lambda s: 2 * at[id(s)].articles > at[id(s)].nodes
        articles: list[Shape] = []
        todo = [order[0]]
        while todo:
            s = todo.pop()
            if is_article(s):
                articles.append(s)
            elif id(s.nodes[0]) not in dropped:
                todo.extend(reversed(s.children))
        ids = set(map(id, articles))

        def fixed(top: Shape) -> list[Shape]:
            out, todo = [], [top]
            while todo:
                s = todo.pop()
                around = at[id(s)].total
                for c in s.children:
                    least = 3 if c.inside else min(3, len(self.pages))
                    if id(c) in ids or id(c.nodes[0]) in dropped:
                        continue  # an article is read on its own
                    if at[id(c)].votes[c.key] >= max(2, least, SHARE * around):
                        out.append(c)
                    else:
                        todo.append(c)
            return out

        if len(self.pages) > 1:
            for top in articles or [order[0]]:
                lost = fixed(top)
                if id(top) not in ids or 2 * sum(s.size for s in lost) <= top.size:
                    dropped.update(id(n) for s in lost for n in s.nodes)
        return "\n".join(t for s in articles or [order[0]] for n in s.nodes for t in blocks(n, dropped))


def articles_of(page: Node) -> list[Node]:
    """The elements that the page marks as its article: articles, those within main if there is one, else main itself."""
    found: list[Node] = []
    todo = [page]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main") and not n.other:
            found.append(n)
        elif not n.other:
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return [x for n in found for x in ([a for a in descend(n, "article")] or [n])]


def descend(node: Node, tag: str) -> list[Node]:
    """The outermost elements of this tag under node, node itself included."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag == tag and not n.other:
            out.append(n)
        elif not n.other:
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def extract(pages: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    large = store(rows.groupBy("host").count().where(F.col("count") > chunk).select(F.col("host").alias("_host"), F.ceil(F.col("count") / chunk).alias("parts")), "large-hosts")
    part = F.pmod(F.xxhash64("page_id", F.lit("part")), F.coalesce("parts", F.lit(1)))
    dealt = rows.join(large, rows["host"] == large["_host"], "left").select("page_id", "url", "html", F.xxhash64("host", part).alias("key"))
    id_ = pages.schema["page_id"].dataType.simpleString()
    url_ = pages.schema["url"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)  # pages nest as deep as they like
        for rows in groups(batches, "key"):
            key = rows.column("key").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            text: list[str] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                sources = rows.column("html").slice(a, b - a)
                wrapper, held, room = Wrapper(), [], KEPT
                for x in sources:
                    page = parse(x.as_py())
                    order = wrapper.learn(page)
                    room -= len(x.as_py())
                    held.append((page, order) if room > 0 else None)  # the trees of very long pages are made twice
                for x, tree in zip(sources, held, strict=True):
                    text.append(wrapper.text(*(tree or (parse(x.as_py()),))))
            yield pa.RecordBatch.from_arrays([rows.column("page_id").combine_chunks(), rows.column("url").combine_chunks(), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return dealt.repartition("key").sortWithinPartitions("key", "page_id").mapInArrow(read, f"page_id {id_}, url {url_}, text string")


def op4_wrapper_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
