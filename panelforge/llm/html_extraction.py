"""Main text of web pages by wrapper induction over pages of one host.

Every distinct page votes for its slots: the path of tags and roles to a text
block, with the text. Votes are counted over the whole host. Slots that nearly
all pages hold are template, slots that vary are content. Pages whose varying
slots are equal are copies and have one vote; pages without a varying slot, whose
all is held by others, have none. To take the template out, pages of a host are
dealt to small groups by hash, and each DOM tree is aligned with its neighbour by
simple tree matching: nodes of equal tag and role match, and among ordered
children the matching of the largest weight is taken (equal first and last children
belong to one, so only what lies between them is searched, by one table however long
it is). Slots that several pages
of a group hold but no alignment matches have moved and stay.
What HTML itself marks as no content (navigation, forms,
scripts, or elements with a class or id of advert, comments and the like) goes
as well, and a page with an ``article`` or ``main`` element has its content there.
Marks are whole class or id values, of parts that all say so (``site-notice``,
``comments-7``); layout classes that only mention a part (``has-sidebar``,
``comments-open``) mark nothing. A marked element that holds an unmarked ``article``
or ``main`` loses the rest of its text only: a ``main`` counts like any other, an
``article`` where no other element of the page holds the content.

Defined results:

* a null or empty ``html`` has an empty text; a null ``url`` is a host of its own;
* a host with a single page, or copies only, has no template; the marks remain;
* two pages of a host that differ have a template: of a page and an edited copy of
  it, with no third page to compare, the part they share goes;
* markup that is not closed ends with the element around it; any input parses, in
  time that grows with its length: a tag that never ends is text;
* block elements more than ``DEPTH`` deep are blocks of the element at that depth, in
  page order; an ``article`` or ``main`` that starts below it counts like any block;
* repeated rows are extracted one by one; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table, text_batches

#: Pages of a group, the share of a host's voters that hold a template slot, and the least number of voters.
GROUP_PAGES = 16
CONSTANT_SHARE = 0.9
LEAST_VOTERS = 2

#: Depth of block elements up to which they nest.
DEPTH = 256

#: Cells of matching tables held at one time; rows let go are worked out again, with the same results.
CELLS = 1_000_000

# Fixed values of HTML: elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
) - {"br"}
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
#: An element that ends open ones of these, up to the elements that hold them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Elements and words in class, id or role that mark what is no content.
DROPPED = RAW | frozenset("head nav header footer aside form button select option input svg canvas object audio video dialog menu".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adslot adbox sponsor sponsored promo promotion banner nav navbar navigation menu"
    " breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond"
    " reply replies search searchform pagination pager toolbar copyright legal disclaimer skip contentinfo complementary form".split()
)
#: Parts that may stand beside a mark in one value.
BESIDE = frozenset(
    "site page global top bottom left right main primary secondary inner outer wrapper wrap container box block area section list item items"
    " bar link links button buttons icon icons slot unit zone x text title count template body posts articles stories".split()
)
#: Beside these, a header or banner is that of the content.
OF_CONTENT = frozenset("post entry article".split())
CONTENT = frozenset(["article", "main"])
#: How an element is dropped: by its mark or as a form around the page, by its kind, or as not shown at all.
MARKED, KIND, HIDDEN = 1, 2, 3

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)")
_IN_TAG = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "sign", "dropped", "rescued", "depth", "children", "first", "last", "whole", "weight")

    def __init__(self, tag: str, sign: str, dropped: int, rescued: bool = False, depth: int = 0):
        self.tag, self.sign, self.dropped, self.depth = tag, sign, dropped, depth
        #: An ``article`` or ``main`` within dropped elements, which counts if the page has no other.
        self.rescued = rescued
        #: Block elements and text blocks (strings), in page order.
        self.children: list[Node | str] = []
        #: Set by :func:`measure`: its texts among those of the tree, hash and matching weight of the whole subtree.
        self.first = self.last = self.weight = 0
        self.whole = b""


class _Tags:
    """Finds markup from left to right; what has been seen never to end is not read again."""

    def __init__(self, page: str):
        self.page = page
        #: Position of the next ``>`` or quote, and from where on it is known.
        self.known, self.special = 0, -1
        #: Specials from which no tag ends.
        self.endless: set[int] = set()

    def _next_special(self, at: int) -> int:
        if not self.known <= at <= self.special:
            found = _IN_TAG.search(self.page, at)
            self.known, self.special = at, found.start() if found else len(self.page)
        return self.special

    def end(self, at: int) -> int:
        """Where the tag whose attributes start at ``at`` ends, after its ``>``; -1 if it does not."""
        first = at = self._next_special(at)
        passed = []
        while at < len(self.page) and at not in self.endless:
            if self.page[at] == ">":
                return at + 1
            passed.append(at)
            close = self.page.find(self.page[at], at + 1)
            if close < 0:
                break
            found = _IN_TAG.search(self.page, close + 1)
            at = found.start() if found else len(self.page)
        self.endless.update(passed, (first,))
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """Start and end of the next markup, its kind (``/``, a tag, ``!`` or the text of a CDATA section), name and attributes."""
        page, size = self.page, len(self.page)
        while 0 <= (at := page.find("<", at)):
            if page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                return at, close + 3 if close >= 0 else size, "!", "", ""
            if page.startswith("<![CDATA[", at):
                close = page.find("]]>", at + 9)
                return at, close + 3 if close >= 0 else size, "[", page[at + 9 : close if close >= 0 else size], ""
            if page.startswith(("<!", "<?"), at):
                close = page.find(">", at)
                return at, close + 1 if close >= 0 else size, "!", "", ""
            tag = _TAG.match(page, at)
            if tag and (end := self.end(tag.end())) >= 0:
                return at, end, tag.group(1) or "tag", tag.group(2).lower(), page[tag.end() : end - 1]
            at += 1
        return size, size, "", "", ""


def marks(value: str) -> bool:
    """Whether one class, id or role says that its element is no content."""
    parts = [part for part in re.split(r"[^a-z]+", value) if part]
    found = [part for part in parts if part in MARKS]
    others = {part for part in parts if part not in MARKS and part not in BESIDE}
    if others and others <= OF_CONTENT and not {"header", "banner"}.intersection(found):
        others = set()
    return bool(found) and not others


def _described(tag: str, attributes: str) -> tuple[str, int, bool]:
    """Tag with its class and id without digits, how it is dropped (0: it is not), and whether its values mark it."""
    dropped = (MARKED if tag == "form" else KIND) if tag in DROPPED else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag, dropped, False
    words, marked, seen = [], False, set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if name in seen:
            continue
        seen.add(name)
        if name in ("class", "id", "role"):
            words += re.split(r"[^a-z]+", value.lower())
            marked = marked or any(map(marks, value.lower().split()))
        elif tag not in ("html", "body") and (
            name == "hidden" or (name == "style" and _HIDDEN.search(value)) or (name == "aria-hidden" and value.lower() == "true")
        ):
            dropped = HIDDEN
    words = [w for w in words if w]
    if marked and not dropped and tag not in CONTENT and tag not in ("html", "body"):
        dropped = MARKED
    return " ".join([tag, *words]), dropped, marked


class _Open:
    """Open elements: tag, node that takes their text, how it is dropped. Each tag knows its depths, so no search walks the stack."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node, int]] = [("#root", root, 0)]
        self.of_tag: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, node: Node, dropped: int) -> None:
        self.of_tag.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node, dropped))

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.of_tag[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def last(self, tags: Iterable[str]) -> int:
        """Depth of the last open one of these tags, 0 if there is none."""
        return max((self.of_tag[tag][-1] for tag in tags if self.of_tag.get(tag)), default=0)


def parse(page: str) -> Node:
    """The tree of block elements; runs of text and inline elements between them are strings."""
    root = Node("#root", "#root", 0)
    opened, tags = _Open(root), _Tags(page)
    run: list[str] = []
    at = 0

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            _, node, dropped = opened.stack[-1]
            if text and (dropped == node.dropped or not dropped):
                node.children.append(text)

    def close(depth: int) -> None:
        flush()
        opened.cut(depth)

    while at < len(page):
        start, end, kind, tag, attributes = tags.next(at)
        if start > at:
            run.append(page[at:start])
        at = end
        if kind == "[":
            run.append(html.escape(tag))
        elif kind == "/":
            depth = opened.last((tag,))
            if depth:
                if tag in BLOCKS or any(t in BLOCKS or dropped for t, _, dropped in opened.stack[depth:]):
                    flush()
                opened.cut(depth)
        elif kind != "tag":
            continue
        elif tag == "br":
            run.append("\n")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(page, at)
            close_at = page.find(">", found.end()) if found else -1
            at = close_at + 1 if close_at >= 0 else len(page)
            run.append(" ")
        else:
            sign, dropped, marked = _described(tag, attributes)
            if tag in CLOSES_P and opened.blocks and opened.stack[opened.blocks[-1]][0] == "p":
                close(opened.blocks[-1])
            if tag in CLOSES:
                ends, holders = CLOSES[tag]
                depth = opened.last(ends)
                if depth > opened.last(holders):
                    close(depth)
            _, node, around = opened.stack[-1]
            if tag in BLOCKS or dropped:
                flush()
                if node.depth >= DEPTH:
                    opened.push(tag, node, max(dropped, around))
                    continue
                if tag in CONTENT and not dropped and not marked and 0 < around < HIDDEN:
                    child = Node(tag, sign, 0, not (tag == "main" and around == MARKED), node.depth + 1)
                else:
                    child = Node(tag, sign, max(dropped, around), depth=node.depth + 1)
                node.children.append(child)
                opened.push(tag, child, child.dropped)
            else:
                opened.push(tag, node, around)
    flush()
    return root


@functools.lru_cache(maxsize=65_536)
def _below(path: str, sign: str) -> str:
    """The path of a child, of one length however deep it is."""
    return hashlib.blake2b(f"{path}/{sign}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def placed(root: Node) -> list[tuple[str, str]]:
    """Path (hashed) and text of the blocks of what is not marked, within ``article`` or ``main`` where the page has such with text."""

    def walk(node: Node, path: str) -> Iterator[tuple[str, str]]:
        for child in node.children:
            if isinstance(child, str):
                if not node.dropped:
                    yield path, child
            elif not child.rescued:
                yield from walk(child, _below(path, child.sign))

    def whole(node: Node, path: str) -> Iterator[tuple[str, str]]:
        for child in node.children:
            if not isinstance(child, str):
                yield from whole(child, _below(path, child.sign))
            elif not node.dropped:
                yield path, child

    def content(node: Node, path: str) -> Iterator[tuple[Node, str]]:
        for child in node.children:
            if not isinstance(child, str):
                if child.tag in CONTENT and not child.dropped and not child.rescued:
                    yield child, _below(path, child.sign)
                else:
                    yield from content(child, _below(path, child.sign))

    inside = [slot for node, path in content(root, "") for slot in walk(node, path)]
    return inside or list(whole(root, ""))


def slots(root: Node) -> list[str]:
    """Texts of :func:`placed`."""
    return [text for _, text in placed(root)]


def slot_key(path: str, text: str) -> int:
    raw = f"{path}\0{text}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def page_keys(page: str | None) -> list[int]:
    """What a page votes for."""
    return sorted({slot_key(*slot) for slot in placed(parse(page or ""))})


def prune(node: Node) -> None:
    """Takes marked elements out of the tree, but for what they hold of unmarked content."""
    kept: list[Node | str] = []
    for child in node.children:
        if isinstance(child, str):
            if not node.dropped:
                kept.append(child)
        else:
            prune(child)
            if child.children or not child.dropped:
                kept.append(child)
    node.children = kept


def measure(root: Node) -> list[str]:
    """All texts of a tree in order; every node learns which are its own, and the hash and weight of its subtree."""
    texts: list[str] = []

    def visit(node: Node) -> None:
        node.first, node.weight = len(texts), 1
        whole = hashlib.blake2b(node.sign.encode("utf-8", "surrogatepass"), digest_size=16)
        for child in node.children:
            if isinstance(child, str):
                texts.append(child)
                node.weight += 3
                whole.update(b"t" + hashlib.blake2b(child.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            else:
                visit(child)
                node.weight += child.weight
                whole.update(b"n" + child.whole)
        node.last, node.whole = len(texts), whole.digest()

    visit(root)
    return texts


def _same(x: Node | str, y: Node | str) -> bool:
    if isinstance(x, str) or isinstance(y, str):
        return x == y
    return x.whole == y.whole


def _content(child: Node | str) -> str | bytes:
    return child if isinstance(child, str) else child.whole


def _sign(child: Node | str) -> str:
    return "#text" if isinstance(child, str) else child.sign


class Matching:
    """Simple tree matching of two trees; equal texts weigh 3, other text pairs and nodes 1.

    Trees, and stretches of children, without a common text hold no constant
    slot; they are not searched for one and weigh what their sizes allow.
    """

    def __init__(self, a: Node, b: Node):
        self.texts = measure(a), measure(b)
        self.roots = a, b
        self.found: dict[tuple[bytes, bytes], tuple[int, list[tuple[int, int]]]] = {}

    def pairs(self) -> Iterator[tuple[Node, int, Node, int]]:
        """The matched text blocks: node and place among its children, of both trees."""
        todo = [self.roots]
        while todo:
            a, b = todo.pop()
            for i, j in self.align(a, b)[1]:
                if isinstance(a.children[i], str):
                    yield a, i, b, j
                else:
                    todo.append((a.children[i], b.children[j]))

    def _apart(self, a: list[Node | str], b: list[Node | str]) -> bool:
        """Whether two stretches of children have no text in common."""

        def held(children: list[Node | str], texts: list[str]) -> set[str]:
            own: set[str] = set()
            for child in children:
                if isinstance(child, str):
                    own.add(child)
                else:
                    own.update(texts[child.first : child.last])
            return own

        return held(a, self.texts[0]).isdisjoint(held(b, self.texts[1]))

    def align(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        """Weight and pairs of the best ordered matching of two nodes' children."""
        key = a.whole, b.whole
        known = self.found.get(key)
        if known is None:
            known = self._aligned(a, b)
            if len(self.found) >= CELLS:
                self.found.clear()
            self.found[key] = known
        return known

    def _aligned(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        m, n = len(a.children), len(b.children)
        if a.whole == b.whole:
            return a.weight, [(i, i) for i in range(m)]
        head = 0
        while head < min(m, n) and _same(a.children[head], b.children[head]):
            head += 1
        tail = 0
        while tail < min(m, n) - head and _same(a.children[m - 1 - tail], b.children[n - 1 - tail]):
            tail += 1
        ends = [(i, i) for i in range(head)], [(m - tail + i, n - tail + i) for i in range(tail)]
        same = sum(3 if isinstance(a.children[i], str) else a.children[i].weight for i, _ in (*ends[0], *ends[1]))
        mine, other = a.children[head : m - tail], b.children[head : n - tail]
        if self._apart(mine, other):
            return 1 + same + min(len(mine), len(other)), [*ends[0], *ends[1]]
        weight, chosen = self._between(mine, other)
        return 1 + same + weight, [*ends[0], *((head + i, head + j) for i, j in chosen), *ends[1]]

    def _between(self, a: list[Node | str], b: list[Node | str]) -> tuple[int, list[tuple[int, int]]]:
        """The matching of the largest weight; of its table, only some rows and those around the way back are held."""
        m, n = len(a), len(b)
        #: Equal children weigh the same, so each distinct pair is weighed once.
        kinds: dict[str | bytes, int] = {}
        of_b = np.array([kinds.setdefault(_content(y), len(kinds)) for y in b])
        distinct = list({_content(y): y for y in b}.values())
        weighed: dict[str | bytes, np.ndarray] = {}

        def against(x: Node | str) -> np.ndarray:
            """Weight of a child with each child of ``b``, 0 if they do not match."""
            found = weighed.get(_content(x))
            if found is None:
                if len(weighed) * len(distinct) >= CELLS:
                    weighed.clear()
                found = weighed[_content(x)] = np.array([self._weight(x, y) for y in distinct])
            return found[of_b]

        def next_row(i: int, above: np.ndarray) -> np.ndarray:
            own, row = against(a[i - 1]), above.copy()
            np.maximum(row[1:], np.where(own > 0, above[:-1] + own, 0), out=row[1:])
            return np.maximum.accumulate(row)

        step = max(CELLS // (n + 1), math.isqrt(m), 1)
        kept: list[np.ndarray] = []
        rows = [np.zeros(n + 1, dtype=np.int64)]
        for i in range(1, m + 1):
            if len(rows) == step + 1:
                kept.append(rows[0])
                rows = rows[-1:]
            rows.append(next_row(i, rows[-1]))
        weight, chosen, i, j, start = int(rows[-1][n]), [], m, n, len(kept) * step
        while i and j:
            if i == start:
                start -= step
                rows = [kept.pop()]
                for k in range(start + 1, i + 1):
                    rows.append(next_row(k, rows[-1]))
            row, above = rows[i - start], rows[i - start - 1]
            own = self._weight(a[i - 1], b[j - 1])
            if own and row[j] == above[j - 1] + own:
                chosen.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif row[j] == above[j]:
                i -= 1
            else:
                j -= 1
        return weight, chosen[::-1]

    def _weight(self, x: Node | str, y: Node | str) -> int:
        if _sign(x) != _sign(y):
            return 0
        if isinstance(x, str):
            return 3 if x == y else 1
        return self.align(x, y)[0]


def moved_keys(trees: list[Node]) -> set[int]:
    """Keys that several trees (without marked elements) hold and that no alignment of neighbours matches."""
    held: Counter[int] = Counter()
    matched: set[int] = set()
    numbered: list[dict[tuple[int, int], int]] = []
    for tree in trees:
        ids: dict[tuple[int, int], int] = {}

        def number(node: Node, path: str, ids: dict[tuple[int, int], int] = ids) -> None:
            for k, child in enumerate(node.children):
                if isinstance(child, str):
                    ids[id(node), k] = slot_key(path, child)
                else:
                    number(child, _below(path, child.sign))

        number(tree, "")
        numbered.append(ids)
        held.update(set(ids.values()))
    # every pair of neighbours once, in a ring
    ring = [(k, (k + 1) % len(trees)) for k in range(len(trees))]
    for k, other in {frozenset(pair): pair for pair in reversed(ring) if len(set(pair)) > 1}.values():
        for a, i, b, j in Matching(trees[k], trees[other]).pairs():
            key = numbered[k][id(a), i]
            if key == numbered[other][id(b), j]:
                matched.add(key)
    # a slot no two neighbours share was not put to the test
    tested = {k for n, ids in enumerate(numbered) for k in set(ids.values()) & set(numbered[(n + 1) % len(trees)].values())}
    return {key for key in tested if held[key] > 1 and key not in matched}


def template_keys(pages: list[list[int]]) -> set[int]:
    """The template of one host by the keys of its pages; :func:`host_templates` does the same in Spark."""

    def constant(votes: list[tuple[int, ...]]) -> set[int]:
        if len(votes) < LEAST_VOTERS:
            return set()
        counts = Counter(key for vote in votes for key in vote)
        return {key for key, n in counts.items() if n >= CONSTANT_SHARE * len(votes)}

    votes = list({tuple(keys) for keys in pages if keys})
    first = constant(votes)
    kept: dict[tuple[int, ...], tuple[int, ...]] = {}
    for vote in votes:
        varying = tuple(key for key in vote if key not in first)
        if varying:
            kept[varying] = max(vote, kept.get(varying, ()))
    return constant(list(kept.values()))


def without_template(pages: list[str | None], template: set[int]) -> list[str]:
    """Main texts of a group of pages, given the template of their host."""
    trees = [parse(page or "") for page in pages]
    contents = [[(slot_key(*slot), slot[1]) for slot in placed(tree)] for tree in trees]
    if template:
        distinct = list({tuple(key for key, _ in c): tree for tree, c in zip(trees, contents, strict=True) if c}.values())
        for tree in distinct:
            prune(tree)
        template = template - moved_keys(distinct)
    return ["\n".join(text for key, text in content if key not in template) for content in contents]


def extract_group(pages: list[str | None]) -> list[str]:
    """Main texts of all pages of one host."""
    return without_template(pages, template_keys([page_keys(page) for page in pages]))


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def host_templates(rows: DataFrame) -> DataFrame:
    """``host, keys``: the template slots of each host of ``host, html``, by votes of its distinct pages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [page_keys(None if pd.isna(x) else x) for x in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "keys": keys})

    def constant(votes: DataFrame, name: str) -> DataFrame:
        sizes = votes.groupBy("host").agg(F.count("*").alias("voters")).where(F.col("voters") >= LEAST_VOTERS)
        counts = votes.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
        # the least count any template slot has, before hosts are looked up
        often = counts.where(F.col("n") >= CONSTANT_SHARE * LEAST_VOTERS).join(sizes, "host").where(F.col("n") >= CONSTANT_SHARE * F.col("voters"))
        return materialize(often.groupBy("host").agg(F.collect_list("key").alias("keys")), name)

    read_pages = rows.select("host", "html").mapInPandas(read, "host string, keys array<long>")
    votes = materialize(read_pages.where(F.size("keys") > 0).distinct(), "page-votes")
    first = constant(votes, "page-constant").withColumnRenamed("keys", "first")
    varying = F.array_except("keys", F.coalesce("first", F.array().cast("array<long>")))
    kept = votes.join(first, "host", "left").withColumn("varying", varying).where(F.size("varying") > 0)
    one = kept.groupBy("host", F.xxhash64("varying").alias("copy")).agg(F.max("keys").alias("keys"))
    return constant(materialize(one, "page-voters"), "page-template")


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``."""
    text_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    sizes = materialize(rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).cast("int").alias("groups")), "page-hosts")
    dealt = rows.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")).cast("int"))
    # each group gets the template of its host
    parts = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    templates = host_templates(rows).join(sizes, "host").select("host", parts.alias("part"), "keys")

    def extract(part: pd.DataFrame, template: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("page_id")
        held = {int(key) for keys in template["keys"] for key in keys}
        texts = without_template([None if pd.isna(x) else x for x in part["html"]], held)
        return pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts, "n_chars": list(map(len, texts))})

    return (
        dealt.groupBy("host", "part")
        .cogroup(templates.groupBy("host", "part"))
        .applyInPandas(extract, "page_id long, url string, text string, n_chars long")
    )


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))
