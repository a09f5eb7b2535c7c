"""Main text of web pages by wrapper induction.

A page is parsed leniently into a tree. Its skeleton is the tree of block elements, with
class and id names as part of a label and runs of equal leaves as one slot. The skeletons
of a host's pages are aligned with the nearest of its frequent ones by simple tree matching;
slots are then comparable over pages. A slot that holds the same text on most of the
different pages of one layout is template, a slot that varies is content. All pages count; only label
trees and hashes are shuffled, and the hosts' templates are broadcast behind a size check.

Copies of a page (of its longest blocks, that is) count once for a template, so copies of an
article make none.

Where a layout has a template, it decides: what varies is content. The markup breaks ties:
what it names as menu, header, footer, sidebar, notice, advert, form, script, style or
comments is left out (blocks by any word of a class or id, inside a main part by whole names
only), and the article or main part bounds the content as long as it holds half of what
varies. Template slots inside an article are cut by a second sign only (a name, or a place at
its rim that is no heading), and not if they'd take more than half of it. Pages of hosts or layouts with fewer than ``LEAST_PAGES`` different pages have no
template: there the markup's main parts are read, a main part with all its articles, else all
parts named as content, else all. An article that is itself classed as a comment or teaser
isn't meant, nor one in a part that is left out, unless the page has no other. Elements may
nest to any depth.

Null and empty html gives an empty text, an empty table no rows. Pages of any length are read
whole, in linear time but for alignments. Urls without a host share one host. Repeated rows
count once for a host's template. Further columns are ignored. White space inside a block
becomes one space, character references are decoded, blocks are joined by an empty line.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.llm.bpe import texts_of
from momentlake.llm.url_filter import host_and_path
from momentlake.plans.lineage import cut

#: A slot is template if this share of at least so many different pages holds one text.
CONSTANT, LEAST_PAGES = 0.8, 8
#: Pages are copies if the longest blocks, up to this share of the text, are equal.
BODY = 0.75
#: Skeletons of this share of a host's pages are references; pages that match less than this share of one don't count for it.
FREQUENT, ALIKE = 0.1, 0.5
#: Pairs of children up to which alignment goes without arrays.
FEW = 64
#: Block elements nested deeper have no slot of their own in a skeleton.
LEVELS = 100
#: Characters of templates that are broadcast; beyond it pages are joined with them by host and a salt.
MOST_BROADCAST, SALTS = 32 << 20, 16

# Names of HTML elements and roles, and customary class names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - set("body caption dd dt head html legend li optgroup option summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = set("ul ol menu dl table select body html article section div main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CHROME_TAGS = set("head nav footer aside form script style textarea title xmp iframe noembed noframes noscript template object svg canvas select button dialog menu math audio video map".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status tooltip".split())
CHROME_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements adbox adsense banner banners sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer header masthead toolbar share sharing social related recommended comment comments commentlist reply replies disqus respond pagination pager skip login search form forms".split()
)
# Classes and ids of articles that are not the page's own.
SIDE_NAMES = set("comment comments commentlist reply replies disqus related recommended promo promos sponsor sponsored advert advertisement teaser".split())
# Words that an article may use of its own: inside a main part they count only where there are controls of a form.
OWN_NAMES = set("alert alerts banner banners form forms login menu menus modal overlay popup respond search skip widget widgets".split())
CONTROLS = set("form input select textarea button".split())
# Inside a main part; what is classed as header there holds the title.
INNER_NAMES = (CHROME_NAMES | SIDE_NAMES) - OWN_NAMES - {"header"}
MAIN_NAMES = set("article post entry content main story".split())

_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_NAME = re.compile(r"[a-z0-9]+")
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""[^"'>]*""")


class Node:
    """An element; ``parts`` are its texts and elements in order, ``kids`` its next block elements."""

    __slots__ = ("chrome", "controls", "holds", "inner", "kids", "label", "main", "maybe", "parts", "slot", "tag", "up")

    def __init__(self, tag: str, label: str, chrome: bool, inner: bool, maybe: bool, main: int, up: Node | None):
        self.tag, self.label, self.chrome, self.inner, self.maybe, self.main, self.up = tag, label, chrome, inner, maybe, main, up
        self.parts: list[str | Node] = []
        self.kids: list[Node] = []
        self.slot, self.holds, self.controls = -1, False, False


@lru_cache(maxsize=4096)
def _facts(tag: str, attributes: str) -> tuple[str, bool, bool, bool, int]:
    """Label, whether the markup names it as no content, the same inside a main part, the same if it has controls, and how surely it is the main part.

    Names count for blocks only, never for parts of a line. Inside a main part only whole
    names count, since headings and sections have slugs of their titles as ids; a heading is
    never cut by name, a section by an id of SIDE_NAMES only.
    """
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip("/ ") else {}
    named = [given.get("id", ""), *given.get("class", "").split()]
    names = {x for n in named for x in _NAME.findall(n.lower())} if any(named) else set()
    label = ".".join([tag, *sorted(filter(None, given.get("class", "").split())), *([f"#{given['id']}"] if given.get("id") else [])])
    role = given.get("role", "").lower()
    main = 4 if tag == "article" else 3 if tag == "main" or role == "main" else 2 if given.get("itemprop") == "articleBody" else 0
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    if any(n.lower() in SIDE_NAMES for n in named):
        main = 0
    sure = role in CHROME_ROLES or hidden
    by_name = not main and tag in BLOCKS and tag not in ("html", "body", "header")
    chrome = tag in CHROME_TAGS or sure or (by_name and bool(names & CHROME_NAMES))
    own_id, classes = given.get("id", "").lower(), set(given.get("class", "").lower().split())
    named_so = bool(classes & INNER_NAMES) or own_id in (SIDE_NAMES if tag == "section" else INNER_NAMES)
    inner = tag in CHROME_TAGS - {"math"} or sure or (by_name and tag not in HEADINGS and named_so)
    maybe = by_name and tag not in HEADINGS and bool((classes | {own_id}) & OWN_NAMES)
    if not main and not chrome and names & MAIN_NAMES and tag in ("div", "section", "td"):
        main = 1
    return re.sub(r"[(),\s]", "_", label), chrome, inner, maybe, main


def _tags(text: str) -> Iterator[tuple[str, str, str, int]]:
    """Text before a tag, "/" or "", name and attributes of it, and where it ends; forward only.

    A ``>`` in quotes doesn't end a tag, unless a quote stays open: from there on all do.
    The caller may send back a place to go on at.
    """
    at = begin = 0
    last, quotes = text.rfind(">"), True
    while (at := text.find("<", at)) >= 0 and (at < last or text.startswith("<!--", at)):
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            yield text[begin:at], "", "", -1
            at = begin = end + 3 if end >= 0 else len(text)
            continue
        if text[at + 1] in "!?":
            end = text.find(">", at)
            yield text[begin:at], "", "", -1
            at = begin = end + 1
            continue
        m = _TAG_NAME.match(text, at + 1)
        if not m:
            at += 1
            continue
        end = m.end()
        while quotes:
            end = _PLAIN.match(text, end).end()
            if end >= len(text) or text[end] == ">":
                break
            end = text.find(text[end], end + 1) + 1 or len(text)
        if not quotes or end >= len(text):
            quotes, end = False, text.find(">", m.end())
        yield text[begin:at], m[1], (m[2].lower(), text[m.end() : end]), end + 1
        at = begin = end + 1
        if m[2].lower() in RAW and not m[1]:
            close = re.compile(rf"</{re.escape(m[2])}(?=[\s/>]|\Z)[^>]*>?", re.I).search(text, at)
            at = begin = close.end() if close else len(text)
    yield text[begin:], "", "", -1


def parse(text: str | None) -> Node:
    """The page's tree. Of any depth, in time linear in the page but for the closing of paragraphs."""
    root = Node("", "", False, False, False, 0, None)
    stack, nodes, blocks = [root], [root], [root]
    places: dict[str, list[int]] = {}  # where elements of a name are open

    def end(k: int) -> None:
        for x in reversed(stack[k:]):
            places[x.tag].pop()
            if blocks[-1] is x:
                blocks.pop()
        del stack[k:]

    def close(tags: set[str], scopes: set[str]) -> None:
        """End the outermost open element of ``tags`` above the next of ``scopes``."""
        above = max((places[x][-1] for x in scopes if places.get(x)), default=0)
        first = [p[k] for x in tags if (p := places.get(x)) and (k := bisect_right(p, above)) < len(p)]
        if first:
            end(min(first))

    for before, slash, found, _ in _tags(text or ""):
        if before:
            stack[-1].parts.append(before)
        if not found:
            continue
        tag, attributes = found
        if slash:
            open_at = places.get(tag)
            if open_at and (tag in BLOCKS or open_at[-1] > (places[blocks[-1].tag][-1] if len(blocks) > 1 else 0)):
                end(open_at[-1])
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPES | {"td", "th", "li", "button"})
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPES - {tag})
        node = Node(tag, *_facts(tag, attributes), stack[-1])
        nodes.append(node)
        stack[-1].parts.append(node)
        if tag in CONTROLS:
            x: Node | None = node
            while x is not None and not x.controls:
                x.controls, x = True, x.up
        if tag in BLOCKS:
            blocks[-1].kids.append(node)
        if tag not in VOID and tag not in RAW:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            if tag in BLOCKS:
                blocks.append(node)
    if not _mark(nodes, False):
        _mark(nodes, True)
    return root


def _mark(nodes: list[Node], anywhere: bool) -> bool:
    """Note which elements hold a main part; one within what is left out counts if ``anywhere``."""
    for x in reversed(nodes):
        x.holds = x.holds and (anywhere or not x.chrome)
        if x.up is not None and (x.holds or (x.main >= 3 and not x.chrome)):
            x.up.holds = True
    return nodes[0].holds


def skeleton(root: Node) -> str:
    """The label tree of the block elements in brackets; numbers the nodes' slots in preorder.

    Blocks more than ``LEVELS`` deep have no slot of their own, their texts belong to the one above.
    """
    count = 0

    def write(node: Node, level: int) -> str:
        nonlocal count
        node.slot, count = count, count + 1
        out, last = [], None
        for x in node.kids if level < LEVELS else ():
            if not x.kids and last is not None and last.label == x.label:
                x.slot = last.slot
                continue
            out.append(write(x, level + 1))
            last = None if x.kids else x
        return node.label + (f"({','.join(out)})" if out else "")

    return write(root, 0)


def _tree(signature: str, known: dict | None = None) -> tuple:
    """(label, children, slot, kind, size) of a signature; equal subtrees are of one kind."""
    slot, stack = 0, [("", [], -1)]
    known = {} if known is None else known

    def done(x: tuple) -> tuple:
        children = [c if len(c) > 3 else done(c) for c in x[1]]
        kind = known.setdefault((x[0], tuple(c[3] for c in children)), len(known))
        return x[0], children, x[2], kind, 1 + sum(c[4] for c in children)

    for m in re.finditer(r"([^(),]*)([(),]|\Z)", signature):
        label, mark = m[1], m[2]
        if label or mark == "(" or (mark in (",", "") and signature[m.start() - 1 : m.start()] != ")"):
            stack[-1][1].append((label, [], slot))
            slot += 1
        if mark == "(":
            stack.append(stack[-1][1][-1])
        elif mark == ")":
            whole = done(stack.pop())
            stack[-1][1][-1] = whole
        if not mark:
            break
    return done(stack[0])[1][0]


@lru_cache(maxsize=512)
def align(signature: str, reference: str) -> dict[int, int]:
    """Slots of a page matched with slots of the reference by simple tree matching.

    The weight of two nodes of one label is 1 and the best total of their children in
    order. Equal subtrees are matched whole; pairs of kinds of subtrees are compared once.
    """
    if signature == reference:
        return {k: k for k in range(len(re.split(r"[(),]", signature)))}
    kinds: dict = {}
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    left, right = _tree(signature, kinds), _tree(reference, kinds)

    def ordered(xs: list, ys: list) -> tuple[int, list[tuple[int, int]]]:
        """The best total of children in order, and the places of those that go together."""
        if len(xs) * len(ys) <= FEW:
            table = [[(0, None)] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for i, x in enumerate(xs):
                for j, y in enumerate(ys):
                    weight = match(x, y)
                    one = (table[i][j][0] + weight, (i, j, table[i][j][1])) if weight else (0, None)
                    table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], one, key=lambda t: t[0])
            weight, chain = table[-1][-1]
            found = []
            while chain:
                found.append(chain[:2])
                chain = chain[2]
            return weight, found
        own = {y[3]: y for y in ys}
        place = {k: n for n, k in enumerate(own)}
        at = np.array([place[y[3]] for y in ys])
        weights = {x[3]: np.array([match(x, y) for y in own.values()], np.int64)[at] for x in {x[3]: x for x in xs}.values()}
        best, ups, lefts = np.zeros(len(ys) + 1, np.int64), [], []
        for x in xs:
            now = best.copy()
            np.maximum(now[1:], best[:-1] + weights[x[3]], out=now[1:])
            now = np.maximum.accumulate(now)
            ups.append(np.packbits(now == best))
            lefts.append(np.packbits(now[1:] == now[:-1]))
            best = now
        bit = lambda row, k: row[k >> 3] >> (7 - (k & 7)) & 1
        i, j, found = len(xs), len(ys), []
        while i and j:
            if bit(ups[i - 1], j):
                i -= 1
            elif bit(lefts[i - 1], j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return int(best[-1]), found

    def match(a, b) -> int:
        """Nodes matched; which children go together is kept in ``known``."""
        if a[0] != b[0]:
            return 0
        if a[3] == b[3]:
            return a[4]
        if (a[3], b[3]) in known:
            return known[a[3], b[3]][0]
        xs, ys = a[1], b[1]
        head = 0
        while head < min(len(xs), len(ys)) and xs[head][3] == ys[head][3]:
            head += 1
        tail = 0
        while tail < min(len(xs), len(ys)) - head and xs[-1 - tail][3] == ys[-1 - tail][3]:
            tail += 1
        total = 1 + sum(x[4] for x in xs[:head]) + sum(x[4] for x in xs[len(xs) - tail :])
        pairs = [(k, k) for k in range(head)] + [(len(xs) - 1 - k, len(ys) - 1 - k) for k in range(tail)]
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if xs and ys and (len(xs) == 1 or len(ys) == 1):
            weight, i, j = max((match(x, y), -i, -j) for i, x in enumerate(xs) for j, y in enumerate(ys))
            total, pairs = total + weight, [*pairs, (head - i, head - j)] if weight else pairs
        elif xs and ys:
            weight, found = ordered(xs, ys)
            total, pairs = total + weight, pairs + [(head + i, head + j) for i, j in found]
        known[a[3], b[3]] = total, pairs
        return total

    to: dict[int, int] = {}
    todo = [(left, right)] if match(left, right) else []
    while todo:
        a, b = todo.pop()
        to[a[2]] = b[2]
        pairs = [(k, k) for k in range(len(a[1]))] if a[3] == b[3] else known[a[3], b[3]][1]
        todo += [(a[1][i], b[1][j]) for i, j in pairs]
    return to


def nearest(signature: str, references: tuple[str, ...]) -> tuple[int, dict[int, int], float]:
    """Which reference aligns best, the slots matched with it, and the share of both trees matched."""
    size = lambda t: len(re.findall(r"[^(),]+", t)) + 1
    best = (0, {}, -1.0)
    for k, r in enumerate(references):
        to = align(signature, r)
        near = 1.0 if signature == r else min(1.0, 2 * len(to) / (size(signature) + size(r)))
        if near > best[2]:
            best = k, to, near
    return best


def _clean(pieces: list[str]) -> str:
    s = "".join(pieces)
    return " ".join((entities.unescape(s) if "&" in s else s).split())


class Block(NamedTuple):
    """A block's text, its slot, whether the markup names it as no content, and the rank of the main part that it is in.

    ``hint``: a word of a class or id around it says that it may be no content; ``head``: it is a heading.
    """

    slot: int
    text: str
    cut: bool
    rank: int
    hint: bool = False
    head: bool = False


def read(text: str | None) -> tuple[str, list[Block]]:
    """The page's skeleton and all its blocks in order."""
    root = parse(text)
    signature = skeleton(root)
    out: list[Block] = []
    held: list[str] = []

    def flush(x: Node, slot: int, cut: bool, rank: int, hint: bool) -> None:
        if held:
            if t := _clean(held):
                out.append(Block(slot, t, cut, rank, hint, x.tag in HEADINGS))
            held.clear()

    # node, next part, slot, left out, rank of the main part around, headings only, hint, block around
    stack: list[list] = [[root, 0, root.slot, False, 0, False, False, root]]
    while stack:
        top = stack[-1]
        x, k, slot, cut, rank, heads, hint, around = top
        if k == len(x.parts):
            stack.pop()
            if x.tag in BLOCKS or x is root:
                flush(x, slot, cut, rank, hint)
            continue
        top[1] = k + 1
        p = x.parts[k]
        if isinstance(p, str):
            if not heads or x.tag in HEADINGS:
                held.append(p)
            continue
        if p.tag in VOID:
            if p.tag == "br":
                held.append(" ")
            elif p.tag == "hr":
                flush(around, slot, cut, rank, hint)
            continue
        if p.tag in RAW:
            continue
        block = p.tag in BLOCKS
        gone = not p.holds and (p.inner or (p.maybe and p.controls) if rank else p.chrome or p.tag == "header")
        if gone and not block:
            continue
        if block:
            flush(around, slot, cut, rank, hint)
        only = (heads and p.tag not in HEADINGS) or (p.tag == "header" and rank > 0 and not p.holds)
        stack.append([p, 0, p.slot if p.slot >= 0 else slot, cut or gone, rank if cut or gone else max(rank, p.main), only, block and (hint or (p.chrome and not p.holds)) or hint, p if block else around])
    return signature, out


def chosen(blocks: list[Block], template: frozenset[int] | None = None) -> list[str]:
    """The texts of the page's content.

    The markup's own main parts (articles and mains, else parts marked as an article's body,
    else parts named as content, else all) are read where there is no template. With a
    template, what varies over the pages of the layout is content: if the main parts hold
    less than half of the varying text, all of it is read. In main parts a template slot is
    cut by a second sign only: a name around it that says so, or its place before or behind
    all that varies there, unless it is a heading; so headings and lines that articles of a
    host share stay. Nor is it cut where that would take more than half of a page. Where no
    part is marked, all but the template is read, unless that's nothing.
    """
    kept = [b for b in blocks if not b.cut]
    best = max((min(b.rank, 3) for b in kept), default=0)
    mains = [b for b in kept if min(b.rank, 3) == best]
    if not template:
        return [b.text for b in mains]
    size = lambda found: sum(len(b.text) for b in found)
    varying = [b for b in kept if b.slot not in template]
    own = [b for b in mains if b.slot not in template]
    if best and own:
        at = [k for k, b in enumerate(mains) if b.slot not in template]
        own = [b for k, b in enumerate(mains) if b.slot not in template or not (b.hint or (not b.head and not at[0] <= k <= at[-1]))]
    if 2 * size(own) < size(varying) and 2 * size(mains) < size(varying):
        return [b.text for b in varying]
    enough = 2 * size(own) >= size(mains) if best else bool(own)
    return [b.text for b in (own if enough else mains)]


def main_text(text: str | None, template: frozenset[int] = frozenset()) -> str:
    """The page's main text; ``template`` has the slots that the pages of its layout share."""
    return "\n\n".join(chosen(read(text)[1], template))


def _slots(text: str | None) -> tuple[str, list[tuple[int, int]], int]:
    """Signature, hash of the text of each slot, and hash of the page's body.

    The body are the longest blocks that hold ``BODY`` of the text that the markup doesn't
    leave out, so copies with another menu or date are one page.
    """
    signature, blocks = read(text)
    texts: dict[int, list[str]] = {}
    for b in blocks:
        texts.setdefault(b.slot, []).append(b.text)
    hashed = sorted((k, xxhash.xxh64_intdigest("\n".join(v).encode("utf-8", "replace"), 42) - (1 << 63)) for k, v in texts.items())
    longest = sorted((b.text for b in blocks if not b.cut), key=lambda t: (-len(t), t))
    total, whole, body = 0, sum(map(len, longest)), []
    for t in longest:
        if total >= BODY * whole:
            break
        total += len(t)
        body.append(t)
    content = "\n\n".join(body)
    return signature, hashed, xxhash.xxh64_intdigest(content.encode("utf-8", "replace"), 42) - (1 << 63)


def templates(pages: DataFrame) -> DataFrame:
    """``host, layouts``: each host's frequent skeletons, with the template slots of the pages nearest to each."""
    part = pages.select("host", "html")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_slots(t) for t in texts_of(b.column(1))]
            listed = pa.array([[{"slot": s, "h": h} for s, h in x[1]] for x in got], pa.list_(pa.struct([("slot", pa.int32()), ("h", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), listed, pa.array([x[2] for x in got], pa.int64())], names=["host", "signature", "slots", "page"])

    seen = part.mapInArrow(slots, "host string, signature string, slots array<struct<slot: int, h: bigint>>, page long")
    one = seen.groupBy("host", "page").agg(F.min(F.struct("signature", "slots")).alias("one"))
    different = cut(one.select("host", "page", "one.signature", "one.slots"))
    counts = different.groupBy("host", "signature").count()
    totals = counts.groupBy("host").agg(F.sum("count").alias("pages"), F.max(F.struct("count", "signature"))["signature"].alias("first"))
    frequent = (F.col("count") >= LEAST_PAGES) & (F.col("count") >= F.col("pages") * FREQUENT)
    listed = counts.join(totals, "host").where((F.col("pages") >= LEAST_PAGES) & (frequent | (F.col("signature") == F.col("first"))))
    references = cut(listed.groupBy("host").agg(F.sort_array(F.collect_list("signature")).alias("references")))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ref, node, h = [], [], [], []
            for n, (signature, listed, refs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("signature", "slots", "references")), strict=True)):
                k, to, near = nearest(signature, tuple(refs))
                found = [(to[s["slot"]], s["h"]) for s in listed if s["slot"] in to] if near >= ALIKE else []
                for slot, x in [(-1, 0), *found] if near >= ALIKE else []:  # -1 counts the page
                    row.append(n)
                    ref.append(refs[k])
                    node.append(slot)
                    h.append(x)
            yield pa.RecordBatch.from_arrays([b.column("host").take(pa.array(row, pa.int64())), pa.array(ref, pa.string()), pa.array(node, pa.int32()), pa.array(h, pa.int64())], names=["host", "reference", "node", "h"])

    matched = different.join(references, "host").select("host", "signature", "slots", "references").mapInArrow(aligned, "host string, reference string, node int, h long")
    held = cut(matched.groupBy("host", "reference", "node", "h").count())
    pages = held.where("node = -1").select("host", "reference", F.col("count").alias("pages"))
    most = held.where("node >= 0").groupBy("host", "reference", "node").agg(F.max("count").alias("most")).join(pages, ["host", "reference"])
    constant = most.where(F.col("most") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * CONSTANT))
    slots_of = constant.groupBy("host", "reference").agg(F.sort_array(F.collect_list("node")).alias("slots"))
    every = references.select("host", F.explode("references").alias("reference")).join(slots_of, ["host", "reference"], "left")
    return every.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("reference", F.coalesce("slots", F.array().cast("array<int>")).alias("slots")))).alias("layouts"))


def extract(pages: DataFrame, carry: list[Column], url: str = "url", html: str = "html") -> DataFrame:
    """The ``carry`` columns and the main text of every row."""
    rows = pages.select(F.struct(*carry).alias("carry"), host_and_path(F.col(url))[0].alias("host"), F.col(html).alias("html"))
    rows = rows.withColumn("host", F.coalesce("host", F.lit("")))
    known = cut(templates(rows))
    if (known.agg(F.sum(F.length(F.to_json("layouts")))).first()[0] or 0) <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("carry", "html", "layouts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, layouts in zip(texts_of(b.column("html")), b.column("layouts").to_pylist(), strict=True):
                signature, blocks = read(text)
                shared: frozenset[int] | None = None
                if layouts:
                    k, to, near = nearest(signature, tuple(x["reference"] for x in layouts))
                    common = set(layouts[k]["slots"])
                    shared = frozenset(s for s, v in to.items() if v in common) if near >= ALIKE else None
                out.append("\n\n".join(chosen(blocks, shared)))
            yield pa.RecordBatch.from_arrays([b.column("carry"), pa.array(out, pa.string())], names=["carry", "text"])

    return joined.mapInArrow(run, joined.select("carry").schema.add("text", "string")).select("carry.*", "text")


def extracted_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    return extract(pages, [F.col("page_id"), F.col("url")]).withColumn("n_chars", F.length("text").cast("long"))
