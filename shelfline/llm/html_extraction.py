"""Main text of web pages by wrapper induction.

Pages of one host are made from one template.  Pages of a host are grouped by layout, a hash of the set of paths of their
sections, and each layout of a host has a wrapper of its own, learned from all its pages: the way to its main region and the
slots, paths whose text is the same on nearly all pages.  A region is a path (tags with their classes and roles).

What is learned from is a page's skeleton: its shown block elements with digests of their texts, one row for pages of equal text.
The way is found from the root down: for each region and each child of it Spark counts the texts that pages hold in the region outside the
child, and a child is entered while ``CONSTANT`` of the layout's pages hold one and the same there, or all hold none.  Marked parts (navigation,
header, footer, aside, form, advert, notice, comments) are no text.  A page with another text beside the way is read from there.

Skeletons of a layout are then dealt to groups of about ``GROUP`` by the digest of their main text, and each page is aligned with the next of its group
by simple tree matching (the largest common top-down match of two ordered trees; what lists of children do not share at their ends is
aligned in a band of ``BAND`` places).  Aligned nodes whose path names one child vote for their text, those that neither neighbour has on their own, and the votes of all groups are
added up: a path is a slot where most votes are for one text.  Each slot is then counted over all pages, and it is template only where at least ``CONSTANT`` of the pages that
have the slot hold that text.  Template text is left out of the pages that hold exactly it; a page with another text in the slot keeps that.
A page of a layout without a way falls back on all its articles, and without any on its whole unmarked text.

A page is parsed once for its skeleton and once for its blocks.  Wrappers go to the tasks as a broadcast table while they are within
``WRAPPER_BYTES``, else by a join; html is neither written nor, but for that join, shuffled; skeletons are.

Text: character references are decoded, runs of white space inside a block become one space, blocks are trimmed and
joined in page order by one newline.  Scripts, styles, comments and other unshown elements give nothing.

Defined results: null or empty html gives an empty text.  Pages without a host form one host.  Repeated rows are
extracted alike.  Elements nest as deep as they like.  Tags that never close, stray end tags and cut-off pages are read as far as they go.  Whole pages
are read.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, table

GROUP = 24
BAND = 40
CONSTANT = 0.99
WRAPPER_BYTES = 64 << 20
PATH = 2000
# Elements by what they do, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video select option textarea button".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                  "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "figcaption"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}}
SECTIONS = frozenset("html body article section main div".split())
SCOPES = frozenset("ul ol dl table td th html body article section main div".split())
# Elements, and words of class, id or role, that mark a region beside the article.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo nav navigation navbar menu breadcrumb breadcrumbs header "
                        "masthead footer sidebar aside widget related share social comment comments reply replies disqus respond cookie cookies "
                        "consent notice notices alert popup modal newsletter subscribe signup login search pagination pager toc skip tags".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "marked", "children")

    def __init__(self, tag: str, name: str, marked: bool) -> None:
        self.tag, self.name, self.marked, self.children = tag, name, marked, []  # children: nodes and texts in order


def _element(tag: str, attributes: str) -> Node:
    values = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    words = {w for v in values.values() for w in re.split(r"[\s_-]+", v)}
    # an id is often one page's own, so it marks a region but names no path
    name = tag + "".join(f".{re.sub(r'[0-9]+', '0', v)}" for k, v in sorted(values.items()) if v and k != "id")
    return Node(tag, name, tag in ASIDE_TAGS or not words.isdisjoint(ASIDE_WORDS))


class Bone(Node):
    """A shown block element of a skeleton: digests of its whole text and of what lies outside its block children (0: none), characters."""

    __slots__ = ("digest", "own", "shown", "source")

    def __init__(self, name: str, digest: int = 0, own: int = 0, shown: int = 0, source: Node | None = None) -> None:
        super().__init__(name.partition(".")[0] or "#", name, False)
        self.digest, self.own, self.shown, self.source = digest, own, shown, source


def parse(html: str) -> Node:
    """The page's tree of elements, with the end tags that HTML lets an author leave out."""
    root = Node("#", "", False)
    stack, at = [root], 0
    opened: Counter = Counter()  # of tags, so that the stack is searched only for what it holds

    def close(tags: set[str] | frozenset[str], within: frozenset[str]) -> None:
        """Ends the innermost open element of the tags, unless an element of ``within`` lies between."""
        if any(opened[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    opened.subtract(x.tag for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k].tag in within:
                    break

    while at < len(html):
        m = _TOKEN.search(html, at)
        if not m:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at:m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            close({tag}, frozenset())
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPES)
        if tag in SAME_CLOSES:
            close(SAME_CLOSES[tag], SCOPES)
        node = _element(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def _below(path: str, name: str) -> str:
    """The path of a child; a long one is shortened to a digest, so that deep nesting costs no more than its elements."""
    out = f"{path}/{name}"
    return out if len(out) <= PATH else "#" + blake2b(out.encode(), digest_size=16).hexdigest()


def pieces(node: Node, slots: dict[str, int] | None = None, path: str = "") -> list[tuple[str, str | None]]:
    """(text, slot) of the blocks under a node in page order, without hidden and marked parts.

    The blocks of a child element whose path is a slot, and whose text is the slot's, carry the slot; of nested ones all, a line each.
    """
    out: list[tuple[str, str | None]] = []
    run: list[str] = []

    def close() -> None:
        if text := _SPACE.sub(" ", unescape("".join(run))).strip():
            out.append((text, "\n".join(inside) or None))
        run.clear()

    inside: list[str] = []  # the slots that the walk is in
    stack: list[tuple[Iterator, str, bool, bool]] = [(iter(node.children), path, False, False)]
    while stack:
        children, at, block, slot = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if block:
                close()
            if slot:
                inside.pop()
        elif isinstance(child, str):
            run.append(child)
        elif child.tag in HIDDEN or child.marked:
            run.append(" ") if child.tag not in BLOCK else close()
        elif child.tag == "br":
            run.append(" ")
        elif child.tag not in VOID or child.tag == "hr":
            below = _below(at, child.name) if slots else ""
            same = bool(slots) and below in slots and _digest(child) == slots[below]
            if child.tag in BLOCK:
                close()
            if same:
                inside.append(below)
            stack.append((iter(child.children), below, child.tag in BLOCK, same))
    close()
    return out


def blocks(node: Node) -> list[str]:
    return [text for text, _ in pieces(node)]


def _digest_of(texts: list[str]) -> int:
    if not texts:
        return 0
    return int.from_bytes(blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _digest(node: Node) -> int:
    return _digest_of(blocks(node))


def skeleton(root: Node) -> Bone:
    """The page's tree of shown block elements without marked ones; only elements right below one another are in it."""
    texts: list[str] = []
    run: list[str] = []
    found: list[tuple[Bone, int, int]] = []  # with the range of its texts; children come before their parents
    top = Bone("", source=root)

    def close() -> None:
        if text := _SPACE.sub(" ", unescape("".join(run))).strip():
            texts.append(text)
        run.clear()

    stack: list[tuple[Iterator, bool, Bone | None, int]] = [(iter(root.children), True, top, 0)]
    while stack:
        children, block, bone, start = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if block:
                close()
            if bone is not None:
                found.append((bone, start, len(texts)))
        elif isinstance(child, str):
            run.append(child)
        elif child.tag in HIDDEN or child.marked:
            run.append(" ") if child.tag not in BLOCK else close()
        elif child.tag == "br":
            run.append(" ")
        elif child.tag not in VOID or child.tag == "hr":
            below = None
            if child.tag in BLOCK:
                close()
                if bone is not None:
                    bone.children.append(below := Bone(child.name, source=child))
            stack.append((iter(child.children), child.tag in BLOCK, below, len(texts)))
    ranges = {id(bone): (start, end) for bone, start, end in found}
    before = [0]
    for text in texts:
        before.append(before[-1] + len(text))
    for bone, start, end in found:
        bone.digest, bone.shown = _digest_of(texts[start:end]), before[end] - before[start]
        if bone.children:
            own, at = [], start
            for x in bone.children:
                first, last = ranges[id(x)]
                own += texts[at:first]
                at = last
            bone.own = _digest_of(own + texts[at:end])
        else:
            bone.own = bone.digest
    return top


def _flat(top: Bone) -> tuple[list[str], list[int], list[int], list[int], list[int]]:
    """A skeleton as a row: names, depths, digests, own digests of inner elements, characters; in page order."""
    out: tuple[list, ...] = ([], [], [], [], [])
    stack = [(top, 0)]
    while stack:
        x, depth = stack.pop()
        for column, value in zip(out, (x.name, depth, x.digest, x.own if x.children else 0, x.shown), strict=True):
            column.append(value)
        stack += [(c, depth + 1) for c in reversed(x.children)]
    return out


def _grown(names: list[str], depths: list[int], digests: list[int], own: list[int], shown: list[int]) -> Bone:
    """The skeleton of a row."""
    stack: list[Bone] = []
    for name, depth, digest, outside, n in zip(names, depths, digests, own, shown, strict=True):
        bone = Bone(name, digest, outside, n)
        del stack[depth:]
        if stack:
            stack[-1].children.append(bone)
        stack.append(bone)
        if depth == 0:
            top = bone
    todo = [top]
    while todo:
        x = todo.pop()
        todo += x.children
        if not x.children:
            x.own = x.digest
    return top


def regions(root: Node) -> Iterator[tuple[str, Node]]:
    """(path, node) of each unmarked shown element that may hold an article: sections, not paragraphs."""
    stack = [("", root)]
    while stack:
        path, node = stack.pop()
        for child in reversed(node.children):
            if isinstance(child, Node) and not child.marked and child.tag not in HIDDEN and child.tag in SCOPES | {"#"}:
                below = _below(path, child.name)
                yield below, child
                stack.append((below, child))


def _elements(node: Node) -> list[Node]:
    return [x for x in node.children if isinstance(x, Node) and x.tag not in HIDDEN and x.tag in BLOCK]


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size and pairs of the largest top-down match of two ordered trees with equal roots.

    Of two lists of children, only those at most ``BAND`` places apart (along the diagonal of the two lengths) are compared;
    lists of up to ``BAND`` are compared whole.  The trees are walked with a stack of open pairs.
    """
    if a.name != b.name:
        return 0, []
    shape = _shapes(a, b)
    done: dict[tuple[int, int], tuple[int, list]] = {}
    stack = [(a, b, False)]
    while stack:
        p, q, ready = stack.pop()
        if (id(p), id(q)) in done:
            continue
        if shape[id(p)] == shape[id(q)]:
            pairs = list(zip(_walk(p), _walk(q), strict=True))
            done[id(p), id(q)] = len(pairs), pairs
            continue
        x, y = _elements(p), _elements(q)
        # children of one shape at both ends belong to a largest match
        first = last = 0
        while first < min(len(x), len(y)) and shape[id(x[first])] == shape[id(y[first])]:
            first += 1
        while last < min(len(x), len(y)) - first and shape[id(x[-1 - last])] == shape[id(y[-1 - last])]:
            last += 1
        ends = [*zip(x[:first], y[:first], strict=True), *zip(x[len(x) - last:], y[len(y) - last:], strict=True)]
        x, y = x[first:len(x) - last], y[first:len(y) - last]
        near = [[j for j in _band(i, len(x), len(y)) if x[i].name == y[j].name] for i in range(len(x))]
        if not ready:
            stack.append((p, q, True))
            stack += [(x[i], y[j], False) for i, js in enumerate(near) for j in js]
            continue
        pairs = _best(p, q, x, y, near, done)[1]
        for c, d in ends:
            pairs += zip(_walk(c), _walk(d), strict=True)
        done[id(p), id(q)] = len(pairs), pairs
    return done[id(a), id(b)]


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += _elements(x)


def _shapes(*trees: Node) -> dict[int, int]:
    """A number of the shape (names without texts) of each element, by identity."""
    known: dict[tuple, int] = {}
    out: dict[int, int] = {}
    for tree in trees:
        for x in reversed(list(_walk(tree))):
            key = (x.name, *(out[id(c)] for c in _elements(x)))
            out[id(x)] = known.setdefault(key, len(known))
    return out


def _band(i: int, n: int, m: int) -> range:
    middle = i * m // max(n, 1)
    return range(max(0, middle - BAND), min(m, middle + BAND + 1)) if max(n, m) > BAND else range(m)


def _best(p: Node, q: Node, x: list[Node], y: list[Node], near: list[list[int]], done: dict) -> tuple[int, list]:
    """The heaviest chain of child pairs in order, among the pairs of the band: sparse, by a prefix maximum tree."""
    tree: list[tuple[int, int]] = [(0, -1)] * (len(y) + 1)  # Fenwick: best (weight, chain) over columns before
    chains: list[tuple[int, int, int]] = []  # i, j, chain before
    for i, js in enumerate(near):
        fresh = []
        for j in js:
            weight, before, k = 0, -1, j
            while k:
                if tree[k][0] > weight:
                    weight, before = tree[k]
                k -= k & -k
            fresh.append((weight + done[id(x[i]), id(y[j])][0], j, len(chains)))
            chains.append((i, j, before))
        for weight, j, chain in fresh:
            k = j + 1
            while k <= len(y):
                if tree[k][0] < weight:
                    tree[k] = (weight, chain)
                k += k & -k
    weight, at, k = 0, -1, len(y)
    while k:
        if tree[k][0] > weight:
            weight, at = tree[k]
        k -= k & -k
    pairs = [(p, q)]
    while at >= 0:
        i, j, at = chains[at]
        pairs += done[id(x[i]), id(y[j])][1]
    return 1 + weight, pairs


def edges(top: Bone) -> Iterator[tuple[str, str, int, int]]:
    """(region, child, digest of the texts in the region outside the child, characters in the child) of one page."""
    stack = [("", [top])]
    while stack:
        path, nodes = stack.pop()
        total = texts = 0
        inner: dict[str, list] = {}
        for x in nodes:
            for digest in (x.own if x.children else x.digest, *(c.digest for c in x.children)):
                total, texts = total + digest, texts + (digest != 0)
            for c in x.children:
                if c.tag in SCOPES:
                    inner.setdefault(_below(path, c.name), []).append(c)
        for child, found in inner.items():
            outside = _long(total - sum(c.digest for c in found)) if texts > sum(c.digest != 0 for c in found) else 0
            yield path, child, outside, sum(c.shown for c in found)
            stack.append((child, found))


def _long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def way(pages: int, counted: list[tuple[str, str, int, int, int]]) -> list[tuple[str, int]]:
    """The regions to enter, with the digest of what lies outside them; counted: region, child, characters, commonest outside and its pages."""
    below: dict[str, list] = defaultdict(list)
    for path, child, weight, outside, n in counted:
        below[path].append((weight, child, outside, n))
    at, out = "", []
    while at in below:
        weight, child, outside, n = max(below[at])
        # text that is not on every page is content, and two pages say too little
        if not weight or n < CONSTANT * pages or (pages < 3 and (outside or n < pages)):
            break
        out.append((child, outside))
        at = child
    return out


def followed(top: Bone, regions: list[str], outside: list[int]) -> tuple[str, list[Bone]]:
    """How far a page goes the way of its layout: the region where it ends and the page's elements there."""
    at, nodes = "", [top]
    for child, digest in zip(regions, outside, strict=True):
        total = texts = 0
        inner = []
        for x in nodes:
            rest = [x.own if x.children else x.digest]
            for c in x.children:
                inner.append(c) if c.tag in SCOPES and _below(at, c.name) == child else rest.append(c.digest)
            total, texts = total + sum(rest), texts + sum(d != 0 for d in rest)
        if not inner or (_long(total) if texts else 0) != digest:
            break
        at, nodes = child, inner
    return at, nodes


def main_digest(nodes: list[Bone]) -> int:
    """Of the main text: pages that share it are copies, which say nothing about the template."""
    return _long(sum(x.digest for x in nodes))


def votes(trees: list[Bone]) -> Counter:
    """(path, digest) of aligned elements of each page and the next, 0 where their texts differ, and of those that no neighbour has."""
    out: Counter = Counter()
    aligned: set[int] = set()
    for a, b in zip(trees, trees[1:], strict=False):
        for path, x, y in _paths(a, b):
            aligned.update((id(x), id(y)))
            if x.digest or y.digest:
                out[path, x.digest if x.digest == y.digest else 0] += 1
    for tree in trees:
        out.update((path, x.digest) for path, x in _named(tree) if x.digest and id(x) not in aligned)
    return out


def induce(pages: list[str]) -> dict[str, object]:
    """The wrapper of one layout's pages, as ``wrappers`` makes it: its way, main region, and slots with the digest of their text."""
    trees = list({x.digest: x for x in map(skeleton, map(parse, pages))}.values())
    weight: Counter = Counter()
    seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for tree in trees:
        for path, child, outside, n in edges(tree):
            weight[path, child] += n
            seen[path, child][outside] += 1
    steps = way(len(trees), [(*k, weight[k], *c.most_common(1)[0]) for k, c in seen.items()])
    regions, outside = [r for r, _ in steps], [d for _, d in steps]
    mains = {m: x for x in trees if (m := main_digest(followed(x, regions, outside)[1]))}
    paths: dict[str, Counter] = defaultdict(Counter)
    for (path, digest), n in votes([mains[m] for m in sorted(mains)]).items():
        paths[path][digest] += n
    slots = {p: c.most_common(1)[0][0] for p, c in paths.items() if max(c.values()) >= 3 and 2 * max(c.values()) > sum(c.values())}
    slots = {p: slots[p] for p in sorted(slots) if slots[p]}
    return {"main": regions[-1] if regions else "", "regions": regions, "outside": outside, "template": list(slots), "digests": list(slots.values())}


def _named(top: Node) -> Iterator[tuple[str, Node]]:
    """(path, element) of the elements of a page whose path names one child."""
    stack = [(top, "")]
    while stack:
        x, path = stack.pop()
        below = _elements(x)
        names = Counter(c.name for c in below)
        for child in below:
            at = _below(path, child.name)
            if names[child.name] == 1:
                yield at, child
            stack.append((child, at))


def _paths(a: Node, b: Node) -> Iterator[tuple[str, Node, Node]]:
    """The aligned pairs with their path, where the path names one child."""
    pairs = {id(x): y for x, y in match(a, b)[1]}
    return ((path, x, pairs[id(x)]) for path, x in _named(a) if id(x) in pairs)


def read(root: Node, wrapper: dict[str, object] | None) -> tuple[list[tuple[str, str | None]], list[str]]:
    """The (text, slots) blocks of one page's main text, and the slots that the page has, with whatever text."""
    if wrapper and wrapper["regions"]:
        main, found = followed(skeleton(root), wrapper["regions"], wrapper["outside"])
        if main:
            nodes = [x.source for x in found]
            slots = dict(zip(wrapper["template"], wrapper["digests"], strict=True))
            return [piece for x in nodes for piece in pieces(x, slots, main)], sorted(_present(nodes, slots, main))
    articles, stack = [], [root]
    while stack:  # in page order; an article inside another is read with it
        x = stack.pop()
        if x.tag in ("article", "main"):
            articles.append(x)
        else:
            stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.marked and c.tag in SCOPES]
    return [piece for x in articles or [root] for piece in pieces(x)], []


def _present(nodes: list[Node], slots: dict[str, int], main: str) -> set[str]:
    """The slots that a page's main region has; only paths that lead to a slot are followed."""
    if not slots:
        return set()
    ways = {p[:k] for p in slots for k in range(len(main), len(p)) if p[k] == "/"} | set(slots)
    out, stack = set(), [(x, main) for x in nodes]
    while stack:
        x, path = stack.pop()
        for child in _elements(x):
            below = _below(path, child.name)
            if below in slots:
                out.add(below)
            if below in ways:
                stack.append((child, below))
    return out


def extract(html: str | None, wrapper: dict[str, object] | None) -> str:
    """The main text of one page whose layout's slots are all template."""
    return "\n".join(text for text, slot in read(parse(html or ""), wrapper)[0] if slot is None)


def layout_of(root: Node) -> int:
    """Hash of the set of paths of a page's unmarked sections: the same for pages of one layout, however long."""
    paths = {p for p, x in regions(root) if x.tag in SECTIONS}
    return int.from_bytes(blake2b("\n".join(sorted(paths)).encode(), digest_size=8).digest(), "big", signed=True)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


SKELETON = "names array<string>, depths array<int>, digests array<long>, own array<long>, shown array<int>"
COLUMNS = ["names", "depths", "digests", "own", "shown"]
KINDS = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (host, html) to host, layout, digest of the page's text, and skeleton; of a batch's equal texts one."""
    for batch in batches:
        rows: dict[tuple, tuple] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(html or "")
            top = skeleton(root)
            if (key := (host, layout_of(root), top.digest)) not in rows:
                rows[key] = _flat(top)
        values = [*zip(*rows, strict=True)] if rows else [(), (), ()]
        shapes = [*zip(*rows.values(), strict=True)] if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(values[0], pa.string()), *(pa.array(v, pa.int64()) for v in values[1:]),
                                          *(pa.array(v, k) for v, k in zip(shapes, KINDS, strict=True))], names=["host", "layout", "page", *COLUMNS])


def _trees(rows: pa.RecordBatch | pa.Table) -> Iterator[Bone]:
    return map(_grown, *(rows.column(c).to_pylist() for c in COLUMNS))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: skeletons to their edges, counted in the batch."""
    for batch in batches:
        n: Counter = Counter()
        weight: Counter = Counter()
        for host, layout, top in zip(batch.column("host").to_pylist(), batch.column("layout").to_pylist(), _trees(batch), strict=True):
            for path, child, outside, shown in edges(top):
                key = (host, layout, path, child, outside)
                n[key] += 1
                weight[key] += shown
        keys = [*zip(*n, strict=True)] if n else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([*keys, list(n.values()), [weight[k] for k in n]], kinds, strict=True)],
                                         names=["host", "layout", "path", "child", "outside", "n", "weight"])


def _mains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: skeletons and their layout's way to the digest of the main text and skeleton; of a batch's equal main texts one."""
    for batch in batches:
        first: dict[tuple, int] = {}
        columns = (batch.column(c).to_pylist() for c in ("host", "layout", "regions", "outside"))
        for i, (host, layout, regions, outside, top) in enumerate(zip(*columns, _trees(batch), strict=True)):
            if m := main_digest(followed(top, regions, outside)[1]):
                first.setdefault((host, layout, m), i)
        some = batch.take(pa.array(list(first.values()), pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column("host"), some.column("layout"), pa.array([m for _, _, m in first], pa.int64()),
                                          *(some.column(c) for c in COLUMNS)], names=["host", "layout", "main", *COLUMNS])


def _aligned(rows: pa.Table) -> pa.Table:
    """applyInArrow function over a group of skeletons: the votes of its pages."""
    mains = dict(zip(rows.column("main").to_pylist(), _trees(rows), strict=True))
    found = votes([mains[m] for m in sorted(mains)])
    host, layout = rows.column("host")[0].as_py(), rows.column("layout")[0].as_py()
    return pa.table({"host": pa.array([host] * len(found), pa.string()), "layout": pa.array([layout] * len(found), pa.int64()),
                     "path": pa.array([p for p, _ in found], pa.string()), "digest": pa.array([d for _, d in found], pa.int64()),
                     "n": pa.array(list(found.values()), pa.int64())})


def _ways(rows: pa.Table) -> pa.Table:
    """applyInArrow function over a layout's counted edges: its way."""
    one = rows.slice(0, 1).to_pylist()[0]
    steps = way(one["pages"], [*zip(*(rows.column(c).to_pylist() for c in ("path", "child", "weight", "outside", "n")), strict=True)])
    return pa.table({"host": pa.array([one["host"]], pa.string()), "layout": pa.array([one["layout"]], pa.int64()),
                     "regions": pa.array([[r for r, _ in steps]], pa.list_(pa.string())), "outside": pa.array([[d for _, d in steps]], pa.list_(pa.int64()))})


def _small(ways: DataFrame) -> DataFrame:
    """Marks rows of a layout for broadcast while they are within WRAPPER_BYTES; else joins shuffle them."""
    size = ways.agg(F.sum(F.length("host") + F.length(F.array_join("regions", "")) + 40 * F.size("regions") + 40)).first()[0]
    return F.broadcast(ways) if (size or 0) <= WRAPPER_BYTES else ways


def wrappers(spark: SparkSession, scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, layout, regions, outside, template, digests): one row per layout of a host, from all its pages; pages have a host."""
    group = ["host", "layout"]
    texts = scratch.keep(pages.select("host", "html").mapInArrow(_skeletons, "host string, layout long, page long, " + SKELETON)
                         .dropDuplicates([*group, "page"]))
    counted = (texts.mapInArrow(_edges, "host string, layout long, path string, child string, outside long, n long, weight long")
               .groupBy(*group, "path", "child", "outside").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
               .groupBy(*group, "path", "child").agg(F.sum("weight").alias("weight"), F.max(F.struct("n", "outside")).alias("best")))
    rows = (counted.join(texts.groupBy(*group).agg(F.count(F.lit(1)).alias("pages")), group)
            .select(*group, "path", "child", "weight", "best.outside", "best.n", "pages"))
    ways = scratch.keep(rows.groupBy(*group).applyInArrow(_ways, "host string, layout long, regions array<string>, outside array<long>"))
    mains = scratch.keep(texts.join(_small(ways), group).mapInArrow(_mains, "host string, layout long, main long, " + SKELETON))
    scratch.drop(texts)
    # copies have one digest, so they meet in one group; the number of groups follows the layout's main texts
    sizes = scratch.keep(mains.groupBy(*group).agg(F.ceil(F.approx_count_distinct("main") / GROUP).alias("groups")))
    dealt = mains.join(bounded(sizes), group).withColumn("part", F.pmod(F.xxhash64("main"), "groups")).drop("groups")
    slots = (dealt.groupBy(*group, "part").applyInArrow(_aligned, "host string, layout long, path string, digest long, n long")
             .groupBy(*group, "path", "digest").agg(F.sum("n").alias("n"))
             .groupBy(*group, "path").agg(F.sum("n").alias("votes"), F.max(F.struct("n", "digest")).alias("best"))
             .where("best.digest != 0 AND best.n >= 3 AND 2 * best.n > votes")
             .groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("path", "best.digest"))).alias("slots")))  # paths that recur in a layout
    learned = scratch.keep(ways.join(slots, group, "left").select(
        *group, "regions", "outside", F.coalesce(F.col("slots.path"), F.array().cast("array<string>")).alias("template"),
        F.coalesce(F.col("slots.digest"), F.array().cast("array<long>")).alias("digests")))
    scratch.drop(mains)
    return learned


PIECES = "struct<layout:long,texts:array<string>,slots:array<string>,present:array<string>,same:array<string>>"


def _pieces(rows: Iterator[tuple[Node, int, dict[str, object] | None]]) -> pa.Array:
    out = []
    for root, layout, wrapper in rows:
        found, present = read(root, wrapper)
        same = {slot for _, held in found if held for slot in held.split("\n")}
        out.append({"layout": layout, "texts": [text for text, _ in found], "slots": [held for _, held in found], "present": present, "same": sorted(same)})
    kind = pa.list_(pa.string())
    return pa.array(out, pa.struct([("layout", pa.int64()), *((c, kind) for c in ("texts", "slots", "present", "same"))]))


def _read_pages(spark: SparkSession, pages: DataFrame, learned: DataFrame) -> DataFrame:
    """page_id, url, host and the pieces of each page, read with the wrapper of its layout."""
    size = learned.agg(F.sum(F.length("host") + F.length(F.array_join("regions", "")) + F.length(F.array_join("template", "")) + 40 * F.size("regions") + 40 * F.size("template") + 40)).first()[0]
    if (size or 0) <= WRAPPER_BYTES:
        table_of = spark.sparkContext.broadcast({(r["host"], r["layout"]): r.asDict() for r in learned.collect()})

        def run(html: pa.Array, host: pa.Array) -> pa.Array:
            def rows():
                for h, k in zip(html.to_pylist(), host.to_pylist(), strict=True):
                    root = parse(h or "")
                    layout = layout_of(root)
                    yield root, layout, table_of.value.get((k, layout))

            return _pieces(rows())

        return pages.select("page_id", "url", "host", F.arrow_udf(run, PIECES)("html", "host").alias("p"))

    kinds = ("regions", "outside", "template", "digests")

    def run_joined(html: pa.Array, layout: pa.Array, *wrapper: pa.Array) -> pa.Array:
        return _pieces((parse(h or ""), lay, {k: v or [] for k, v in zip(kinds, w, strict=True)}) for h, lay, *w in zip(
            html.to_pylist(), layout.to_pylist(), *(x.to_pylist() for x in wrapper), strict=True))

    def layouts(html: pa.Array) -> pa.Array:
        return pa.array([layout_of(parse(h or "")) for h in html.to_pylist()], pa.int64())

    return (pages.withColumn("layout", F.arrow_udf(layouts, "long")("html")).join(learned, ["host", "layout"], "left")
            .select("page_id", "url", "host", F.arrow_udf(run_joined, PIECES)("html", "layout", *kinds).alias("p")))


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row."""
    scratch = Scratch(spark, "html")
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url")))
    learned = wrappers(spark, scratch, pages)
    found = scratch.keep(_read_pages(spark, pages, learned).select("page_id", "url", "host", "p.*"))
    # a slot is template where nearly all pages that have it hold the voted text; combined before the shuffle
    held = F.transform("present", lambda s: F.struct(s.alias("slot"), F.array_contains("same", s).cast("int").alias("same")))
    counts = (found.where(F.size("present") > 0).select("host", "layout", F.inline(held))
              .groupBy("host", "layout", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("same"))
              .where(F.col("same") >= CONSTANT * F.col("n"))
              .groupBy("host", "layout").agg(F.collect_list("slot").alias("template")))  # at most a wrapper's slots
    counts = scratch.keep(counts)
    none = F.array().cast("array<string>")
    kept = F.zip_with("texts", "slots", lambda t, s: F.when(s.isNull() | ~F.arrays_overlap(F.split(s, "\n"), F.coalesce("template", none)), t))
    joined = found.join(bounded(counts), ["host", "layout"], "left")
    return (joined.select("page_id", "url", F.array_join(kept, "\n").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``: page_id, url, text, n_chars."""
    return main_texts(spark, table(spark, sf_dir, "pages"))
