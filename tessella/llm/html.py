"""Main text of web pages by wrapper induction.

Pages are parsed into trees of block elements. For every host a wrapper is
induced from all its pages: their trees are aligned by simple tree matching
(most matched nodes, order kept, runs of like siblings as one repeating node),
nodes that match are merged and the others added. Trees that are equal count
once; the different ones are merged some at a time, then what they gave, until
each host has one. Where a wrapper grows beyond its bounds nothing is left
out: siblings of one label and about one size, then of one label, then of one
tag, become one node, in any order, from the deepest up, or what is below a
node belongs to it. Then every
page is aligned with its host's wrapper, and what each of the wrapper's slots
holds is counted over all pages: text, links, and in how many pages a slot has
the same text. From these counts the wrapper is read from the root down: as
long as one slot holds most of the text of what it stands in, that slot is
where the content is, and what stands beside it is template, but for headings,
paragraphs and what says the page's title. Within the content, lists of nothing but links are template as well, and so is,
before its first and after its last text that varies and is no heading, what a slot has in nearly all pages; headings stay, as
articles may share them. All other slots vary and are content. A page that is alone on its host, or whose text mostly stands
where the alignment finds no place for it, is read by a wrapper of its own.

Elements that are what the result must not have by their kind (nav, aside,
form, script, footer and so on, and containers whose class is one of a few
whole words) hold no text. ``article`` and ``main`` are evidence: they count
more in finding the slot with most text.
"""

from __future__ import annotations

import html as html_module
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_hot, slices
from tessella.llm.urlfilter import host
from tessella.sources.scratch import forget, written
from tessella.sources.tables import table

#: Trees of a host that one step merges, about; dealt by a hash of the tree, so any input order gives the same.
MERGED_AT_ONCE = 32
#: A text is template if a slot has it in this share of the different pages that have the slot, and in so many of them.
CONSTANT, LEAST_PAGES = 0.9, 3
#: If such texts were a larger share of a host's content, its pages are copies of each other, not a template.
MOST_CONSTANT = 0.8
#: A slot holds most of the text by this share, or by the next where the element around it is marked as main part.
HOLDS, HOLDS_INSIDE = 0.5, 0.8
#: A slot repeats if pages have it more often than this.
REPEATS = 1.2
#: Share of linked text from which a list or container in the content is a menu, if it is in most pages.
LINKED, IN_MOST = 0.8, 0.8
#: How much more text in a marked main part counts.
MAIN_COUNTS = 3
#: A page has a wrapper of its own if more of its text than this finds no place in its host's wrapper.
UNKNOWN = 0.5
#: Elements further down belong to their ancestor at this depth; siblings of more kinds than this are taken by coarser
#: kinds; and trees have so many nodes at most, in page order. So alignment is bounded however a page is made.
DEEPEST, WIDEST, MOST_NODES = 64, 64, 3_000
#: Steps of alignment from which siblings are matched in order without trying all ways.
MOST_STEPS = 1_000_000
#: Labels longer than this are hashed.
LONGEST_LABEL = 100
#: How a wrapper's node has its kids: in order, or in any order some of each label, one for about each size, or one of each label, or
#: of each tag, or none, all below being its own.
ORDERED, BY_SIZE, BY_LABEL, BY_TAG, CLOSED = range(5)
#: So many kids of a wrapper's node say that its pages have no one order.
IN_NO_ORDER = 32
#: Nodes of wrappers that a task remembers.
REMEMBERED = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "dd", "dt", "html", "legend", "li", "optgroup", "option", "tbody", "tfoot", "thead", "tr"}
#: An opening tag ends open elements of these names, up to the nearest of those that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NO_CONTENT = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map menu meter nav noembed noframes noscript object option progress script search select style svg template textarea title video".split()
)
#: Whole words of class that mark containers which aren't content, words of role, and ids.
CLASS_MARKS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist comment-form comment-list cookie cookies cookie-banner cookie-notice footer login masthead menu modal nav navbar navigation newsletter newsletter-signup notice notices pagination popup promo related related-articles related-posts share sharing sidebar signup site-footer site-header skip-link social social-share sponsored subscribe toolbar topbar widget widgets".split()
)
ROLE_MARKS = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ID_MARKS = frozenset("comments respond disqus_thread sidebar footer header nav navigation menu cookie-banner cookie-notice".split())
#: Those of them that say advert or notice on any element.
ADVERT_MARKS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising cookie-banner cookie-notice notice notices sponsored".split())
#: Inside an article or main, these words on these elements may name its own text.
MAY_BE_TEXT = frozenset("banner login masthead menu modal popup toolbar widget widgets".split())
TEXT_CONTAINERS = frozenset("fieldset section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("details dir div dl fieldset ol section table tbody td tr ul".split())
#: Elements that may hold the content, and those that belong to it where they stand beside the element that does.
HOLDERS = frozenset("article body center div html main section table tbody td tr".split())
BESIDE = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hgroup ol p pre table ul".split())

#: An attribute: its name ends at white space, a slash, an equals sign or the tag's end; a quote opens a value only after an equals sign.
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+)|(?=>|\Z))|)"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:[\s/]|" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE) + r")*+(?P<end>>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_WANTED = re.compile("class|id|role|style|hidden", re.I)
_SPACE = re.compile(r"\s+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block element: its tag, its label (tag and class words without digits), its block children and its own blocks."""

    __slots__ = ("blocks", "kids", "label", "main", "tag")

    def __init__(self, tag: str, label: str, main: bool):
        self.tag, self.label, self.main = tag, label, main
        self.kids: list[Node] = []
        self.blocks: list[int] = []  # places in the page's list of blocks


@dataclass
class Open:
    """An open element: its name, the node that its text belongs to, and whether its text is gone or linked."""

    name: str
    node: Node
    depth: int
    gone: bool
    linked: bool
    inside: bool  # of an article or main


class Page:
    """The tree of a page, and its blocks in order: (text, how many of its characters are in links)."""

    def __init__(self, source: str):
        self.root = Node("", "", False)
        self.title = ""
        self.blocks: list[tuple[str, int]] = []
        self._buffer: list[tuple[str, bool]] = []
        self._stack: list[Open] = [Open("", self.root, 0, False, False, False)]
        self._at: dict[str, list[int]] = {}  # places of open elements in the stack, by name
        self._blocks_at = [0]  # places of open block elements
        self._parse(source)

    def _flush(self) -> None:
        if self._buffer:
            text = _SPACE.sub(" ", "".join(x for x, _ in self._buffer)).strip()
            if text:
                linked = sum(len(_SPACE.sub("", x)) for x, link in self._buffer if link)
                self._stack[-1].node.blocks.append(len(self.blocks))
                self.blocks.append((text, min(linked, len(text))))
            self._buffer.clear()

    def _text(self, raw: str) -> None:
        at = self._stack[-1]
        if not at.gone:
            self._buffer.append((html_module.unescape(raw) if "&" in raw else raw, at.linked))

    def _last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names; 0 if none."""
        return max((self._at[n][-1] for n in names if self._at.get(n)), default=0)

    def _push(self, opened: Open) -> None:
        place = len(self._stack)
        self._stack.append(opened)
        self._at.setdefault(opened.name, []).append(place)
        if opened.name in BLOCK:
            self._blocks_at.append(place)

    def _open(self, name: str, tag: str) -> None:
        if name in CLOSES_P and self._stack[self._blocks_at[-1]].name == "p":
            self._cut(self._blocks_at[-1])
        if name in ENDS:
            names, until = ENDS[name]
            place = self._last(names)
            if place > self._last(until):
                self._cut(place)
        if name == "br" or name == "td" or name == "th":
            self._text(" ")
        if name in VOID:
            if name == "hr":
                self._flush()
            return
        up = self._stack[-1]
        found = attributes(tag) if len(tag) > len(name) + 2 and _WANTED.search(tag) else {}
        words = found.get("class", "").lower().split()
        gone = up.gone or name in NO_CONTENT or name == "header" and not up.inside
        if name in CONTAINERS or name == "article":
            marks = CLASS_MARKS - MAY_BE_TEXT if up.inside and name in TEXT_CONTAINERS else CLASS_MARKS
            gone = gone or not marks.isdisjoint(words) or found.get("id", "").lower() in ID_MARKS
        elif name not in ("body", "html", "main"):
            gone = gone or not ADVERT_MARKS.isdisjoint(words)
        if name not in ("body", "html", "main", "article"):
            gone = gone or not ROLE_MARKS.isdisjoint(found.get("role", "").lower().split())
        gone = gone or "hidden" in found and found["hidden"].lower() not in ("false", "until-found") or found.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(found.get("style", "")))
        linked = up.linked or name == "a"
        if name not in BLOCK:
            self._push(Open(name, up.node, up.depth, gone, linked, up.inside))
            return
        self._flush()
        main = name in ("article", "main") or found.get("role", "").lower() == "main"
        node, depth = up.node, up.depth
        if depth < DEEPEST and not gone:
            label = ".".join([name, *sorted({w for w in words if not any(c.isdigit() for c in w)})])
            if len(label) > LONGEST_LABEL:
                label = f"{name}.{xxhash.xxh64_hexdigest(label)}"
            node, depth = Node(name, label, main), depth + 1
            up.node.kids.append(node)
        self._push(Open(name, node, depth, gone, linked, up.inside or main))

    def _cut(self, i: int) -> None:
        while len(self._stack) > i:
            name = self._stack[-1].name
            if name in BLOCK:
                self._flush()
                self._blocks_at.pop()
            self._at[name].pop()
            self._stack.pop()

    def _close(self, name: str) -> None:
        """Ends the innermost open element of the name; of elements that aren't blocks, none outside the table or body that is open."""
        place = self._last((name,))
        if place and (name in BLOCK or place > self._last(("table", "body", "html"))):
            self._cut(place)

    def _parse(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TAG.search(source, at)
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            tag, at = found.group(), found.end()
            named = _NAME.match(tag)
            if not named or not found.group("end"):
                continue  # a comment, a declaration, or a tag that the page's end cuts
            name = named.group(1).lower()
            if tag[1] == "/":
                self._close(name)
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                if name == "title" and not self.title:
                    self.title = _SPACE.sub(" ", html_module.unescape(source[at : close.start() if close else end])).strip()
                self._open(name, tag)
                at = close.start() if close else end
                continue
            if name == "plaintext":
                self._text(source[at:])
                break
            self._open(name, tag)
        self._cut(1)
        self._flush()


def attributes(tag: str) -> dict[str, str]:
    """The attributes of an opening tag; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTES.findall(tag[:-1], len(_NAME.match(tag).group())):
        value = "".join(values)
        found.setdefault(name.lower(), html_module.unescape(value) if "&" in value else value)
    return found


class Runs:
    """A page's tree with neighbouring siblings of one label and shape taken together.

    ``mass``: characters outside links below the nodes, more for marked main
    parts; ``inner``: the same before that; ``own``: characters of the nodes'
    own blocks; ``total``, ``linked``: all characters below and those in links;
    ``titled``: whether a block is the page's title, or at least half of it from its beginning.
    """

    __slots__ = ("inner", "kids", "label", "linked", "main", "mass", "nodes", "own", "slot", "tag", "titled", "total")
    loose = ORDERED

    def __init__(self, nodes: list[Node], page: Page, left: list[int]):
        first = nodes[0]
        self.label, self.tag, self.main, self.nodes, self.slot = first.label, first.tag, first.main, nodes, -1
        blocks = [page.blocks[i] for n in nodes for i in n.blocks]
        self.own = self.total = sum(len(t) for t, _ in blocks)
        self.linked = sum(k for _, k in blocks)
        self.titled = any(2 * len(t) >= len(page.title) and page.title.startswith(t) for t, _ in blocks)
        self.inner = self.total - self.linked
        self.kids = []
        for group in _grouped([k for n in nodes for k in n.kids]):
            if left[0] <= 0:
                for n in group:  # beyond the bound a tree's blocks belong to the node above
                    _take(n, nodes[-1])
                    n.kids = []
                continue
            left[0] -= 1
            kid = Runs(group, page, left)
            self.kids.append(kid)
            self.inner += kid.mass
            self.total += kid.total
            self.linked += kid.linked
        self.mass = self.inner * (MAIN_COUNTS if self.main else 1)

    def folded(self, how: int) -> list[Runs]:
        """The kids, each for itself also where a wrapper's node has one of each label or tag."""
        return [] if how == CLOSED else self.kids


def _take(node: Node, into: Node) -> None:
    below = [node]
    while below:
        n = below.pop()
        into.blocks += n.blocks
        below += n.kids


def _shape(node: Node) -> tuple:
    return tuple(sorted({(k.tag, *sorted({x.tag for x in k.kids})) for k in node.kids}))


def _grouped(nodes: list[Node]) -> list[list[Node]]:
    groups: list[list[Node]] = []
    kinds: list[tuple] = []
    for n in nodes:
        kind = (n.label, _shape(n))
        if kinds and kinds[-1] == kind:
            groups[-1].append(n)
        else:
            groups.append([n])
            kinds.append(kind)
    # Of too many groups those of a kind are one, by label and shape, or else by tag.
    for same in (lambda n: (n.label, _shape(n)), lambda n: n.tag):
        if len(groups) > WIDEST:
            by: dict = {}
            for g in groups:
                by.setdefault(same(g[0]), []).extend(g)
            groups = list(by.values())
    return groups


class Wrapper:
    """A node of a host's wrapper."""

    __slots__ = ("folds", "kids", "label", "loose", "main", "slot", "tag")

    def __init__(self, label: str, main: bool, loose: int = ORDERED):
        self.label, self.tag, self.main, self.loose, self.slot = label, label.partition(".")[0], main, loose, -1
        self.kids: list[Wrapper] = []
        self.folds: dict[int, list[Wrapper]] = {}

    @classmethod
    def of(cls, tree: Wrapper | Runs, label: str | None = None) -> Wrapper:
        """A copy of the tree, its root with this label."""
        out = cls(tree.label if label is None else label, tree.main, tree.loose)
        out.kids = [cls.of(k) for k in tree.kids]
        return out

    def packed(self) -> bytes:
        return zlib.compress(json.dumps(self._packed(), separators=(",", ":")).encode(), 1)

    def _packed(self) -> list:
        return [self.label, int(self.main), self.loose, [k._packed() for k in self.kids]]

    @classmethod
    def unpacked(cls, made: bytes) -> Wrapper:
        root = cls._unpacked(json.loads(zlib.decompress(made)))
        root.numbered()
        return root

    @classmethod
    def _unpacked(cls, made: list) -> Wrapper:
        out = cls(made[0], bool(made[1]), made[2])
        out.kids = [cls._unpacked(k) for k in made[3]]
        return out

    def levels(self) -> list[list[Wrapper]]:
        """The nodes by depth."""
        found = [[self]]
        while found[-1]:
            found.append([k for node in found[-1] for k in node.kids])
        return found[:-1]

    def tags(self) -> dict[int, str]:
        """The tag of each slot."""
        return {node.slot: node.tag for level in self.levels() for node in level}

    def numbered(self, at: int = 0) -> int:
        """Numbers the slots in order."""
        self.slot, at = at, at + 1
        for k in self.kids:
            at = k.numbered(at)
        return at

    def folded(self, how: int) -> list[Wrapper]:
        """The kids as a node that is no less loose has its own: those that are then one are merged."""
        if how == self.loose or how == CLOSED:
            return self.kids if how == self.loose else []
        if how not in self.folds:
            self.folds[how] = self._folded(how)
        return self.folds[how]

    def _folded(self, how: int) -> list[Wrapper]:
        by: dict[tuple, Wrapper] = {}
        for k in self.kids:
            one = Wrapper.of(k, k.tag if how == BY_TAG else k.label)
            kind = one.label, _size(one).bit_length() if how == BY_SIZE else 0
            if kind in by:
                merge(by[kind], one)
            else:
                by[kind] = one
        return list(by.values())

    def loosen(self, how: int) -> None:
        if self.loose < how:
            self.kids, self.loose = self.folded(how), how
            self.folds = {}

    def bound(self) -> None:
        """Makes nodes with too many kids looser, and of too large a tree the deepest first; no place of any page is lost."""
        self._narrow()
        levels = self.levels()
        if sum(map(len, levels)) > MOST_NODES:
            for how, depth in [(how, depth) for how in (BY_SIZE, BY_LABEL, BY_TAG, CLOSED) for depth in reversed(range(len(levels)))]:
                if sum(map(len, levels)) <= MOST_NODES // 2:
                    break
                for node in levels[depth] if depth < len(levels) else []:
                    if len(node.folded(how)) < len(node.kids):
                        node.loosen(how)
                    node.folds = {}
                levels = self.levels()
            self._narrow()

    def _narrow(self) -> None:
        below = [self]
        while below:
            node = below.pop()
            if len(node.kids) > IN_NO_ORDER:
                node.loosen(BY_SIZE)
            if len(node.kids) > 2 * WIDEST and node.loose == BY_SIZE:
                node.kids, node.folds = node._folded(BY_SIZE), {}  # some have grown to one size
            for how in (BY_LABEL, BY_TAG):
                if len(node.kids) > 2 * WIDEST:
                    node.loosen(how)
            below += node.kids


def _size(tree: Wrapper | Runs) -> int:
    return 1 + sum(map(_size, tree.kids))


def matching(a: Wrapper, b: Wrapper | Runs, memo: dict) -> tuple:
    """Simple tree matching: the most nodes that two trees can have matched, and which children match, both folded as the looser has them."""
    at = id(a), id(b)
    if at not in memo:
        memo[at] = (*_matching(a, b, memo), a, b)  # with the nodes, so that none else gets their places in memory
    return memo[at]


def _matching(a: Wrapper, b: Wrapper | Runs, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    how = max(a.loose, b.loose)
    ours, theirs = a.folded(how), b.folded(how)
    m, n = len(ours), len(theirs)
    memo["steps"] = memo.get("steps", 0) + (m * n if how <= BY_SIZE else n)
    if how == BY_SIZE:
        return _fitting(ours, theirs, memo)
    if how != ORDERED:
        places = {k.label: i for i, k in enumerate(ours)}
        names = [k.tag if how == BY_TAG else k.label for k in theirs]
        pairs = [(places[name], j) for j, name in enumerate(names) if name in places]
        return 1 + sum(matching(ours[i], theirs[j], memo)[0] for i, j in pairs), pairs
    if memo["steps"] > MOST_STEPS:
        pairs, i = [], 0
        for j in range(n):
            found = next((k for k in range(i, m) if ours[k].label == theirs[j].label), None)
            if found is not None:
                pairs.append((found, j))
                i = found + 1
        return 1 + len(pairs), pairs
    score = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            gain = matching(ours[i], theirs[j], memo)[0] if ours[i].label == theirs[j].label else 0
            score[i + 1][j + 1] = max(score[i][j] + gain, score[i][j + 1], score[i + 1][j])
    pairs, i, j = [], m, n
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + score[m][n], pairs[::-1]


def _fitting(ours: list[Wrapper], theirs: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Each of theirs goes to the smallest of ours that has all its nodes, or else most of them."""
    by: dict[str, list[int]] = {}
    for i in sorted(range(len(ours)), key=lambda i: _size(ours[i])):
        by.setdefault(ours[i].label, []).append(i)
    total, pairs = 1, []
    for j, kid in enumerate(theirs):
        most, best, whole = 0, -1, _size(kid)
        for i in by.get(kid.label, ()):
            score = matching(ours[i], kid, memo)[0]
            if score > most:
                most, best = score, i
            if score == whole:
                break
        if best >= 0:
            total += most
            pairs.append((best, j))
    return total, pairs


def merge(wrapper: Wrapper, tree: Wrapper) -> None:
    """Adds to the wrapper the nodes of the tree that match none of its own."""
    memo: dict = {}
    below = [(wrapper, tree)]
    while below:
        w, t = below.pop()
        pairs = {j: i for i, j in matching(w, t, memo)[1]}
        how = max(w.loose, t.loose)
        old, w.loose = w.folded(how), how
        kids, before = list(old), 0
        for j, kid in enumerate(t.folded(how)):
            if how == BY_SIZE:
                if j not in pairs or matching(old[pairs[j]], kid, memo)[0] < _size(kid):
                    own = next((k for k in kids if k.label == kid.label and _size(k).bit_length() == _size(kid).bit_length()), None)
                    if own is None:
                        kids.append(Wrapper.of(kid))
                    else:
                        merge(own, kid)
            elif j in pairs:
                own = old[pairs[j]]
                before = kids.index(own) + 1
                below.append((own, kid))
            else:
                kids.insert(before, Wrapper.of(kid))
                before += 1
        w.kids, w.folds = kids, {}


def _key(text: str) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _runs(page: Page) -> Runs:
    return Runs([page.root], page, [MOST_NODES])


def induced(made: Sequence[bytes]) -> bytes:
    """The packed wrapper of packed trees or wrappers of a host's pages."""
    if len(made) == 1:
        return made[0]
    wrapper = Wrapper.unpacked(made[0])
    for packed in made[1:]:
        merge(wrapper, Wrapper.unpacked(packed))
        wrapper.bound()
    return wrapper.packed()


@dataclass
class Slot:
    """What a slot of a wrapper holds, over all pages that have it."""

    pages: int = 0
    count: int = 0  # nodes
    mass: int = 0
    around: int = 0  # mass of what it stands in
    own: int = 0
    total: int = 0
    linked: int = 0
    titled: int = 0


def _aligned(wrapper: Wrapper, runs: Runs) -> int:
    """Gives runs the slots that they match; returns the mass of those that match none."""
    memo: dict = {}
    lost, below = 0, [(wrapper, runs)]
    while below:
        w, r = below.pop()
        r.slot = w.slot
        if w.loose == CLOSED:
            r.own = r.total
            continue
        pairs = {j: i for i, j in matching(w, r, memo)[1]}
        for j, kid in enumerate(r.kids):
            if j in pairs:
                below.append((w.kids[pairs[j]], kid))
            else:
                lost += kid.mass
    return lost


def _placed(runs: Runs) -> tuple[list[tuple[int, int]], list[tuple]]:
    """(block, slot) of all blocks, those without a slot by the nearest node above that has one; and for each slot its counts."""
    blocks: list[tuple[int, int]] = []
    held: dict[int, Slot] = {}
    below = [(runs, 0, runs.inner)]
    while below:
        r, slot, around = below.pop()
        if r.slot >= 0:
            slot = r.slot
            s = held.setdefault(slot, Slot(1))
            s.count += len(r.nodes)
            s.mass += r.mass
            s.around += around
            s.own += r.own
            s.total += r.total
            s.linked += r.linked
            s.titled |= r.titled
        blocks += [(i, slot) for n in r.nodes for i in n.blocks]
        first = {k.slot: k for k in reversed(r.kids)}
        below += [(k, slot, r.inner if first[k.slot] is k else 0) for k in r.kids]
    return sorted(blocks), [(k, s.count, s.mass, s.around, s.own, s.total, s.linked, int(s.titled)) for k, s in held.items()]


def content(wrapper: Wrapper, slots: dict[int, Slot]) -> set[int]:
    """The slots of a wrapper that are content."""
    none, kept = Slot(), set()

    def keep(node: Wrapper) -> None:
        kept.add(node.slot)
        pages = slots.get(node.slot, none).pages
        for k in node.kids:
            s = slots.get(k.slot, none)
            menu = k.tag in CONTAINERS and s.pages >= LEAST_PAGES and s.pages >= IN_MOST * pages and s.linked >= LINKED * s.total > 0
            if not menu:
                keep(k)

    def descend(node: Wrapper, inside: bool) -> None:
        heirs = []
        for k in node.kids:
            s = slots.get(k.slot, none)
            share = HOLDS_INSIDE if inside and k.tag != "article" else HOLDS
            if node.tag != "article" and k.tag in HOLDERS and s.mass > 0 and s.mass >= share * s.around and s.count <= REPEATS * s.pages:
                heirs.append(k)
        if not heirs:
            keep(node)
        for k in node.kids if heirs else []:
            s = slots.get(k.slot, none)
            if k in heirs:
                descend(k, inside or k.main)
            elif 2 * s.linked <= s.total and (k.tag in BESIDE or 2 * s.titled >= s.pages > 0):
                keep(k)

    descend(wrapper, False)
    return kept


def read_alone(page: Page) -> list[str]:
    """The content blocks of a page by a wrapper of its own."""
    runs = _runs(page)
    wrapper = Wrapper.of(runs)
    wrapper.numbered()
    _aligned(wrapper, runs)
    return _alone(page, runs, wrapper)


def _alone(page: Page, runs: Runs, wrapper: Wrapper) -> list[str]:
    blocks, counts = _placed(runs)
    kept = content(wrapper, {k: Slot(1, *rest) for k, *rest in counts})
    return [page.blocks[i][0] for i, slot in blocks if slot in kept]


def main_text(source: str | None) -> str:
    """The content blocks of a page that stands alone, joined by empty lines."""
    return "\n\n".join(read_alone(Page(source))) if source else ""


#: Slot of blocks that are content by their page's own wrapper.
OWN = -1
PARSED = "_content bigint, _blocks array<struct<slot:int,text:string,h:bigint>>, _slots array<struct<slot:int,count:bigint,mass:bigint,around:bigint,own:bigint,total:bigint,linked:bigint,titled:bigint>>"


def read_page(source: str | None, wrapper: Wrapper | None) -> tuple[int, list[dict], list[dict]]:
    """A hash of the page's texts, its blocks with slots, and the counts of its slots; only content where it is read alone."""
    page = Page(source or "")
    if wrapper is not None:
        runs = _runs(page)
        if _aligned(wrapper, runs) <= UNKNOWN * runs.inner:
            blocks, counts = _placed(runs)
            texts = [page.blocks[i][0] for i, _ in blocks]
            names = ("slot", "count", "mass", "around", "own", "total", "linked", "titled")
            return _key("\n".join(texts)), [{"slot": k, "text": t, "h": _key(t)} for (_, k), t in zip(blocks, texts, strict=True)], [dict(zip(names, c, strict=True)) for c in counts]
    return 0, [{"slot": OWN, "text": t, "h": 0} for t in read_alone(page)], []


def _unpacked(made: bytes | None, cache: dict[bytes, tuple[Wrapper, int]]) -> Wrapper | None:
    """The wrapper from its packed form; a task remembers some."""
    if not made:
        return None
    if made not in cache:
        if sum(n for _, n in cache.values()) > REMEMBERED:
            cache.clear()
        wrapper = Wrapper.unpacked(made)
        cache[made] = wrapper, len(wrapper.tags())
    return cache[made][0]


def shapes(pages: DataFrame) -> DataFrame:
    """_host, _made, _n: the different trees of each host's pages, packed, and how many pages have them."""
    rows = pages.where("html IS NOT NULL").select(host(F.col("url")).alias("_host"), "html")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = Counter((at, Wrapper.of(_runs(Page(source))).packed()) for at, source in zip(batch.column("_host").to_pylist(), batch.column("html").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([m for _, m in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["_host", "_made", "_n"])

    return rows.mapInArrow(run, "_host string, _made binary, _n bigint").groupBy("_host", "_made").agg(F.sum("_n").alias("_n"))


def wrappers(pages: DataFrame) -> DataFrame:
    """_host, _wrapper for the hosts with several pages, induced from all of them.

    The different trees of a host are dealt into parts of about MERGED_AT_ONCE,
    each part is merged into one wrapper, the trees of most pages first, and so
    are the wrappers of MERGED_AT_ONCE parts, until each host has one. A task
    holds one part at a time: some packed trees and a wrapper, all bounded, however
    many pages a host has.
    """
    trees = written(shapes(pages), "shapes")
    sizes = trees.groupBy("_host").agg(F.count("*").alias("_trees"), F.sum("_n").alias("_pages")).where("_pages > 1")
    sizes = written(sizes.select("_host", "_trees", F.ceil(F.col("_trees") / MERGED_AT_ONCE).alias("_parts")), "hosts")
    rows = join_hot(trees, sizes, ["_host"], "_trees", trees.count()).withColumn("_part", F.pmod(F.xxhash64("_made"), "_parts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("_host", "_part", "_parts", "_n", "_made")], strict=True))
        for (at, part, parts), group in groupby(sorted_rows, lambda row: row[:3]):
            *_, counts, made = zip(*group, strict=True)
            yield pa.RecordBatch.from_pydict({"_host": [at], "_part": [part], "_parts": [parts], "_n": [sum(counts)], "_made": [induced(made)]})

    before = None
    while True:
        dealt = rows.repartition("_host", "_part").sortWithinPartitions("_host", "_part", F.desc("_n"), "_made")
        merged = written(dealt.mapInArrow(run, "_host string, _part bigint, _parts bigint, _n bigint, _made binary"), "wrappers")
        if before is not None:
            forget(before)
        if (merged.agg(F.max("_parts")).first()[0] or 1) == 1:
            return merged.select("_host", F.col("_made").alias("_wrapper"))
        before = merged
        rows = merged.withColumns({"_part": F.floor(F.col("_part") / MERGED_AT_ONCE), "_parts": F.ceil(F.col("_parts") / MERGED_AT_ONCE)})


def parsed(pages: DataFrame, known: DataFrame) -> DataFrame:
    """page_id, url, _host of every row, with its blocks and the counts of its slots."""
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("_host")).join(known, "_host", "left")
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("h", pa.int64())]))
    counts = pa.list_(pa.struct([("slot", pa.int32()), *[(c, pa.int64()) for c in ("count", "mass", "around", "own", "total", "linked", "titled")]]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, tuple[Wrapper, int]] = {}
        for batch in slices(batches, "html"):
            found = [read_page(source, _unpacked(made, cache)) for source, made in zip(batch.column("html").to_pylist(), batch.column("_wrapper").to_pylist(), strict=True)]
            content_, blocks, slots = zip(*found, strict=True)
            arrays = [*[batch.column(c) for c in ("page_id", "url", "_host")], pa.array(content_, pa.int64()), pa.array(blocks, kind), pa.array(slots, counts)]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "_host", "_content", "_blocks", "_slots"])

    return rows.mapInArrow(run, f"page_id bigint, url string, _host string, {PARSED}")


def judged(read: DataFrame, known: DataFrame) -> DataFrame:
    """_host, _kept and _gone: the slots of each wrapper that are content, and the texts in them (slot, h) that are template.

    Pages of a host with equal texts count once. Counts are aggregated before
    they are shuffled; a task then has a wrapper and a row for each of its slots.
    """
    hashes = F.array_distinct(F.transform("_blocks", lambda b: F.struct(b["slot"].alias("slot"), b["h"].alias("h"), F.length(b["text"]).alias("n"))))
    once = read.where(F.size("_slots") > 0).groupBy("_host", "_content").agg(F.min(F.struct("_slots", hashes.alias("_texts"))).alias("_"))
    once = written(once.select("_host", "_._slots", "_._texts"), "layouts")
    sums = [F.sum(f"_s.{c}").alias(c) for c in ("count", "mass", "around", "own", "total", "linked", "titled")]
    slots = written(once.select("_host", F.explode("_slots").alias("_s")).groupBy("_host", F.col("_s.slot").alias("slot")).agg(F.count("*").alias("pages"), *sums), "slots")
    texts = once.select("_host", F.explode("_texts").alias("_t")).groupBy("_host", "_t").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    texts = texts.select("_host", F.col("_t.slot").alias("slot"), F.col("_t.h").alias("h"), (F.col("_t.n") * F.col("pages")).cast("bigint").alias("size"), F.col("pages").alias("has"))
    same = texts.join(slots.select("_host", "slot", "pages"), ["_host", "slot"]).where(F.col("has") >= CONSTANT * F.col("pages"))
    per = slots.groupBy("_host").agg(F.collect_list(F.struct("slot", "pages", "count", "mass", "around", "own", "total", "linked", "titled")).alias("_slots"))
    constant = same.groupBy("_host").agg(F.collect_list(F.struct("slot", "h", "size")).alias("_same"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slots = {x.pop("slot"): Slot(**x) for x in row["_slots"]}
                made = Wrapper.unpacked(row["_wrapper"])
                kept = content(made, slots)
                heads = sorted(k for k, tag in made.tags().items() if tag in HEADINGS)
                gone = [x for x in row["_same"] or [] if x["slot"] in kept and x["slot"] not in heads]
                if sum(x["size"] for x in gone) > MOST_CONSTANT * sum(slots[k].own for k in kept if k in slots):
                    gone = []
                gone = pa.array([[{"slot": x["slot"], "h": x["h"]} for x in gone]], pa.list_(pa.struct([("slot", pa.int32()), ("h", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array([row["_host"]]), pa.array([sorted(kept)], pa.list_(pa.int32())), gone, pa.array([heads], pa.list_(pa.int32()))], names=["_host", "_kept", "_gone", "_heads"])

    return known.join(per, "_host").join(constant, "_host", "left").mapInArrow(run, "_host string, _kept array<int>, _gone array<struct<slot:int,h:bigint>>, _heads array<int>")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null or empty html gives an empty text. Pages without a host are one
    host. Repeated rows each get theirs; an empty table gives none.
    """
    known = wrappers(pages)
    read = written(parsed(pages, known), "parsed")
    rules = written(judged(read, known), "layouts")
    rows = read.drop("_content", "_slots").join(rules, "_host", "left")
    # Of the content's blocks, template is what is constant before the first or after the last that varies and is no heading.
    is_content = lambda b: (b["slot"] == OWN) | F.array_contains("_kept", b["slot"])
    constant = lambda b: F.array_contains("_gone", F.struct(b["slot"].alias("slot"), b["h"].alias("h")))
    head = lambda b: F.array_contains("_heads", b["slot"])
    kinds = lambda b: F.when(b["slot"] == OWN, 2).when(constant(b), 0).when(head(b), 1).otherwise(2)
    rows = rows.withColumn("_content", F.transform(F.filter("_blocks", is_content), lambda b: F.struct(b["text"].alias("text"), F.coalesce(kinds(b), F.lit(2)).alias("kind"))))
    place = lambda found: F.array_position(F.transform(found, lambda b: b["kind"]), 2)
    rows = rows.withColumns({"_first": place(F.col("_content")), "_last": F.size("_content") + 1 - place(F.reverse("_content"))})
    kept = F.filter("_content", lambda b, i: (b["kind"] > 0) | (i + 1 > F.col("_first")) & (i + 1 < F.col("_last")))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
