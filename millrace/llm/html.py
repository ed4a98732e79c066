"""Main text of web pages by wrapper induction over the pages of a host.

A page is parsed into a tree of block elements in which like siblings are folded into one repeated node. The trees of a
host are aligned one after the other by simple tree matching into the host's template. For each node the template knows
on how many pages it stands, how much text and link text it holds, and whether its text is the same on all of them. Each
task unites the pages that it reads; the tasks' templates are united in rounds of FAN_IN, so no task sees more than that.

A template node whose text is constant on nearly all pages is template. The article's place is found in the template too:
from the root down, always into the element with most varying text outside of links, until no element below holds most of
it. An article or main element is evidence that outweighs that. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments named by their tags or attributes are template whatever their text. A page is
aligned to its host's template; what falls into the article's place, is not constant and not so named is its text. A page
without that place is judged by its own tree.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import defaultdict
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, only, table
from .urls import host_and_path

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title xmp iframe noembed noframes template".split())
NOISE = frozenset(
    "nav header footer aside form script style noscript template head title menu select option button iframe svg canvas object embed "
    "textarea label input dialog xmp noembed noframes audio video datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Words in class, id or role that name what isn't the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer foot sidebar aside complementary contentinfo widget notice notices cookie cookies consent alert popup modal newsletter subscribe "
    "signup login search share sharing social related recommended comment comments disqus replies reply form pagination pager toolbar skip copyright".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre section table ul".split()
)
INVISIBLE = frozenset("script style template link meta base source track param area".split())
HEAD = frozenset("head title meta link script style base noscript template".split())
#: Elements whose likes are folded wherever they stand among their siblings; others only in runs and alternations.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th blockquote pre figure figcaption address hr".split())
#: Elements that the search for the article's place goes into.
CONTAINERS = frozenset("#root html body div section article main center table tbody tr td".split())
#: First words of a class that say what is around, not what this is.
MODIFIERS = frozenset("no not non has have with without is show hide js".split())
#: Elements that no class makes noise, and the words that an article's class can.
SAFE = frozenset("html body main".split())
ARTICLE_NOISE = frozenset("ad ads advert advertisement sponsored promo related comment comments reply replies".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)>|[^<]++|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
COMMON_SHARE = 0.9
LEAST_PAGES = 3
MOST = 0.6  # share of the varying text that draws the search for the article's place further down
RARE = 256  # a node on less than this share of a template's pages is not template
SIZES_KEPT = 1 << 19  # sizes of mappings that a matching remembers
FAN_IN = 64


class Node:
    """A block element of a page, folded with its likes, or of a template, where the numbers are sums over pages."""

    __slots__ = ("tag", "name", "noise", "kids", "pages", "texts", "constant", "chars", "links", "shape", "folded", "likes")

    def __init__(self, tag: str, name: str, noise: bool):
        self.tag, self.name, self.noise, self.kids = tag, name, noise, []
        self.pages, self.texts, self.constant, self.chars, self.links, self.shape, self.folded, self.likes = 1, 0, None, 0, 0, 0, None, None


@lru_cache(maxsize=20_000)
def described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Name (tag and words of class, id and role), whether it names a header, and whether other noise, of a start tag."""
    words, noise, header = set(), tag in NOISE and tag != "header", tag == "header"
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for token in value.split():
                own = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                words.update(own)
                if own and own[0] not in MODIFIERS and tag not in SAFE:
                    bad = (ARTICLE_NOISE if tag == "article" else NOISE_WORDS).intersection(own)
                    header |= bool(bad) and bad <= {"header", "masthead"}
                    noise |= bool(bad - {"header", "masthead"})
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            noise |= tag not in SAFE
    return tag + ("." + ".".join(sorted(words)) if words else ""), header, noise


def parse(page: str, hashed: bool = True) -> tuple[Node, list[tuple[Node, str]]]:
    """The folded tree of a page, and its blocks of text in page order, each with its node; in time linear in the page.

    Comments, scripts and styles are left out. With ``hashed`` each node gets a hash of its texts in order.
    """
    root = Node("#root", "#root", False)
    stack: list[list] = [["#root", root, 0, 0]]  # tag, node unless inline, place here, open blocks beneath
    above: list[Node] = [root]  # the open block elements
    noisy = [False]
    articles = 0  # open article and main elements
    opened: dict[str, list[list]] = defaultdict(list)  # the open entries of each tag
    held: list[str] = []
    found: list[tuple[Node, str]] = []
    link = 0

    def flush():
        nonlocal link
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                node = above[-1]
                node.texts = 1
                node.chars += len(text)
                node.links += min(link, len(text))
                if hashed:
                    node.constant = xxhash.xxh64_intdigest(f"{node.constant}|{text}".encode("utf-8", "replace")) >> 1
                found.append((node, text))
        link = 0

    def pop():
        nonlocal articles
        entry = stack.pop()
        tag, node = entry[:2]
        if opened[tag] and opened[tag][-1] is entry:
            opened[tag].pop()
        if node is not None:
            flush()
            above.pop()
            noisy.pop()
            articles -= tag in ("article", "main")
            _fold(above[-1], node)

    def close_to(names, stops) -> None:
        at = max([opened[n][-1][2] for n in names if opened[n]], default=0)
        if at > max([opened[n][-1][2] for n in stops if opened[n]], default=0):
            while len(stack) > at:
                pop()

    at, end, lowered = 0, len(page), None
    last = page.rfind(">")
    while at < end:
        if at > last:  # no tag can end any more
            cut = page.find("<!--", at)
            held.append(page[at : cut if cut >= 0 else end])
            break
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                held.append(text)
                link += len(text.strip()) if opened["a"] else 0
            elif text.startswith("<![CDATA["):
                held.append(entities.escape(text[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                if tag == "p":
                    flush()
                continue
            entry = opened[tag][-1]
            if entry[1] is None and len(above) > entry[3]:
                opened[tag].pop()  # an inline element ends within blocks that go on
            else:
                while len(stack) > entry[2]:
                    pop()
            continue
        if opened["head"] and tag not in HEAD:
            close_to(("head",), ())
        if tag in P_CLOSERS:
            close_to(("p",), ("article", "section", "div", "table", "td", "button", "body"))
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            close_to(names.split(), stops)
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in RAW:
            if tag not in INVISIBLE:
                flush()
            if lowered is None:
                lowered = page.lower() if len(page.lower()) == end else page
            close = lowered.find("</" + tag, at)
            after = page.find(">", close) if close >= 0 else -1
            at = end if after < 0 else after + 1
            continue
        if tag in VOID or m[3].endswith("/") and not m[3].rstrip("/").endswith("="):
            if tag in ("br", "img"):
                held.append(" ")
            elif tag not in INVISIBLE and tag != "wbr":
                flush()
            continue
        name, header, noise = described(tag, m[3])
        # an article's own header holds its title
        worse = noise or header and not articles
        inline = tag in INLINE and not (worse and not noisy[-1])
        entry = [tag, None, len(stack), len(above)]
        stack.append(entry)
        opened[tag].append(entry)
        if inline:
            continue
        flush()
        entry[1] = node = Node(tag, name + "!" * worse, worse)
        above.append(node)
        noisy.append(noisy[-1] or worse)
        articles += tag in ("article", "main")
    while len(stack) > 1:
        pop()
    flush()
    root.shape = _shape(root)
    out = []
    for node, text in found:
        while node.folded is not None:
            node = node.folded
        out.append((node, text))
    return root, out


def _shape(node: Node) -> int:
    return xxhash.xxh64_intdigest(f"{node.name}{'#' * node.texts}({','.join([str(k.shape) for k in node.kids])})".encode("utf-8", "replace"))


def _fold(parent: Node, node: Node) -> None:
    """Hang a closed element on its parent: into a sibling of the same shape, after it, or not at all if it is empty."""
    if not node.texts:
        if not node.kids:
            return
        if len(node.kids) == 1 and node.kids[0].name == node.name:
            node = node.kids[0]  # an element that holds nothing but its like
    node.shape = _shape(node)
    kids = parent.kids
    like = None
    if node.tag in FLOW:
        if parent.likes is None:
            parent.likes = {}
        like = parent.likes.setdefault(node.shape, node)
        like = None if like is node else like
    elif kids and kids[-1].shape == node.shape:
        like = kids[-1]
    if like is not None:
        _merge_page(like, node)
        return
    kids.append(node)
    if len(kids) >= 4 and kids[-1].shape == kids[-3].shape and kids[-2].shape == kids[-4].shape and node.tag not in FLOW:
        _merge_page(kids[-4], kids[-2])
        _merge_page(kids[-3], kids[-1])
        del kids[-2:]


def _merge_page(into: Node, node: Node) -> None:
    """Add a subtree to one of the same shape on the same page."""
    todo = [(into, node)]
    while todo:
        a, b = todo.pop()
        if a.constant is not None and b.constant is not None:
            a.constant = xxhash.xxh64_intdigest(f"{a.constant}|{b.constant}") >> 1
        a.chars, a.links, b.folded = a.chars + b.chars, a.links + b.links, a
        todo += zip(a.kids, b.kids)


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += node.kids[::-1]
    return out


class Matching:
    """Largest mappings between the subtrees of two trees, of any size; subtrees of one structure are compared once."""

    def __init__(self):
        self.kinds: dict[int, int] = {}  # number of the structure of each node, by identity
        self.numbers: dict[tuple, int] = {}
        self.sizes: dict[tuple[int, int], int] = {}

    def kind(self, node: Node) -> int:
        if id(node) not in self.kinds:
            for n in reversed(preorder(node)):
                self.kinds[id(n)] = self.numbers.setdefault((n.name, *[self.kinds[id(k)] for k in n.kids]), len(self.numbers))
        return self.kinds[id(node)]

    def size(self, a: Node, b: Node) -> int:
        """Matched pairs of nodes in the largest mapping of two trees of one name."""
        x, y = a.kids, b.kids
        if not x or not y:
            return 1
        key = self.kind(a), self.kind(b)
        found = self.sizes.get(key)
        if found is None:
            if _same_names(x, y):
                found = 1 + sum([self.size(p, q) for p, q in zip(x, y)])
            else:
                weights, place = self.weights(x, y)
                row = np.zeros(len(y) + 1, dtype=np.int32)
                for w in weights:
                    row = _next_row(row, w, place)
                found = 1 + int(row[-1])
            if len(self.sizes) >= SIZES_KEPT:
                self.sizes.clear()  # they are found again when needed
            self.sizes[key] = found
        return found

    def weights(self, x: list[Node], y: list[Node]) -> tuple[list, np.ndarray]:
        """For each of x its sizes with the structures in y, None if no name is the same; and the structure of each of y."""
        first: dict[int, int] = {}
        named: dict[str, list[tuple[int, Node]]] = {}
        place = np.empty(len(y), dtype=np.intp)
        for j, q in enumerate(y):
            kind = self.kind(q)
            if kind not in first:
                first[kind] = len(first)
                named.setdefault(q.name, []).append((first[kind], q))
            place[j] = first[kind]
        found: dict[int, np.ndarray | None] = {}
        for p in x:
            kind = self.kind(p)
            if kind not in found:
                found[kind] = None
                if p.name in named:
                    sizes = np.zeros(len(first), dtype=np.int32)
                    for n, q in named[p.name]:
                        sizes[n] = self.size(p, q)
                    found[kind] = sizes
        return [found[self.kind(p)] for p in x], place

    def pairs(self, a: Node, b: Node) -> list:
        """Matched pairs of kids, each with those below; rows between every step-th are computed again on the way back."""
        x, y = a.kids, b.kids
        if not x or not y:
            return []
        if _same_names(x, y):
            return [(i, i, self.pairs(p, q)) for i, (p, q) in enumerate(zip(x, y))]
        weights, place = self.weights(x, y)
        step, starts, row = isqrt(len(x)) + 1, [], np.zeros(len(y) + 1, dtype=np.int32)
        for i, w in enumerate(weights):
            if i % step == 0:
                starts.append(row)
            row = _next_row(row, w, place)
        found, rows, low, i, j = [], [], len(x), len(x), len(y)
        while i and j:
            if i <= low:
                low = (i - 1) // step * step
                rows = [starts[low // step]]
                for w in weights[low:i]:
                    rows.append(_next_row(rows[-1], w, place))
            above, here, w = rows[i - 1 - low], rows[i - low], weights[i - 1]
            w = 0 if w is None else w[place[j - 1]]
            if w and here[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                found.append((i, j))
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
        return [(m, n, self.pairs(x[m], y[n])) for m, n in found[::-1]]


def _same_names(x: list[Node], y: list[Node]) -> bool:
    """Whether siblings differ in name and are those of the other tree, so that each can only match its like."""
    names = [k.name for k in x]
    return len(x) == len(y) and len(set(names)) == len(names) and names == [k.name for k in y]


def _next_row(row: np.ndarray, weights: np.ndarray | None, place: np.ndarray) -> np.ndarray:
    """Sizes of the largest mappings of one more sibling and those before it with each beginning of the others."""
    if weights is None:
        return row
    out = row.copy()
    np.maximum(row[1:], row[:-1] + weights[place], out=out[1:])
    return np.maximum.accumulate(out)


def match(a: Node, b: Node) -> tuple[int, list]:
    """Simple tree matching: the size of the largest order-keeping mapping of two trees, and the matched pairs of kids.

    Siblings that differ in name are aligned without search. Of mappings of one size the one that matches latest is taken.
    """
    if a.name != b.name:
        return 0, []
    pairs = Matching().pairs(a, b)
    size, todo = 1, [pairs]
    while todo:
        of = todo.pop()
        size += len(of)
        todo += [inner for *_, inner in of]
    return size, pairs


def _deep(f, *arguments):
    """Call with room for trees of any depth; calls of plain functions take no C stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1_000_000))
    try:
        return f(*arguments)
    finally:
        sys.setrecursionlimit(before)


def _add(a: Node, b: Node) -> None:
    if a.texts and b.texts:
        a.constant = a.constant if a.constant == b.constant else -1
    elif b.texts:
        a.constant = b.constant
    a.pages, a.texts, a.chars, a.links = a.pages + b.pages, a.texts + b.texts, a.chars + b.chars, a.links + b.links


def unite(whole: Node, other: Node) -> dict[int, Node]:
    """Put a tree into a template: matched nodes are added, others take their places in order.

    Returns the template's node of each of the tree's, by identity.
    """
    where: dict[int, Node] = {}
    todo = [(whole, other, _deep(match, whole, other)[1])]
    while todo:
        a, b, pairs = todo.pop()
        _add(a, b)
        where[id(b)] = a
        x, y, kids, i, j = a.kids, b.kids, [], 0, 0
        for m, n, inner in pairs:
            kids += x[i : m] + y[j:n]
            kids.append(x[m])
            todo.append((x[m], y[n], inner))
            i, j = m + 1, n + 1
        taken = {n for _, n, _ in pairs}
        for n, k in enumerate(y):
            if n not in taken:
                for node in preorder(k):
                    where[id(node)] = node
        a.kids = kids + x[i:] + y[j:]
    return where


def prune(whole: Node) -> None:
    """Drop the nodes that stand on too few of a template's pages."""
    for node in preorder(whole):
        node.kids = [k for k in node.kids if k.pages * RARE >= whole.pages]


def packed(root: Node) -> str:
    """A template as text: its nodes in page order with their depths."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        out.append([depth, node.tag, node.name, int(node.noise), node.pages, node.texts, node.constant, node.chars, node.links])
        todo += [(k, depth + 1) for k in reversed(node.kids)]
    return json.dumps(out, separators=(",", ":"))


def unpacked(text: str) -> Node:
    path: list[Node] = []
    for depth, tag, name, noise, *numbers in json.loads(text):
        node = Node(tag, name, bool(noise))
        node.pages, node.texts, node.constant, node.chars, node.links = numbers
        del path[depth:]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def is_constant(node: Node, pages: int) -> bool:
    """Whether a template node's text is the same on nearly all of at least LEAST_PAGES pages."""
    return node.texts > 0 and node.constant not in (None, -1) and node.texts >= LEAST_PAGES and node.texts >= COMMON_SHARE * pages


def region(whole: Node) -> list[Node]:
    """The nodes of a template that are the article's place: one, or several of one name beside each other."""
    mass: dict[int, int] = {}
    order = preorder(whole)
    for node in reversed(order):
        own = 0 if not node.texts or is_constant(node, whole.pages) else max(0, node.chars - node.links)
        mass[id(node)] = 0 if node.noise else own + sum([mass[id(k)] for k in node.kids])
    total = mass[id(whole)]
    if not total:
        return [whole]
    for wanted in ("article", "main"):
        found, todo = [], [whole]
        while todo:
            node = todo.pop()
            if node.noise:
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                todo += node.kids[::-1]
        best = max(found, key=lambda n: mass[id(n)], default=None)
        if best is not None and mass[id(best)]:
            return [n for n in found if n.name == best.name]
    node = whole
    while True:
        best = max(node.kids, key=lambda n: mass[id(n)], default=None)
        if best is None or not best.kids or best.tag not in CONTAINERS or mass[id(best)] < MOST * mass[id(node)]:
            return [node]
        # a heading before it belongs to it
        before = node.kids[: node.kids.index(best)]
        if node.tag not in ("#root", "html", "body") and any(k.tag in ("h1", "h2", "h3") and mass[id(k)] for k in before):
            return [node]
        node = best


def decide(tree: Node, whole: Node | None) -> list[bool] | None:
    """For each node of a page's tree, in page order, whether its text is content, by the template ``whole``; without one
    by the tree itself. None if the template's article place holds no text on this page."""
    own = whole is None
    whole = tree if own else whole
    place = {id(n) for n in region(whole)}
    out: list[tuple[bool, bool]] = []
    todo = [(tree, whole, _deep(match, whole, tree)[1], False, False)]
    while todo:
        t, at, pairs, inside, noisy = todo.pop()
        inside, noisy = inside or at is not None and id(at) in place, noisy or t.noise
        good = bool(t.texts) and inside and not noisy
        out.append((good and not (at is not None and is_constant(at, whole.pages)), good))
        to = {n: (at.kids[m], inner) for m, n, inner in pairs} if at is not None else {}
        todo += [(k, *to.get(n, (None, [])), inside, noisy) for n, k in reversed(list(enumerate(t.kids)))]
    if any([x for x, _ in out]):
        return [x for x, _ in out]
    if any([x for _, x in out]):
        return [x for _, x in out]  # all pages are copies, so nothing varies
    return [False] * len(out) if own else None


def article(page: str | None, whole: Node | None, known: dict) -> str:
    """Main text of a page; ``known`` keeps the decisions of one template by shape."""
    if not page:
        return ""
    tree, found = parse(page, hashed=False)
    chosen = known.get(tree.shape, False)
    if chosen is False:
        if len(known) > 20_000:
            known.clear()
        chosen = known[tree.shape] = decide(tree, whole)
    if chosen is None:
        chosen = decide(tree, None)
    content = {id(node) for node, good in zip(preorder(tree), chosen) if good}
    return "\n".join([text for node, text in found if id(node) in content])


def _united(batches):
    """(host, pages, template) of the pages of a task: one for each host, or more where hosts are very many."""
    whole: dict[str, Node] = {}
    shapes: dict[tuple[str, int], list[Node]] = {}

    def emit():
        out = [(host, t.pages, packed(t)) for host, t in whole.items()]
        whole.clear()
        shapes.clear()
        for k in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[k : k + 256]), (pa.string(), pa.int64(), pa.string()))], ["host", "pages", "template"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if not page:
                continue
            tree, _ = parse(page)
            if host not in whole:
                whole[host] = tree
                shapes[host, tree.shape] = preorder(tree)
                continue
            same = shapes.get((host, tree.shape))
            if same is not None:
                for a, b in zip(same, preorder(tree)):
                    _add(a, b)
            else:
                nodes = preorder(tree)
                where = unite(whole[host], tree)
                shapes[host, tree.shape] = [where[id(n)] for n in nodes]
            t = whole[host]
            if t.pages >= 2 * RARE and not t.pages & (t.pages - 1):
                prune(t)
                for key in [k for k in shapes if k[0] == host]:
                    del shapes[key]
        if len(whole) > 2000 or len(shapes) > 20_000:
            yield from emit()
    yield from emit()


def _unite_group(key, group):
    """One template of a group's templates, most pages first."""
    rows = sorted(zip(group["pages"].to_pylist(), group["template"].to_pylist()), key=lambda r: (-r[0], r[1]))
    whole = unpacked(rows[0][1])
    for _, text in rows[1:]:
        unite(whole, unpacked(text))
    if whole.pages >= 2 * RARE:
        prune(whole)
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([whole.pages], pa.int64()), pa.array([packed(whole)], pa.string())], ["host", "pages", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, template): a template for each host of (host, html), as a table."""
    schema = "host string, pages long, template string"
    found = durable(pages.mapInArrow(_united, schema))
    while True:
        most = found.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= 1:
            return found
        parts = -(-most // FAN_IN)
        part = F.pmod(F.xxhash64("template", "pages"), F.lit(parts)).cast("int")
        found = durable(found.groupBy("host", part.alias("part")).applyInArrow(_unite_group, schema), instead_of=found)


def extract(pages: DataFrame, broadcast_bytes: int = 32 << 20, frequent: int = 256) -> DataFrame:
    """(page_id, url, text): the article of each page; one row per input row.

    A null or empty html gives an empty text, as does a page without text outside of template parts. Host and template
    come from the url; pages without a host share one template. A host's only page is judged by its own elements alone.
    Other columns are ignored; repeated rows give repeated results; an empty table gives no rows. Templates go to every
    worker if they take no more than ``broadcast_bytes`` in all; beyond it only those of hosts with 1/``frequent`` of all
    pages, of which there can be no more than ``frequent``, go to every worker, and the others are joined by host.
    """
    url, host = F.col("url").cast("string"), host_and_path(F.col("url").cast("string"))[0]
    given = only(pages, "page_id", "url", "html").select("page_id", url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    found = templates(given.select("host", "html"))
    kind = given.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    row = found.agg(F.coalesce(F.sum(F.octet_length("template") + 64), F.lit(0)).alias("n"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages")).first()
    everywhere = found if row["n"] <= broadcast_bytes else found.filter(F.col("pages") * frequent >= row["pages"])
    shared = found.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in everywhere.select("host", "template").toLocalIterator()})

    def run(batches):
        return _articles(batches, shared.value)

    if row["n"] <= broadcast_bytes:
        return given.mapInArrow(run, schema)
    rare = found.filter(F.col("pages") * frequent < row["pages"]).select(F.col("host").alias("rare_host"), "template")
    # pages of frequent hosts are dealt by row, not by host
    key = F.when(F.col("host").isin(list(shared.value)), F.lit(None)).otherwise(F.col("host"))
    plain = given.filter(key.isNull()).mapInArrow(run, schema)
    joined = given.filter(key.isNotNull()).join(rare, F.col("host") == F.col("rare_host"), "left")
    return plain.unionByName(joined.select("page_id", "url", "html", "host", "template").mapInArrow(run, schema))


@lru_cache(maxsize=1024)
def _loaded(template: str | None):
    return (unpacked(template), {}) if template else (None, {})


def _articles(batches, shared):
    for batch in batches:
        hosts = batch.column("host").to_pylist()
        own = batch.column("template").to_pylist() if "template" in batch.schema.names else [shared.get(h) for h in hosts]
        texts = [article(page, *_loaded(t)) for t, page in zip(own, batch.column("html").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Edge cases as in ``extract``."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
