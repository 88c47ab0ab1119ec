"""Main text of web pages by wrapper induction.

Pages of one host are aligned: their DOM trees are matched by simple tree matching, the largest ordered set of node
pairs with equal labels and matched parents. A node whose text is the same in nearly all aligned pages is template; the slots whose
text varies are content. Summed over all pages of a host, the varying text outside of menus, adverts and the like points out the
container of the article. A page's text is that of the container without what is template or plays such a role.

Equal pages of a host count once. Varying text may be an advert or a reader's comment, which no alignment can tell from an
article, so elements, roles and words of class names mark sides. Words never mark a page's main elements, and a host on which
they mark nearly all varying text is read without the marks that hold it.

A host of any size is aligned in groups of a few pages, dealt by hash; only counts leave a group, and they add up. Two trees are
matched with the memory of their nodes and of about 2 sqrt(n) rows of the longest pair of child lists; equal beginnings and ends of such lists
pair at once, so long tables of like rows cost their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.shared import pick, written

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# What the markup language says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the second set ends where one of the first begins; the third stops the search for it.
_IMPLIED = {
    **{t: (frozenset(["p"]), frozenset("button table td th caption".split())) for t in CLOSED_BY_BLOCK},
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    **{t: (frozenset("dt dd".split()), frozenset(["dl"])) for t in ("dt", "dd")},
    **{t: (frozenset("td th".split()), frozenset("table tr".split())) for t in ("td", "th")},
    "tr": (frozenset("tr".split()), frozenset("table tbody thead tfoot".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements, roles and words of class names or ids that are never article text.
SIDE_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea input dialog head title menu".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs menu nav navbar navigation sidebar widget "
    "widgets related recommended recommendations footer comment comments disqus respond replies pagination pager skip toolbar toc banner alert".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
#: Elements that words never mark; names beside which a header is the article's own; words that turn a mark around; words that links must bear out.
MAIN_TAGS = frozenset("html body main article".split())
OWN_WORDS = frozenset("post entry article story".split())
TURNING_WORDS = frozenset("no not has with without".split())
LINK_WORDS = frozenset("related recommended recommendations".split())
ARTICLES = frozenset(("article", "main"))
#: Elements an article may fill; those for its parts are none.
CONTAINERS = frozenset("html body main article section div center td content".split())


_MAIN_HEADING = re.compile(r">h1(?![^.>!])")
#: Ends the key of a node that only a word marks as side.
MARK = "!"


class Node:
    """``side``: no article text for certain; a key that ends in ``MARK``: side by a word alone, for all below it too."""

    __slots__ = ("tag", "key", "children", "side", "article", "ids")

    def __init__(self, tag: str, key: str, side: bool, article: bool):
        self.tag, self.key, self.side, self.article = tag, key, side, article
        self.children: list[Node | str] = []
        self.ids = (0, 0)


def parse(page: str) -> Node:
    """The DOM tree of any text; end tags without a start are passed over, open elements end with their parent."""
    root = Node("", "", False, False)
    stack, at, end = [root], 0, len(page)
    waits = False

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _IMPLIED:
            ends, stops = _IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in stops:
                    break
        parent = stack[-1]
        node = _element(tag, m[3], parent)
        parent.children.append(node)
        waits = waits or node.key.endswith(MARK + "?")
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            stop = close.start() if close else end
            if not node.side:
                node.children.append(page[at:stop])
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return _decide_links(root) if waits else root


def _element(tag: str, attributes: str, parent: Node) -> Node:
    side = parent.side or tag in SIDE_TAGS
    article = parent.article or tag in ARTICLES
    key, marked, own = tag.replace(MARK, ""), False, False
    if attributes and not attributes.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        said = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        # A page of widgets is no widget.
        names = [frozenset(re.split("[_-]+", name)) for name in said if not name.endswith(("-page", "_page"))]
        article = article or found.get("role") in ("main", "article")
        side = side or found.get("role") in SIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        side = side or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
        own = any(not n.isdisjoint(OWN_WORDS) for n in names)
        if tag not in MAIN_TAGS:
            words = SIDE_WORDS if article or own else SIDE_WORDS | HEADER_WORDS
            marked = any(not n.isdisjoint(words) and n.isdisjoint(TURNING_WORDS) for n in names)
        if "class" in found:
            # Numbers in class names count things; they do not tell layouts apart. The signs of paths and marks mean nothing here.
            key = f"{key}.{re.sub(f'[0-9>{MARK}]+', '', found['class']).strip()}"
        if marked and article and all(n.isdisjoint(SIDE_WORDS - LINK_WORDS) for n in names):
            # Within an article, lists of related pages are links; a part about related things is not.
            key += MARK + "?"
            marked = False
    return Node(tag, key + MARK if marked else key, side or tag == "header" and not article and not own, article)


def _decide_links(root: Node) -> Node:
    """Mark the nodes that wait for a look at their links: at least half of the text is linked."""
    waiting = [n for _, n in walk(root, None) if n.key.endswith(MARK + "?")]
    for node in waiting:
        linked = total = 0
        todo = [(node, False)]
        while todo:
            n, link = todo.pop()
            for c in n.children:
                if isinstance(c, Node):
                    todo.append((c, link or c.tag == "a"))
                else:
                    size = len("".join(c.split()))
                    total, linked = total + size, linked + size * link
        node.key = node.key[:-1] if 2 * linked >= total else node.key[: -1 - len(MARK)]
    return root


def own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def block_text(node: Node) -> str:
    """Text of a node and its inline parts; what other blocks inside it say is theirs."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag in INLINE:
            todo.extend(reversed(c.children or [" "]))
    return " ".join("".join(out).split())


class Shapes:
    """Numbers for subtrees: one for equal labels, one for equal labels and texts; and the largest matchings of labelled trees.

    A child's number is smaller than its parent's.
    """

    def __init__(self) -> None:
        self.shape: dict[tuple, int] = {}
        self.whole: dict[tuple, int] = {}
        self.kinds: list[tuple[str, tuple[int, ...], int]] = []
        self.below: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> None:
        order, todo = [], [root]
        while todo:
            n = todo.pop()
            order.append(n)
            todo.extend(c for c in n.children if isinstance(c, Node))
        for n in reversed(order):
            inner = [c for c in n.children if isinstance(c, Node)]
            form = (n.key, *[c.ids[0] for c in inner])
            shape = self.shape.setdefault(form, len(self.shape))
            if shape == len(self.kinds):
                self.kinds.append((n.key, form[1:], 1 + sum(self.kinds[c.ids[0]][2] for c in inner)))
            said = (n.key, *[c.ids[1] if isinstance(c, Node) else c for c in n.children])
            n.ids = (shape, self.whole.setdefault(said, len(self.whole)))

    def weight(self, x: int, y: int) -> int | None:
        """Pairs in the largest matching of two subtrees with matched roots; None where parts of them are not known yet."""
        if self.kinds[x][0] != self.kinds[y][0]:
            return 0
        if x == y:
            return self.kinds[x][2]
        if not self.kinds[x][1] or not self.kinds[y][1]:
            return 1
        known = self.below.get((x, y))
        return None if known is None else 1 + known

    def learn(self, xs: list[int], ys: list[int]) -> None:
        """Make the weights of all pairs of two child lists known, deeper ones first, without recursion."""
        todo = [(x, y) for x in dict.fromkeys(xs) for y in dict.fromkeys(ys) if self.weight(x, y) is None]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.below:
                todo.pop()
                continue
            px, py = list(self.kinds[x][1]), list(self.kinds[y][1])
            head, tail = trimmed(px, py)
            mx, my = px[head : len(px) - tail], py[head : len(py) - tail]
            missing = [(p, q) for p in set(mx) for q in set(my) if self.weight(p, q) is None]
            if missing:
                todo.extend(missing)
                continue
            sure = sum(self.kinds[p][2] for p in px[:head]) + sum(self.kinds[p][2] for p in px[len(px) - tail :])
            last = np.zeros(len(my) + 1, np.int64)
            for last in self.rows(mx, my, last):
                pass
            self.below[x, y] = sure + int(last[-1])
            todo.pop()

    def rows(self, xs: list[int], ys: list[int], first: np.ndarray) -> Iterator[np.ndarray]:
        """The rows below ``first`` of the table of best matchings of beginnings of ``xs`` and ``ys``; all weights are known."""
        if not ys:
            yield from (first for _ in xs)
            return
        names, where = np.unique(ys, return_inverse=True)
        names, weights = names.tolist(), {}
        last = first
        for x in xs:
            if x not in weights:
                if len(weights) > 64:
                    weights.clear()
                weights[x] = np.array([self.weight(x, y) for y in names], np.int64)[where]
            row = np.empty_like(last)
            row[0] = 0
            np.maximum(last[1:], last[:-1] + weights[x], out=row[1:])
            # A beginning is at least as good as each shorter one.
            last = np.maximum.accumulate(row)
            yield last

    def aligned(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Positions paired by a best matching of two child lists, from the kept rows at every ``step``-th place."""
        if not xs or not ys:
            return []
        self.learn(xs, ys)
        step = max(1, int(len(xs) ** 0.5))
        starts = [np.zeros(len(ys) + 1, np.int64)]
        starts.extend(row for i, row in enumerate(self.rows(xs, ys, starts[0]), 1) if i % step == 0)
        pairs, j = [], len(ys)
        for block in range((len(xs) - 1) // step, -1, -1):
            at = block * step
            table = [starts[block], *self.rows(xs[at : at + step], ys, starts[block])]
            i = len(table) - 1
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((at + i, j))
        return pairs


def trimmed(xs: list, ys: list) -> tuple[int, int]:
    """How many equal items two lists begin and end with. Pairing them loses nothing: no partner fits a subtree better than its equal."""
    most = min(len(xs), len(ys))
    head = 0
    while head < most and xs[head] == ys[head]:
        head += 1
    tail = 0
    while tail < most - head and xs[-1 - tail] == ys[-1 - tail]:
        tail += 1
    return head, tail


def match(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node]]:
    """Pairs of a largest simple tree matching of two trees whose roots are taken to match; ``shapes`` has numbered both.

    Children equal in text pair first where that costs no pair, then children equal in labels.
    """
    if shapes is None:
        shapes = Shapes()
        shapes.number(a)
        shapes.number(b)
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs = [c for c in x.children if isinstance(c, Node)]
        ys = [c for c in y.children if isinstance(c, Node)]
        for level in (1, 0):
            head, tail = trimmed([c.ids[level] for c in xs], [c.ids[level] for c in ys])
            todo.extend(zip(xs[:head], ys[:head]))
            if tail:
                todo.extend(zip(xs[-tail:], ys[-tail:]))
            xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        todo.extend((xs[i], ys[j]) for i, j in shapes.aligned([c.ids[0] for c in xs], [c.ids[0] for c in ys]))
    return pairs


def walk(node: Node, path: str | None = "") -> Iterator[tuple[str | None, Node]]:
    """All nodes in page order with their paths; none are built for ``path=None``."""
    todo = [(path, node)]
    while todo:
        at, n = todo.pop()
        yield at, n
        todo.extend((None if at is None else f"{at}>{c.key}", c) for c in reversed(n.children) if isinstance(c, Node))


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def align(pages: list[str]) -> tuple[dict[str, int], dict[tuple[str, str], int], int]:
    """From different pages of one host: characters of article-like text per path, in how many pages a node is constant, pages that count.

    Every tree is matched with the one of most nodes. Inline elements are parts of their block's text, which is
    constant as a whole or not; a text that no other aligned page shares is no template. A page that shares nine tenths of its text
    with that tree is another version of it: it tells nothing of the template and does not count.
    """
    trees = [parse(p) for p in pages]
    shapes = Shapes()
    for t in trees:
        shapes.number(t)
    sizes = [shapes.kinds[t.ids[0]][2] for t in trees]
    seed = trees[sizes.index(max(sizes))]
    paths = {id(n): p for p, n in walk(seed)}
    constant: dict[tuple[str, str], int] = {}
    counted = [seed]
    for tree in trees:
        if tree is seed:
            continue
        shared = [
            (paths[id(x)], said) for x, y in match(seed, tree, shapes)
            if not x.side and x.tag not in INLINE and (said := block_text(x)) and said == block_text(y)]
        total = sum(len(block_text(n)) for p, n in walk(tree) if not n.side and n.tag not in INLINE and not marked(p, []))
        if sum(len(said) for p, said in shared if not marked(p, [])) >= 0.9 * total > 0:
            continue
        counted.append(tree)
        for slot in shared:
            constant[slot] = constant.get(slot, 1) + 1
    varying: dict[str, int] = {}
    for tree in counted:
        for path, node in walk(tree):
            if not node.side and node.tag != "a":
                said = own_text(node)
                if said and (node.tag in INLINE or constant.get((path, block_text(node)), 0) < 0.9 * len(counted)):
                    varying[path] = varying.get(path, 0) + len(said)
    return varying, {(p, digest(s)): n for (p, s), n in constant.items()}, len(counted)


def freed(varying: dict[str, int]) -> list[str]:
    """Paths of the nodes marked by words that hold a main heading and nine tenths of the varying text outside other marks: they are the page, not a side of it.

    Outer ones are asked first.
    """
    out: list[str] = []
    while True:
        under: dict[str, int] = {}
        headed = set()
        for path, n in varying.items():
            first = marked(path, out)
            under[first] = under.get(first, 0) + n
            if first and _MAIN_HEADING.search(path, len(first)):
                headed.add(first)
        best = max(headed, key=lambda p: (under[p], p), default=None)
        if best is None or under[best] < 0.9 * (under[best] + under.get("", 0)):
            return out
        out.append(best)


def marked(path: str, free: list[str]) -> str:
    """The outermost node on a path that a word marks and that is not freed; empty if none."""
    at = -1
    while MARK in path and (at := path.find(f"{MARK}>", at + 1)) >= 0:
        if path[: at + 1] not in free:
            return path[: at + 1]
    return path if path.endswith(MARK) and path not in free else ""


def container(varying: dict[str, int]) -> str:
    """The path that holds the article: down from the root while one child keeps nearly all varying text.

    An element made for articles needs three fifths of it, any other 98 in 100.
    """
    total, at = sum(varying.values()), ""
    while True:
        below: dict[str, int] = {}
        for path, n in varying.items():
            if path.startswith(f"{at}>"):
                child = at + ">" + path[len(at) + 1 :].split(">", 1)[0]
                below[child] = below.get(child, 0) + n
        best = max(below, key=lambda p: (below[p], p), default=None)
        if best is None:
            return at
        tag = best.rsplit(">", 1)[1].split(".")[0].rstrip(MARK)
        if tag not in CONTAINERS or below[best] < (0.6 if tag in ARTICLES else 0.98) * total:
            return at
        at = best


def layout(varying: dict[str, int]) -> tuple[str, list[str]]:
    """The container of the article and the marked nodes that are no sides, from the varying text per path."""
    free = freed(varying)
    return container({p: n for p, n in varying.items() if not marked(p, free)}), free


def blocks(tree: Node, inside: str, free: list[str], template: set[tuple[str, str]]) -> list[str] | None:
    """Texts of the blocks inside every node of the path ``inside``, in page order; None if the page has no such node."""
    out: list[str] = []
    found = inside == ""
    run: list[str] = []

    def flush() -> None:
        said = " ".join("".join(run).split())
        run.clear()
        if said:
            out.append(said)

    # (path, node, taking text) to enter, or None to end a block.
    todo: list = [("", tree, inside == "")]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        if isinstance(item, str):
            run.append(item)
            continue
        path, node, taking = item
        if taking and (node.side or node.key.endswith(MARK) and path not in free or template and node.tag not in INLINE and (path, digest(block_text(node))) in template):
            continue
        if not taking and path == inside:
            taking = found = True
        if taking and node.tag == "br":
            run.append(" ")
            continue
        block = taking and node.tag not in INLINE
        if block:
            flush()
            todo.append(None)
        for c in reversed(node.children):
            if isinstance(c, Node):
                todo.append((f"{path}>{c.key}", c, taking))
            elif taking:
                todo.append(c)
    flush()
    return out if found else None


def main_text(page: str | None, inside: str | None, free: list[str], template: set[tuple[str, str]]) -> str:
    """The article of one page; a page without the host's container is taken by its own layout."""
    if not page:
        return ""
    tree = parse(page)
    found = blocks(tree, inside, free, template) if inside is not None else None
    if found is None:
        alone = {}
        for path, node in walk(tree):
            if not node.side and node.tag != "a" and (said := own_text(node)):
                alone[path] = alone.get(path, 0) + len(said)
        found = blocks(tree, *layout(alone), template) or []
    return "\n".join(found)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose (host, deal) the task has not met before; 16 bytes are remembered for each."""
    met = set()
    for b in batches:
        keep = []
        for host, deal in zip(b["host"].to_pylist(), b["deal"].to_pylist()):
            name = blake2b(f"{deal} {host}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            keep.append(name not in met)
            met.add(name)
        yield b.filter(pa.array(keep, pa.bool_()))


def wrappers(pages: DataFrame, group_pages: int = 16) -> DataFrame:
    """``host, inside, free, template`` per host of ``pages`` (``host, html, deal``), from all its different pages.

    ``deal`` is equal for equal pages only. They are dealt by it into groups of about ``group_pages``; equal ones meet and count once.
    Template are nodes constant in nine tenths of the counted pages of a host, of which there must be two.
    """
    sizes = written(pages.select("host", "deal").distinct().groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    singles = pages.mapInArrow(_first_of_each, "host string, html string, deal string")
    part = F.pmod(F.xxhash64("deal"), F.ceil(F.col("pages") / group_pages))
    # A join by host leaves all pages of a host in one place; the groups must not stay there. Copies of a page still left, one a task, fold here.
    dealt = singles.join(sizes, "host").select("host", part.alias("part"), "deal", "html").repartition("host", "part")
    dealt = dealt.groupBy("host", "part", "deal").agg(F.first("html").alias("html"))

    def induce(group: pa.Table) -> pa.Table:
        varying, constant, counted = align([h or "" for h in group["html"].to_pylist()])
        host = group["host"][0].as_py()
        rows = [(host, p, None, n) for p, n in varying.items()] + [(host, p, d, n) for (p, d), n in constant.items()]
        rows.append((host, None, None, counted if counted > 1 else 0))
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], ["host", "path", "said", "n"])

    votes = written(dealt.groupBy("host", "part").applyInArrow(induce, "host string, path string, said string, n long"), "votes")
    summed = votes.groupBy("host", "path", "said").agg(F.sum("n").alias("n"))
    counted = summed.filter("path is null").select("host", F.col("n").alias("pages"))
    template = (
        summed.filter("said is not null").join(counted.filter("pages >= 2"), "host").filter("n >= 0.9 * pages")
        .groupBy("host").agg(F.collect_list(F.struct("path", "said")).alias("template")))
    choose = F.udf(lambda slots: layout({s["path"]: s["n"] for s in slots}), "struct<inside: string, free: array<string>>", useArrow=True)
    inside = summed.filter("path is not null and said is null").groupBy("host").agg(choose(F.collect_list(F.struct("path", "n"))).alias("_l"))
    return inside.select("host", "_l.inside", "_l.free").join(template, "host", "left")


def extract(pages: DataFrame, group_pages: int = 16) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    A null page is empty and has an empty text. Pages without a readable host are one host of that kind.
    Repeated rows are extracted alike and all returned, and count once for the host; an empty table gives an empty one. Among equally good
    containers the last by path is taken. Other columns, of any name, are left out. A very long page costs its length where its
    lists are alike, at worst the product of the lengths of two lists that are not.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pick(pages, "page_id", "url", "html").withColumn("host", host)
    deal = F.sha2(F.coalesce("html", F.lit("")), 256)
    known = written(wrappers(rows.select("host", "html", deal.alias("deal")), group_pages), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, inside, free, template in zip(b.column(2), b.column(3), b.column(4), b.column(5)):
                said = {(t["path"], t["said"]) for t in template.as_py() or ()}
                texts.append(main_text(page.as_py(), inside.as_py(), free.as_py() or [], said))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "inside", "free", "template")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return joined.mapInArrow(run, f"{kinds}, text string, n_chars long")
