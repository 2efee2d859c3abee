"""Main text of web pages by wrapper induction.

Pages of a host are parsed into trees of elements, in which repeated siblings fold into one
iterated node. Pages with one tree have one layout. The layouts of a host are aligned with
that of the most pages by simple tree matching, the largest top-down matching that keeps
the order of siblings; that gives each node a place in the host's template. Places whose
text is the same on pages with different articles are constant, the others are slots.

What decides about a page: its region is its article elements, else its main ones, else all
of it; parts that by element, role or word of class or id are no article (menus, notices,
forms and the like) are out; of what remains, constant nodes are out too.

Layouts and places are rows, folded per task and combined by key. Neither has a bound, and
nothing depends on the order of pages or on their partitions.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.llm.storage import prepared, stored

#: Different texts with which a node varies, and nodes held by a task before it hands them on.
VALUES = 4
HELD_NODES = 50_000
#: Elements nested deeper become siblings, as in browsers: their text is kept.
DEPTH = 150
#: Different articles beside which a node is the same before it counts as constant, on pages
#: without and with an article element.
CONSTANT = 3
CONSTANT_INSIDE = 8

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# What HTML says about elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html dd dt li option tbody td tfoot th thead tr legend summary".split())
#: Opening one of these ends an open one of the set, up to the given container.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# What is never article, by element, by word of class or id, and by role.
NOT_TAGS = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map menu nav "
    "noscript object script select style svg template textarea title video".split()
)
NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement adverting alert banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies copyright disclaimer disqus footer login menu modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promotion related reply replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar widget".split()
)
NOT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())


class Node:
    """An element: name (tag and class), children (nodes and texts), and whether it is by
    its kind not article."""

    __slots__ = ("tag", "name", "children", "out", "holds")

    def __init__(self, tag: str, name: str, out: bool) -> None:
        self.tag, self.name, self.out = tag, name, out
        self.children: list = []
        self.holds = False  # an article or main element


def described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(name, not article, is main) of an element."""
    name, out, main = tag, tag in NOT_TAGS, tag == "main"
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                out = True
            elif key == "role":
                out = out or value.lower() in NOT_ROLES
                main = main or value.lower() == "main"
            elif value:
                words = [w.lower() for w in NAME_PART.findall(value)]
                name = f"{name}.{'-'.join(w for w in words if not w.isdigit())}"
                out = out or not NOT_WORDS.isdisjoint(words)
    return name, out, main


def parse(html: str) -> Node:
    """The tree of a page, however ill-formed."""
    root = Node("#root", "#root", False)
    stack = [root]
    at, raw_end = 0, None

    def close_to(tags: set, until: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    for token in TOKEN.finditer(html):
        start = token.start()
        if start < at:
            continue
        if start > at:
            stack[-1].children.append(html[at:start])
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            continue
        tag = tag.lower()
        if token[1] or token[4]:  # an end tag
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        attributes = token[3] or token[6] or ""
        if tag in CLOSES_P:
            close_to({"p"}, {"td", "th", "li", "button", "table", "object"})
        if tag in ENDS:
            close_to(*ENDS[tag])
        name, out, main = described(tag, attributes)
        node = Node(tag, name, out)
        stack[-1].children.append(node)
        if tag == "article" and not out or main:
            for above in stack:
                above.holds = True
        if tag in RAW and not attributes.endswith("/"):
            raw_end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = raw_end.end() if raw_end else len(html)
            node.out = True
        elif tag not in VOID and not attributes.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


class Folded:
    """A node of a folded tree: repeated siblings merged, with the digest of its own text."""

    __slots__ = ("name", "children", "nodes", "texts")

    def __init__(self, node: Node) -> None:
        self.name = node.name
        self.nodes = [node]
        self.texts: list[str] = []
        self.children: list[Folded] = []


def fold(node: Node) -> Folded:
    """Merge like siblings, also those that others part."""
    out = Folded(node)
    absorb(out, node)
    return out


def absorb(out: Folded, node: Node) -> None:
    for child in node.children:
        if isinstance(child, str):
            if not child.isspace():
                out.texts.append(child)
        elif child.tag not in RAW:
            like = next((c for c in out.children if c.name == child.name), None)
            if like is None:
                out.children.append(fold(child))
            else:
                like.nodes.append(child)
                absorb(like, child)


def preorder(tree: Folded) -> Iterator[Folded]:
    yield tree
    for child in tree.children:
        yield from preorder(child)


class Slot:
    """A node of a layout: its name, and whether its text is in the region of the article."""

    __slots__ = ("name", "children", "told")

    def __init__(self, name: str, told: bool) -> None:
        self.name, self.told = name, told
        self.children: list[Slot] = []


def layout_of(tree: Folded, told: list[Node]) -> str:
    """A folded tree as a line per node in preorder: depth, mark of the region, name."""
    region = {id(n) for n in told}
    lines: list[str] = []

    def walk(node: Folded, depth: int, within: bool) -> None:
        within = within or any(id(n) in region for n in node.nodes)
        lines.append(f"{depth}{'*' if within else ' '}{node.name}")
        for child in node.children:
            walk(child, depth + 1, within)

    walk(tree, 0, False)
    return "\n".join(lines)


def slots_of_layout(layout: str) -> list[Slot]:
    """The nodes of a layout in preorder, the root first."""
    out: list[Slot] = []
    above: list[Slot] = []
    for line in layout.split("\n"):
        depth, mark, name = re.fullmatch(r"(\d+)([* ])(.*)", line, re.S).groups()
        slot = Slot(name, mark == "*")
        del above[int(depth) :]
        if above:
            above[-1].children.append(slot)
        above.append(slot)
        out.append(slot)
    return out


def matched(a, b, memo: dict) -> tuple[int, list]:
    """Simple tree matching of two nodes of one name: (nodes matched, pairs of children)."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    gain = [[0] * n for _ in range(m)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            if x.name == y.name:
                gain[i][j] = 1 + matched(x, y, memo)[0]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((a.children[i], b.children[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[key] = best[m][n], pairs[::-1]
    return memo[key]


def aligned(layout: list[Slot], lead: list[Slot]) -> list[int]:
    """The place in the host's template of every node of a layout.

    Matched nodes share the place of the lead's node. What the lead lacks has the place that
    its names give, so that it is one place in all layouts; what the lead has in another
    order among siblings is a place apart.
    """
    out: list[int] = []
    memo: dict = {}

    def walk(node: Slot, like: Slot | None, path: str) -> None:
        out.append(digest([path]))
        pairs = {id(child): other for other, child in matched(like, node, memo)[1]} if like else {}
        names = {c.name for c in like.children} if like else set()
        for child in node.children:
            other = pairs.get(id(child))
            moved = "~" if other is None and child.name in names else ""
            walk(child, other, f"{path}/{moved}{child.name}")

    walk(layout[0], lead[0], "")
    return out


class Evidence:
    """What shows whether text is template: the least digests of the different texts, and of
    the different articles of pages that have one. As many as thresholds ask for are
    enough to tell counts below them exactly, in whatever order they come."""

    __slots__ = ("values", "articles")

    def __init__(self, values: Iterable[int] = (), articles: Iterable[int] = ()) -> None:
        self.values, self.articles = list(values), list(articles)

    def add(self, values: Iterable[int], articles: Iterable[int]) -> None:
        self.values = least(self.values, values, VALUES)
        self.articles = least(self.articles, articles, CONSTANT_INSIDE)


def least(held: list[int], more: Iterable[int], n: int) -> list[int]:
    new = [v for v in more if v not in held]
    return sorted({*held, *new})[:n] if new else held


def digest(texts: list[str]) -> int:
    joined = " ".join(" ".join(t.split()) for t in texts)
    return int.from_bytes(hashlib.blake2b(joined.encode("utf-8", "replace"), digest_size=7).digest(), "big")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def regions(root: Node) -> tuple[list[Node], bool]:
    """The article elements of a page, else its main ones, else all of it, and whether an
    element said so."""

    def find(node: Node, wanted) -> list[Node]:
        found = []
        for child in node.children:
            if isinstance(child, Node) and not (child.out and not child.holds):
                if wanted(child):
                    found.append(child)
                else:
                    found += find(child, wanted)
        return found

    articles = find(root, lambda n: n.tag == "article" and not n.out)
    mains = [] if articles else find(root, lambda n: n.tag == "main")
    return (articles or mains, True) if articles or mains else ([root], False)


class Page:
    """A parsed page: its layout, its nodes, and the blocks of its article."""

    def __init__(self, html: str | None) -> None:
        root = parse(html or "")
        told, inside = regions(root)
        tree = fold(root)
        self.layout = layout_of(tree, told)
        self.nodes = list(preorder(tree))
        self.blocks = blocks_of(told, inside, {id(n): i for i, f in enumerate(self.nodes) for n in f.nodes})


def article(blocks: list[tuple[str, tuple]], constant: Iterable[int] | None) -> str:
    """The blocks that hold any text which is not template, joined by blank lines."""
    gone = frozenset(constant or ())
    return "\n\n".join(text for text, nodes in blocks if not gone.issuperset(nodes))


def main_text(html: str | None, constant: Iterable[int] | None) -> str:
    """Blocks of the page's article joined by blank lines; empty if there is none. Constant
    are the numbers, in preorder, of the nodes of its folded tree whose text is template."""
    return article(Page(html).blocks, constant)


def blocks_of(told: list[Node], inside: bool, places: dict[int, int]) -> list[tuple[str, tuple]]:
    """Blocks of text of the region, each with the nodes that its text stands in."""
    blocks: list[tuple[str, tuple]] = []
    current: list = [[], 0, set()]  # texts, their length in links, nodes

    def flush() -> None:
        nonlocal current
        text = " ".join(unescape("".join(current[0])).split())
        # without an article element, lists of links are left out by block
        if text and (inside or 2 * current[1] <= len(text)):
            blocks.append((text, tuple(sorted(current[2]))))
        current = [[], 0, set()]

    # a stack, as trees may be deeper than Python's
    todo: list = [(n, False, False) for n in reversed(told)]
    while todo:
        node, linked, leaving = todo.pop()
        if isinstance(node, tuple):
            text, place = node
            current[0].append(text)
            if not text.isspace():
                current[2].add(place)
                current[1] += len(text) if linked else 0
            continue
        if leaving:
            flush()
            continue
        if node.out and not node.holds and not any(node is n for n in told):
            # what is left out parts words like any element of its kind
            if node.tag in BLOCK:
                flush()
            continue
        if node.tag == "header" and not inside:
            continue
        if node.tag == "br":
            current[0].append(" ")
            continue
        if node.tag in BLOCK or node.tag == "#root":
            flush()
            todo.append((node, False, True))
        linked = linked or node.tag == "a"
        place = places.get(id(node), -1)
        for child in reversed(node.children):
            todo.append(((child, place), linked, False) if isinstance(child, str) else (child, linked, False))
    flush()
    return blocks


def layout_key(host: str, layout: str) -> bytes:
    return hashlib.blake2b(f"{host}\n{layout}".encode("utf-8", "replace"), digest_size=16).digest()


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


LONGS = pa.list_(pa.int64())
LAYOUTS = "host string, key binary, layout string, pages long, nodes binary"
LAYOUT_FIELDS = pa.schema(
    [("host", pa.string()), ("key", pa.binary()), ("layout", pa.string()), ("pages", pa.int64()), ("nodes", pa.binary())]
)
PLACES = "host string, place long, key binary, at int, told boolean, inside boolean, texts array<long>, articles array<long>"
PLACE_FIELDS = pa.schema(
    [("host", pa.string()), ("place", pa.int64()), ("key", pa.binary()), ("at", pa.int32()), ("told", pa.bool_()),
     ("inside", pa.bool_()), ("texts", LONGS), ("articles", LONGS)]
)
EVIDENCE = "host string, place long, texts array<long>, articles array<long>"
EVIDENCE_FIELDS = pa.schema([("host", pa.string()), ("place", pa.int64()), ("texts", LONGS), ("articles", LONGS)])


def host_layouts(pages: DataFrame) -> DataFrame:
    """A row per host and layout from (url, html): pages, and the evidence of every node.

    Folded per task; a task that holds many nodes hands on what it has and starts anew.
    """

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            for url, html in zip(*(c.to_pylist() for c in batch.columns)):
                page, host = Page(html), host_of(url)
                state = held.get((host, page.layout))
                if state is None:
                    if size >= HELD_NODES:
                        yield packed(held)
                        held, size = {}, 0
                    state = held[host, page.layout] = [0, {}]
                    size += len(page.nodes)
                told = [digest([article(page.blocks, None)])]
                nodes = ((i, [digest(n.texts)], told) for i, n in enumerate(page.nodes) if n.texts)
                take(state, 1, nodes)
        if held:
            yield packed(held)

    def take(state: list, pages: int, nodes: Iterable[tuple]) -> None:
        state[0] += pages
        for at, values, articles in nodes:
            state[1].setdefault(at, Evidence()).add(values, articles)

    def packed(held: dict[tuple, list]) -> pa.RecordBatch:
        rows = []
        for (host, layout), (n, nodes) in held.items():
            data = pickle.dumps([(at, e.values, e.articles) for at, e in sorted(nodes.items())])
            rows.append((host, layout_key(host, layout), layout, n, data))
        return batch_of(rows, LAYOUT_FIELDS)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for batch in batches:
            out = []
            for host, _, layout, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, layout) != of:
                    if of is not None:
                        out.append(packed({of: state}))
                    of, state = (host, layout), [0, {}]
                take(state, n, pickle.loads(data))
            yield from out
        if of is not None:
            yield packed({of: state})

    partial = stored(pages.mapInArrow(learn, LAYOUTS), "layouts")
    return partial.repartition("key").sortWithinPartitions("key").mapInArrow(merge, LAYOUTS)


def template_places(layouts: DataFrame) -> DataFrame:
    """The place in its host's template of every node with text of every layout.

    Layouts are aligned by simple tree matching with the lead of the host, the layout of the
    most of its pages. A layout is aligned on its own, in any task.
    """
    leads = layouts.groupBy(F.col("host").alias("of")).agg(F.max_by("layout", F.struct("pages", "key")).alias("lead"))
    joined = layouts.join(leads, F.col("host").eqNullSafe(F.col("of")), "left")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, key, layout, data, lead in zip(*(c.to_pylist() for c in batch.columns)):
                slots = slots_of_layout(layout)
                places = aligned(slots, slots if lead == layout else slots_of_layout(lead))
                inside = not slots[0].told
                rows = [
                    (host, places[at], key, at, slots[at].told, inside, values, articles)
                    for at, values, articles in pickle.loads(data)
                ]
                if rows:
                    yield batch_of(rows, PLACE_FIELDS)

    return joined.select("host", "key", "layout", "nodes", "lead").mapInArrow(align, PLACES)


def place_evidence(places: DataFrame) -> DataFrame:
    """The evidence of each place over all layouts of its host, combined per task first."""

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Evidence] = {}
        for batch in batches:
            for host, place, values, articles in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, place) not in held and len(held) >= HELD_NODES:
                    yield packed(held)
                    held = {}
                held.setdefault((host, place), Evidence()).add(values, articles)
        if held:
            yield packed(held)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, Evidence()
        for batch in batches:
            done: dict[tuple, Evidence] = {}
            for host, place, values, articles in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, place) != of:
                    if of is not None:
                        done[of] = state
                    of, state = (host, place), Evidence()
                state.add(values, articles)
            if done:
                yield packed(done)
        if of is not None:
            yield packed({of: state})

    def packed(held: dict[tuple, Evidence]) -> pa.RecordBatch:
        return batch_of([(*of, e.values, e.articles) for of, e in held.items()], EVIDENCE_FIELDS)

    partial = places.select("host", "place", "texts", "articles").mapInArrow(combine, EVIDENCE)
    by_place = partial.repartition("host", "place").sortWithinPartitions("host", "place")
    return by_place.mapInArrow(merge, EVIDENCE)


def constant_nodes(pages: DataFrame) -> DataFrame:
    """(of, constant): the nodes of a layout's pages that hold template, by number, for each
    layout that has any.

    A node is constant where its place has one text on the host, beside articles that
    differ: pages that are copies of each other are one. It counts only in a region where
    other text varies.
    """
    layouts = stored(host_layouts(pages), "wrappers")
    places = stored(template_places(layouts), "places")
    evidence = place_evidence(places).select(
        F.col("host").alias("of_host"),
        F.col("place").alias("of_place"),
        F.when(F.size("texts") == 1, F.size("articles")).otherwise(0).alias("same"),
        (F.size("texts") >= VALUES).alias("varies"),
    )
    evidence = stored(evidence.where((F.col("same") >= CONSTANT) | F.col("varies")), "evidence")
    told = places.where("told").select("host", "place", "key", "at", "inside")
    match = F.col("host").eqNullSafe(F.col("of_host")) & F.col("place").eqNullSafe(F.col("of_place"))
    enough = F.col("same") >= F.when(F.col("inside"), CONSTANT_INSIDE).otherwise(CONSTANT)
    found = told.join(evidence, match).groupBy(F.col("key").alias("of"))
    found = found.agg(F.max("varies").alias("varied"), F.collect_list(F.when(enough, F.col("at"))).alias("constant"))
    return found.where(F.col("varied") & (F.size("constant") > 0)).select("of", "constant")


def extract_main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    A missing or empty html has no text. A missing url is a host of its own; a host with
    one page has no constant nodes. Repeated rows, and pages with the same article, get a
    row each and are one page where it is asked what is constant. Further columns are not
    looked at.
    """
    prepared(pages.sparkSession)
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html")
    )
    constant = stored(constant_nodes(rows.select("url", "html")), "constant")

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blocks = [], []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                page = Page(html)
                keys.append(layout_key(host_of(url), page.layout))
                blocks.append(pickle.dumps(page.blocks))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(blocks, pa.binary())],
                ["id", "url", "key", "blocks"],
            )

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            out = [article(pickle.loads(blocks), gone) for blocks, gone in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                [id_column, url_column, "text", "n_chars"],
            )

    by_layout = rows.mapInArrow(placed, "id long, url string, key binary, blocks binary")
    joined = by_layout.join(constant, F.col("key") == F.col("of"), "left").select("id", "url", "blocks", "constant")
    return joined.mapInArrow(extract, f"`{id_column}` long, `{url_column}` string, text string, n_chars long")
