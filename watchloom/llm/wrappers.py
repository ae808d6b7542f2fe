"""HTML extraction by wrappers: union-free expressions learned from pages of one host.

A page is read as a tree of block elements; inline markup belongs to the text
around it. A wrapper is such a tree without texts, whose nodes may be optional
or repeated and whose text slots know how much text and link text they held. Two
of them are aligned child by child: what matches is merged, a mismatch becomes
an optional group, and equal neighbours (also pairs and triples of them) become
a repeated group. So each task folds its pages into one wrapper per host, and
wrappers of several tasks fold into one in the same way, in two steps, so that a
hot host needs no large group.

The wrapper shows where a host keeps its main text: an article or main element,
else the deepest element that holds most text outside menus, adverts, forms and
the like. Pages are then read along that path. A page without it is its own
wrapper.

Given rows: null and empty html gives an empty text; a page without a url
belongs to the host "" with the others of its kind; repeated pages are read
alike; pages are read whole, elements nested deeper than ``DEEPEST`` count as
part of the one they are in.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.stored import stored
from watchloom.llm.words import pieces
from watchloom.session import ship_package

DEEPEST = 150
LONGEST_ROW = 64  # children of a wrapper node kept in order; beyond it, one group per kind
SALTS = 64

# Element kinds of HTML, and the words by which pages name what is not main text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul button".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript textarea template iframe svg math object xmp".split()
ENDS_PARAGRAPH = BLOCKS - set("option optgroup select button title head html body".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOT_MAIN = set("nav aside footer form head title dialog menu select option button fieldset".split())
NOT_MAIN_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
NOT_MAIN_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promotion related respond share sharing sidebar skip social sponsor sponsored "
    "subscribe toolbar topbar widget".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


class Node:
    """An element of a page: texts are (text, in a link) among its children."""

    __slots__ = ("tag", "kind", "main", "skip", "kids")

    def __init__(self, tag: str, attributes: str = ""):
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        # Whole names only: "no-sidebar" or "with-sidebar" say something about the main text beside it.
        names = f"{named.get('class', '')} {named.get('id', '')}".lower().split() if tag not in ("html", "body") else []
        role = named.get("role", "").lower()
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or bool(_NO_DISPLAY.search(named.get("style", "")))
        self.tag = tag
        self.main = tag in ("article", "main") or role == "main"
        self.skip = hidden or tag in NOT_MAIN or role in NOT_MAIN_ROLES or (
            not self.main and not NOT_MAIN_NAMES.isdisjoint(names))
        classes = sorted(re.sub(r"\d+", "0", c) for c in named.get("class", "").lower().split())
        self.kind = ".".join([tag, *classes]) + "!" * self.skip
        self.kids: list = []


def parse(page: str) -> Node:
    """Tree of the block elements of a page; scripts, styles and comments are left out."""
    root = Node("#root")
    stack, links, at = [root], 0, 0
    deeper: list[str] = []  # open elements below DEEPEST, which have no node

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].kids.append((page[at:upto], links > 0))

    def leave(tags: set[str], within: set[str]) -> None:
        for depth in range(len(deeper) - 1, -1, -1):
            if deeper[depth] in tags:
                del deeper[depth:]
                return
            if deeper[depth] in within:
                return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                del stack[depth:]
                deeper.clear()
                return
            if stack[depth].tag in within:
                return

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            text(len(page))
            return root
        text(token.start())
        at = token.end()
        if token[2] is None:
            continue
        tag, closing = token[2].lower(), bool(token[1])
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            stack[-1].kids.append(("\n", False))
        elif tag in RAW and not closing:
            if not token[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag in BLOCKS:
            links = 0 if tag not in VOID else links
            if closing:
                if tag in deeper:
                    while deeper.pop() != tag:
                        pass
                    stack[-1].kids.append(Node("hr"))
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        deeper.clear()
                        break
                continue
            if tag in ENDS_PARAGRAPH and (deeper[-1] if deeper else stack[-1].tag) == "p":
                (deeper or stack).pop()
            if tag in CLOSES:
                leave(*CLOSES[tag])
            node = Node(tag, token[3])
            if len(stack) < DEEPEST and not deeper:
                stack[-1].kids.append(node)
                if tag not in VOID:
                    stack.append(node)
            else:
                stack[-1].kids.append(Node("hr"))  # still a break between blocks
                if tag not in VOID:
                    deeper.append(tag)


# A wrapper node is a list: kind, optional, repeated, children, characters, characters in links.
KIND, OPTIONAL, REPEATED, KIDS, CHARS, LINKED = range(6)


def skeleton(node: Node) -> list:
    """A page's own wrapper."""
    kids: list[list] = []
    for kid in node.kids:
        if isinstance(kid, Node):
            kids.append(skeleton(kid))
        else:
            size = len(kid[0].strip())
            if size:
                if kids and kids[-1][KIND] == "#":
                    kids[-1][CHARS] += size
                    kids[-1][LINKED] += size * kid[1]
                else:
                    kids.append(["#", False, False, [], size, size * kid[1]])
    return [node.kind, False, False, folded(kids), 0, 0]


def merged(one: list, two: list) -> list:
    """One node for two of the same kind."""
    return [one[KIND], one[OPTIONAL] or two[OPTIONAL], one[REPEATED] or two[REPEATED],
            aligned(one[KIDS], two[KIDS]), one[CHARS] + two[CHARS], one[LINKED] + two[LINKED]]


def folded(row: list[list]) -> list[list]:
    """Neighbouring repeats of one, two or three nodes become repeated groups."""
    if len(row) > LONGEST_ROW:
        kinds: dict[str, list] = {}
        for node in row:
            known = kinds.get(node[KIND])
            kinds[node[KIND]] = node if known is None else merged(known, node)
            kinds[node[KIND]][REPEATED] |= known is not None
        return list(kinds.values())
    for size in (1, 2, 3):
        out: list[list] = []
        for node in row:
            out.append(node)
            while len(out) >= 2 * size and all(out[-k][KIND] == out[-k - size][KIND] for k in range(1, size + 1)):
                group = [merged(out[-2 * size + k], out[-size + k]) for k in range(size)]
                for member in group:
                    member[REPEATED] = True
                del out[-2 * size :]
                out += group
        row = out
    return row


def aligned(one: list[list], two: list[list]) -> list[list]:
    """Longest common order of kinds; what only one side has becomes optional."""
    if [n[KIND] for n in one] == [n[KIND] for n in two]:
        return [merged(a, b) for a, b in zip(one, two)]
    m, n = len(one), len(two)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if one[i][KIND] == two[j][KIND] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < m or j < n:
        if i < m and j < n and one[i][KIND] == two[j][KIND]:
            out.append(merged(one[i], two[j]))
            i, j = i + 1, j + 1
        elif j == n or (i < m and best[i + 1][j] >= best[i][j + 1]):
            out.append([*one[i][:OPTIONAL], True, *one[i][REPEATED:]])
            i += 1
        else:
            out.append([*two[j][:OPTIONAL], True, *two[j][REPEATED:]])
            j += 1
    return folded(out)


def weight(node: list) -> float:
    """Characters of main text below a node: link text counts against it."""
    if node[KIND].endswith("!"):
        return 0.0
    return node[CHARS] - 2.0 * node[LINKED] + sum(weight(k) for k in node[KIDS])


def main_path(wrapper: list) -> list[str]:
    """Kinds from below the root to the element that holds the main text."""
    found: list[tuple[float, int, list[str]]] = []

    def visit(node: list, path: list[str]) -> None:
        for kid in node[KIDS]:
            tag = kid[KIND].split(".")[0]
            if kid[KIND] != "#" and not kid[KIND].endswith("!"):
                here = [*path, kid[KIND]]
                if tag in ("article", "main"):
                    found.append((weight(kid), len(here), here))
                visit(kid, here)

    visit(wrapper, [])
    if found:
        top = max(w for w, _, _ in found)
        # The innermost of those that hold most of it: an article rather than the main element around it.
        return max((f for f in found if f[0] >= 0.5 * top), key=lambda f: (f[1], f[0]))[2]
    path, node = [], wrapper
    while True:
        total = weight(node)
        heavy = [k for k in node[KIDS] if k[KIND] != "#" and not k[REPEATED] and weight(k) > 0.7 * max(total, 1.0)]
        if not heavy or heavy[0][KIND].split(".")[0] in {"p", "pre", "blockquote"} | HEADINGS:
            return path
        node = heavy[0]
        path.append(node[KIND])


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, without what is not main text."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    def visit(here: Node, heading_only: bool) -> None:
        for kid in here.kids:
            if isinstance(kid, Node):
                flush()
                if not kid.skip:
                    visit(kid, (heading_only or kid.tag == "header") and kid.tag not in HEADINGS)
                flush()
            elif not heading_only:
                held.append(kid[0])

    visit(node, False)
    flush()
    return out


def along(node: Node, path: list[str]) -> list[Node]:
    """Elements of a page at a path of kinds."""
    level = [node]
    for kind in path:
        level = [kid for n in level for kid in n.kids if isinstance(kid, Node) and kid.kind == kind]
    return level


def main_text(page: str | None, path: list[str] | None) -> str:
    """Main text of a page at the host's path; blocks are two line ends apart."""
    tree = parse(page or "")
    places = along(tree, path) if path else []
    blocks = [b for place in places for b in blocks_of(place)]
    if not blocks:
        own = main_path(skeleton(tree))
        blocks = [b for place in (along(tree, own) if own else [tree]) for b in blocks_of(place)]
    return "\n\n".join(blocks)


def host_of(url: str | F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _fold_wrappers(key: str, rows: DataFrame) -> DataFrame:
    """Folds column ``wrapper`` of equal hosts (and equal ``key``)."""

    def run(table: pa.Table) -> pa.Table:
        wrapper = None
        for text in sorted(table.column("wrapper").to_pylist()):
            wrapper = json.loads(text) if wrapper is None else merged(wrapper, json.loads(text))
        return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [json.dumps(wrapper)]})

    keys = ["host", key] if key else ["host"]
    return rows.groupBy(*keys).applyInArrow(run, "host string, wrapper string")


def learned(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one wrapper per host as JSON, from all of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        salt = TaskContext.get().partitionId() % SALTS
        for piece in pieces(batches, "html"):
            for host, page in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
                own = skeleton(parse(page or ""))
                known[host] = own if host not in known else merged(known[host], own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(known), pa.string()), pa.array([salt] * len(known), pa.int32()),
             pa.array([json.dumps(w) for w in known.values()], pa.string())], ["host", "salt", "wrapper"])

    partial = pages.select("host", "html").mapInArrow(run, "host string, salt int, wrapper string")
    return _fold_wrappers("", _fold_wrappers("salt", partial))


def paths(wrappers: DataFrame) -> DataFrame:
    """(host, path) of the main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_path(json.loads(w)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.list_(pa.string()))], ["host", "path"])

    return wrappers.mapInArrow(run, "host string, path array<string>")


def extract(pages: DataFrame) -> DataFrame:
    """Replaces ``html`` by ``text`` and ``n_chars`` (code points); other columns are handed through."""
    ship_package(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars", "host", "path")]
    given = pages.select(*(f.name for f in kept), "html", host_of("url").alias("host"))
    wrappers = stored(learned(given), "wrappers")
    places = stored(paths(wrappers), "main-paths")
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            texts = [main_text(h, p) for h, p in zip(piece.column("html").to_pylist(), piece.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(f.name) for f in kept), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return given.join(places, "host", "left").select(*(f.name for f in kept), "html", "path").mapInArrow(run, schema)
