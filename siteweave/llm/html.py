"""Main text of web pages by composite text density.

For every node of a page's tree the composite density is its characters per
tag, weighted down by the share of link characters and link tags. A node's
density sum adds up its children's densities; the node of the largest sum holds
the article. The lowest density on the path from the body to that node is
the threshold, and every further subtree that reaches it, and is no boilerplate,
joins in page order, and so does loose text of the nodes on the path. If the node
lies in ``article`` or ``main`` elements, the outermost of these is the article, and
only further ``article`` and ``main`` elements join.

Boilerplate elements (menus, page headers, footers, sidebars, notices, adverts,
forms, reader comments) are known by tag, role and class words and are left out
before densities are taken, and so are scripts, styles and markup. Forms and class
words do not count on elements that wrap most of the page's text or its article.

Defined results: null and empty pages, and pages without text, give an empty
text; markup that ends early counts as ended there; repeated rows get repeated
results. Other columns than id, url and html are not read.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, inf, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import ship, slices

# Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
#: A start tag ends open elements of these kinds, unless one of the second kinds stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
BARRIERS = frozenset("table td th button".split())

# What tells boilerplate.
BOILERPLATE_TAGS = frozenset("nav aside footer menu button select dialog head object canvas audio video".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related share "
    "sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
MAIN_TAGS = frozenset(("article", "main"))

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip, self.marked = tag, parent, skip, False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def is_boilerplate(tag: str, attributes: str, parent: Node) -> bool:
    if tag in BOILERPLATE_TAGS:
        return True
    if tag == "header" and not within(parent, MAIN_TAGS):
        return True
    if tag in ("body", "html", "article", "main") or "=" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "role":
            if value in BOILERPLATE_ROLES:
                return True
        elif name == "aria-hidden":
            if value == "true":
                return True
    return False


def is_marked(tag: str, attributes: str) -> bool:
    """True for forms and for class and id words of boilerplate, which wrappers of whole pages have too."""
    if tag == "form":
        return True
    if tag in ("body", "html", "article", "main") or "=" not in attributes:
        return False
    return any(
        name.lower() in ("class", "id") and not BOILERPLATE_WORDS.isdisjoint(WORDS.findall((a or b or c).lower()))
        for name, a, b, c in ATTRIBUTE.findall(attributes)
    )


def within(node: Node | None, tags: frozenset) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(page: str) -> tuple[Node, list[Node]]:
    """The page's tree and its nodes in page order. Boilerplate keeps its place and is marked."""
    root = Node("body", None, False)
    nodes, here, at, size = [root], root, 0, len(page)
    closer: dict[str, re.Pattern] = {}
    while at < size:
        found = TAG.search(page, at)
        if found is None:
            text(here, page[at:])
            break
        if found.start() > at:
            text(here, page[at : found.start()])
        at = found.end()
        end, name, rest = found[1], found[2], found[3]
        if name is None:
            end, name, rest = found[4], found[5], found[6]
            if name is None:
                continue
        name = name.lower()
        if end:
            if name in ("body", "html"):
                continue
            node = here
            while node is not root and node.tag != name:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if name in RAW:
            if name not in closer:
                closer[name] = re.compile(rf"</{name}\s*>", re.I)
            done = closer[name].search(page, at)
            at = done.end() if done else size
            continue
        if name in ("body", "html"):
            continue
        if name in ENDS_P:
            here = closed(here, ("p",), BARRIERS)
        if name in ENDS:
            here = closed(here, *ENDS[name])
        node = Node(name, here, here.skip or is_boilerplate(name, rest, here))
        node.marked = is_marked(name, rest)
        here.children.append(node)
        nodes.append(node)
        if name not in VOID:
            here = node
    drop_marked(nodes)
    return root, nodes


def drop_marked(nodes: list[Node]) -> None:
    """Marked subtrees become boilerplate, unless they wrap the page: those with most of its characters outside links, or its article."""
    if not any(n.marked for n in nodes):
        return
    plain: dict[int, int] = {}
    under: set[int] = set()
    free = 0
    for node in nodes:
        own = sum(len(" ".join(c.split())) for c in node.children if type(c) is str)
        plain[id(node)] = own
        if node.marked or id(node.parent) in under:
            under.add(id(node))
        elif not within(node, ("a",)) if own else False:
            free += own
    for node in reversed(nodes):
        if node.skip or node.tag == "a":
            plain[id(node)] = 0
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
    wraps: set[int] = set()
    main = max((n for n in nodes if n.tag in MAIN_TAGS and not n.skip), key=lambda n: plain[id(n)], default=None)
    if main is not None and (main.tag == "main" or plain[id(main)] >= free):
        node = main
        while node is not None:
            wraps.add(id(node))
            node = node.parent
    most = plain[id(nodes[0])]
    for node in nodes[1:]:
        if node.parent.skip or (node.marked and id(node) not in wraps and 2 * plain[id(node)] <= most):
            node.skip = True


def text(node: Node, raw: str) -> None:
    if not node.skip:
        node.children.append(unescape(raw) if "&" in raw else raw)


def closed(here: Node, tags, barriers) -> Node:
    """Where one stands after the innermost open element of ``tags`` has ended, if no barrier is nearer."""
    node = here
    while node is not None and node.tag not in barriers:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return here


def measure(nodes: list[Node]) -> None:
    """Counts of whole subtrees, then densities and density sums; boilerplate counts for nothing."""
    for node in reversed(nodes):
        if node.skip:
            continue
        own = sum(len(" ".join(c.split())) for c in node.children if type(c) is str)
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        if not node.skip and node.chars:
            node.density = density(node, share)
            if node.parent is not None:
                node.parent.total += node.density


def density(node: Node, body_share: float) -> float:
    """Characters per tag; the more of them are links, the smaller the logarithm's value and the larger its base."""
    chars, tags = node.chars, max(node.tags, 1)
    plain = max(chars - node.link_chars, 1)
    base = log(chars / plain * node.link_chars + body_share * chars + e)
    value = chars / max(node.link_chars, 1) * (tags / max(node.link_tags, 1))
    return chars / tags * max(log(max(value, 1.0)), 0.0) / max(log(base), 0.05)


def chosen(nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    body = nodes[0]
    candidates = [n for n in nodes if n.total > 0]
    if not candidates:
        return [body]
    best = max(candidates, key=lambda n: n.total)
    path, node = [], best
    main = None
    while node is not None:
        path.append(node)
        if node.tag in MAIN_TAGS:
            main = node
        node = node.parent
    threshold = min(n.density for n in path)
    if main is not None:
        best = main
    on_path, out = set(map(id, path)), []

    def visit(node: Node) -> None:
        stack = [node]
        while stack:
            node = stack.pop()
            if node is best or (id(node) not in on_path and not node.skip and node.density >= threshold and (main is None or node.tag in MAIN_TAGS)):
                out.append(node)
                continue
            inside = with_loose_text(node) if main is None and id(node) in on_path else node.children
            stack.extend(c for c in reversed(inside) if type(c) is not str)

    visit(body)
    return out


def with_loose_text(node: Node) -> list[Node | str]:
    """A path node's children, where text that stands in the node itself, with the inline elements around it, is a node of its own."""
    out: list[Node | str] = []
    run: list[Node | str] = []

    def end() -> None:
        loose = sum(len(" ".join(c.split())) for c in run if type(c) is str)
        if loose > sum(c.link_chars for c in run if type(c) is not str):
            one = Node("p", None, False)
            one.children, one.density = list(run), inf
            out.append(one)
        else:
            out.extend(run)
        run.clear()

    for child in node.children:
        if type(child) is str or (child.tag not in BLOCK and not child.skip and child.total == 0):
            run.append(child)
        else:
            end()
            out.append(child)
    end()
    return out


def blocks(root: Node) -> list[str]:
    """The texts of a subtree's blocks; ``br`` is white space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(line).split())
        if joined:
            out.append(joined)
        line.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif type(node) is str:
            line.append(node)
        else:
            block = node.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            elif node.tag == "br":
                line.append(" ")
            if not node.skip:
                stack.extend(reversed(node.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    _, nodes = parse(page)
    measure(nodes)
    return "\n".join(b for node in chosen(nodes) for b in blocks(node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint").withColumnRenamed("id", id_col)
