"""Main text of web pages by site style trees.

Pages of one host are merged into one tree of all their elements, menus and adverts included. A node of the tree is an
element path: tag and class from the root, equal siblings once; its block elements are judged. For every node two kinds of importance are taken from
entropies over the host's pages:

* presentation: how evenly the pages spread over the different child sequences below the node. Varied sequences mean
  content; one sequence everywhere means template;
* content: for the texts that stand directly in the node, 1 - mean of log(pages with the text) / log(pages with the
  node). A text on every page (menus, notices) has importance 0, a text on one page 1. The fewer pages have a node, the less
  is known of it: its content importance is shrunk towards 1 as if one more page with a text of its own there had been seen.

A node's own importance is its presentation importance, or with texts (1 - DAMPING) of its content importance and DAMPING
of the other. Its composite importance is the mean of its own and all its descendants' importance, a node d steps below
counting GAMMA^d times its pages. A branch in which every node has composite importance under MIN_IMPORTANCE is noise and is
removed from each page of the host; texts that all pages share go from four pages on. Pages of a host with the same text
count once.

What says that it isn't the article, whatever its entropy (reader comments differ from page to page), goes by fixed lists:
elements such as nav and footer, and class words. Where a word is only a part of a class name, or a common word, or the
branch is a form, the branch stays if it holds more than half of the page's text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, only, ship
from lodestone.llm.textkit import blocks, lean

MIN_IMPORTANCE, DAMPING, GAMMA = 0.2, 0.1, 0.9
#: Key of the root, above all elements.
ROOT = 0
#: Removed branches up to which they are broadcast; beyond, Spark joins by host.
BROADCAST_PATHS = 200_000

# Fixed lists: HTML elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noframes noembed".split())
SILENT = set("head svg canvas object button select input math audio video datalist".split()) | RAW
AROUND = set("nav header footer aside menu dialog".split())
BREAKS = {"hr"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body"}
# Fixed lists: words of class, id and role attributes that name parts around the article.
CLEAR = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter pagination pager popup sidebar signup social sponsor sponsored subscribe toolbar contentinfo complementary".split()
)
LIKELY = CLEAR | set("comment disclaimer discussion notice notices promo related reply replies respond search share sharing skip tags teaser widget".split())
# Fixed list: of an article element, these only.
ASIDES = set("ad advert comment comments reply related promo teaser sponsored".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.DOTALL)
#: One attribute: its whole name, and its value. Matches follow one another, so a value is never searched for names.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """key: hash of the labels from the root. above: the key of the nearest block element around it, if any; silent: in an element without text of its own; around: listed outright; likely: the
    nearest listed branch that goes unless it holds most of the page (`outer`: the one around it); gone: in a branch that the
    tree removes."""

    __slots__ = ("tag", "key", "above", "silent", "around", "likely", "outer", "gone", "article", "kids", "block")

    def __init__(self, tag: str, label: str = "", parent: Node | None = None, silent: bool = False, around: bool = False):
        self.tag, self.kids = tag, []
        self.above: int | None = parent.block if parent else None
        self.key = child_key(parent.key, label) if parent else ROOT
        self.block = self.key if tag in BLOCK else self.above
        self.silent = silent or bool(parent and parent.silent)
        self.around = around or bool(parent and parent.around)
        self.likely: Node | None = parent.likely if parent else None
        self.outer: Node | None = None
        self.gone = bool(parent and parent.gone)
        self.article = tag == "article" or bool(parent and parent.article)


def listed(name: str, marks: list[str], in_article: bool = False) -> int:
    """2: around the article for certain, 1: likely, 0: not listed. The header element of an article has its title."""
    if name == "header" and in_article:
        return 0
    if name in AROUND:
        return 2
    if name in ("html", "body", "main"):
        return 0
    found = int(name == "form")
    for token in " ".join(marks).lower().split():
        if name == "article":
            found = max(found, 2 if token in ASIDES else int(not ASIDES.isdisjoint(re.split("[-_]", token))))
        elif name in HEADINGS and token in ("header", "masthead"):
            continue
        elif token in CLEAR:
            return 2
        elif token in LIKELY or not LIKELY.isdisjoint(re.split("[-_]", token)):
            found = 1
    return found


def walk(page: str, removed: set[int] | frozenset[int] = frozenset()) -> Iterator[tuple[str, Node, str]]:
    """Events of a page: ("open", node, ""), ("text", node, raw text), ("break", node, "") and ("close", node, "")."""
    stack, at, open_tags = [Node("")], 0, Counter()
    while m := TAG.search(page, at):
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "text", stack[-1], html.escape(m[0][9:-3], quote=False)
            continue
        if m[1] or m[4]:
            if open_tags[name]:
                while True:
                    node = stack.pop()
                    open_tags[node.tag] -= 1
                    yield "close", node, ""
                    if node.tag == name:
                        break
            elif name in BLOCK:
                yield "break", stack[-1], ""
            continue
        if name in CLOSES_P:
            # A block ends an open paragraph, with the inline elements in it.
            for k in range(len(stack) - 1, 0, -1):
                tag = stack[k].tag
                if tag == "p" or (tag == name and name in ("li", "dt", "dd", "tr", "td", "th")):
                    while len(stack) > k:
                        open_tags[stack[-1].tag] -= 1
                        yield "close", stack.pop(), ""
                    break
                if tag in BLOCK:
                    break
        marks, hidden = [], False
        for a in ATTRIBUTE.finditer(m[3] or m[6] or ""):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("class", "id", "role"):
                marks.append(value)
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
                hidden = True
        parent = stack[-1]
        label = name + ("." + re.sub(r"\d+", "0", " ".join(marks)).lower() if marks else "")
        found = listed(name, marks, parent.article)
        node = Node(name, label, parent, hidden or name in SILENT, found == 2)
        if found == 1:
            node.likely, node.outer = node, parent.likely
        if removed and not node.gone:
            node.gone = node.key in removed
        if not parent.kids or parent.kids[-1] != label:
            parent.kids.append(label)
        yield "open", node, ""
        if name in VOID or (m[3] or "").endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            # All up to the closing tag is text, whatever it looks like.
            end = re.compile(f"</{name}(?=[\\s/>]|$)", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                yield "text", node, page[at:stop]
            close = page.find(">", stop)
            at = len(page) if close < 0 else close + 1
            yield "close", node, ""
            continue
        stack.append(node)
        open_tags[name] += 1
    if at < len(page):
        yield "text", stack[-1], page[at:]
    while len(stack) > 1:
        yield "close", stack.pop(), ""


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def child_key(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, parent & (1 << 64) - 1) - (1 << 63)


def path_key(path: str) -> int:
    """Key of a node by its labels, each after a slash."""
    key = ROOT
    for label in path.split("/")[1:]:
        key = child_key(key, label)
    return key


def blocks_of(page: str, removed: set[int] | frozenset[int] = frozenset()) -> Iterator[tuple[Node, bool, str]]:
    """(block element, inside an article or main element, text) for every block of text."""
    stack: list[Node] = []
    parts: list[str] = []
    inside = 0
    root = owner = Node("")

    def flush() -> Iterator[tuple[Node, bool, str]]:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            yield owner, inside > 0, text

    for event, node, text in walk(page, removed):
        if event == "text":
            # Listed elements inside a block go without splitting it.
            if not node.silent and node.around == owner.around and node.likely is owner.likely:
                parts.append(text)
        elif event == "break":
            yield from flush()
        elif node.tag in VOID:
            if node.tag in BREAKS:
                yield from flush()
            elif node.tag == "br":
                parts.append(" ")
        elif node.tag in BLOCK:
            yield from flush()
            step = 1 if event == "open" else -1
            if event == "open":
                stack.append(node)
            elif stack:
                stack.pop()
            owner = stack[-1] if stack else root
            if node.tag in ("article", "main") and not node.around:
                inside += step
    yield from flush()


def tree_rows(page: str) -> tuple[int, list[int]]:
    """Key of a page's text; path key, kind, feature, path key, ... of the page, each once: kind 0 child sequences, 1 texts, 2
    the node itself, with the key of the node above it (ROOT: none). Nodes are block elements, which alone own texts."""
    rows: dict[tuple[int, int, int], None] = {}

    def add(node: Node, kind: int, feature: int) -> None:
        rows[node.key, 2, ROOT if node.above is None else node.above] = None
        rows[node.key, kind, feature] = None

    for event, node, _ in walk(page):
        if event == "close" and node.tag in BLOCK and not node.silent:
            add(node, 0, text_key("|".join(node.kids)))
    whole = xxhash.xxh64()
    for node, _, text in blocks_of(page):
        whole.update(text + "\n")
        add(node, 1, text_key(text))
    return whole.intdigest() - (1 << 63), [x for r in rows for x in r]


def main_text(page: str | None, removed: set[int] | frozenset[int] = frozenset()) -> str:
    """Blocks outside listed and removed branches, joined by an empty line; those of <article> or <main> only if they
    hold at least half of the characters. A page that would lose every block by the tree keeps them."""
    if not page:
        return ""
    found = [x for x in blocks_of(page, removed) if not x[0].around]
    # Branches in the order of their opening: outer ones first.
    branches: dict[int, Node] = {}
    chars: dict[int, int] = {}
    for node, _, text in found:
        new, branch = [], node.likely
        while branch is not None and id(branch) not in branches:
            new.append(branch)
            branches[id(branch)] = branch
            branch = branch.outer
        chars |= dict.fromkeys(map(id, reversed(new)), 0)
        if node.likely is not None:
            chars[id(node.likely)] += len(text)
    inner = list(chars)
    for at in reversed(inner):
        if branches[at].outer is not None:
            chars[id(branches[at].outer)] += chars[at]
    total = sum(len(text) for _, _, text in found)
    stays: dict[int | None, bool] = {id(None): True}
    for at in inner:
        stays[at] = stays[id(branches[at].outer)] and 2 * chars[at] > total
    found = [x for x in found if stays[id(x[0].likely)]]
    left = [x for x in found if not x[0].gone] or found
    inside = [t for _, own, t in left if own]
    most = 2 * sum(map(len, inside)) >= sum(len(t) for _, _, t in left)
    return "\n\n".join(inside if most else [t for _, _, t in left])


def style_tree(spark: SparkSession, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, path, parent, n_pages, content, presentation, importance, composite, most (the highest composite importance in
    the branch) of the nodes of each host's tree; pages: (host, html). Paths are hashes; a root's parent is null."""
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in blocks(batch, "html")):
            found = [tree_rows(page or "") for page in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in found], pa.int64()), pa.array([r for _, r in found], pa.list_(pa.int64()))], ["host", "key", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: Counter[tuple] = Counter()  # a page adds 1 to each of its features; summed here before the shuffle
            for host, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.update((host, *key) for key in zip(r[::3], r[1::3], r[2::3], strict=True))
            rows = [(*k, n) for k, n in sums.items()]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["host", "path", "kind", "feature", "n"])

    # One page for each text of a host: copies are no further evidence.
    once = pages.select("host", "html").mapInArrow(lean(parse), "host string, key long, rows array<long>").groupBy("host", "key").agg(F.min("rows").alias("rows"))
    counts = once.select("host", "rows").mapInArrow(lean(run), "host string, path long, kind int, feature long, n long").groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    per = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("n_pages"),
        F.min(F.when(F.col("kind") == 2, F.col("feature"))).alias("parent"),
        F.sum(F.when(F.col("kind") == 0, n)).alias("sequences"),
        F.sum(F.when(F.col("kind") == 0, n * F.ln(n))).alias("sequence_logs"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.ln(n))).alias("text_logs"),
    )
    m = F.ln(F.greatest(F.col("n_pages"), F.lit(2)).cast("double"))
    presentation = F.when(F.col("sequences") > 0, (F.ln("sequences") - F.col("sequence_logs") / F.col("sequences")) / m).otherwise(0.0)
    content = F.when(F.col("texts") > 0, F.greatest(1 - F.col("text_logs") / (F.col("texts") * m), F.lit(0.0)))
    shrunk = 1 - (1 - F.col("content")) * F.col("n_pages") / (F.col("n_pages") + 1)
    nodes = per.select("host", "path", F.when(F.col("parent") != ROOT, F.col("parent")).alias("parent"), "n_pages", content.alias("content"), presentation.alias("presentation")).withColumn(
        "importance", F.when(F.col("content").isNull(), F.col("presentation")).otherwise((1 - DAMPING) * shrunk + DAMPING * F.col("presentation"))
    )
    nodes = scratch.write(nodes, "nodes")
    weight = F.col("n_pages").cast("double")
    with_sums, ups = branch_totals(nodes.withColumn("sum", weight * F.col("importance")).withColumn("pages", weight), {"sum": GAMMA, "pages": GAMMA}, F.sum, scratch, "sums")
    nodes = with_sums.withColumn("composite", F.col("sum") / F.col("pages")).drop("sum", "pages").withColumn("most", F.col("composite"))
    nodes, _ = branch_totals(nodes, {"most": 1.0}, F.max, scratch, "most", ups)
    return nodes.select("host", "path", "parent", "n_pages", "content", "presentation", "importance", "composite", "most")


def branch_totals(nodes: DataFrame, columns: dict[str, float], total, scratch: Scratch, name: str, ups: list[DataFrame] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """`nodes` (host, path, parent, ...) with each column's total over the branch below a node, a node d steps below counting factor^d.

    After round k a node has the total of its branch to 2^k - 1 steps; it then adds those of the nodes 2^k steps below. The
    ancestors 2^k steps above are made by joining those of the round before with themselves (`ups`, which may be given again): as many
    rounds as the deepest page's depth has bits, and never more than a row a node.
    """
    known = ups is not None
    ups = ups if known else [scratch.write(nodes.where("parent is not null").select("host", "path", F.col("parent").alias("up")), f"{name}-up-0")]
    k = 0
    while k < len(ups):
        up = ups[k]
        if not known:
            if up.isEmpty():
                ups.pop()
                break
            again = up.select("host", F.col("path").alias("up"), F.col("up").alias("far"))
            ups.append(scratch.write(up.join(again, ["host", "up"]).select("host", "path", F.col("far").alias("up")), f"{name}-up-{k + 1}"))
        below = nodes.join(up, ["host", "path"]).groupBy("host", F.col("up").alias("path")).agg(*(total(F.col(c) * F.lit(f ** (1 << k))).alias(f"_{c}") for c, f in columns.items()))
        join = nodes.join(below, ["host", "path"], "left")
        merge = {F.sum: lambda c: F.col(c) + F.coalesce(f"_{c}", F.lit(0.0)), F.max: lambda c: F.greatest(c, f"_{c}")}[total]
        nodes = scratch.write(join.withColumns({c: merge(c) for c in columns}).drop(*(f"_{c}" for c in columns)), f"{name}-{k}")
        k += 1
    return nodes, ups


def removed_branches(tree: DataFrame) -> DataFrame:
    """host, removed array<long>: the tops of branches in which every node has low composite importance."""
    noise = tree.where(F.col("most") < MIN_IMPORTANCE)
    inner = noise.select("host", F.col("path").alias("parent"))
    return noise.join(inner, ["host", "parent"], "left_anti").groupBy("host").agg(F.collect_set("path").alias("removed"))


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    Null or empty html gives an empty text; null urls form one host; rows that repeat a page_id are extracted each; further
    columns are ignored; an empty table gives no rows. Texts are whole. The tree is built from all pages of a host, summed
    within tasks first.
    """
    ship(spark)
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    scratch = Scratch(spark, "style-tree")
    removed = scratch.write(removed_branches(style_tree(spark, rows, scratch)), "removed")
    scratch.drop("nodes")
    size = removed.agg(F.sum(F.size("removed"))).first()[0] or 0
    joined = rows.join(F.broadcast(removed) if size <= BROADCAST_PATHS else removed, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in blocks(batch, "html")):
            texts = [main_text(page, set(gone or ())) for page, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "removed").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
