"""Main text of web pages by a site style tree over the pages of each host.

Method: the DOMs of one host are merged by presentation path (block tags with their classes and ids,
numbers in them made equal). Every path has two importances, from the host's m distinct pages: of its
presentation, the entropy of its sequences of children over log(m), and of its content, one minus the
mean of log(n) / log(m) over its texts, n being the pages with that text. Both are drawn towards one
half by one page's weight, so a host of two pages is judged like one of a million, only less surely. The
importance of a branch is the mean of those of its paths, weighted by how often they occur and by
``DAMPING`` per level (presentations also by 1 - DAMPING**kinds of children). A branch goes if it and all branches
below it are of low importance; a single text goes if its own importance is low, as a strip that shares
its path with paragraphs is. In articles the limit is lower. A host of one distinct page has no tree.

Tags of the menu, footer, sidebar, form and script kinds go at once. Names (whole class or id names, or
compounds of listed words, never ``has-sidebar`` or ``related-news``) remove a container unless it holds a mark
(article or main); advert, comment and suggestion names unless it holds all marks; without marks, a weak name never
removes more than half of the text. Inside text elements only the strong names count. A mark breaks ties: the
marked text is returned alone if it is at least half of what is left, and if the tree would remove all of it, it stays.

Scale: one scan emits paths and texts as hashes, which are counted in partial aggregates, so a hot host is no
hot task; exact copies of a page count once. Texts on one page only never meet a join. The second scan cuts the
pages; the paths and texts to remove are a row per host (a text must be on about m**0.7 pages, so
the row grows like m**0.3), broadcast only after counting, otherwise joined (adaptive execution
splits a hot host). Elements deeper than ``DEEP`` levels share the path of their ancestor there. A page must
fit in a task's memory; nothing is capped.

Defined results: a null or empty html gives an empty text; a null url or one without ``://`` belongs
to the host ''; rows are returned one by one, repeated or not; malformed markup is read as it
comes, open elements end with their parent; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosieve.llm.arrays import pieces
from geosieve.llm.tables import BROADCAST_ROWS, map_arrow, small, written_with
from geosieve.llm.urls import split_url

TOKEN = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br math mi mn mo mrow msup msub msubsup mfrac msqrt mroot mtext mspace "
    "mover munder munderover mstyle semantics".split())
# Removed without ending the sentence they stand in.
QUIET = frozenset("script style noscript template button select textarea iframe svg canvas object audio video annotation".split())
REMOVED = QUIET | frozenset("nav footer aside option menu dialog head title datalist".split())
# Names of these count only if they are strong.
WORDED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dd dt address hr tr tbody".split())
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies gdpr newsletter breadcrumb "
    "breadcrumbs comment comments commentlist disqus reply replies respond related recommended recommendations "
    "pagination pager".split())
WEAK = frozenset(
    "promo promotion banner sidebar menu nav navbar navigation footer header masthead consent notice popup modal "
    "overlay subscribe subscription share sharing social widget toolbar login signup search skip".split())
# Words that may stand beside a listed one in a compound name.
BESIDE = frozenset(
    "site page main top bottom left right upper lower box bar block list wrapper wrap container section area slot unit "
    "item items link links form global primary secondary user reader google posts articles stories buttons button thread bottom "
    "message msg text holder panel group row col column inner outer js x".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = ("article", "main")
# An opening tag of the key ends an open element of the values.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LOW, LOW_INSIDE, DAMPING, DEEP = 0.3, 0.1, 0.9, 64
STYLE, TEXT, BRANCH, PAGE = range(4)  # kinds of rows of the tree
U64 = (1 << 63) - 1


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) & U64


class Node:
    """An open element; inline ones share the block they stand in."""

    __slots__ = ("tag", "path", "up", "block", "depth", "hard", "soft", "article", "marks", "size", "style", "out")

    def __init__(self, tag, path, up, depth, hard, soft, article):
        self.tag, self.path, self.up, self.depth, self.hard, self.soft, self.article = tag, path, up, depth, hard, soft, article
        self.block, self.marks, self.size, self.style, self.out = self, 0, 0, 0, False


@functools.lru_cache(1 << 14)
def named(names: str) -> int:
    """2 for a strong name of a removable part, 1 for a weak one, 0 for none."""
    found = 0
    for name in names.split():
        parts = re.findall("[a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if all(p in STRONG or p in WEAK or p in BESIDE for p in parts):
            found = max([found, *(2 if p in STRONG else 1 if p in WEAK else 0 for p in parts)])
    return found


def _open(tag: str, attributes: str, parent: Node) -> Node:
    names, role, hard, soft = "", "", parent.hard or tag in REMOVED, 0
    if attributes:
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        role = found.get("role", "").lower()
        if tag not in ("html", "body"):
            hard = hard or "hidden" in found
            if tag not in INLINE:
                soft = named(names) if names and tag != "main" else 0
                soft = 0 if soft == 1 and tag in WORDED else soft
                soft = 2 if role in ROLES else soft or int(found.get("aria-hidden") == "true")
    if tag in INLINE:
        node = Node(tag, parent.path, parent.up, parent.depth, hard, 0, parent.article)
        node.block = parent.block
        return node
    if tag == "form" or tag == "header" and not parent.article:
        soft = max(soft, 1)
    block = parent.block
    style = f"{tag} {re.sub('[0-9]+', '#', names)} {role}"
    block.style = _hash(f"{block.style} {style}")
    path = _hash(f"{block.path}/{style}") if block.depth < DEEP else block.path
    mark = (tag in MAIN or role in MAIN) and not hard and not soft
    node = Node(tag, path, block, block.depth + 1, hard, soft, parent.article or mark)
    node.marks = int(mark)
    return node


def parse(page: str, host: str = "") -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements, parents first, and (element, text) of each block of text in page order."""
    root = Node("", _hash(host), None, 0, False, 0, False)
    stack, words, nodes, blocks, at = [root], [], [root], [], 0

    def end_block():
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                blocks.append((stack[-1].block, text))

    for token in TOKEN.finditer(page):
        start, end = token.span()
        if start < at:
            continue  # inside a raw element
        if start > at and not stack[-1].hard:
            words.append(page[at:start])
        at = end
        tag = token.group(2) or token.group(5)
        if tag is None:
            continue
        tag, closing = tag.lower(), token.group(1) or token.group(4)
        if tag == "br":
            if not stack[-1].hard:
                words.append(" ")
            continue
        if tag not in INLINE and tag not in QUIET and not stack[-1].hard:
            end_block()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        attributes = token.group(3) if token.group(2) else token.group(6)
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, end)
            at = close.start() if close else len(page)
            continue
        if tag not in INLINE and tag not in QUIET:
            # A block ends an open paragraph; items end items of the same list.
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if open_tag == "p" or open_tag in ENDS.get(tag, ()):
                    del stack[i:]
                    break
                if open_tag not in INLINE:
                    break
        if not attributes.endswith("/") or tag not in INLINE and tag not in QUIET:
            stack.append(_open(tag, attributes, stack[-1]))
            if tag not in INLINE and not stack[-1].hard:
                nodes.append(stack[-1])
    if at < len(page) and not stack[-1].hard:
        words.append(page[at:])
    end_block()
    return nodes, blocks


def _kept(page: str, low: set[int], host: str = "") -> str:
    nodes, blocks = parse(page, host)
    for node, text in blocks:
        node.size += len(text)
    for node in reversed(nodes[1:]):
        node.up.size += node.size
        node.up.marks += node.marks
    root = nodes[0]
    for node in nodes[1:]:
        held = (node.marks and (node.soft == 1 or node.marks == root.marks)
                or not root.marks and node.soft == 1 and 2 * node.size > root.size)
        node.out = node.up.out or bool(node.soft) and not (held and node.tag not in WORDED)
    left = [(node, text) for node, text in blocks if not node.out]
    kept = [(node, text) for node, text in left if node.path not in low and node.path ^ _hash(text) not in low]
    marked = [text for node, text in kept if node.article] or [text for node, text in left if node.article]
    if marked and 2 * sum(map(len, marked)) >= sum(len(text) for _, text in kept):
        return "\n".join(marked)
    return "\n".join(text for _, text in kept)


def _tree(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, extra, n): on how many distinct pages a path has a child sequence or a text.

    ``extra`` tells paths in articles. Rows of kind BRANCH name an ancestor and its distance, the one row of
    kind PAGE counts the host's pages.
    """
    def work(batches):
        known: set[int] = set()
        for piece in pieces(batches, "html"):
            rows: list[tuple] = []
            for key, host, page in zip(*(piece.column(c).to_pylist() for c in ("key", "host", "html"))):
                if not page:
                    continue
                nodes, blocks = parse(page, host)
                own = _hash(page)
                seen = {(n.path, STYLE, n.style, n.article) for n in nodes if n.style}
                seen |= {(n.path, TEXT, _hash(t), n.article) for n, t in blocks}
                rows.append((key, 0, PAGE, 0, 0, own))
                rows += [(key, *s, own) for s in seen]
                for node in nodes:
                    if node.path not in known:
                        known.add(node.path)
                        above, far = node, 0
                        while above is not None:
                            if far == 0 or above.path != node.path:
                                rows.append((key, node.path, BRANCH, above.path, far, 0))
                            above, far = above.up, far + 1
                if len(known) > 1 << 20:
                    known.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.int64)) for c in zip(*rows)],
                                                 names=["host", "path", "kind", "value", "extra", "page"])

    rows = map_arrow(pages, work, "host long, path long, kind long, value long, extra long, page long")
    # Equal copies of a page count once.
    return rows.groupBy("host", "path", "kind", "value", "extra").agg(F.count_distinct("page").alias("n"))


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, path, importance, highest, inside, texts) of every path, and (host, path, text, importance,
    inside) of texts on two pages or more; ``pages`` has key, host and html. ``highest`` is the
    greatest importance of the branch's own branches."""
    tree, _ = written_with(_tree(pages), "style_tree")
    sizes, seen = written_with(tree.filter(F.col("kind") == PAGE).select("host", F.col("n").alias("m")).filter("m > 1"), "hosts")
    m, log_m = F.col("m"), F.log(F.col("m").cast("double"))

    def drawn(x):
        return (m * F.least(x, F.lit(1.0)) + 0.5) / (m + 1)

    def total(kind, value):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("double")

    n = F.col("n")
    sums = tree.filter(F.col("kind") <= TEXT).groupBy("host", "path").agg(
        *(total(k, v).alias(f"{a}{i}") for i, k in enumerate((STYLE, TEXT))
          for a, v in (("n", n), ("log", n * F.log(n.cast("double"))))),
        F.count_if(F.col("kind") == STYLE).alias("kinds"), F.max("extra").alias("inside"))
    presentation = drawn((F.log("n0") - F.col("log0") / F.col("n0")) / log_m)
    content = drawn(1 - F.col("log1") / F.col("n1") / log_m)
    often = F.col("n0") * (1 - F.pow(F.lit(DAMPING), F.col("kinds")))
    own = sums.join(small(sizes, seen["rows"]), "host").select(
        "host", "path", "inside", F.col("n1").alias("texts"), (often + F.col("n1")).alias("weight"),
        (F.when(F.col("n0") > 0, often * presentation).otherwise(0) + F.when(F.col("n1") > 0, F.col("n1") * content).otherwise(0)).alias("value"))
    own, _ = written_with(own, "paths")
    above = tree.filter(F.col("kind") == BRANCH).select("host", "path", F.col("value").alias("top"), F.col("extra").alias("far"))
    fade = F.pow(F.lit(DAMPING), F.col("far"))
    branches = above.join(own, ["host", "path"]).groupBy("host", F.col("top").alias("path")).agg(
        (F.sum(fade * F.col("value")) / F.sum(fade * F.col("weight"))).alias("importance"))
    highest = above.join(branches, ["host", "path"]).groupBy("host", F.col("top").alias("path")).agg(F.max("importance").alias("highest"))
    paths = own.select("host", "path", "inside", "texts").join(branches, ["host", "path"]).join(highest, ["host", "path"])
    texts = tree.filter(F.col("kind") == TEXT).filter("n > 1").join(small(sizes, seen["rows"]), "host").select(
        "host", "path", F.col("value").alias("text"), F.col("extra").alias("inside"),
        drawn(1 - F.log(n.cast("double")) / log_m).alias("importance"))
    return paths, texts


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row."""
    host = split_url(F.col(url_col))[0]
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                         host.alias("host"), F.xxhash64(host).alias("key"))
    paths, texts = style_tree(pages.select("key", "host", "html"))
    limit = F.when(F.col("inside") == 1, LOW_INSIDE).otherwise(LOW)
    low = paths.filter((F.col("texts") > 0) & (F.col("highest") < limit)).select("host", F.col("path").alias("low")).union(
        texts.filter(F.col("importance") < limit).select("host", F.col("path").bitwiseXOR(F.col("text")).alias("low")))
    low, seen = written_with(low.groupBy(F.col("host").alias("key")).agg(F.collect_set("low").alias("low")), "low_paths",
                             all=F.coalesce(F.sum(F.size("low")), F.lit(0)))
    right = F.broadcast(low) if (seen["all"] or 0) <= BROADCAST_ROWS else low.hint("merge")

    def work(batches):
        for piece in pieces(batches, "html"):
            columns = (piece.column(c).to_pylist() for c in ("html", "low", "host"))
            texts = [_kept(page, set(skip or ()), host) if page else "" for page, skip, host in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("url"), pa.array(texts, pa.string()),
                 pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=["id", "url", "text", "n_chars"])

    kind = pages.schema["id"].dataType.simpleString()
    return map_arrow(pages.join(right, "key", "left").select("id", "url", "html", "low", "host"), work,
                     f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
