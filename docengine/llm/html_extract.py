"""Main text of web pages: a site style tree per host, and the meaning of elements and their names."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import slices, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|svg|math|textarea|iframe|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|href|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: A start of one of the first closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
FENCE = frozenset("ul ol dl table article section main body html div td th aside nav header footer form blockquote".split())
#: Elements, roles and words in class or id names that are not part of an article.
DROP_TAGS = frozenset("head nav footer aside form button select dialog menu object canvas audio video".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay"
    " newsletter subscribe subscription signup login sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond reply replies"
    " share sharing social related recommended recommendations widget widgets toolbar skip legal copyright pagination pager search tags".split()
)
HEADER_WORDS = frozenset(("header", "topbar", "branding"))
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
#: Containers that their place among equal siblings tells apart where they have no class or id, up to the place MOST_PLACES.
PLACED = frozenset("div section table ul ol dl td form aside nav header footer".split())
MOST_PLACES = 9
#: Elements nested deeper belong to the style node at this depth.
DEPTH = 64
#: What ends a piece of text that is counted as one feature.
PIECE = re.compile(r"[.!?;:|\u00b7\u2022]+")
#: A style node counts from so many pages; a branch goes if its importance is this far below its host's mean; pages that the same node on all hosts weighs; decay of a level.
LEAST_PAGES, GAP, PRIOR_PAGES, DECAY = 5, 0.1, 50, 0.9


class Node:
    """An open element: its place in the style tree and those above it, what says that it goes (a low branch, or a name), and whether it is inside an article or main part."""

    __slots__ = ("tag", "path", "chain", "low", "drop", "article", "main", "named", "places")

    def __init__(self, tag: str, path: int, chain: tuple[int, ...], low: bool, drop: bool, article: bool, main: bool, named: bool):
        self.tag, self.path, self.chain, self.low, self.drop, self.article, self.main, self.named = tag, path, chain, low, drop, article, main, named
        self.places: dict[str, int] = {}


class Parser:
    """Reads pages into blocks of text; holds the numbers of style paths that it has met, up to a limit."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}

    def path(self, parent: int, signature: str) -> int:
        if (p := self.paths.get((parent, signature))) is None:
            if len(self.paths) > 200_000:
                self.paths.clear()
            p = self.paths[parent, signature] = xxhash.xxh3_64_intdigest(f"{parent}>{signature}") - 2**63
        return p

    def read(self, page: str, low: frozenset[int] = frozenset(), tree: dict | None = None, links: list | None = None) -> list[tuple[str, Node]]:
        """(text, node) of each block, in page order; with tree, also path -> (paths above, paths of its children), with links also (path, target)."""
        root = Node("", 0, (), False, False, False, False, False)
        stack, blocks, pieces = [root], [], []
        holder = root

        def flush() -> None:
            if pieces:
                if text := " ".join(html.unescape("".join(pieces)).split()):
                    blocks.append((text, holder))
                pieces.clear()

        at = 0
        for token in TOKEN.finditer(page):
            top = stack[-1]
            if token.start() > at:
                if not pieces:
                    holder = top
                pieces.append(page[at : token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if not inline:
                flush()
            elif tag == "br":
                pieces.append(" ")
                if len(pieces) == 1:
                    holder = top
            if token["close"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if inline and stack[i].tag in FENCE:
                        break
                continue
            if tag in VOID:
                continue
            closes = CLOSES.get(tag) or (() if inline else {"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag[0] == "h" and tag[1:].isdigit() else {"p"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    break
                if stack[i].tag in FENCE:
                    break
            node = self.open(tag, token["attributes"], stack[-1], inline, links)
            if tree is not None and not inline:
                tree.setdefault(stack[-1].path, (stack[-1].chain, []))[1].append(node.path)
                tree.setdefault(node.path, (node.chain, []))
            if node.path in low and not inline and tag not in ("html", "body") and (node.named or not (node.article or node.main)):
                node.low = True
            if not token["attributes"].endswith("/") or tag not in ("br", "hr"):
                stack.append(node)
        if at < len(page):
            if not pieces:
                holder = stack[-1]
            pieces.append(page[at:])
        flush()
        return blocks

    def open(self, tag: str, attributes: str, parent: Node, inline: bool, links: list | None = None) -> Node:
        drop, named, signature = parent.drop or tag in DROP_TAGS, parent.named and parent.article, tag
        article, main = parent.article or tag == "article", parent.main or tag == "main"
        if tag == "header" and not article:
            drop = True
        if attributes and not attributes.isspace():
            words: set[str] = set()
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    value = re.sub(r"\d+", "0", value)
                    signature += f".{value}"
                    named = True
                    words.update(re.split(r"[^a-z]+", value))
                elif name == "href":
                    if links is not None and tag == "a" and value:
                        links.append((parent.path, value))
                elif name == "role":
                    drop = drop or value in DROP_ROLES
                    main = main or value == "main"
                    article = article or value == "article"
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    drop = True
            if tag not in ("html", "body", "article", "main"):
                if words & DROP_WORDS and not words & CONTENT_WORDS:
                    drop = True
                elif words & {"comments", "comment", "ad", "ads", "sidebar", "cookie"}:
                    drop = True
                elif words & HEADER_WORDS and not article and not words & CONTENT_WORDS:
                    drop = True
        if inline or len(parent.chain) >= DEPTH:
            return Node(tag, parent.path, parent.chain, parent.low, drop, article, main, named)
        if signature == tag and tag in PLACED:
            place = parent.places[tag] = min(parent.places.get(tag, 0) + 1, MOST_PLACES)
            signature = f"{tag}:{place}"
        return Node(tag, self.path(parent.path, signature), (*parent.chain, parent.path), parent.low, drop, article, main, named)


def main_text(parser: Parser, page: str, low: frozenset[int]) -> tuple[str, int, int]:
    """The blocks of a page's articles, else of its main part, else of all, without what goes; and how many blocks low branches and, of the others, names took away."""
    every = parser.read(page, low)
    kept = [(t, n) for t, n in every if not n.low]
    by_tree = len(every) - len(kept)
    blocks = [(t, n) for t, n in kept if not n.drop]
    for part in ("article", "main"):
        if any(getattr(n, part) for _, n in blocks):
            blocks = [(t, n) for t, n in blocks if getattr(n, part)]
            break
    return "\n".join(t for t, _ in blocks), by_tree, len(kept) - len(blocks)


def features(text: str) -> set[str]:
    """The pieces between a block's sentence marks, in lower case."""
    return {p for x in PIECE.split(text.lower()) if (p := x.strip())}


def _style_rows(pages: DataFrame) -> DataFrame:
    """(_host, _path, _chain, _kind, _value, _c): on how many of a batch's pages a style path has these children (kind 0, _value their hash, _chain the paths above) or holds this piece of text or link (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in slices(batches):
            counts: Counter = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree: dict = {}
                links: list = []
                blocks = parser.read(page, tree=tree, links=links)
                tree.setdefault(0, ((), []))
                counts.update((host, p, chain, 0, np.array(children, np.int64).tobytes()) for p, (chain, children) in tree.items())
                counts.update({(host, n.path, None, 1, piece) for t, n in blocks for piece in features(t)} | {(host, p, None, 1, f">{x}") for p, x in links})
            hosts, paths, chains, kinds, values = zip(*counts, strict=True) if counts else ((),) * 5
            hashes = [xxhash.xxh3_64_intdigest(v) - 2**63 for v in values]
            columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(chains, pa.list_(pa.int64())), pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_host", "_path", "_chain", "_kind", "_value", "_c"])

    return pages.mapInArrow(run, "_host string, _path long, _chain array<long>, _kind int, _value long, _c long")


def _spread(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _texts and _logs: how many features the nodes have, and the sum of the logarithms of the pages that have them; counts holds _value and _c."""
    of = counts.groupBy(*keys, "_value").agg(F.sum("_c").alias("_c"))
    return of.groupBy(*keys).agg(F.count("*").alias("_texts"), F.sum(F.log("_c")).alias("_logs"))


def style_tree(pages: DataFrame, prior_pages: int = PRIOR_PAGES) -> DataFrame:
    """_host, _path, _chain, _m, _all (pages that have it, on the host and on all hosts), _texts, _content, _styles, _importance: the nodes of the style trees of all hosts of pages (_host, _page), each with its own importance.

    Pages of one host are merged: a node is a style path, the elements (with class
    and id, else the place of a container among its equals) from the root down.
    Counts are aggregated in the tasks before every shuffle, so a host with a third of
    all pages is no hot key.

    Content: the features of a node are its pieces of text between sentence marks
    and its link targets. A feature on c of the node's m pages has the
    entropy log c / log m; the content importance is one less the mean over the
    distinct features, so copies of one article weigh as one text. A host with few
    pages says little about them: prior_pages pages of weight stand for the same node on
    the pages of all hosts.

    Presentation: the entropy of the distribution of a node's children over its pages.
    A node with both has their mean, weighted by DECAY in favour of content.
    """
    counted = written(_style_rows(pages.where("_host is not null")).groupBy("_host", "_path", "_chain", "_kind", "_value").agg(F.sum("_c").alias("_c")), "styles")
    m = F.col("_m").cast("double")
    styles = counted.where("_kind = 0").groupBy("_host", "_path", "_chain").agg(F.sum("_c").alias("_m"), F.sum(F.col("_c") * F.log("_c")).alias("_clogc"))
    styles = styles.withColumn("_styles", F.when(m > 1, 1 - F.col("_clogc") / (m * F.log(m)))).drop("_clogc")
    pieces = counted.where("_kind = 1")
    own = _spread(pieces, ["_host", "_path"])
    every = _spread(pieces, ["_path"]).withColumnsRenamed({"_texts": "_all_texts", "_logs": "_all_logs"}).join(styles.groupBy("_path").agg(F.sum("_m").alias("_all")), "_path")
    nodes = styles.join(own, ["_host", "_path"], "left").join(every, "_path", "left")
    here = F.when(m > 1, F.col("_logs") / F.col("_texts") / F.log(m))
    there = F.when(F.col("_all") > F.col("_m"), F.col("_all_logs") / F.col("_all_texts") / F.log("_all"))
    weight = F.when(there.isNotNull(), F.lit(float(prior_pages))).otherwise(0.0)
    content = 1 - (m * F.coalesce(here, F.lit(0.0)) + weight * F.coalesce(there, F.lit(0.0))) / (m + weight)
    nodes = nodes.withColumn("_content", F.when(F.col("_texts").isNotNull() & (here.isNotNull() | there.isNotNull()), content))
    both = (1 - DECAY) * F.col("_styles") + DECAY * F.col("_content")
    return nodes.select("_host", "_path", "_chain", "_m", "_all", "_texts", "_content", "_styles", F.coalesce(both, "_content", "_styles").alias("_importance"))


def low_branches(pages: DataFrame, least_pages: int = LEAST_PAGES, gap: float = GAP, prior_pages: int = PRIOR_PAGES) -> DataFrame:
    """(_host, _low): the style paths of each host's tree whose branches are to be removed.

    A branch's composite importance is the mean of its nodes' importance, by
    pages and by DECAY for each level down. A branch goes if neither it nor
    any branch inside it comes within `gap` of the host's own mean content importance
    (over all features of its nodes, most of which articles have; the mean of all hosts weighs as prior_pages features). Both are sums over
    pairs (node above, node) with partial aggregation. Nodes on fewer than least_pages pages of their
    host and fewer than prior_pages of all hosts are not judged. _low holds the tops of the removed branches only.
    """
    nodes = written(style_tree(pages, prior_pages).where((F.col("_m") >= least_pages) | (F.col("_all") >= prior_pages)), "nodes")
    pairs = nodes.where("_importance is not null").select("_host", "_path", "_m", "_importance", F.posexplode(F.concat(F.reverse("_chain"), F.array("_path"))).alias("_p", "_above"))
    down = F.when(F.col("_above") == F.col("_path"), 0).otherwise(F.col("_p") + 1)
    share = F.pow(F.lit(DECAY), down) * F.col("_m")
    composite = pairs.groupBy("_host", "_above").agg((F.sum(share * F.col("_importance")) / F.sum(share)).alias("_composite"))
    inner = nodes.select("_host", "_chain", F.col("_path").alias("_above")).join(composite, ["_host", "_above"])
    inner = inner.select("_host", "_composite", F.explode(F.concat("_chain", F.array("_above"))).alias("_path"))
    most = inner.groupBy("_host", "_path").agg(F.max("_composite").alias("_most"))
    sums = [F.coalesce(F.sum(F.col("_content") * F.col("_texts")), F.lit(0.0)).alias("_of"), F.coalesce(F.sum(F.when(F.col("_content").isNotNull(), F.col("_texts"))), F.lit(0)).alias("_n")]
    every = nodes.agg(*sums).select((F.col("_of") / F.nullif(F.col("_n"), F.lit(0))).alias("_mean"))
    base = nodes.groupBy("_host").agg(*sums).crossJoin(F.broadcast(every)).select("_host", ((F.col("_of") + prior_pages * F.col("_mean")) / (F.col("_n") + prior_pages)).alias("_base"))
    low = written(most.where("_path <> 0").join(base, "_host").where(F.col("_most") < F.col("_base") - gap).select("_host", "_path"), "low")
    parents = nodes.select("_host", "_path", F.try_element_at("_chain", F.lit(-1)).alias("_parent"))
    inside = low.withColumnRenamed("_path", "_parent").select("_host", "_parent")
    tops = low.join(parents, ["_host", "_path"]).join(inside, ["_host", "_parent"], "left_anti")
    return tops.groupBy("_host").agg(F.collect_set("_path").alias("_low"))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", carry: tuple[str, ...] = (), gap: float = GAP) -> DataFrame:
    """Main text of every page: _text (empty if none), _by_tree and _by_names (blocks removed as low branches, and those that were not but whose element, role or name is no part of an article), and carried columns as _carry_<name>.

    First the site style trees of all hosts; then each page is read again,
    without the branches that are unimportant on its host. What elements, roles or names mark as
    clutter or as an article decides the rest: unique clutter such as readers' comments, and hosts of few pages.
    Inside an article only branches
    with a class or id are judged by the tree, so that an article that is copied to
    all pages of a host stays. Of the rest, the articles count, else the main
    part, else everything. Character references are decoded, white space in a
    block becomes one space, blocks are joined by line feeds.

    The table of trees has one row per host, with as many paths as its tops of low
    branches. It is written out first: it is broadcast
    only if its files are below spark.sql.autoBroadcastJoinThreshold, else the join
    is shuffled, and adaptive execution splits a hot host.

    Null html is empty. Pages whose url is null or has no host are read
    without a tree. Broken markup never fails: what cannot be a tag is text.
    Repeated rows are pages of their own. Other columns are ignored, also those named like inner ones. An empty table gives no rows.
    """
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(host.alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_page"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    trees = written(low_branches(rows.select("_host", "_page"), gap=gap), "trees")
    joined = rows.join(trees, "_host", "left").drop("_host")
    names = [f"_carry_{c}" for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, nothing = Parser(), frozenset()
        for batch in slices(batches):
            found = [main_text(parser, page, frozenset(low) if low else nothing) for page, low in zip(batch.column("_page").to_pylist(), batch.column("_low").to_pylist(), strict=True)]
            texts, by_tree, by_names = zip(*found, strict=True)
            extra = [pa.array(texts, pa.string()), pa.array(by_tree, pa.int64()), pa.array(by_names, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *extra], [*names, "_text", "_by_tree", "_by_names"])

    kinds = "".join(f"`{c}` {t}, " for c, t in joined.dtypes if c in names)
    return joined.mapInArrow(run, f"{kinds}_text string, _by_tree long, _by_names long")
