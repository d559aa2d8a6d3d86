"""Main text of web pages, with a site style tree per host.

A page becomes blocks of text under labelled elements; navigation, page headers and
footers, sidebars, notices, adverts, forms and comments are left out by tag, role
or name.  For what is left, the pages of a host are merged into one tree of styles:
counts per (host, node, feature) give each node's entropy, over contents for nodes
that hold text and over child sequences for others.  Importance is combined from
the leaves up.  Branches of low importance, which repeat over the site, are removed
from each page, and so are content nodes: single texts that repeat in their node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.session import materialise

#: Elements without a place in the main text, whatever they hold.
NEVER = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input iframe svg canvas "
    "object audio video map dialog menu".split()
)
#: Whole names (class, id or role) that mark what is not main text.
NOT_MAIN = frozenset(
    "ad ads advert advertisement advertisements adverts sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead header topbar toolbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond pagination pager widget widgets "
    "contentinfo complementary search skip skiplink copyright legal disclaimer tags".split()
)
#: Names of elements that are left out even if they hold an article: those of comments and teasers.
_HOLD_ARTICLES = frozenset("related recommended recommendations comment comments commentlist disqus reply replies respond".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_DIGITS = regex.compile(r"\d+")


@lru_cache(maxsize=100_000)
def _number(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _above(named: tuple[str, ...]) -> str:
    """The style node over the last of an element's removable paths."""
    return named[-2] if len(named) > 1 else ""


class _Element:
    __slots__ = ("tag", "path", "dropped", "region", "named", "children", "names", "marked")

    def __init__(self, tag: str, path: str, dropped: bool, region: str, named: tuple[str, ...], names: frozenset[str], marked: tuple["_Element", ...]) -> None:
        self.tag, self.path, self.dropped, self.region, self.named = tag, path, dropped, region, named
        self.children: list[str] = []
        # names that leave it out, none once an article or main begins in it, and the elements around that had some
        self.names, self.marked = names, (*marked, self) if names else marked

    def left_out(self) -> bool:
        return any(e.names for e in self.marked)


class _Blocks(HTMLParser):
    """Blocks as (element, text), and element paths with the nodes over them and child sequences."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", "", False, "", (), frozenset(), ())]
        self.pieces: list[str] = []
        self.blocks: list[tuple[_Element, str]] = []
        self.nodes: list[tuple[str, str, str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text:
            holder = next(e for e in reversed(self.stack) if e.tag not in _INLINE)
            self.blocks.append((holder, text))

    def _pop(self, depth: int) -> None:
        if any(e.tag not in _INLINE for e in self.stack[depth:]):
            self.flush()
        for element in self.stack[depth:]:
            if element.path in element.named and not element.dropped and element.children:
                self.nodes.append((element.path, _above(element.named), " ".join(element.children)))
        del self.stack[depth:]

    def _find(self, tags: tuple[str, ...], limits: tuple[str, ...] = ()) -> int:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in tags:
                return depth
            if self.stack[depth].tag in limits:
                break
        return 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            if tag in ("br", "hr", "wbr"):
                self.pieces.append("" if tag == "wbr" else " ")
            if tag == "hr":
                self.flush()
            return
        if tag not in _INLINE:
            if depth := self._find(("p",), ("button", "table", "td", "th", "object")):
                self._pop(depth)
            if tag in _CLOSED_BY and (depth := self._find(_CLOSED_BY[tag], _LISTS[tag])):
                self._pop(depth)
            self.flush()
        known = dict(attrs)
        names = f"{known.get('class') or ''} {known.get('id') or ''} {known.get('role') or ''}".lower().split()
        above = self.stack[-1]
        label = tag + "".join(f".{_DIGITS.sub('0', n)}" for n in sorted((known.get("class") or "").split()[:3]))
        path = f"{above.path}/{label}"
        hidden = "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in (known.get("style") or "").replace(" ", "")
        dropped = above.dropped or tag in NEVER or hidden
        marks = NOT_MAIN.intersection(names) if tag not in ("html", "body", "article", "main") else frozenset()
        region = above.region
        if tag in ("article", "main") and not dropped:
            region = "article" if "article" in (tag, region) else tag
            for element in above.marked:
                element.names &= _HOLD_ARTICLES
        if tag == "header" and region != "article":
            dropped = True
        if above.tag == "header" and tag not in _HEADINGS and tag not in ("div", "hgroup") and tag not in _INLINE:
            dropped = True
        named = above.named if tag in ("html", "body", "article", "main") else (*above.named, path)
        above.children.append(label)
        self.stack.append(_Element(tag, path, dropped, region, named, marks, above.marked))

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        limits = () if tag not in _INLINE else tuple({e.tag for e in self.stack} - _INLINE)
        if depth := self._find((tag,), limits):
            self._pop(depth)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].dropped:
            self.pieces.append(data)

    def finish(self) -> None:
        self.close()
        self._pop(1)
        self.flush()


def blocks_of(html: str) -> tuple[list[tuple[str, tuple[str, ...], str]], list[tuple[str, str, str]]]:
    """Blocks (path, removable paths, text) of a page's main part, and its element nodes."""
    parser = _Blocks()
    parser.feed(html)
    parser.finish()
    kept = [(e, text) for e, text in parser.blocks if not e.left_out()]
    # an article among teasers or comments is the page's own if there is nothing else
    kept = kept or [(e, text) for e, text in parser.blocks if e.region]
    for region in ("article", "main", ""):
        chosen = [(e.path, e.named, text) for e, text in kept if e.region == region or not region]
        if chosen:
            return chosen, parser.nodes
    return [], parser.nodes


_BLOCK = pa.struct([("text", pa.string()), ("node", pa.int64()), ("content", pa.int64())])
_NODE = pa.struct([("node", pa.int64()), ("above", pa.int64()), ("kind", pa.int8()), ("feature", pa.int64())])
_NODES = "array<struct<node: long, above: long, kind: tinyint, feature: long>>"
_PARSED = f"page_id long, url string, host string, page_hash long, blocks array<struct<text: string, node: long, content: long>>, nodes {_NODES}"
#: Rows of a style node: that a page has it, a text it holds there, a sequence of its children.
_SEEN, _TEXT, _SHAPE = 0, 1, 2


def _parsed_row(html: str | None) -> tuple[int, list[dict], list[dict]]:
    """Hash, blocks and style nodes of a page; blocks carry their node and content node.

    The nodes are those that hold blocks of the main part, each once, with their child
    sequences.  Texts are not listed again, as the blocks have them.
    """
    blocks, elements = blocks_of(html or "")
    found = [{"text": text, "node": _number(path), "content": _number(f"{path}\n{text}")} for path, _, text in blocks]
    held = {path: above for _, named, _ in blocks for above, path in zip(("", *named), named)}
    nodes = {(path, above, _SEEN, "") for path, above in held.items()} | {(path, "", _SEEN, "") for path, _, _ in blocks if path not in held}
    nodes |= {(path, above, _SHAPE, children) for path, above, children in elements if path in held}
    listed = [{"node": _number(n), "above": _number(a), "kind": kind, "feature": _number(f) if f else 0} for n, a, kind, f in sorted(nodes)]
    return _number("\n".join(text for _, _, text in blocks)), found, listed


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            hashes, blocks, nodes = zip(*map(_parsed_row, part.column(3).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(hashes, pa.int64()), pa.array(blocks, pa.list_(_BLOCK)), pa.array(nodes, pa.list_(_NODE))],
                names=["page_id", "url", "host", "page_hash", "blocks", "nodes"],
            )


#: A node is removed below this importance, where at least so many different pages show it.
LEAST_IMPORTANCE = 0.2
LEAST_PAGES = 5
_DECAY = 0.9


def _low_branches(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one host whose combined importance is low, as is that of all below them.

    ``nodes`` has a row per style node, not per page.
    """
    least = {}
    rows = {r.node: r for r in nodes.itertuples()}
    below: dict[int, list[int]] = {}
    for r in rows.values():
        below.setdefault(r.above, []).append(r.node)

    def importance(node: int, depth: int = 0) -> float:
        if node not in least:
            least[node] = 1.0
            row = rows[node]
            children = below.get(node, []) if depth < 100 else []
            if not children:
                least[node] = row.importance
            else:
                shares = np.array([rows[c].pages for c in children], float)
                lower = float(np.dot(shares / shares.sum(), [importance(c, depth + 1) for c in children]))
                fade = _DECAY ** len(children)
                least[node] = (1 - fade) * row.importance + fade * max(lower, row.content)
        return least[node]

    lows: dict[int, bool] = {}

    def low(node: int, depth: int = 0) -> bool:
        if node not in lows:
            lows[node] = False
            own = rows[node].pages >= LEAST_PAGES and importance(node) < LEAST_IMPORTANCE
            lows[node] = own and (depth >= 100 or all([low(c, depth + 1) for c in below.get(node, [])]))
        return lows[node]

    gone = [n for n in rows if low(n)]
    hosts = pd.Series([key[0]] * len(gone), dtype=object)  # the result must be plain strings, not an Arrow-backed column
    return pd.DataFrame({"host": hosts, "node": pd.Series(sorted(gone), dtype="int64")})


def low_branches(parsed: DataFrame) -> DataFrame:
    """(host, node): style and content nodes of low importance on each host.

    Pages of a host with the same blocks count once, so copies of a page do not make
    its text look like a template.  A node's entropy over contents is the mean of
    1 - log(n) / log(N) over its N texts, n of them equal; a content node, one text of
    a node, has that value as its importance, N being the pages with the node.
    """
    own = parsed.where("host <> ''").select(
        "host", "page_hash", "nodes", F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["content"].alias("content"))).alias("held")
    )
    own = own.dropDuplicates(["host", "page_hash"])
    above = F.map_from_entries(F.transform(F.filter("nodes", lambda n: n["kind"] == _SEEN), lambda n: F.struct(n["node"], n["above"])))
    kind = F.lit(_TEXT).cast("byte").alias("kind")
    held = F.transform(F.array_distinct("held"), lambda h: F.struct(h["node"].alias("node"), F.col("over")[h["node"]].alias("above"), kind, h["content"].alias("feature")))
    nodes = own.withColumn("over", above).select("host", F.explode(F.concat("nodes", held)).alias("n")).select("host", "n.*")
    # a page lists a feature of a node once, so n counts pages
    seen = nodes.groupBy("host", "node", "above", "kind", "feature").agg(F.count("*").alias("n"))

    def spread(kind: int) -> Column:
        n = F.when(F.col("kind") == kind, F.col("n"))
        diverse = F.when(F.sum(n) > 1, 1 - F.sum(n * F.log(n)) / (F.sum(n) * F.log(F.sum(n)))).otherwise(1.0)
        return F.when(F.sum(n) > 0, diverse)

    often = F.collect_list(F.when((F.col("kind") == _TEXT) & (F.col("n") >= LEAST_PAGES), F.struct("feature", "n")))
    table = seen.groupBy("host", "node", "above").agg(
        F.sum(F.when(F.col("kind") == _SEEN, F.col("n"))).alias("pages"), spread(_TEXT).alias("texts"), spread(_SHAPE).alias("shapes"), often.alias("often")
    )
    table = materialise(table, "pages_tree")
    tree = table.select("host", "node", "above", "pages", F.coalesce("texts", "shapes", F.lit(0.0)).alias("importance"), F.coalesce("texts", F.lit(0.0)).alias("content"))
    low = tree.where("host <> ''").groupBy("host").applyInPandas(_low_branches, "host string, node long")
    texts = table.select("host", "pages", F.explode("often").alias("o")).select("host", "pages", "o.*")
    texts = texts.where((F.col("pages") >= LEAST_PAGES) & (1 - F.log("n") / F.log("pages") < LEAST_IMPORTANCE))
    return low.unionByName(texts.select("host", F.col("feature").alias("node")))


_BITMAP_BITS = 25


def _slot(host: Column, node: Column) -> Column:
    return F.xxhash64(host, node).bitwiseAND(F.lit((1 << _BITMAP_BITS) - 1))


def _bitmap(low: DataFrame) -> np.ndarray:
    """A bitmap of the removed nodes; its size does not depend on the data."""
    words = low.select(_slot(F.col("host"), F.col("node")).alias("slot")).selectExpr("slot >> 3 AS word", "shiftleft(1, CAST(slot & 7 AS INT)) AS bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (_BITMAP_BITS - 3), np.uint8)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint8)
    return bits


def _asker(bitmap: Any) -> Any:
    """A column function: whether one of the slots is set."""

    @F.arrow_udf("boolean")
    def ask(slots: pa.Array) -> pa.Array:
        flat = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        hits = (bitmap.value[flat >> 3] >> (flat & 7).astype(np.uint8)) & 1
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(slots).to_numpy(zero_copy_only=False))])
        total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
        return pa.array(total[ends[1:]] > total[ends[:-1]])

    return ask


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) per row of ``pages`` (page_id, url, html).

    Character references are decoded; white space within a block becomes one space;
    blocks are trimmed and joined by one space in page order.  A null or empty page
    has the empty text.  Pages without host get no style tree.  Rows that repeat
    stay; an empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    parsed = materialise(own.mapInArrow(_parse_batches, _PARSED), "pages_parsed")
    low = materialise(low_branches(parsed), "pages_low")
    # only pages with a node that may be gone meet their host's list
    ask = _asker(pages.sparkSession.sparkContext.broadcast(_bitmap(low)))
    slots = F.flatten(F.transform("blocks", lambda b: F.array(_slot(F.col("host"), b["node"]), _slot(F.col("host"), b["content"]))))
    asked = parsed.select("page_id", "url", "host", "blocks", ask(slots).alias("open"))
    removed = low.groupBy("host").agg(F.collect_list("node").alias("removed"))
    joined = asked.where("open").drop("open").join(removed, "host", "left")
    gone = F.coalesce("removed", F.array().cast("array<long>"))
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(F.array(b["node"], b["content"]), gone))
    texts = asked.where("not open").select("page_id", "url", "blocks").unionByName(joined.select("page_id", "url", kept.alias("blocks")))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), " ")
    return texts.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
