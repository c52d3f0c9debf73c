"""Main text of web pages by site style trees.

Each page is parsed once into text blocks (runs of inline content of one block element). Known
structure decides first: scripts, menus, headers, footers, side bars, notices, adverts, forms
and comments, told by element, role or whole names of class and id (``cookie-notice``, but not
``has-sidebar``), are left out. A name leaves out no article or main, no element with the page's
only or larger article or main in it, and none that holds most of the page's text (where an
article or main stands elsewhere: nearly all of it).

All that is left, articles and mains included, is merged into one style tree for each host: an element node is a
path of elements with their classes; a page adds to each of its nodes its style (the sequence
of child nodes) and its content (the hash of its text there). A node's importance is the
entropy of its styles and of its contents over the pages that hold the node (of its contents:
that have text there), to the base of their number: what looks and reads the same wherever it
occurs scores near 0, on a host of any size. On fewer than ``MIN_PAGES`` pages there is nothing
to tell a template by, so the score is 1. Inner nodes weigh in their children
(with ``GAMMA`` per style, as a deviation from the template already counts). Branches that
score below ``LEAST`` in all their nodes are removed from each page. The tags are a prior to
this: where the articles (else the mains) hold most of a page's text, they are the page's main
part, and the tree's verdict on it holds only if it leaves most of its text. Counting is a grouped sum by (host, node, style or
content), combined map-side, so a host with a third of all pages is no group in one task; only
the merged tree of a host (nodes, not pages) is handled together. Pages of equal html count
once, and hosts with fewer than ``MIN_PAGES`` different pages keep all branches.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by line feeds in page order. Null or empty html gives an empty text; broken or cut-off
markup is read as far as it goes. Every input row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

MIN_PAGES = 5
GAMMA = 0.9
LEAST = 0.3
# Share of a page's text from which on a name of class or id leaves out no element: without, and
# with an article or main elsewhere on the page.
MOST = 0.5
NEARLY_ALL = 0.9

# HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture q "
             "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUT = set("head script style title noscript template nav footer aside form button select input textarea iframe svg canvas object "
          "embed audio video map dialog menu noembed noframes".split())
OUT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
OUT_WORDS = set("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr "
                "notice notices popup modal overlay newsletter subscribe signup login share sharing social sidebar related recommended "
                "breadcrumb breadcrumbs menu nav navbar navigation pagination pager comment comments disqus replies respond footer "
                "masthead topbar skip".split())
HEADER_WORDS = set("header site-header".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
               "h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "p": {"td", "th", "button", "table"}}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NUMBER = re.compile(r"\d+")


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Element:
    __slots__ = ("name", "out", "named", "core", "zone", "path", "parent", "above", "own", "children", "words")

    def __init__(self, name, out, named, core, zone, path, parent, above):
        self.name, self.out, self.named, self.core, self.zone, self.path, self.parent, self.above = name, out, named, core, zone, path, parent, above
        self.own = 0  # characters of text, without white space at the ends
        self.children: list[int] = []
        self.words: list[str] = []


def _label(name: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """(name with classes, left out by its attributes, by a whole name of class or id, header by such a name)."""
    if not attrs.strip():
        return name, False, False, False
    found = {}
    for k, a, b, c in _ATTR.findall(attrs):
        found.setdefault(k.lower(), html.unescape(a or b or c))
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    # A name counts if all its words do.
    names = [{w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", n) if w and not w.isdigit()} for n in named.split()]
    style = found.get("style", "").replace(" ", "").lower()
    out = (found.get("role", "").lower() in OUT_ROLES or "hidden" in found
           or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style)
    classes = ".".join(sorted(_NUMBER.sub("#", found.get("class", "").lower()).split()))
    return (f"{name}.{classes}" if classes else name, out, any(words and words <= OUT_WORDS for words in names),
            not HEADER_WORDS.isdisjoint(named.split()))


def _leave_out(elements: list[Element]) -> None:
    """Mark what the names of class and id leave out, and all below it. Elements in page order."""
    if any(e.named for e in elements):
        held = {id(e): e.own for e in elements}
        cores = dict.fromkeys(held, 0)  # text in the articles and mains at and below an element
        for e in reversed(elements):
            if e.core:
                cores[id(e)] = held[id(e)]
            if e.parent is not None:
                held[id(e.parent)] += held[id(e)]
                cores[id(e.parent)] += cores[id(e)]
        free = {}  # no named element at or above: in an article or main?
        for e in elements:
            up = False if e.parent is None else free[id(e.parent)]
            free[id(e)] = None if e.named or up is None else up or e.core
        beside = sum(e.own for e in elements if free[id(e)])
        share = (NEARLY_ALL if beside else MOST) * held[id(elements[0])]
        for e in elements:
            e.out = e.out or (e.named and not e.core and held[id(e)] <= share and cores[id(e)] <= beside)
    for e in elements:
        e.out = e.out or (e.parent is not None and e.parent.out)


def parse(text: str) -> tuple[list[tuple[int, int, str]], list[Element]]:
    """Blocks as (zone, node, text) in page order, and the page's block elements. Zone: 2
    inside an article, 1 inside a main, else 0."""
    root = Element("#root", False, False, False, 0, _hash("#root"), None, None)
    stack, blocks, elements, held = [root], [], [root], []

    def close(names, within=()):
        """Close the innermost open element of these names, unless a boundary lies between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                if any(e.name not in INLINE for e in stack[i:]):
                    flush_to(block_of())
                del stack[i:]
                return
            if stack[i].name in within:
                return

    def block_of():
        for e in reversed(stack):
            if e.name not in INLINE:
                return e
        return root

    def flush_to(element):
        if held:
            blocks.append((element, held.copy()))
            held.clear()

    pos, size = 0, len(text)
    while pos < size:
        m = _TOKEN.search(text, pos)
        upto = m.start() if m else size
        if upto > pos and not stack[-1].out:
            held.append((stack[-1], text[pos:upto]))
            stack[-1].own += len(text[pos:upto].strip())
        if not m:
            break
        pos = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" and not any(e.name == "p" for e in stack):
                flush_to(block_of())
            elif name not in VOID:
                close({name})
            continue
        if name not in INLINE:
            flush_to(block_of())
        if name in CLOSES_P:
            close({"p"}, SCOPE["p"])
        if name in SAME_CLOSES:
            for other in SAME_CLOSES[name]:
                close({other}, SCOPE.get(other, set()) | SCOPE.get(name, set()))
        if name == "br":
            if not stack[-1].out:
                held.append((stack[-1], " "))
            continue
        if name in VOID:
            continue
        up = stack[-1]
        label, hidden, named, header = _label(name, m["attrs"])
        own = 2 if name == "article" else 1 if name == "main" or 'role="main"' in m["attrs"] else 0
        zone = max(up.zone, own)
        named = name not in ("html", "body") and (named or (header and zone == 0))
        out = up.out or name in OUT or (hidden and name not in ("html", "body")) or (name == "header" and up.zone == 0)
        path = up.path if name in INLINE else _hash(up.path, label)
        if name in RAW:
            # Their text is no markup: skip to the end tag.
            stop = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(text, pos)
            pos = stop.end() if stop else size
            continue
        element = Element(name, out, named, own > 0, zone, path, up, up if up.name not in INLINE else up.above)
        stack.append(element)
        elements.append(element)
    flush_to(block_of())
    _leave_out(elements)
    found = []
    for element, pieces in blocks:
        block = " ".join(html.unescape("".join([t for e, t in pieces if not e.out])).split())
        if block and not element.out:
            found.append((element.zone, element.path, block))
            element.words.append(block)
    kept = [e for e in elements if e.name not in INLINE and not e.out]
    for e in kept[1:]:
        e.above.children.append(e.path)
    return found, kept


def page_nodes(elements: list[Element]) -> list[dict]:
    """The page's style-tree nodes: node, parent, style, content (0: no text)."""
    nodes: dict[int, dict] = {}
    for e in elements:
        parent = e.parent.path if e.parent is not None else 0
        n = nodes.setdefault(e.path, {"parent": parent, "style": [], "content": []})
        n["style"].append(",".join(map(str, e.children)))
        n["content"] += e.words
    return [{"node": k, "parent": n["parent"], "style": _hash(*n["style"]), "content": _hash(*n["content"]) if n["content"] else 0}
            for k, n in nodes.items()]


def main_zone(blocks: list[tuple[int, int, str]]) -> int:
    """The zone (2: articles, 1: mains) that holds most of the page's text; 3 if none does."""
    total = sum(len(t) for _, _, t in blocks)
    return next((zone for zone in (2, 1) if sum(len(t) for z, _, t in blocks if z >= zone) > MOST * total), 3)


def _parse_pages(batches):
    block_type = pa.list_(pa.struct([("main", pa.bool_()), ("node", pa.int64()), ("text", pa.string())]))
    node_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("node", "parent", "style", "content")]))
    for b in batches:
        blocks, nodes, digests = [], [], []
        for text in b.column(2).to_pylist():
            found, elements = parse(text or "")
            least = main_zone(found)
            blocks.append([{"main": z >= least, "node": n, "text": t} for z, n, t in found])
            nodes.append(page_nodes(elements))
            digests.append(_hash(text or ""))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(digests, pa.int64()), pa.array(blocks, block_type), pa.array(nodes, node_type)],
            names=["page_id", "url", "digest", "blocks", "nodes"])


PARSED = ("page_id long, url string, digest long, blocks array<struct<main:boolean,node:long,text:string>>, "
          "nodes array<struct<node:long,parent:long,style:long,content:long>>")


def importance(tree: dict[int, tuple[int, float, float | None, int]]) -> dict[int, float]:
    """Composite importance of each node. tree: node -> (parent, style entropy, content entropy
    or None without text, number of styles)."""
    children: dict[int, list[int]] = {}
    for node, (parent, *_) in tree.items():
        if parent != node and parent in tree:
            children.setdefault(parent, []).append(node)
    out: dict[int, float] = {}
    order, seen = [n for n, (p, *_) in tree.items() if p not in tree or p == n], set()
    for node in order:
        if node not in seen:
            seen.add(node)
            order += children.get(node, [])
    for node in reversed(order):
        if node in out:
            continue
        _, style, content, styles = tree[node]
        parts = [out[c] for c in children.get(node, []) if c in out] + ([] if content is None else [content])
        weight = GAMMA**styles
        out[node] = (1 - weight) * style + weight * sum(parts) / len(parts) if parts else style
    return out


def noisy(tree: dict, score: dict[int, float]) -> set[int]:
    """Nodes that score below LEAST with all nodes below them."""
    bad = {n for n, s in score.items() if s < LEAST}
    for node in tree:
        if node not in bad:
            # An important node keeps all above it.
            at = tree[node][0]
            while at in bad:
                bad.discard(at)
                at = tree[at][0]
    return bad


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = {r.node: (r.parent, r.style, None if math.isnan(r.content) else r.content, r.styles) for r in pdf.itertuples()}
    gone = noisy(tree, importance(tree))
    return pd.DataFrame([(pdf["host"].iloc[0], n) for n in gone], columns=["host", "node"])


def _entropy(rows: DataFrame, value: str) -> DataFrame:
    """Entropy and number of kinds of a value for each (host, node). The base is the number of
    the node's own pages, not the host's: the score of a rare layout does not sink as the host grows."""
    counts = rows.groupBy("host", "node", value).agg(F.sum("c").alias("c"))
    summed = counts.groupBy("host", "node").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.count("*").alias("kinds"))
    share = F.when(F.col("total") < MIN_PAGES, 1.0).otherwise(1 - F.col("clogc") / F.col("total") / F.log("total"))
    return summed.select("host", "node", share.alias(value), F.col("kinds").alias(f"{value}_kinds"))


def noise_nodes(parsed: DataFrame) -> DataFrame:
    """(host, noise): the style-tree nodes of low importance, and all below them."""
    # Pages of equal html count once: their nodes are equal, so any one of them will do.
    once = parsed.groupBy("host", "digest").agg(F.count("*").alias("copies"))
    pages = materialise(once.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES), "hosts")
    rows = parsed.select("host", "digest", F.inline("nodes")).distinct()
    rows = rows.groupBy("host", "node", "parent", "style", "content").agg(F.count("*").alias("c"))
    rows = materialise(rows.join(pages.select("host"), "host", "left_semi"), "style-tree")
    nodes = rows.groupBy("host", "node").agg(F.min("parent").alias("parent"))
    nodes = nodes.join(_entropy(rows, "style"), ["host", "node"]).join(_entropy(rows.where("content <> 0"), "content"), ["host", "node"], "left")
    nodes = nodes.select("host", "node", "parent", "style", "content", F.col("style_kinds").alias("styles"))
    judged = nodes.groupBy("host").applyInPandas(_judge, "host string, node long")
    return materialise(judged.groupBy("host").agg(F.collect_list("node").alias("noise")), "noise")


def _chars(blocks):
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = materialise(base.mapInArrow(_parse_pages, PARSED).withColumn(
        "host", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))), "parsed-pages")
    noise = noise_nodes(parsed)
    joined = parsed.join(noise, "host", "left")
    main = F.filter("blocks", lambda b: b["main"])
    noisy_main = F.filter(main, lambda b: F.array_contains("noise", b["node"]))
    whole_main = F.coalesce(_chars(noisy_main) >= (1 - MOST) * _chars(main), F.lit(False))
    clean = lambda b: ~F.coalesce(F.array_contains("noise", b["node"]), F.lit(False))
    # The condition stands outside the filters: inside, it would be worked out for each block.
    kept = F.when(whole_main, F.filter("blocks", lambda b: b["main"] | clean(b))).otherwise(F.filter("blocks", clean))
    text = F.coalesce(F.array_join(F.transform(kept, lambda b: b["text"]), "\n"), F.lit(""))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
