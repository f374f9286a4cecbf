"""Main text of web pages by site style trees (operator 8).

The pages of a host are merged into one tree: nodes are paths of tags with their
class or id, without long numbers. For each node, the entropy of its layouts over
the pages tells whether it is one layout for all (a template) or varies, and the
entropy of its texts tells whether the same texts stand on many pages (menus,
notices) or each on its own page. A layout or text on c of m pages has the share
c / m; one on a single page has the share that Good and Turing's estimate gives such
(2 * doubles / singles / m), so that menus that rotate are known before each has
been met often. An entropy of log(SCALE) or more is an importance of 1.

A host with few pages has little evidence. Its importance is averaged with that of
the same path on other hosts, in proportion to the pages (PRIOR_PAGES, MOST_PRIOR);
a path that no other host has is held to be important until its own pages say
otherwise. No number of pages switches the method on or off.

Importance is combined from the leaves to the root: of l layouts, a node's own
entropy counts 1 - GAMMA^l, the mean of its children and texts GAMMA^l. A branch is
removed from each page of the host if it and all below it are under the threshold.
An article or main part counts as more important (the square root), whatever is
around it, but does not decide on the rest of its page. In a second step, branches
whose tag, role or class says what they are go too. Pages of a host with the same
text in their largest node are copies and count once.

All of the tree's work is DataFrame aggregations over hashes, so that a host with a
third of all pages is spread over tasks.
"""

from __future__ import annotations

from html import unescape

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, map_slices

#: Fixed sets of HTML: elements without content, with raw text, that start a block, and that an open p ends at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the key ends where one of these begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "p": BLOCK - {"body", "html", "option", "caption", "td", "th", "tr", "tbody", "tfoot", "thead"}}
_ENDING = frozenset().union(*ENDS.values())
#: Branches that are not main text, by tag, by role, and by a word of class or id.
NOISE_TAGS = frozenset("head nav footer aside form button select input dialog menu label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar side footer header masthead comment comments reply replies disqus social share sharing related recommended widget toolbar pagination pager search skip copyright".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: Elements nested deeper than this are put beside their parent, as browsers do at a depth of their own.
DEEPEST = 200
NAME = regex.compile(r"/?([A-Za-z][^\s/>]*+)")
ATTR = regex.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+", regex.S)
WORD = regex.compile(r"[a-z]+")
DIGITS = regex.compile(r"\d{3,}")
GAMMA = 0.9
#: Layouts or texts of which each page would have its own.
SCALE = 10_000.0
#: Pages as many as which the assumption counts that a node is important.
PRIOR_PAGES = 3.0
#: Pages as many as which other hosts' nodes of the same path count at most.
MOST_PRIOR = 100.0

_paths: dict[tuple[int, str], int] = {}


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _path(parent: int, label: str) -> int:
    got = _paths.get((parent, label))
    if got is None:
        if len(_paths) > 100_000:
            _paths.clear()
        got = _paths[parent, label] = hash_text(f"{parent}/{label}")
    return got


class Node:
    __slots__ = ("tag", "path", "parent", "noise", "low", "main", "layout")

    def __init__(self, tag: str, path: int, parent: int, noise: bool, low: bool, main: bool):
        self.tag, self.path, self.parent, self.noise, self.low, self.main, self.layout = tag, path, parent, noise, low, main, []


class Page:
    """A page's blocks of text and its nodes, in time linear in its length.

    ``low``: paths whose branches are removed; ``lowest``: those inside a declared main
    part. ``names``: whether tags, roles and classes mark branches as noise.
    """

    def __init__(self, html: str, low: frozenset[int] | set[int] = frozenset(), lowest: frozenset[int] | set[int] = frozenset(), names: bool = True):
        self.blocks: list[tuple[str, int, bool]] = []  # text, path, removed
        self.nodes: list[Node] = []
        self._low, self._names = (low, lowest), names
        self._stack = [Node("", 0, 0, False, False, False)]
        self._words: list[str] = []
        self._read(html)

    def _flush(self) -> None:
        if self._words:
            top = self._stack[-1]
            if text := " ".join(unescape("".join(self._words)).split()):
                self.blocks.append((text, top.path, top.noise or top.low))
            self._words = []

    def _open(self, tag: str, attrs: str) -> None:
        stack = self._stack
        if tag in _ENDING:
            while len(stack) > 1 and self._ends(tag):
                stack.pop()
        if len(stack) > DEEPEST:
            stack.pop()
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if attrs.strip() else {}
        name = f"{values.get('class', '')} {values.get('id', '')}".lower().strip()
        role = values.get("role", "").lower()
        above = stack[-1]
        label = (f"{tag}.{DIGITS.sub('', name)}" if name else tag) + ("@main" if role == "main" else "")
        path = _path(above.path, label)
        main = above.main or tag in MAIN_TAGS or role == "main"
        noise = self._names and (above.noise or tag in NOISE_TAGS or (tag == "header" and not above.main) or role in NOISE_ROLES or "hidden" in values)
        if self._names and not noise and name and tag not in ("html", "body", "article", "main"):
            noise = not NOISE_WORDS.isdisjoint(WORD.findall(name))
        low = path in self._low[main] or (above.low and main == above.main)  # where a main part begins, the branches around it don't decide
        node = Node(tag, path, above.path, noise, low, main)
        above.layout.append(label)
        self.nodes.append(node)
        stack.append(node)

    def _ends(self, tag: str) -> bool:
        """Whether the start of ``tag`` ends an open element; what is open inside that ends with it."""
        for k in range(len(self._stack) - 1, 0, -1):
            node = self._stack[k]
            if tag in ENDS.get(node.tag, ()):
                del self._stack[k + 1 :]
                return True
            if node.tag in BLOCK and node.tag not in ENDS:
                return False
        return False

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag == tag:
                del self._stack[k:]
                return
            if self._stack[k].tag in ("article", "main", "body") and tag not in ("body", "html"):
                return  # a stray end tag

    def _read(self, html: str) -> None:
        last, quotes, at, told = html.rfind(">"), True, 0, 0
        while (at := html.find("<", at)) >= 0:
            begin = at
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(html)
                self._tell(html, told, begin)
                told = at
                continue
            name = NAME.match(html, at + 1)
            if at > last or not (name or html[at + 1 : at + 2] in ("!", "?")):
                at += 1
                continue  # no tag
            end = self._tag_end(html, name.end() if name else at + 2, quotes and name is not None)
            if end < 0:  # all that end tags from here on stand in quotes: such quotes count no more
                quotes, end = False, html.find(">", at)
            self._tell(html, told, begin)
            at = told = end + 1
            if name:
                tag = name[1].lower()
                if tag in BLOCK:
                    self._flush()
                elif tag == "br":
                    self._words.append(" ")
                attrs = html[name.end() : end]
                if html[begin + 1] == "/":
                    self._close(tag)
                elif tag in RAW:
                    if not attrs.rstrip().endswith("/"):
                        close = regex.compile(rf"</{regex.escape(tag)}(?![^\s/>])", regex.I).search(html, at)
                        end = html.find(">", close.end()) if close else -1
                        at = told = end + 1 if end >= 0 else len(html)
                elif tag not in VOID:
                    self._open(tag, attrs)
        self._tell(html, told, len(html))
        self._flush()

    def _tell(self, html: str, a: int, b: int) -> None:
        if b > a:
            self._words.append(html[a:b])

    @staticmethod
    def _tag_end(html: str, at: int, quotes: bool) -> int:
        """Where the tag's '>' is, or -1. Pairs of quotes hide it where ``quotes`` is set."""
        while True:
            end = html.find(">", at)
            if end < 0 or not quotes:
                return end
            first = min((q for q in (html.find('"', at, end), html.find("'", at, end)) if q >= 0), default=-1)
            if first < 0:
                return end
            shut = html.find(html[first], first + 1)
            if shut < 0:
                return end
            at = shut + 1

    def text(self) -> str:
        """Main text: all blocks that are left."""
        return "\n".join(b[0] for b in self.blocks if not b[2])


def host_of(url: Column) -> Column:
    """Host of a URL with or without scheme, in lower case, without 'www.'; '' where there is none."""
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.coalesce(F.lower(F.trim(host)), F.lit("")), r"^www\.", "")


def page_stats(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What each page adds to its host's tree: (host, path, parent, kind, feature, page).

    kind 0: the page has the node; 1: the node's layout; 2: a text in it; 3: one of the
    node's ancestors or itself (page 0). ``page`` is a hash of the text of the page's
    largest node. Pages without text have their whole html hashed.
    """
    rows = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].alias("html"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if not html:
                continue
            page = Page(html, names=False)
            told: dict[int, list[str]] = {}
            for text, path, _ in page.blocks:
                told.setdefault(path, []).append(text)
            key = hash_text(max(("\n".join(t) for t in told.values()), key=lambda t: (len(t), t), default=html))
            parent = {n.path: n.parent for n in page.nodes}
            seen = {(n.path, n.parent, 0, 0, key) for n in page.nodes}
            seen |= {(n.path, n.parent, 1, hash_text(" ".join(c for i, c in enumerate(n.layout) if not i or c != n.layout[i - 1])), key) for n in page.nodes}
            seen |= {(path, parent.get(path, 0), 2, hash_text(text), key) for text, path, _ in page.blocks}
            for path, above in parent.items():
                up = path
                while up:
                    seen.add((path, above, 3, up, 0))
                    up = parent.get(up, 0)
            for path, above, kind, feature, of in seen:
                for column, value in zip(out, (host, path, above, kind, feature, of), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), *[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 2), strict=True)], ["host", "path", "parent", "kind", "feature", "page"])

    return map_slices(rows, "html", run, "host string, path long, parent long, kind int, feature long, page long")


def _entropy(kind: str, pages: Column) -> Column:
    """Importance from the entropy of shares: ``<kind>_n`` pages with one, ``_1`` and ``_2`` of them on one and two pages, ``_log`` the sum of c log c of the rest."""
    n, single, double = (F.col(f"{kind}_{x}").cast("double") for x in ("n", "1", "2"))
    share = F.greatest(2 * double / F.greatest(single, F.lit(1.0)) / pages, F.lit(1 / SCALE))
    own = F.when(pages <= 1, F.lit(float(np.log(SCALE)))).otherwise(-F.log(F.least(share, F.lit(1.0))))
    return F.least((single * own + (n - single) * F.log(pages) - F.col(f"{kind}_log")) / F.greatest(n, F.lit(1.0)) / float(np.log(SCALE)), F.lit(1.0))


def style_tree(stats: DataFrame) -> DataFrame:
    """Each host's nodes: (host, path, parent, chain array<long>, pages, layouts, layout, texts, content).

    ``chain``: the node and its ancestors; ``layout`` and ``content``: importance by
    this host's pages alone; ``layouts`` and ``texts``: how many different ones.
    """
    each = stats.groupBy("host", "path", "parent", "kind", "feature", "page").agg(F.lit(1).alias("one"))
    counts = each.groupBy("host", "path", "parent", "kind", "feature").agg(F.count("*").alias("c"))
    kind, c = F.col("kind"), F.col("c").cast("double")
    parts = [F.max(F.when(kind == 0, F.col("c"))).alias("pages"), F.collect_set(F.when(kind == 3, F.col("feature"))).alias("chain")]
    for k, name in ((1, "l"), (2, "t")):
        of = kind == k
        parts += [
            F.count(F.when(of, 1)).alias(f"{name}_kinds"), F.coalesce(F.sum(F.when(of, c)), F.lit(0.0)).alias(f"{name}_n"), F.count(F.when(of & (c == 1), 1)).alias(f"{name}_1"),
            F.count(F.when(of & (c == 2), 1)).alias(f"{name}_2"), F.coalesce(F.sum(F.when(of & (c > 1), c * F.log(c))), F.lit(0.0)).alias(f"{name}_log"),
        ]
    pages = F.col("pages").cast("double")
    sums = counts.groupBy("host", "path", "parent").agg(*parts).filter("pages IS NOT NULL")  # text beside all elements has no node
    return sums.select("host", "path", "parent", "chain", "pages", F.col("l_kinds").alias("layouts"), _entropy("l", pages).alias("layout"), F.col("t_kinds").alias("texts"), _entropy("t", pages).alias("content"))


def smooth(tree: DataFrame) -> DataFrame:
    """The tree with ``layout`` and ``content`` averaged with those of the same path on other hosts."""
    m = F.col("pages").cast("double")
    weight = {"layout": m * m / (m + PRIOR_PAGES)}
    weight["content"] = F.when(F.col("texts") > 0, weight["layout"]).otherwise(0.0)
    by_path = tree.groupBy("path").agg(*(F.sum(x).alias(f"{k}_{n}") for k, w in weight.items() for n, x in (("w", w), ("s", w * F.col(k)))))
    for_all = tree.join(if_small(cut(by_path, "paths")), "path")
    out = []
    for k, w in weight.items():
        others = F.greatest(F.col(f"{k}_w") - w, F.lit(0.0))
        prior = (PRIOR_PAGES + F.greatest(F.col(f"{k}_s") - w * F.col(k), F.lit(0.0))) / (PRIOR_PAGES + others)
        strength = PRIOR_PAGES + F.least(others, F.lit(MOST_PRIOR))
        out.append(((m * F.col(k) + strength * prior) / (m + strength)).alias(k))
    return for_all.select("host", "path", "parent", "chain", "pages", "layouts", "texts", *out)


def importance(tree: DataFrame) -> DataFrame:
    """(host, path, parent, composite, most): each node's composite importance, and the largest of it and of all below it.

    composite = (1 - f) * layout + f * mean(parts), f = GAMMA^layouts, with the node's
    children and its texts as parts; that of a node without parts is its layout, of one
    without children its content. As a sum over all nodes below, each weighted by the
    product of f / parts on the way, it takes no recursion.
    """
    kids = tree.groupBy("host", F.col("parent").alias("path")).agg(F.count("*").alias("kids"))
    f = F.pow(F.lit(GAMMA), F.col("layouts").cast("double"))
    has = (F.col("texts") > 0).cast("int")
    parts = F.col("kids") + has
    own = F.when(F.col("kids") == 0, F.when(has == 1, F.col("content")).otherwise(F.col("layout"))).otherwise((1 - f) * F.col("layout") + F.when(has == 1, f * F.col("content") / parts).otherwise(0.0))
    nodes = tree.join(kids, ["host", "path"], "left").fillna(0, ["kids"])
    nodes = cut(nodes.select("host", "path", "parent", "chain", own.alias("own"), F.when(F.col("kids") > 0, F.col("layouts") * float(np.log(GAMMA)) - F.log(parts.cast("double"))).otherwise(0.0).alias("log_f")), "tree-nodes")
    up = nodes.select("host", F.col("path").alias("below"), F.explode("chain").alias("path"))
    sums = up.join(nodes.select("host", "path", "log_f"), ["host", "path"]).groupBy("host", "below").agg(F.sum("log_f").alias("total"))
    placed = nodes.join(sums.withColumnRenamed("below", "path"), ["host", "path"]).select("host", "path", "parent", "chain", "own", (F.col("total") - F.col("log_f")).alias("way"))
    placed = cut(placed, "tree-ways")  # way: logarithms of f / parts from the root to the parent
    up = placed.select("host", "own", F.col("way").alias("way_below"), F.explode("chain").alias("path"))
    composite = up.join(placed.select("host", "path", "way"), ["host", "path"]).groupBy("host", "path").agg(F.sum(F.col("own") * F.exp(F.col("way_below") - F.col("way"))).alias("composite"))
    composite = cut(placed.select("host", "path", "parent", "chain").join(composite, ["host", "path"]), "tree-composite")
    most = composite.select("host", "composite", F.explode("chain").alias("path")).groupBy("host", "path").agg(F.max("composite").alias("most"))
    return composite.select("host", "path", "parent", "composite").join(most, ["host", "path"])


def low_branches(valued: DataFrame, threshold: float) -> DataFrame:
    """(host, low array<long>, lowest array<long>): paths whose importance is under the threshold, as that of all below them.

    ``lowest`` holds those that are under it when raised as parts of a declared main
    part. Of branches inside each other the outer ones are listed.
    """
    most = F.col("most")
    low = valued.filter(most < threshold)
    upper = low.select("host", F.col("path").alias("parent"), most.alias("outer"))
    low = low.join(upper, ["host", "parent"], "left").filter(F.col("outer").isNull() | ((most < threshold**2) & (F.col("outer") >= threshold**2)))
    return low.groupBy("host").agg(F.collect_set(F.when(F.col("outer").isNull(), F.col("path"))).alias("low"), F.collect_set(F.when(most < threshold**2, F.col("path"))).alias("lowest"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, names: bool = True) -> DataFrame:
    """Main text of every page, a row for each input row: (id, url, text, n_chars).

    NULL or empty html gives an empty text; a NULL id or url stays NULL, and pages
    without host share one tree. Repeated rows are told each, and count once in the
    tree. An empty table gives an empty one. If removal by importance would leave a page empty, only tags and
    classes decide. ``names=False`` leaves the second step out. Other columns are left out.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    tree = cut(style_tree(page_stats(rows)), "style-tree")
    low = cut(low_branches(importance(smooth(tree)), threshold), "low-branches")
    joined = rows.withColumn("host", host_of(F.col("url"))).join(if_small(low), "host", "left").select("id", "url", "html", "low", "lowest")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for html, gone, inner in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
            text = Page(html, set(gone), set(inner), names).text() if html and gone is not None else ""
            texts.append(text or (Page(html, names=names).text() if html else ""))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return map_slices(joined, "html", run, f"id {rows.schema[0].dataType.simpleString()}, url string, text string, n_chars long")
