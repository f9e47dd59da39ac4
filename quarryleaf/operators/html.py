"""HTML to text, titles, links and nodes.

Regular expressions serve flat pages JVM-side; trees are read by the standard
library's parser in Arrow batches, as a table of nodes on which records,
containers and common ancestors are found declaratively.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that hold no content of a page.
NOISE_TAGS = ["script", "style", "noscript", "header", "footer", "nav", "aside", "form", "iframe", "svg", "menu", "dialog", "template"]
#: Elements and roles within which repeated siblings are no records.
NOISE_REGION_TAGS = ["nav", "aside", "footer", "header", "pre", "code"]
NOISE_ROLES = ["navigation", "complementary", "banner", "contentinfo", "tablist", "tab", "tabpanel"]
#: Class and id patterns of noise regions, and classes of tabs.
NOISE_CLASS = r"(?i)\b(nav|sidebar|toc|table-of-contents|breadcrumb|menu|site-header|site-footer)\b"
TAB_CLASS = r"(?i)\btab(?:Item|panel|-item|-panel|-pane|_|content-pane)\b"
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    """The common named entities, &amp; last."""
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_html(html: Column, noise: list[str] = NOISE_TAGS) -> Column:
    """Text of a page with flat markup: noise elements and comments go, each
    tag ends a text node, nodes are trimmed and joined by line ends."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in noise:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?is)<title(?:\s[^>]*)?>.*?</title\s*>", "")
    nodes = F.transform(F.split(F.regexp_replace(out, r"(?s)<[^>]*>", "\u0001"), "\u0001"), lambda t: F.trim(F.regexp_replace(unescape(t), r"[\t-\r ]+", " ")))
    return F.array_join(F.filter(nodes, lambda t: t != ""), "\n")


def fenced_lines(html: Column) -> Column:
    """Each text node of a fragment on a line of its own, trimmed, with a fence
    before and after preformatted text, whose inner white space stays."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?i)</?pre(?:\s[^>]*)?>", "\u0001```\u0001")
    nodes = F.transform(F.split(F.regexp_replace(out, r"(?s)<[^>]*>", "\u0001"), "\u0001"), lambda t: F.regexp_replace(unescape(t), r"^\s+|\s+\z", ""))
    return F.array_join(F.filter(nodes, lambda t: t != ""), "\n")


def page_title(html: Column, md: Column) -> Column:
    """The title element without tags, else the first level-one heading of the
    markdown, else empty."""
    raw = F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    title = F.trim(F.regexp_replace(unescape(F.regexp_replace(raw, r"(?s)<[^>]*>", "")), r"[\t-\r ]+", " "))
    return F.when(title != "", title).otherwise(F.coalesce(F.regexp_extract(md, r"(?m)^# +(.+?)[ \t]*$", 1), F.lit("")))


def longest(candidates: list[Column], marked: str | None = None) -> Column:
    """The longest candidate that is not empty, the earlier of equals; of those
    that hold ``marked`` if any does. Null if all are empty."""
    rows = F.array(*(F.struct(F.length(c).alias("n"), F.lit(-i).alias("o"), c.alias("t")) for i, c in enumerate(candidates)))
    rows = F.filter(rows, lambda r: F.coalesce(r["n"], F.lit(0)) > 0)
    if marked is not None:
        best = F.filter(rows, lambda r: F.contains(r["t"], F.lit(marked)))
        rows = F.when(F.size(best) > 0, best).otherwise(rows)
    return F.array_max(rows)["t"]


class _Tree(HTMLParser):
    """Nodes of a page in document order. An end tag closes the nearest open
    element of its name; one that none matches is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else None
        self.nodes.append({"node": len(self.nodes), "parent": parent, "path": [*self.open], "tag": tag, "classes": (a.get("class") or "").split(), "elem_id": a.get("id") or "", "role": (a.get("role") or "").lower(), "hidden": "hidden" in a or (a.get("aria-hidden") or "").lower() == "true", "own": []})
        if tag not in VOID_TAGS:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and data.strip():
            self.nodes[self.open[-1]]["own"].append(data.strip())


def nodes_of(html: str | None) -> list[dict]:
    """Nodes with the text of their whole subtree, in document order."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    texts: list[list[str]] = [n["own"] for n in tree.nodes]
    for n in reversed(tree.nodes):  # children come after their parents
        if n["parent"] is not None:
            texts[n["parent"]] = [*texts[n["parent"]], *texts[n["node"]]]
    return [{k: v for k, v in n.items() if k != "own"} | {"text": " ".join(t), "depth": len(n["path"])} for n, t in zip(tree.nodes, texts)]


_NODE = "struct<node:int,parent:int,path:array<int>,tag:string,classes:array<string>,elem_id:string,role:string,hidden:boolean,text:string,depth:int>"
_NODE_ARROW = pa.list_(pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("path", pa.list_(pa.int32())), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("elem_id", pa.string()), ("role", pa.string()), ("hidden", pa.bool_()), ("text", pa.string()), ("depth", pa.int32())]))


def dom_nodes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A row for each element of each page, beside the page's other columns."""

    def run(html: pa.Array) -> pa.Array:
        return pa.array([nodes_of(x.as_py()) for x in html], _NODE_ARROW)

    rest = [c for c in pages.columns if c != html_col]
    return pages.select(*rest, F.explode(F.arrow_udf(run, f"array<{_NODE}>")(F.col(html_col))).alias("_n")).select(*rest, "_n.*")


def sibling_runs(nodes: DataFrame, key: str, least: int = 3) -> DataFrame:
    """nodes that stand in a run of siblings of one tag and one set of classes,
    with run (its first node) and run_size; an element without a class ends a
    run."""
    signature = F.when(F.size("classes") > 0, F.concat(F.col("tag"), F.lit("|"), F.array_join(F.array_sort("classes"), " ")))
    order = Window.partitionBy(key, "parent").orderBy("node")
    marked = nodes.where("parent is not null").withColumn("signature", signature)
    breaks = F.col("signature").isNull() | ~F.lag("signature").over(order).eqNullSafe(F.col("signature"))
    island = marked.withColumn("island", F.sum(breaks.cast("int")).over(order))
    each = Window.partitionBy(key, "parent", "island")
    out = island.withColumn("run_size", F.count("*").over(each)).withColumn("run", F.min("node").over(each))
    return out.where((F.col("run_size") >= least) & F.col("signature").isNotNull()).drop("island")


def record_groups(nodes: DataFrame, key: str, least_median: int = 20, most_groups: int = 8) -> DataFrame:
    """(key, group_id, parent_tag, signature, count, median_text_len, members)
    of repeated content on each page: runs outside noise regions and not of
    tabs, of enough text; a page with too many groups has none."""
    noisy = F.col("tag").isin(NOISE_REGION_TAGS) | F.col("role").isin(NOISE_ROLES) | F.rlike(F.array_join("classes", " "), F.lit(NOISE_CLASS)) | F.rlike(F.array_join("classes", " "), F.lit(TAB_CLASS)) | F.rlike(F.col("elem_id"), F.lit(NOISE_CLASS))
    marks = nodes.where(noisy).groupBy(key).agg(F.collect_set("node").alias("_noise"))
    runs = sibling_runs(nodes, key).join(marks, key, "left")
    line = F.array_append(F.slice(F.reverse("path"), 1, 20), F.col("node"))
    tablike = F.col("role").isin("tab", "tabpanel") | F.col("hidden") | F.rlike(F.array_join("classes", " "), F.lit(TAB_CLASS))
    groups = runs.groupBy(key, "parent", "run", "signature").agg(
        F.count("*").cast("int").alias("count"),
        F.percentile(F.length("text"), F.lit(0.5)).alias("median"),
        F.bool_or(tablike).alias("tabs"),
        F.min_by(F.arrays_overlap(line, F.coalesce("_noise", F.array().cast("array<int>"))), "node").alias("noise"),
        F.array_sort(F.collect_list("node")).alias("members"),
    )
    good = groups.where((F.col("median") >= least_median) & ~F.col("tabs") & ~F.col("noise"))
    numbered = good.withColumn("group_id", F.row_number().over(Window.partitionBy(key).orderBy("parent", "run")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    tags = nodes.select(key, F.col("node").alias("parent"), F.col("tag").alias("parent_tag"))
    return numbered.where(F.col("_n") <= most_groups).join(tags, [key, "parent"]).select(key, "group_id", "parent_tag", "signature", "count", F.col("median").cast("int").alias("median_text_len"), "members")


def smallest_with(nodes: DataFrame, anchors: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, anchor, node, path, depth): the deepest elements that have all
    tokens of an anchor, ``most`` at most. anchors: key, anchor; a column within
    names the element that an anchor was read from, outside which it is not
    looked for (null: anywhere)."""
    from quarryleaf.functions.text import contains_all_tokens

    near = nodes.join(anchors, key)
    if "within" in anchors.columns:
        near = near.where(F.col("within").isNull() | (F.col("node") == F.col("within")) | F.array_contains("path", F.col("within")))
    found = near.where(contains_all_tokens(F.col("text"), F.col("anchor"))).select(key, "anchor", "node", "parent", "path", "depth")
    above = found.select(F.col(key), "anchor", F.col("parent").alias("node")).where("node is not null").distinct()
    deepest = found.join(above, [key, "anchor", "node"], "left_anti")
    return deepest.withColumn("_n", F.row_number().over(Window.partitionBy(key, "anchor").orderBy("node"))).where(F.col("_n") <= most).drop("_n", "parent")


def drop_outliers(containers: DataFrame, key: str) -> DataFrame:
    """Of three containers or more, those far above the median depth go, if two
    remain. containers: key, node, path, depth."""
    w = Window.partitionBy(key)
    median = F.element_at(F.sort_array(F.collect_list("depth").over(w)), F.floor(F.count("*").over(w) / 2).cast("int") + 1)
    kept = containers.withColumn("_keep", F.col("depth") >= median - 2).withColumn("_n", F.count("*").over(w))
    kept = kept.withColumn("_kept", F.count_if("_keep").over(w))
    return kept.where((F.col("_n") < 3) | (F.col("_kept") < 2) | F.col("_keep")).drop("_keep", "_n", "_kept")


def common_ancestor(containers: DataFrame, key: str) -> DataFrame:
    """(key, lca): the deepest element that is or holds every container."""
    lines = containers.select(key, F.array_append("path", F.col("node")).alias("line"))
    together = F.aggregate(F.collect_list("line"), F.lit(None).cast("array<int>"), lambda s, x: F.when(s.isNull(), x).otherwise(F.array_intersect(s, x)))
    return lines.groupBy(key).agg(F.element_at(together, -1).alias("lca"))
