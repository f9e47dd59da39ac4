"""HTML to markdown with headings, code fences, tables, links and record marks.

A page is a tree, so one Arrow function walks it; which elements are records is
found before, on the node table (``html.record_groups``), and comes in beside
the page as element numbers.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryleaf.operators import html as dom
from quarryleaf.operators.chunking import record_end, record_mark

BLOCKS = {"address", "article", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
_HIDDEN = {*dom.NOISE_TAGS, "title", "head"}


class _Writer(HTMLParser):
    """Lines of a page. Elements are numbered as ``html.nodes_of`` numbers them.

    first: element to (group, index) of records; last: element to the group that
    ends behind it; kept: elements that hold a record, which are shown even
    within an element that is otherwise left out."""

    def __init__(self, first: dict, last: dict, kept: set):
        super().__init__(convert_charrefs=True)
        self.first, self.last, self.kept = first, last, kept
        self.number = 0
        self.open: list[tuple] = []
        self.lines: list[str] = []
        self.words: list[str] = []
        self.lead = ""
        self.cells: list[str] | None = None
        self.code: list[str] | None = None
        self.hidden = False

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.lines.append(self.lead + text)
            self.lead = ""

    def handle_starttag(self, tag, attrs):
        number, self.number = self.number, self.number + 1
        state = (tag, number, self.hidden, dict(attrs).get("href") or "", len(self.words))
        self.hidden = (self.hidden or tag in _HIDDEN) and number not in self.kept
        if not self.hidden:
            if number in self.first:
                self.flush()
                self.lines.append(record_mark(*self.first[number]))
            if tag == "br":
                (self.words if self.code is None else self.code).append("\n")
            elif tag == "pre":
                self.flush()
                self.code = []
            elif tag == "tr":
                self.flush()
                self.cells = []
            elif tag in ("td", "th") and self.cells is not None:
                self.words = []
            elif tag in BLOCKS:
                self.flush()
                if tag[0] == "h" and tag[1:].isdigit():
                    self.lead = "#" * int(tag[1]) + " "
                elif tag == "li":
                    self.lead = "- "
        if tag in dom.VOID_TAGS:
            self.hidden = state[2]
        else:
            self.open.append(state)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in dom.VOID_TAGS:
            self.close_last()

    def handle_endtag(self, tag):
        if any(t == tag for t, *_ in self.open):
            while self.close_last() != tag:
                pass

    def close_last(self) -> str:
        tag, number, outer, href, since = self.open.pop()
        if not self.hidden:
            if tag == "pre" and self.code is not None:
                text = "".join(self.code).strip("\n")
                self.code = None
                if text.strip():
                    self.lines += ["```", *text.split("\n"), "```"]
            elif tag in ("td", "th") and self.cells is not None:
                self.cells.append(" ".join("".join(self.words).split()))
                self.words = []
            elif tag == "tr" and self.cells is not None:
                if any(self.cells):
                    self.lines.append("| " + " | ".join(self.cells) + " |")
                self.cells = None
            elif tag == "a" and re.match("https?://", href) and since <= len(self.words):
                text = " ".join("".join(self.words[since:]).split())
                if text:
                    self.words[since:] = [f"[{text}]({href})"]
            elif tag in BLOCKS:
                self.flush()
                self.lead = ""
            if number in self.last:
                self.flush()
                self.lines.append(record_end(self.last[number]))
        self.hidden = outer
        return tag

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.code is None else self.code).append(data)


def markdown(html: str | None, records: list[dict] | None = None) -> str:
    """A page's text. records: group_id and members (element numbers) of each
    group; a record is preceded by its mark and a group's last is followed by
    the group's end."""
    first, last, kept = {}, {}, set()
    for g in records or []:
        for i, n in enumerate(g["members"]):
            first[n] = (g["group_id"], i)
        last[g["members"][-1]] = g["group_id"]
    if first:
        paths = {n["node"]: n["path"] for n in dom.nodes_of(html)}
        kept = {p for n in first for p in [*paths.get(n, []), n]}
    w = _Writer(first, last, kept)
    w.feed(html or "")
    w.close()
    while w.open:
        w.close_last()
    w.flush()
    return "\n".join(w.lines)


def fenced_text(html: Column) -> Column:
    """Text of a page with its code blocks in fences."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([markdown(x.as_py()) for x in pages], pa.string())

    return F.arrow_udf(run, "string")(html)


def page_markdown(pages: DataFrame, key: str, html_col: str = "html", records: bool = True) -> DataFrame:
    """pages with md. With ``records``, repeated content is annotated; of the
    structured text and the one without boilerplate the longest is taken, of
    those with marks if there are any."""
    plain = dom.strip_html(F.col(html_col))
    if not records:
        return pages.withColumn("md", F.coalesce(dom.longest([fenced_text(F.col(html_col)), plain]), F.lit("")))
    nodes = dom.dom_nodes(pages.select(key, html_col), html_col)
    groups = dom.record_groups(nodes, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("group_id", "members"))).alias("_groups"))

    def run(page: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([markdown(x.as_py(), g.as_py()) for x, g in zip(page, found)], pa.string())

    structured = F.arrow_udf(run, "string")(F.col(html_col), F.col("_groups"))
    out = pages.join(groups, key, "left").withColumn("_md", structured)
    return out.withColumn("md", F.coalesce(dom.longest([F.col("_md"), plain], marked="[[REC|"), F.lit(""))).drop("_groups", "_md")
