"""What is attached to an answer: links, excerpts, entities and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.functions.text import excerpt, netloc, strip

LINK_BYTES, LINK_COUNT, LINK_EXTRA = 10_240, 50, 32

#: Follow-up hints by host.
HOST_HINTS = {
    "arxiv.org": {"recommended_followup_filter": "site:arxiv.org", "pdf_template": "https://arxiv.org/pdf/{id}", "abs_template": "https://arxiv.org/abs/{id}"},
    "github.com": {"recommended_followup_filter": "site:github.com", "raw_template": "https://raw.githubusercontent.com/{owner}/{repo}/{ref}/{path}"},
    "en.wikipedia.org": {"recommended_followup_filter": "site:en.wikipedia.org", "search_template": "https://en.wikipedia.org/w/index.php?search={query}"},
    "ko.wikipedia.org": {"recommended_followup_filter": "site:ko.wikipedia.org", "search_template": "https://ko.wikipedia.org/w/index.php?search={query}"},
    "ja.wikipedia.org": {"recommended_followup_filter": "site:ja.wikipedia.org"},
    "youtube.com": {"recommended_followup_filter": "site:youtube.com"},
    "www.youtube.com": {"recommended_followup_filter": "site:youtube.com"},
    "stackoverflow.com": {"recommended_followup_filter": "site:stackoverflow.com", "tag_template": "https://stackoverflow.com/questions/tagged/{tag}"},
}


def outbound_links(chunks: DataFrame, key: str, most_bytes: int = LINK_BYTES, most: int = LINK_COUNT) -> DataFrame:
    """(key, url, anchor_text, in_chunk_idx, ord): links of a page's chunks in
    order, each (url, anchor) once, up to the first that goes over the size
    limit. chunks: key, chunk_index, text."""
    pattern = r"(?<!!)\[([^\]]+)\]\((https?://[^)\s]+)\)"
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("url"), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("anchor_text"))
    each = chunks.select(key, "chunk_index", F.posexplode(found).alias("pos", "l")).select(key, "chunk_index", "pos", "l.url", strip(F.col("l.anchor_text")).alias("anchor_text"))
    first = Window.partitionBy(key, "url", "anchor_text").orderBy("chunk_index", "pos")
    once = each.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    so_far = Window.partitionBy(key).orderBy("chunk_index", "pos")
    size = F.length("url") + F.length("anchor_text") + LINK_EXTRA
    out = once.withColumn("_bytes", F.sum(size).over(so_far)).withColumn("ord", (F.row_number().over(so_far) - 1).cast("long"))
    return out.where((F.col("_bytes") <= most_bytes) & (F.col("ord") < most)).select(key, "url", "anchor_text", F.col("chunk_index").alias("in_chunk_idx"), "ord")


def excerpts(chunk_texts: Column) -> Column:
    """array<struct<chunk_idx, summary>> of the first three chunks returned; an
    empty one is dropped and not replaced."""
    top = F.transform(F.slice(chunk_texts, 1, 3), lambda t, i: F.struct(i.alias("chunk_idx"), excerpt(t).alias("summary")))
    return F.filter(top, lambda x: x["summary"] != "")


def chain_hints(url: Column) -> Column:
    """The host's hints, an empty map for other hosts."""
    hints = F.create_map(*(x for h, d in HOST_HINTS.items() for x in (F.lit(h), F.create_map(*(F.lit(y) for kv in d.items() for y in kv)))))
    return F.coalesce(F.try_element_at(hints, netloc(url)), F.create_map().cast("map<string,string>"))
