"""Page profiles: where a page's main content is, found from anchors.

All steps are joins and windows on the node table of ``html.dom_nodes``: the
smallest elements that have an anchor, the best of them, its container, the
containers' common ancestor, and a selector for that. A profile is applied to
later pages of the site by its selector and checked by its anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryleaf.functions.text import contains_all_tokens, fresh_anchors, squeeze, stable_class, url_hash
from quarryleaf.operators import html
from quarryleaf.settings import DEFAULTS

#: Elements that are containers whatever their size.
SEMANTIC_TAGS = ["main", "article", "section", "table", "ul", "ol", "dl"]
#: Regions whose matches count last.
NOISE_TAGS = ["nav", "aside", "footer", "header"]
NOISE_ROLES = ["navigation", "complementary", "banner", "contentinfo"]
LEAST_CHARS = 300


def in_noise(nodes: DataFrame, key: str) -> DataFrame:
    """nodes with noise: whether they or what holds them is a noise region."""
    text = lambda c: F.rlike(F.coalesce(c, F.lit("")), F.lit(html.NOISE_CLASS))
    marks = F.col("tag").isin(NOISE_TAGS) | F.col("role").isin(NOISE_ROLES) | text(F.array_join("classes", " ")) | text(F.col("elem_id"))
    regions = nodes.where(marks).groupBy(key).agg(F.collect_set("node").alias("_noise"))
    line = F.array_append("path", F.col("node"))
    return nodes.join(regions, key, "left").withColumn("noise", F.coalesce(F.arrays_overlap(line, "_noise"), F.lit(False))).drop("_noise")


def best_matches(nodes: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, anchor, node, noise, found): of the smallest elements that have an
    anchor the first outside noise regions, else the first."""
    found = html.smallest_with(nodes, anchors, key)
    noise = in_noise(nodes, key).select(key, "node", "noise")
    w = Window.partitionBy(key, "anchor")
    ranked = found.join(noise, [key, "node"]).withColumn("found", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("noise", "node")))
    return ranked.where("_n = 1").select(key, "anchor", "node", "path", "noise", "found")


def containers(nodes: DataFrame, matches: DataFrame, key: str, least: int = LEAST_CHARS) -> DataFrame:
    """matches with the container of each: the nearest element, itself
    included, that has enough text or a tag of its own meaning; the body if
    none does. (key, anchor, node, path, depth)"""
    size = F.length(squeeze(F.col("text")))
    good = (size >= least) | F.col("tag").isin(SEMANTIC_TAGS) | F.col("tag").isin("body", "html")
    each = nodes.select(key, F.col("node").alias("c_node"), F.col("path").alias("c_path"), "depth", good.alias("good"))
    lines = matches.select(key, "anchor", F.explode(F.array_append("path", F.col("node"))).alias("c_node"))
    near = lines.join(each.where("good"), [key, "c_node"])
    return near.groupBy(key, "anchor").agg(F.max(F.struct("depth", "c_node", "c_path")).alias("c")).select(key, "anchor", F.col("c.c_node").alias("node"), F.col("c.c_path").alias("path"), "c.depth")


def selectors(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node, selector): by id, else tag and stable classes, else places
    among siblings of one tag, four levels at most."""
    place = F.row_number().over(Window.partitionBy(key, "parent", "tag").orderBy("node"))
    step = F.concat("tag", F.lit(":nth-of-type("), place.cast("string"), F.lit(")"))
    each = nodes.withColumn("_step", F.when(F.col("parent").isNotNull(), step))
    classes = F.filter("classes", lambda c: F.rlike(c, F.lit("^[a-zA-Z][a-zA-Z0-9_-]{2,}$")) & ~F.rlike(c, F.lit(r"^[a-zA-Z]+-?\d{3,}$")))
    by_class = F.concat("tag", F.array_join(F.transform(classes, stable_class), ""))
    steps = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("node", F.coalesce("_step", F.lit("")).alias("s")))).alias("_steps"))
    line = F.slice(F.reverse(F.array_append("path", F.col("node"))), 1, 4)
    by_place = F.array_join(F.reverse(F.filter(F.transform(line, lambda n: F.try_element_at("_steps", n)), lambda s: s != "")), " > ")
    selector = F.when(F.rlike("elem_id", F.lit("^[a-zA-Z][a-zA-Z0-9_-]+$")), F.concat(F.lit("#"), "elem_id")).when(F.size(classes) > 0, by_class).otherwise(by_place)
    return each.join(steps, key).select(key, "node", selector.alias("selector"))


def mapped(nodes: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, lca_tag, selector, chars, anchors, missed, outliers): the main
    content of each page by its anchors (see ``html.smallest_with``). An ancestor that is the whole page is
    a failure, and has no selector. ``missed`` are anchors that no element has,
    ``outliers`` those whose container lay far above the others."""
    body = nodes.where("tag = 'body'").groupBy(key).agg(F.min("node").alias("_body"))
    shown = nodes.join(body, key).where((F.col("node") == F.col("_body")) | F.array_contains("path", F.col("_body"))).drop("_body")
    found = containers(nodes, best_matches(shown, anchors, key), key)
    kept = html.drop_outliers(found, key)
    lca = html.common_ancestor(kept, key).withColumnRenamed("lca", "node")
    tags = nodes.select(key, "node", F.col("tag").alias("lca_tag"), F.length(squeeze(F.col("text"))).alias("chars"))
    out = lca.join(tags, [key, "node"]).join(selectors(nodes, key), [key, "node"])
    selector = F.when(~F.col("lca_tag").isin("body", "html"), F.col("selector"))
    names = lambda rows, name: rows.groupBy(key).agg(F.array_sort(F.collect_set("anchor")).alias(name))
    asked = anchors.select(key, "anchor").distinct()
    missed = asked.join(found.select(key, "anchor"), [key, "anchor"], "left_anti")
    outliers = found.join(kept.select(key, "anchor"), [key, "anchor"], "left_anti")
    out = out.select(key, "lca_tag", selector.alias("selector"), "chars")
    for rows, name in ((kept, "anchors"), (missed, "missed"), (outliers, "outliers")):
        out = out.join(names(rows, name), key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


_PART = r"^([a-zA-Z][a-zA-Z0-9-]*)?((?:#[\w-]+|\.[\w-]+|\[class\*=\"[^\"]*\"\])*)(?::nth-of-type\((\d+)\))?$"


def matching(nodes: DataFrame, selector: Column, key: str) -> DataFrame:
    """nodes that a selector of the kind made by ``selectors`` names: one
    compound of id, tag and classes, or a chain of places joined by ' > '.
    selector: a column of nodes."""
    place = F.row_number().over(Window.partitionBy(key, "parent", "tag").orderBy("node"))
    each = nodes.withColumn("_selector", selector).withColumn("_step", F.concat("tag", F.lit(":nth-of-type("), place.cast("string"), F.lit(")")))
    steps = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("node", "_step"))).alias("_steps"))
    one = F.col("_selector")
    part = lambda g: F.regexp_extract(one, _PART, g)
    named = F.regexp_extract_all(part(2), F.lit(r"\.([\w-]+)"), F.lit(1))
    inside = F.regexp_extract_all(part(2), F.lit(r'\[class\*="([^"]*)"\]'), F.lit(1))
    elem = F.regexp_extract(part(2), r"#([\w-]+)", 1)
    joined = F.array_join("classes", " ")
    compound = ((part(1) == "") | (F.lower(part(1)) == F.col("tag"))) & ((elem == "") | (elem == F.col("elem_id"))) & (F.size(F.array_except(named, "classes")) == 0) & F.forall(inside, lambda c: F.contains(joined, c)) & (F.rlike(one, F.lit(_PART)))
    chain = F.split(one, " > ")
    line = F.reverse(F.slice(F.reverse(F.array_append("path", F.col("node"))), 1, F.size(chain)))
    places = F.transform(line, lambda n: F.coalesce(F.try_element_at("_steps", n), F.lit("")))
    by_place = F.contains(one, F.lit(":nth-of-type("))
    out = each.join(steps, key).where(F.when(by_place, places == chain).otherwise(compound))
    return out.drop("_steps", "_step", "_selector")


def subtree(nodes: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """(key, node, text, drifted): the first element that a page's profile
    names and that has all of its anchors; none means that the page drifted.
    profiles: key, selector, anchors."""
    own = nodes.join(profiles.select(key, F.col("selector").alias("_s"), F.col("anchors").alias("_a")), key)
    good = matching(own.where(F.col("_s").isNotNull()), F.col("_s"), key).where((F.size("_a") > 0) & F.forall("_a", lambda a: contains_all_tokens(F.col("text"), a)))
    first = good.groupBy(key).agg(F.min_by(F.struct("node", "text"), "node").alias("_f"))
    return profiles.select(key).join(first, key, "left").select(key, F.col("_f.node").alias("node"), F.col("_f.text").alias("text"), F.col("_f").isNull().alias("drifted"))


def generate(nodes: DataFrame, answers: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """A profile for each page from a model's checked answer (key, parsed: see
    ``text.profile_response``), with the stage at which a page failed: no
    answer, no anchor found, or no selector."""
    anchors = answers.where(F.col("parsed").isNotNull()).select(key, F.explode("parsed.content_anchors").alias("anchor"))
    maps = mapped(nodes, anchors, key)
    fresh = nodes.where(F.col("tag") == "body").groupBy(key).agg(F.first(fresh_anchors(F.col("text"))).alias("fresh"))
    out = pages.select(key, "url", url_hash(F.col("url")).alias("url_hash")).join(answers, key, "left").join(maps, key, "left").join(fresh, key, "left")
    stage = F.when(F.col("parsed").isNull(), "model").when(F.col("lca_tag").isNull(), "mapper").when(F.col("selector").isNull(), "selector")
    return out.select(key, "url", "url_hash", F.col("parsed.page_type").alias("page_type"), "selector", "lca_tag", "chars", F.coalesce("anchors", "fresh").alias("anchors"), stage.alias("failed_at"))


def answered(prompts: DataFrame, ask, retry_note: Column, key: str) -> DataFrame:
    """(key, parsed, tries): a model's answers, each asked once more with a note
    where the first was not valid. prompts: key, prompt; ask: Column to Column,
    the provider."""
    from quarryleaf.functions.text import profile_response

    first = prompts.withColumn("_first", profile_response(ask(F.col("prompt"))))
    again = F.when(F.col("_first").isNull(), profile_response(ask(F.concat("prompt", F.lit("\n\n"), retry_note))))
    out = first.withColumn("_again", again)
    return out.select(key, F.coalesce("_first", "_again").alias("parsed"), F.when(F.col("_first").isNull(), 2).otherwise(1).alias("tries"))


def lookup(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """pages with the newest profile of their own URL, if any. pages: url;
    profiles: url_hash, generated_at and the rest."""
    rest = [c for c in profiles.columns if c != "url_hash"]
    newest = profiles.groupBy("url_hash").agg(F.max_by(F.struct(*rest), "generated_at").alias("profile"))
    return pages.withColumn("url_hash", url_hash(F.col("url"))).join(newest, "url_hash", "left")


def branched(direct: DataFrame, retrieved: DataFrame, full: DataFrame) -> DataFrame:
    """One table of all ways in which pages were answered; a column that a way
    lacks is null there."""
    return direct.unionByName(retrieved, allowMissingColumns=True).unionByName(full, allowMissingColumns=True)


def branch(chunks: DataFrame, has_query: DataFrame, direct: int = DEFAULTS.profile_direct_chunks) -> DataFrame:
    """Which way a page with a profile goes: few chunks are all returned,
    whatever the query; many are ranked if there is a query. chunks: page_id;
    has_query: page_id, has_query."""
    n = chunks.groupBy("page_id").agg(F.count("*").alias("n_chunks"))
    path = F.when(F.col("n_chunks") <= direct, "profile_direct").when(F.col("has_query"), "profile_retrieval").otherwise("profile_direct_large")
    return n.join(has_query, "page_id").withColumn("path", path)
