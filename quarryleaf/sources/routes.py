"""Which fetcher a URL goes to, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryleaf.functions.text import host

#: Hosts, domains, namespaces and media types with their own readers.
YOUTUBE_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be"]
STACK_DOMAINS = {"stackoverflow.com": "stackoverflow", "superuser.com": "superuser", "serverfault.com": "serverfault", "askubuntu.com": "askubuntu", "mathoverflow.net": "mathoverflow"}
WIKI_NAMESPACES = ["Special:", "Wikipedia:", "Help:", "Talk:", "User:", "File:", "Category:", "Template:", "Portal:"]
PASSTHROUGH_TYPES = ["application/json", "application/xml", "text/xml", "application/rss+xml", "application/atom+xml"]


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def is_pdf(url: Column) -> Column:
    low = F.lower(url)
    return F.endswith(low, F.lit(".pdf")) | F.contains(low, F.lit("/pdf/"))


def is_passthrough(url: Column) -> Column:
    return F.rlike(F.lower(url_path(url)), F.lit(r"\.(json|xml|rss|atom)$"))


def is_passthrough_type(content_type: Column) -> Column:
    base = F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))
    return F.coalesce(base.isin(PASSTHROUGH_TYPES) | F.endswith(base, F.lit("+json")) | F.endswith(base, F.lit("+xml")), F.lit(False))


def youtube_id(url: Column) -> Column:
    """The video of a URL, or null."""
    one = r"[A-Za-z0-9_-]{11}"
    path, h = url_path(url), host(url)
    short = F.regexp_extract(path, rf"^/+({one})(?:/|$)", 1)
    watch = F.regexp_extract(F.concat(F.lit("&"), url_query(url)), rf"&v=({one})(?:&|$)", 1)
    other = F.regexp_extract(path, rf"^/(?:shorts|live)/({one})(?:/|$)", 1)
    found = F.when(h == "youtu.be", short).when(h.isin(YOUTUBE_HOSTS), F.when(path.isin("/watch", "/watch/"), watch).otherwise(other))
    return F.nullif(found, F.lit(""))


def github_route(url: Column) -> Column:
    """struct<owner, repo, kind, detail>, or null. Kinds are readme, issue,
    pull and blob; detail is a number, or ref/path of a blob."""
    s = segments(url)
    third, n = F.get(s, F.lit(2)), F.size(s)
    number = F.get(s, F.lit(3))
    numbered = (n >= 4) & F.rlike(number, F.lit("^[0-9]+$"))
    kind = (
        F.when((n == 2) | (third == "tree"), "readme")
        .when((third == "issues") & numbered, "issue")
        .when((third == "pull") & numbered, "pull")
        .when((third == "blob") & (n >= 5), "blob")
    )
    detail = F.when(kind.isin("issue", "pull"), number).when(kind == "blob", F.array_join(F.slice(s, 4, F.greatest(n - 3, F.lit(0))), "/"))
    own = host(url).isin("github.com", "www.github.com") & (n >= 2) & kind.isNotNull()
    return F.when(own, F.struct(F.get(s, F.lit(0)).alias("owner"), F.get(s, F.lit(1)).alias("repo"), kind.alias("kind"), detail.alias("detail")))


def stack_route(url: Column) -> Column:
    """struct<site, post>, or null: the question or answer of a URL."""
    h = host(url)
    known = F.create_map(*(F.lit(x) for pair in STACK_DOMAINS.items() for x in pair))
    site = F.coalesce(F.try_element_at(known, F.regexp_replace(h, r"^www\.", "")), F.nullif(F.regexp_extract(h, r"^(.+)\.stackexchange\.com$", 1), F.lit("")))
    post = F.nullif(F.regexp_extract(url_path(url), r"^/(?:questions|q|a)/(\d+)", 1), F.lit(""))
    return F.when(site.isNotNull() & post.isNotNull(), F.struct(site.alias("site"), post.alias("post")))


def wikipedia_route(url: Column) -> Column:
    """struct<lang, title>, or null for other pages and namespaces."""
    lang = F.regexp_extract(host(url), r"^([a-z]{2,3})(?:\.m)?\.wikipedia\.org$", 1)
    title = F.try_url_decode(F.replace(F.regexp_extract(url_path(url), r"^/wiki/(.+)$", 1), F.lit("+"), F.lit("%2B")))
    ordinary = F.coalesce(title, F.lit("")) != ""
    for n in WIKI_NAMESPACES:
        ordinary &= ~F.startswith(title, F.lit(n))
    return F.when((lang != "") & ordinary, F.struct(lang.alias("lang"), title.alias("title")))


def is_pdf_response(status: Column, content_type: Column) -> Column:
    """Whether a probe's answer is a PDF; a probe that failed has nulls."""
    base = F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))
    return F.coalesce((status < 400) & (base == "application/pdf"), F.lit(False))


def passthrough_response(status: Column, content_type: Column) -> Column:
    """The content type of a probe's answer that is passed on as it is, or null."""
    return F.when((status < 400) & is_passthrough_type(content_type), content_type)


#: Readers in the order in which they are asked: name, and which URLs it takes.
READERS = [
    ("pdf", is_pdf),
    ("passthrough", is_passthrough),
    ("youtube", lambda url: youtube_id(url).isNotNull()),
    ("github", lambda url: github_route(url).isNotNull()),
    ("stackexchange", lambda url: stack_route(url).isNotNull()),
    ("wikipedia", lambda url: wikipedia_route(url).isNotNull()),
]


def route(url: Column, readers: list = READERS, rest: str = "browser") -> Column:
    """The first reader that takes the URL; ``rest`` takes what none does."""
    out = None
    for name, takes in readers:
        out = F.when(takes(url), name) if out is None else out.when(takes(url), name)
    return F.lit(rest) if out is None else out.otherwise(rest)
