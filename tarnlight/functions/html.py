"""Signals of html pages as native expressions: script, style and comments are blanked first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quiet(html: Column) -> Column:
    """The html without comments, scripts and styles (JSON-LD blocks go with the scripts)."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    return F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")


def visible_text(html: Column) -> Column:
    """Text without navigation, header, footer and tags, blanks collapsed."""
    out = quiet(html)
    for tag in ("nav", "header", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def has_tag(html: Column, tag: str) -> Column:
    return html.rlike(rf"(?i)<{tag}[\s/>]")


# The landmark roles of the accessibility standard.
LANDMARKS = ("banner", "complementary", "contentinfo", "form", "main", "navigation", "region", "search")


def landmark_count(html: Column) -> Column:
    roles = F.regexp_extract_all(html, F.lit(r"""(?i)\srole\s*=\s*["']?([a-zA-Z]+)"""), F.lit(1))
    return F.size(F.filter(roles, lambda r: F.lower(r).isin(*LANDMARKS)))


def semantic_score(html: Column) -> Column:
    """0 to 3: a main or article; a header and a nav; two landmark roles or more."""
    q = quiet(html)
    a = (has_tag(q, "main") | has_tag(q, "article")).cast("int")
    b = (has_tag(q, "header") & has_tag(q, "nav")).cast("int")
    return a + b + (landmark_count(q) >= 2).cast("int")


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(quiet(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def json_ld_texts(html: Column) -> Column:
    return F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""), F.lit(1)
    )


def has_date(html: Column) -> Column:
    """A publication or modification date in meta tags or a time element."""
    q = quiet(html)
    names = "article:published_time|article:modified_time|og:updated_time|datePublished|dateModified|date|publish[-_]date|last-modified"
    return q.rlike(rf"""(?i)<meta[^>]+(?:property|name|itemprop)\s*=\s*["'](?:{names})["']""") | q.rlike(r"(?i)<time[^>]+datetime\s*=")


def has_author(html: Column) -> Column:
    q = quiet(html)
    return (
        q.rlike(r"""(?i)<meta[^>]+name\s*=\s*["']author["'][^>]+content\s*=\s*["'][^"']""")
        | q.rlike(r"""(?i)<a[^>]+rel\s*=\s*["'][^"']*\bauthor\b""")
        | q.rlike(r"""(?i)itemprop\s*=\s*["']author""")
        | q.rlike(r"""(?i)class\s*=\s*["'][^"']*(?:byline|author)""")
    )


def any_link(links: Column, pattern: str) -> Column:
    return F.exists(links, lambda h: h.rlike(pattern))


def trust_signals(html: Column, links: Column) -> Column:
    """Kinds of trust pages that links or texts name, in fixed order."""
    q = quiet(html)
    return F.array_compact(F.array(
        F.when(any_link(links, "(?i)privacy") | q.rlike("(?i)privacy"), F.lit("privacy")),
        F.when(any_link(links, "(?i)terms") | q.rlike("(?i)terms (?:of|and)"), F.lit("terms")),
    ))


def meta_tag_points(html: Column) -> Column:
    """Open Graph title and description, five points each."""
    q = quiet(html)
    return F.when(q.rlike(r"""(?i)<meta[^>]+property\s*=\s*["']og:title["']"""), 5.0).otherwise(0.0) + F.when(
        q.rlike(r"""(?i)<meta[^>]+property\s*=\s*["']og:description["']"""), 5.0
    ).otherwise(0.0)
