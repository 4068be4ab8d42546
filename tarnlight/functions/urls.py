"""URL expressions (RFC 3986 split by regular expression: never fails, unlike parse_url)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic URI pattern of RFC 3986, appendix B.
URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + URI, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 2))


def netloc(url: Column) -> Column:
    return part(url, 4)


def path(url: Column) -> Column:
    return part(url, 5)


def query(url: Column) -> Column:
    return part(url, 7)


def hostname(url: Column) -> Column:
    """Lower-case host without user info and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def domain(url: Column) -> Column:
    """The host name without one leading ``www.``."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def ensure_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def strip_slashes(text: Column) -> Column:
    return F.regexp_replace(text, r"^/+|/+$", "")


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slash (an empty path is "/"), no query, no fragment."""
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), F.when(bare == "", F.lit("/")).otherwise(bare))


def depth(url: Column) -> Column:
    """Number of path segments."""
    bare = strip_slashes(path(url))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "/")))


def page_weight(url: Column) -> Column:
    """Weight of a page in its site: 3 at depth 0 and 1, 2 at depth 2, else 1."""
    n = depth(url)
    return F.when(n <= 1, 3).when(n == 2, 2).otherwise(1)


def first_segment(url: Column) -> Column:
    return F.split(strip_slashes(path(url)), "/").getItem(0)


def markdown_path(url: Column) -> Column:
    """Relative path of a page's markdown copy: a trailing slash or an empty path means index."""
    p = F.regexp_replace(path(url), "^/+", "")
    return F.concat(
        F.when((p == "") | p.endswith("/"), F.concat(p, F.lit("index"))).otherwise(p), F.lit(".md")
    )


def directory_name(url: Column) -> Column:
    """A directory name made of host, path and query; other characters than A-Z a-z 0-9 . - become one "_"."""
    q = query(url)
    raw = F.concat(netloc(url), path(url), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("_"), q)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[^a-zA-Z0-9.\-]", "_"), "_+", "_"), "^_+|_+$", "")


def report_slug(url: Column) -> Column:
    """A file name for a report on a URL: no scheme, slashes as underscores."""
    return F.replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), F.lit("/"), F.lit("_"))


def is_valid(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")


def entity_key(url: Column) -> Column:
    """One key for spellings of a URL that differ in the case of the host, trailing slashes or a fragment."""
    text = F.trim(url)
    q = part(text, 6)
    head = F.concat(F.coalesce(part(text, 1), F.lit("")), F.coalesce(part(text, 3), F.lit("")))
    return F.concat(F.lower(head), F.regexp_replace(path(text), "/+$", ""), F.coalesce(q, F.lit("")))
