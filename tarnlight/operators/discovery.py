"""Discovery of pages: sitemaps, internal links, filters and diverse samples per site."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urldefrag, urljoin, urlparse
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlight.functions import html as H
from tarnlight.functions import urls

# Fixed value: the XML namespace of the sitemap protocol.
_NS = "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def sitemap_locs(xml: str | None) -> tuple[list[str], list[str]]:
    """(pages, child sitemaps) of a sitemap text; damaged or foreign XML has neither."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return [], []
    locs = lambda kind: [t.strip() for e in root.iter(f"{_NS}{kind}") if (t := e.findtext(f"{_NS}loc")) and t.strip()]
    return locs("url"), locs("sitemap")


def parse_sitemaps(df: DataFrame, url: str, xml: str) -> DataFrame:
    """(url, kind, pos, loc) of every entry; kind is page or sitemap."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, x in zip(b.iloc[:, 0], b.iloc[:, 1]):
                pages, children = sitemap_locs(x)
                out += [(u, "page", i, v) for i, v in enumerate(pages)] + [(u, "sitemap", i, v) for i, v in enumerate(children)]
            yield pd.DataFrame(out, columns=["url", "kind", "pos", "loc"])

    return df.select(url, xml).mapInPandas(parse, "url string, kind string, pos long, loc string")


def sitemap_pages(fetches: DataFrame, most: int = 500, children: int = 10) -> DataFrame:
    """(site, url) of the pages of each site's sitemap, or of the first children of its index; fetches: site, url, body."""
    entries = parse_sitemaps(fetches, "url", "body")
    owned = entries.join(fetches.select("site", "url"), "url")
    index = owned.filter((F.col("kind") == "sitemap") & (F.col("pos") < children)).select("site", F.col("loc").alias("child"), F.col("pos").alias("child_pos"))
    direct = owned.filter("kind = 'page'").join(index.select(F.col("child").alias("url")).distinct(), "url", "left_anti").select("site", "loc", F.lit(-1).cast("long").alias("child_pos"), "pos")
    below = entries.filter("kind = 'page'").join(index, F.col("url") == F.col("child")).select("site", "loc", "child_pos", "pos")
    w = W.partitionBy("site").orderBy("child_pos", "pos", "loc")
    return direct.unionByName(below).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select("site", F.col("loc").alias("url"))


def internal_links(df: DataFrame, url: str, html: str) -> DataFrame:
    """(url, pos, link): absolute links to the same host, without fragments, each once, in order."""

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for base, links in zip(b.iloc[:, 0], b.iloc[:, 1]):
                host, seen = urlparse(base or "").netloc, {}
                for h in links if links is not None else ():
                    try:
                        full = urldefrag(urljoin(base, h))[0]
                        parts = urlparse(full)
                    except ValueError:
                        continue
                    if parts.scheme in ("http", "https") and parts.netloc == host:
                        seen.setdefault(full, len(seen))
                out += [(base, i, link) for link, i in seen.items()]
            yield pd.DataFrame(out, columns=["url", "pos", "link"])

    return df.select(url, H.hrefs(F.col(html)).alias("_h")).mapInPandas(resolve, "url string, pos long, link string")


def robots_access(robots: DataFrame, bots: list[str], site: str = "site", body: str = "body", path: str = "/") -> DataFrame:
    """(site, bot, allowed) by the robots rules of each site; a NULL body (no file) allows nothing to be said: no rows."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, text in zip(b.iloc[:, 0], b.iloc[:, 1]):
                if text is None:
                    continue
                rules = RobotFileParser()
                rules.parse(text.splitlines())
                out += [(s, bot, rules.can_fetch(bot, path)) for bot in bots]
            yield pd.DataFrame(out, columns=["site", "bot", "allowed"])

    return robots.select(site, body).mapInPandas(judge, "site string, bot string, allowed boolean")


def allowed_urls(pages: DataFrame, robots: DataFrame, bot: str, site: str = "site", url: str = "url") -> DataFrame:
    """Pages that a bot may fetch; sites without a robots file stay whole.

    Rules go to the pages by a join on the site, which adaptive execution splits where a site is hot.
    """
    joined = pages.join(robots.select(site, F.col("body").alias("_rules")), site, "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            keep = []
            for u, text in zip(b[url], b["_rules"]):
                if text is None or text != text:
                    keep.append(True)
                    continue
                rules = known.get(text)
                if rules is None:
                    rules = RobotFileParser()
                    rules.parse(text.splitlines())
                    if len(known) < 10_000:
                        known[text] = rules
                keep.append(rules.can_fetch(bot, u))
            yield b[pd.Series(keep, index=b.index, dtype=bool)]

    return joined.mapInPandas(judge, joined.schema).drop("_rules")


def unique_urls(df: DataFrame, url: str, order: str) -> DataFrame:
    """The first row (by order) of each normalised URL; aggregates before it shuffles."""
    rest = [c for c in df.columns if c != order]
    first = df.groupBy(urls.normalize(F.col(url)).alias("normalized_url")).agg(F.min(F.struct(order, *rest)).alias("r"))
    return first.select("normalized_url", *[F.col(f"r.{c}").alias(c) for c in df.columns])


def diverse_sample(df: DataFrame, site: str, url: str, most: int, order: str) -> DataFrame:
    """Up to `most` pages per site, taking turns between the first path segments (a sampling operator).

    Within a segment pages come in the given order. Row numbers are limited per group before the shuffle.
    """
    seg = urls.first_segment(F.col(url))
    turn = df.withColumn("segment", seg).withColumn("turn", F.row_number().over(W.partitionBy(site, "segment").orderBy(order))).filter(F.col("turn") <= most)
    return turn.withColumn("place", F.row_number().over(W.partitionBy(site).orderBy("turn", "segment"))).filter(F.col("place") <= most)


def discovered(fetches: DataFrame, pages: DataFrame, most: int = 500) -> DataFrame:
    """(site, url, method): the sitemap's pages of a site, or where it has none, the links of its pages.

    fetches: site, url, body of sitemap files; pages: site, url, html.
    """
    listed = sitemap_pages(fetches, most).withColumn("method", F.lit("sitemap"))
    without = pages.join(listed.select("site").distinct(), "site", "left_anti")
    links = internal_links(without, "url", "html").join(without.select("site", "url").distinct(), "url").select("site", F.col("link").alias("url")).distinct()
    return listed.unionByName(links.withColumn("method", F.lit("links"))).distinct()
