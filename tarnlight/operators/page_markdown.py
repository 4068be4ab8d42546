"""Bulk conversion of pages to markdown with its statistics, and site facts for generated files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.functions import dom, html, markdown, urls
from tarnlight.runtime import spread


def convert(pages: DataFrame, key: str, source: str, config: dom.MarkdownConfig = dom.MarkdownConfig(), *keep: str) -> DataFrame:
    """(key, markdown, kept columns) of every page; NULL and empty html give an empty markdown. One parse per page, in Arrow batches."""
    kinds = dict(pages.dtypes)
    names = [key, "markdown", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [dom.to_markdown(h, config) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[2:]], names=names)

    return spread(pages.select(key, source, *keep)).mapInArrow(run, ", ".join([f"{key} {kinds[key]}", "markdown string", *(f"{c} {kinds[c]}" for c in keep)]))


def reduction(pages: DataFrame, key: str, source: str, config: dom.MarkdownConfig = dom.MarkdownConfig()) -> DataFrame:
    """(key, raw_tokens, clean_tokens, reduction_pct) of the conversion, from one scan without a join."""
    sized = pages.select(key, source, markdown.token_estimate(F.col(source)).alias("raw_tokens"))
    made = convert(sized, key, source, config, "raw_tokens").select(key, "raw_tokens", markdown.token_estimate(F.col("markdown")).alias("clean_tokens"))
    return made.withColumn("reduction_pct", markdown.waste_pct(F.col("raw_tokens"), F.col("clean_tokens")))


def site_files(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    """(path, markdown) of a static copy of the pages."""
    return convert(pages, key, source, dom.MarkdownConfig(), url).select(urls.markdown_path(F.col(url)).alias("path"), "markdown")


def llms_txt(pages: DataFrame, site: str, url: str, source: str, most: int = 5000) -> DataFrame:
    """(site, part, llms_txt): a title line and one link per page, by address.

    Sites of more than `most` pages get several numbered files of about that many links, pages
    spread by a hash of their address, so that no file and no task holds a whole large site.
    """
    rows = pages.select(site, F.col(url).alias("u"), F.coalesce(html.title(F.col(source)), F.col(url)).alias("t")).dropna(subset=["u", site]).distinct()
    parts = rows.groupBy(site).agg(F.ceil(F.count("*") / most).alias("parts"))
    placed = rows.join(parts, site).withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")))
    lines = placed.groupBy(site, "part").agg(F.sort_array(F.collect_list(F.struct("u", "t"))).alias("p"))
    body = F.array_join(F.transform("p", lambda p: F.concat(F.lit("- ["), p["t"], F.lit("]("), p["u"], F.lit(")"))), "\n")
    return lines.select(site, "part", F.concat(F.lit("# "), F.col(site), F.lit("\n\n## Pages\n"), body).alias("llms_txt"))
