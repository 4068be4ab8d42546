"""Texts made from rows: llms.txt from nested content, agent files, JSON-LD and prompts, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters of page content that a prompt may hold.
PROMPT_CHARS = 8000


def llms_txt(title: Column, description: Column, sections: Column) -> Column:
    """llms.txt of nested content; sections: array of struct(heading, links array of struct(title, url, description))."""

    def link(x: Column) -> Column:
        note = F.when(F.coalesce(x["description"], F.lit("")) != "", F.concat(F.lit(": "), x["description"])).otherwise(F.lit(""))
        return F.concat(F.lit("- ["), F.coalesce(x["title"], x["url"]), F.lit("]("), x["url"], F.lit(")"), note)

    def section(x: Column) -> Column:
        return F.concat(F.lit("## "), x["heading"], F.lit("\n\n"), F.array_join(F.transform(x["links"], link), "\n"))

    quote = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("> "), description))
    parts = F.concat(F.array(F.concat(F.lit("# "), title), quote), F.transform(F.coalesce(sections, F.array()), section))
    return F.concat(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n"), F.lit("\n"))


def json_ld(kind: str, fields: dict[str, Column]) -> Column:
    """A JSON-LD object of the fields that are not NULL, indented."""
    entries = [F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[c.alias(n) for n, c in fields.items()]]
    return F.to_json(F.struct(*entries), {"pretty": "true"})


def agents_md(name: Column, description: Column, headings: Column, links: Column, most: int = 20) -> Column:
    """A short guide for agents: what the site is, its sections, its first links."""
    listed = lambda xs: F.array_join(F.transform(F.slice(F.array_distinct(F.coalesce(xs, F.array().cast("array<string>"))), 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), name), F.nullif(description, F.lit("")), F.lit("## Sections"), listed(headings), F.lit("## Links"), listed(links))


def page_prompt(task: str, url: Column, content: Column) -> Column:
    """A prompt over a page: the task, the address and the content, cut to PROMPT_CHARS characters."""
    return F.concat(F.lit(task + "\n\nURL: "), url, F.lit("\n\n"), F.substring(F.coalesce(content, F.lit("")), 1, PROMPT_CHARS))
