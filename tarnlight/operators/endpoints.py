"""Checks of HTTP observations: licence hints, llms.txt, usage headers and agent endpoints.

fetches: site, path, method, status int, headers map<string,string>, body string, error string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# User agents of AI crawlers, probed paths and header names.
AI_BOTS = (
    "GPTBot", "ChatGPT-User", "Google-Extended", "ClaudeBot", "PerplexityBot", "Amazonbot", "OAI-SearchBot", "DeepSeek-AI", "Grok", "Meta-ExternalAgent", "cohere-ai", "AI2Bot", "ByteSpider",
)
LLMS_PATHS = ("/llms.txt", "/.well-known/llms.txt")
LLMS_FULL_PATHS = ("/llms-full.txt", "/.well-known/llms-full.txt")
AGENTS_PATHS = ("/agents.md", "/AGENTS.md", "/.well-known/agents.md")
PAYMENT_HEADERS = ("x-payment", "x-payment-required", "x-402-receipt", "pay", "payment-address")


def robots_directives(robots: Column) -> dict[str, Column]:
    """Sitemaps, first valid crawl delay and named AI agents of a robots text."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))

    def values(name: str) -> Column:
        hits = F.filter(lines, lambda x: x.rlike(rf"(?i)^{name}:\s*\S"))
        return F.transform(hits, lambda x: F.trim(F.regexp_extract(x, rf"(?i)^{name}:\s*(.+)$", 1)))

    delays = F.filter(F.transform(values("crawl-delay"), lambda x: x.try_cast("double")), lambda d: d.isNotNull())
    agents = F.array_distinct(F.filter(values("user-agent"), lambda a: a.isin(*AI_BOTS)))
    return {"sitemaps": values("sitemap"), "crawl_delay": F.get(delays, F.lit(0)), "ai_agents": agents}


def _hit() -> Column:
    return (F.col("status") == 200) & F.col("error").isNull()


def _first_path(paths: tuple[str, ...], also: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(paths))):
        rank = F.when(F.col("path") == p, i).otherwise(rank)
    ok = _hit() & also & rank.isNotNull()
    return F.min_by(F.when(ok, F.col("path")), F.when(ok, rank))


def header(name: str) -> Column:
    """A header's value, whatever the case of its name; of several the last."""
    entries = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(entries, F.lit(-1))["value"]


def usage_flag(value: Column, name: str) -> Column:
    """yes or no of a key of a usage header; of several the last counts, NULL for anything else."""
    found = F.regexp_extract_all(F.lower(value), F.lit(rf"\b{name}\s*=\s*(\w+)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(last == "yes", True).when(last == "no", False)


def site_checks(fetches: DataFrame) -> DataFrame:
    """One row per site with every check and the score of the endpoints, to which agent_readiness adds that of the page; conditional aggregates, one shuffle."""
    f = fetches.withColumn("content_type", F.coalesce(header("content-type"), F.lit("")))
    f = f.withColumn("usage", F.when(_hit() & (F.col("method") == "HEAD"), F.nullif(F.trim(header("content-usage")), F.lit(""))))
    get = F.col("method") == "GET"
    filled = get & F.col("body").rlike(r"\S")
    mcp = get & _hit() & (F.col("path") == "/.well-known/mcp.json")
    is_json = F.expr("try_parse_json(body) is not null")
    names = F.transform(F.map_keys("headers"), F.lower)
    paid = F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, PAYMENT_HEADERS))), F.lit(False)) & (F.col("method") == "HEAD")
    md = F.coalesce(F.col("content_type").rlike(r"text/(?:x-)?markdown"), F.lit(False)) & F.col("error").isNull() & (F.col("method") == "GET-MARKDOWN")
    out = f.groupBy("site").agg(
        _first_path(LLMS_PATHS, filled).alias("llms_path"), _first_path(LLMS_FULL_PATHS, filled).alias("llms_full_path"),
        F.max("usage").alias("usage_header"),
        _first_path(AGENTS_PATHS, get & F.col("content_type").contains("text")).alias("agents_path"),
        F.bool_or(md).alias("markdown_accept"),
        F.max(F.when(mcp, F.when(is_json, 4.0).otherwise(1.0))).alias("mcp_score"),
        F.max(F.when(mcp, F.json_array_length(F.get_json_object("body", "$.tools")))).alias("mcp_tools"),
        F.bool_or((F.col("status") == 402) & (F.col("method") == "HEAD")).alias("has_402"), F.bool_or(paid).alias("has_payment_header"),
        F.bool_or(get & _hit() & (F.col("path") == "/.well-known/nlweb")).alias("nlweb"),
    )
    score = (
        F.when(F.col("agents_path").isNotNull(), 5.0).otherwise(0.0) + F.when(F.col("markdown_accept"), 5.0).otherwise(0.0) + F.coalesce("mcp_score", F.lit(0.0))
        + F.coalesce(F.col("has_402").cast("int"), F.lit(0)) + F.coalesce(F.col("has_payment_header").cast("int"), F.lit(0)) + F.when(F.col("nlweb"), 0.5).otherwise(0.0)
    )
    return out.withColumns({
        "allows_training": usage_flag(F.col("usage_header"), "training"), "allows_search": usage_flag(F.col("usage_header"), "search"), "agent_score": F.least(F.lit(20.0), score),
    })


# Headers that belong to one connection and are not passed on.
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailers", "transfer-encoding", "upgrade")


def forwarded_headers(headers: Column) -> Column:
    """A map of headers without those of one connection."""
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*HOP_BY_HOP))


def wants_markdown(accept: Column) -> Column:
    return F.coalesce(F.lower(accept).contains("text/markdown"), F.lit(False))


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False))


def agent_readiness(checks: DataFrame, signals: DataFrame) -> DataFrame:
    """checks (site_checks) with the agent score in full.

    signals: site, semantic_score (0 to 3) and nlweb_schema (boolean) of the site's main page, one row per
    site. Sites without such a page get no points for it; a score is at most 20.
    """
    page = signals.select("site", "semantic_score", "nlweb_schema")
    more = F.coalesce("semantic_score", F.lit(0)) + F.when(F.coalesce("nlweb_schema", F.lit(False)), 0.5).otherwise(0.0)
    return checks.join(page, "site", "left").withColumn("agent_score", F.least(F.lit(20.0), F.col("agent_score") + more))


def check_totals(checks: DataFrame) -> DataFrame:
    """Sites that pass each agent check, as number and percentage: (check, n, pct); unpivoted before the sums."""
    flags = {
        "agents_md": F.col("agents_path").isNotNull(), "markdown_accept": F.col("markdown_accept"), "mcp": F.col("mcp_score").isNotNull(), "llms_txt": F.col("llms_path").isNotNull(),
        "x402": F.col("has_402") | F.col("has_payment_header"), "nlweb": F.col("nlweb"),
    }
    long = checks.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in flags.items()])))
    return long.groupBy("check").agg(F.count_if("ok").alias("n"), F.bround(100 * F.count_if("ok") / F.count("*"), 1).alias("pct"))
