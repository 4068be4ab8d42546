"""Queries over scores: pillars, lint, recommendations, sites, rankings, history, answers, observations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import html as H
from tarnlight.functions import markdown as M
from tarnlight.functions import readiness
from tarnlight.functions import urls as U
from tarnlight.operators import answer_analytics, discovery, endpoints, generated_texts, score_changes, site_marts, structured_data
from tarnlight.plans.content_queries import _QUIET, _VISIBLE, _WS, _metrics_sql
from tarnlight.runtime import broadcast_if_small, durable, spread, table

# Robots files by kind of site (length of the host modulo 4); the tables hold no robots files of their own.
ROBOTS = {
    0: None,
    1: "User-agent: *\nDisallow:\nSitemap: https://example.test/sitemap.xml\nCrawl-delay: 5\n",
    2: "User-agent: GPTBot\nDisallow: /\n\nUser-agent: ClaudeBot\nCrawl-delay: soon\nCrawl-delay: 2.5\nDisallow: /private\n\nUser-agent: *\nAllow: /\n",
    3: "user-agent: *\ndisallow: /\n\nUser-Agent: Grok\nDisallow:\n\nsitemap: https://example.test/a.xml\nSitemap:  https://example.test/b.xml\n",
}


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("site").dropna().distinct().withColumn("kind", F.pmod(F.length("site"), F.lit(4)))


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = spark.createDataFrame(list(ROBOTS.items()), "kind int, body string")
    return _sites(spark, sf_dir).join(broadcast_if_small(bodies), "kind").select("site", "kind", "body")


def bot_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.robots_access(_robots(spark, sf_dir), list(endpoints.AI_BOTS))


BOT_ACCESS_SQL = (
    "with s as (select distinct site, length(site) % 4 as kind from pages where site is not null), b(bot) as (values " + ", ".join(f"('{b}')" for b in endpoints.AI_BOTS) + ") "
    "select site, bot, case kind when 1 then true when 2 then bot <> 'GPTBot' else bot = 'Grok' end as allowed from s, b where kind <> 0"
)


def bot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_marts.cross_tab(bot_access(spark, sf_dir), "site", "bot", "allowed", ["GPTBot", "ClaudeBot", "Grok"])


BOT_MATRIX_SQL = f"""with a as ({BOT_ACCESS_SQL}) select site, bool_or(allowed) filter (bot = 'GPTBot') as "GPTBot", bool_or(allowed) filter (bot = 'ClaudeBot') as "ClaudeBot", bool_or(allowed) filter (bot = 'Grok') as "Grok" from a group by site"""


def robots_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = endpoints.robots_directives(F.col("body"))
    return _robots(spark, sf_dir).select("site", F.array_join(d["sitemaps"], ",").alias("sitemaps"), d["crawl_delay"].alias("crawl_delay"), F.array_join(d["ai_agents"], ",").alias("ai_agents"))


def _robots_values() -> str:
    return ", ".join(f"({k}, {'null' if v is None else chr(39) + v + chr(39)})" for k, v in ROBOTS.items())


ROBOTS_SQL = f"""
with r(kind, body) as (values {_robots_values()}), s as (select distinct site, length(site) % 4 as kind from pages where site is not null),
l as (select site, list_transform(string_split(replace(coalesce(body, ''), chr(13), chr(10)), chr(10)), lambda x: trim(x)) as lines from s join r using (kind))
select site, array_to_string(list_transform(list_filter(lines, lambda x: regexp_matches(x, '(?i)^sitemap:\\s*\\S')), lambda x: trim(regexp_extract(x, '(?i)^sitemap:\\s*(.+)$', 1))), ',') as sitemaps,
  list_filter(list_transform(list_filter(lines, lambda x: regexp_matches(x, '(?i)^crawl-delay:\\s*\\S')), lambda x: try_cast(trim(regexp_extract(x, '(?i)^crawl-delay:\\s*(.+)$', 1)) as double)), lambda d: d is not null)[1] as crawl_delay,
  array_to_string(list_filter(list_transform(list_filter(lines, lambda x: regexp_matches(x, '(?i)^user-agent:\\s*\\S')), lambda x: trim(regexp_extract(x, '(?i)^user-agent:\\s*(.+)$', 1))), lambda a: a in ({', '.join(f"'{b}'" for b in endpoints.AI_BOTS)})), ',') as ai_agents
from l"""


def _bots_column():
    bot = lambda name, ok: F.struct(F.lit(name).alias("bot"), ok.alias("allowed"))
    kind = F.pmod(F.length("site"), F.lit(4))
    return F.array(bot("GPTBot", kind == 1), bot("ClaudeBot", kind != 3), bot("Grok", F.lit(True)))


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide page rows: content metrics, token waste, site facts by kind of site, types of the markup in use."""
    raw, clean = M.token_estimate(F.col("html")), M.token_estimate(F.col("text"))
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "url", "site", "error", "markdown", "html")).select("page_id", "url", "site", "error", "markdown", "html", H.visible_text(F.col("html")).alias("text"))
    metrics = {n: c for n, c in M.content_metrics(F.col("markdown")).items()}
    kind = F.pmod(F.length("site"), F.lit(4))
    types = F.array_compact(F.array(F.when(F.col("html").contains("<article"), "Article"), F.when(F.col("html").contains("<pre"), "HowTo"), F.when(F.col("html").contains("<table><"), "Dataset")))
    return rows.select(
        "page_id", "url", "site", "error", *[c.alias(n) for n, c in metrics.items()], raw.alias("raw_tokens"), clean.alias("clean_tokens"), M.waste_pct(raw, clean).alias("waste_pct"),
        F.coalesce(types, F.array().cast("array<string>")).alias("schema_types"), F.coalesce(F.size(types), F.lit(0)).alias("blocks_found"),
        (kind == 1).alias("llms_found"), (kind == 2).alias("llms_full_found"), (kind != 0).alias("robots_found"), _bots_column().alias("bots"),
    )


_PAGE_ROWS_SQL = rf"""
m as ({_metrics_sql('pages', 'page_id', 'markdown')}),
h as (select page_id, url, site, error, coalesce(html, '') as html, {_QUIET} as q from pages),
w as (select *, length(html) // 4 as raw_tokens, length({_VISIBLE}) // 4 as clean_tokens, length(site) % 4 as kind from h),
p as (select w.*, m.* exclude (page_id), case when raw_tokens = 0 then 0.0 else round_even((raw_tokens - clean_tokens)::double / raw_tokens * 100, 1) end as waste_pct,
  list_filter([case when contains(html, '<article') then 'Article' end, case when contains(html, '<pre') then 'HowTo' end, case when contains(html, '<table><') then 'Dataset' end], lambda x: x is not null) as schema_types,
  kind = 1 as llms_found, kind = 2 as llms_full_found, kind <> 0 as robots_found,
  [{{'bot': 'GPTBot', 'ok': kind = 1}}, {{'bot': 'ClaudeBot', 'ok': kind <> 3}}, {{'bot': 'Grok', 'ok': true}}] as bots from w join m using (page_id)),
s as (select *, len(schema_types) as blocks_found, len(list_filter(bots, lambda b: not b.ok)) as blocked,
  case when kind <> 0 then round_even(25 * len(list_filter(bots, lambda b: b.ok))::double / 3, 1) else 0.0 end as robots_score, case when kind in (1, 2) then 10.0 else 0.0 end::double as llms_score,
  case when len(schema_types) > 0 then least(25, 8 + 5 * len(list_filter(schema_types, lambda t: t in ('Article', 'FAQPage', 'HowTo', 'Product', 'Recipe'))) + 3 * len(list_filter(schema_types, lambda t: t not in ('Article', 'FAQPage', 'HowTo', 'Product', 'Recipe')))) else 0 end::double as schema_score,
  least(40, case when word_count >= 1500 then 25 when word_count >= 800 then 20 when word_count >= 400 then 15 when word_count >= 150 then 8 else 0 end + has_headings::int * 7 + has_lists::int * 5 + has_code_blocks::int * 3)::double as content_score from p)"""


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readiness.with_scores(_page_rows(spark, sf_dir))
    return rows.select("page_id", "robots_score", "llms_score", "schema_score", "content_score", "overall_score", "rescaled_score")


PAGE_SCORES_SQL = f"""with {_PAGE_ROWS_SQL}
select page_id, robots_score, llms_score, schema_score, content_score, robots_score + llms_score + schema_score + content_score as overall_score,
  round_even(robots_score / 25 * 20, 1) + round_even(llms_score / 10 * 5, 1) + round_even(schema_score / 25 * 20, 1) + round_even(content_score / 40 * 35, 1) as rescaled_score from s"""


def lint_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page_rows(spark, sf_dir).select("page_id", F.inline(readiness.lint_checks()))
    return rows


LINT_SQL = f"""with {_PAGE_ROWS_SQL},
c as (select page_id, unnest([{{'name': 'AI Primitives', 'passed': llms_found or llms_full_found, 'severity': case when llms_found or llms_full_found then 'pass' else 'fail' end}},
  {{'name': 'Bot Access', 'passed': not (robots_found and blocked > 0), 'severity': case when robots_found and blocked > 0 then 'fail' else 'pass' end}},
  {{'name': 'Data Structuring', 'passed': blocks_found > 0, 'severity': case when blocks_found > 0 then 'pass' else 'fail' end}},
  {{'name': 'Token Efficiency', 'passed': waste_pct < 70, 'severity': case when waste_pct < 30 then 'pass' when waste_pct < 70 then 'warn' else 'fail' end}}]) as x from s)
select page_id, x.name as name, x.passed as passed, x.severity as severity from c"""


def page_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(spark, sf_dir).select("page_id", F.inline(readiness.diagnostics()))


DIAGNOSTICS_SQL = f"""with {_PAGE_ROWS_SQL},
d as (select page_id, unnest([
  case when waste_pct > 70 then {{'code': 'WARN-001', 'severity': 'warn', 'value': round_even(waste_pct, 0)::int::varchar}} end,
  case when not has_code_blocks then {{'code': 'WARN-002', 'severity': 'warn', 'value': null::varchar}} end, case when not has_headings then {{'code': 'WARN-003', 'severity': 'warn', 'value': null::varchar}} end,
  case when robots_found and blocked > 0 then {{'code': 'WARN-004', 'severity': 'warn', 'value': blocked::varchar}} end,
  case when readability_grade is not null then {{'code': 'INFO-001', 'severity': 'info', 'value': case when readability_grade < 6 then 'elementary' when readability_grade < 9 then 'middle school' when readability_grade < 13 then 'high school' else 'college level' end}} end,
  case when blocks_found > 0 then {{'code': 'INFO-002', 'severity': 'info', 'value': array_to_string(schema_types[1:5], ', ')}} end]) as x from s)
select page_id, x.code as code, x.severity as severity, x.value as value from d where x is not null"""


def page_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readiness.with_scores(_page_rows(spark, sf_dir)).select("page_id", F.posexplode(readiness.recommendations()).alias("place", "r"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), F.col("r.rule").cast("long").alias("rule"), "r.pillar", "r.impact", "r.priority")


_PRIO = lambda gap, most: f"case when ({gap}) / {most}::double >= 0.5 then 'high' when ({gap}) / {most}::double >= 0.25 then 'medium' else 'low' end"
RECOMMENDATIONS_SQL = f"""with {_PAGE_ROWS_SQL},
g as (select *, 25 - robots_score as gr, 25 - schema_score as gs, 40 - content_score as gc, 5 - len(list_filter(schema_types, lambda t: t in ('Article', 'FAQPage', 'HowTo', 'Product', 'Recipe'))) as missing from s),
r as (select page_id, unnest([
  case when gr > 0 and not robots_found then {{'rule': 1, 'pillar': 'robots', 'impact': gr, 'priority': {_PRIO('gr', 25)}}} end,
  case when gr > 0 and robots_found and blocked > 0 then {{'rule': 2, 'pillar': 'robots', 'impact': gr, 'priority': {_PRIO('gr', 25)}}} end,
  case when not llms_found and not llms_full_found then {{'rule': 3, 'pillar': 'llms_txt', 'impact': 10.0::double, 'priority': 'high'}} end,
  case when llms_found and not llms_full_found then {{'rule': 4, 'pillar': 'llms_txt', 'impact': 0.0::double, 'priority': 'low'}} end,
  case when gs > 0 and blocks_found = 0 then {{'rule': 5, 'pillar': 'schema', 'impact': gs, 'priority': {_PRIO('gs', 25)}}} end,
  case when gs > 0 and blocks_found > 0 and missing > 0 then {{'rule': 6, 'pillar': 'schema', 'impact': least(gs, 5.0 * missing), 'priority': {_PRIO('gs', 25)}}} end,
  case when gc > 0 and word_count < 400 then {{'rule': 7, 'pillar': 'content', 'impact': least(gc, 15.0), 'priority': {_PRIO('gc', 40)}}} end,
  case when gc > 0 and not has_headings then {{'rule': 8, 'pillar': 'content', 'impact': least(gc, 7.0), 'priority': {_PRIO('least(gc, 7.0)', 40)}}} end,
  case when gc > 0 and not has_lists then {{'rule': 9, 'pillar': 'content', 'impact': least(gc, 5.0), 'priority': {_PRIO('least(gc, 5.0)', 40)}}} end,
  case when gc > 0 and readability_grade > 12.0 then {{'rule': 10, 'pillar': 'content', 'impact': least(gc, 3.0), 'priority': 'medium'}} end,
  case when gc > 0 and answer_first_ratio < 0.3 and has_headings then {{'rule': 11, 'pillar': 'content', 'impact': least(gc, 3.0), 'priority': 'medium'}} end]) as x from g)
select page_id, row_number() over (partition by page_id order by round_even(x.impact, 1) desc, x.rule) - 1 as place, x.rule::bigint as rule, x.pillar as pillar, round_even(x.impact, 1) as impact, x.priority as priority from r where x is not null"""


def _site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_marts.aggregate_sites(readiness.with_scores(_page_rows(spark, sf_dir)))


def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_rows(spark, sf_dir)


_DEPTH = "case when regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') = '' then 0 else len(string_split(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')) end"
_SITE_ROWS_SQL = f"""{_PAGE_ROWS_SQL},
v as (select *, error is null or word_count > 0 as ok, case when {_DEPTH} <= 1 then 3 when {_DEPTH} = 2 then 2 else 1 end as weight from s),
t as (select site, count(*) as pages, count(error) as pages_failed,
  coalesce(round_even(sum(schema_score * weight) filter (ok) / sum(weight) filter (ok), 1), 0.0) as schema_score, coalesce(round_even(sum(content_score * weight) filter (ok) / sum(weight) filter (ok), 1), 0.0) as content_score,
  coalesce(sum(blocks_found) filter (ok), 0)::bigint as blocks_found, coalesce((sum(word_count) filter (ok))::bigint // count(*) filter (ok), 0) as avg_words, coalesce((sum(char_count) filter (ok))::bigint // count(*) filter (ok), 0) as avg_chars,
  coalesce(bool_or(has_headings) filter (ok), false) as has_headings, coalesce(bool_or(has_lists) filter (ok), false) as has_lists, coalesce(bool_or(has_code_blocks) filter (ok), false) as has_code_blocks from v group by site)"""
SITE_SCORES_SQL = f"with {_SITE_ROWS_SQL} select * from t"


def site_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites ranked by the mean token waste of their pages."""
    waste = _page_rows(spark, sf_dir).groupBy("site").agg(F.bround(F.avg("waste_pct"), 1).alias("waste_pct"), F.bool_or(F.col("llms_found")).alias("llms_found"), F.bool_or("robots_found").alias("robots_found"), F.first("bots").alias("bots"))
    rows = site_marts.leaderboard(waste)
    ready = site_marts.rag_ready(F.col("llms_found"), F.col("bots"), F.col("robots_found"), F.col("waste_pct"), 50.0)
    return rows.select("site", "waste_pct", "rank", ready.alias("rag_ready"))


LEADERBOARD_SQL = f"""with {_PAGE_ROWS_SQL},
a as (select site, round_even(avg(waste_pct), 1) as waste_pct, bool_or(llms_found) as llms, any_value(kind) as kind from s group by site)
select site, waste_pct, row_number() over (order by coalesce(waste_pct, 100), site) as rank, llms and (kind = 0 or kind = 1) and waste_pct < 50 as rag_ready from a"""


def category_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of site scores by the top-level label of the host."""
    sites = _site_rows(spark, sf_dir).withColumn("category", F.substring_index("site", ".", -1)).withColumn("score", F.col("schema_score") + F.col("content_score"))
    return site_marts.category_stats(sites, "category", "score", "site", "avg_words")


CATEGORY_SQL = f"""with {_SITE_ROWS_SQL} select regexp_extract(site, '[^.]*$') as category, count(*) as n, round_even(avg(schema_score + content_score), 1) as avg_score, round_even(avg(avg_words), 0) as avg_words, max(schema_score + content_score) as best_score,
  arg_min(site, (-(schema_score + content_score), site)) as best from t group by 1"""


def site_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by overall score, the first and last five marked."""
    pages = readiness.with_scores(_page_rows(spark, sf_dir)).filter("site is not null")
    rows = site_marts.overall(site_marts.aggregate_sites(pages), pages)
    return rows.select("site", "robots_score", "llms_score", "schema_score", "content_score", "overall_score", F.col("rank").cast("long").alias("rank"), "is_top", "is_bottom")


OVERALL_SQL = f"""with {_SITE_ROWS_SQL}, f as (select site, max(robots_score) as robots_score, max(llms_score) as llms_score from s where site is not null group by 1),
o as (select site, robots_score, llms_score, schema_score, content_score, round_even(robots_score + llms_score + schema_score + content_score, 1) as overall_score from t join f using (site))
select *, row_number() over w as rank, row_number() over w <= 5 as is_top, row_number() over w > count(*) over () - 5 as is_bottom from o window w as (order by overall_score desc, site)"""


def lint_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by check and verdict."""
    return lint_results(spark, sf_dir).groupBy("name", "severity").agg(F.count("*").alias("n_pages"))


VERDICTS_SQL = f"select name, severity, count(*) as n_pages from ({LINT_SQL}) group by all"


def audit_page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the latest audit of their address beside their own statistics."""
    audits = table(spark, sf_dir, "audits").filter("url is not null and ts is not null").groupBy("url").agg(F.max(F.struct("ts", "id", "overall_score")).alias("a"))
    pages = _page_rows(spark, sf_dir).select("page_id", "url", "word_count", "raw_tokens", "clean_tokens", "waste_pct")
    return pages.join(audits, "url").select("page_id", F.col("a.id").alias("audit_id"), F.col("a.overall_score").alias("audited_score"), "word_count", "raw_tokens", "clean_tokens", "waste_pct")


AUDIT_PAGES_SQL = f"""with {_PAGE_ROWS_SQL}, a as (select url, arg_max(id, (ts, id)) as audit_id from audits where url is not null and ts is not null group by 1)
select page_id, audit_id, overall_score as audited_score, word_count, raw_tokens, clean_tokens, waste_pct from p join a using (url) join (select distinct id as audit_id, overall_score from audits) using (audit_id)"""


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and mean waste by top-level label and site kind, with subtotals."""
    rows = _page_rows(spark, sf_dir).select(F.substring_index("site", ".", -1).alias("category"), F.col("robots_found"), "waste_pct")
    return rows.rollup("category", "robots_found").agg(F.count("*").alias("n"), F.bround(F.avg("waste_pct"), 2).alias("avg_waste"))


ROLLUP_SQL = f"""with {_PAGE_ROWS_SQL} select regexp_extract(site, '[^.]*$') as category, robots_found, count(*) as n, round_even(avg(waste_pct), 2) as avg_waste from s group by rollup (1, 2)"""


def headings_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_marts.split_means(_page_rows(spark, sf_dir), "has_headings", "waste_pct")


SPLIT_SQL = f"""with {_PAGE_ROWS_SQL} select round_even(avg(waste_pct) filter (has_headings), 2) as avg_with, round_even(avg(waste_pct) filter (not has_headings), 2) as avg_without,
  round_even(avg(waste_pct) filter (has_headings) - avg(waste_pct) filter (not has_headings), 2) as difference, count(*) filter (has_headings) as n_with from s"""


# ---- history ------------------------------------------------------------------------------------
def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "audits").select("id", "url", "ts", "overall_score", "robots_score", "llms_txt_score", "schema_org_score", "content_score").distinct()
    return rows.filter("overall_score is not null and url is not null and ts is not null").withColumn("url", U.entity_key(F.col("url")))


_AUDITS_SQL = r"""a as (select distinct id, lower(regexp_extract(trim(url), '^([^:/?#]+:)?(//[^/?#]*)?')) || regexp_replace(regexp_extract(trim(url), '^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)', 3), '/+$', '') || regexp_extract(trim(url), '^[^?#]*(\?[^#]*)?', 1) as url,
  ts, overall_score, robots_score, llms_txt_score, schema_org_score, content_score from audits where overall_score is not null and url is not null and ts is not null)"""


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_changes.latest(_audits(spark, sf_dir), "url", ["ts", "id"], 3).select("url", "id", "overall_score", F.col("place").cast("long").alias("place"))


HISTORY_SQL = f"with {_AUDITS_SQL}, r as (select *, row_number() over (partition by url order by ts desc, id desc) as place from a) select url, id, overall_score, place from r where place <= 3"


def score_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_changes.regressions(_audits(spark, sf_dir), "url", ["ts", "id"], "overall_score", ["content_score"], 5.0)
    return rows.select("url", "id", "prev_overall_score", "overall_score", "delta_overall_score", "delta_content_score")


REGRESSIONS_SQL = f"""with {_AUDITS_SQL}, l as (select *, lag(overall_score) over w as prev_overall_score, lag(content_score) over w as pc from a window w as (partition by url order by ts, id))
select url, id, prev_overall_score, overall_score, round_even(overall_score - prev_overall_score, 1) + 0 as delta_overall_score, round_even(content_score - pc, 1) + 0 as delta_content_score from l where round_even(overall_score - prev_overall_score, 1) < -5"""


def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pillars that are worse now than at the first audit of the URL."""
    rows = _audits(spark, sf_dir)
    scores = ["overall_score", "robots_score", "schema_org_score", "content_score"]
    ends = rows.groupBy("url").agg(*[F.min_by(s, F.struct("ts", "id")).alias(f"a_{s}") for s in scores], *[F.max_by(s, F.struct("ts", "id")).alias(f"b_{s}") for s in scores])
    first, last = ends.select("url", *[F.col(f"a_{s}").alias(s) for s in scores]), ends.select("url", *[F.col(f"b_{s}").alias(s) for s in scores])
    return score_changes.against_baseline(last, first, "url", scores, 5.0)


_ENDS_SQL = f"""f as (select *, row_number() over (partition by url order by ts, id) as k, row_number() over (partition by url order by ts desc, id desc) as j from a),
e as (select x.url, """ + ", ".join(f"x.{s} as a_{s}, y.{s} as b_{s}" for s in ("overall_score", "robots_score", "schema_org_score", "content_score")) + """ from f x join f y on x.url = y.url and x.k = 1 and y.j = 1)"""
BASELINE_SQL = f"with {_AUDITS_SQL}, {_ENDS_SQL}, p as (" + " union all ".join(f"select url, '{s}' as pillar, a_{s} as previous, b_{s} as current, round_even(b_{s} - a_{s}, 1) + 0 as delta from e" for s in ("overall_score", "robots_score", "schema_org_score", "content_score")) + ") select * from p where delta < -5"


def threshold_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_changes.latest(_audits(spark, sf_dir), "url", ["ts", "id"], 1)
    return score_changes.threshold_failures(rows, "url", {"overall_score": 50.0, "content_score": 10.0, "robots_score": None}, {"schema_org_score": 24.0})


THRESHOLD_SQL = f"""with {_AUDITS_SQL}, r as (select *, row_number() over (partition by url order by ts desc, id desc) as j from a), c as (select * from r where j = 1)
select url, 'overall_score' as pillar, overall_score as actual, 50.0::double as bound from c where overall_score < 50 union all select url, 'content_score', content_score, 10.0 from c where content_score < 10
union all select url, 'schema_org_score', schema_org_score, 24.0 from c where schema_org_score > 24"""


def pairwise_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last audit of each URL, pillar by pillar."""
    rows = _audits(spark, sf_dir)
    scores = ["overall_score", "content_score"]
    ends = rows.groupBy("url").agg(*[F.min_by(s, F.struct("ts", "id")).alias(f"a_{s}") for s in scores], *[F.max_by(s, F.struct("ts", "id")).alias(f"b_{s}") for s in scores])
    return score_changes.pairwise(ends.select("url", *[F.col(f"a_{s}").alias(s) for s in scores]), ends.select("url", *[F.col(f"b_{s}").alias(s) for s in scores]), "url", scores)


PAIRWISE_SQL = f"with {_AUDITS_SQL}, {_ENDS_SQL}, p as (" + " union all ".join(f"select url, '{s}' as pillar, a_{s} as score_a, b_{s} as score_b, round_even(a_{s} - b_{s}, 1) + 0 as delta from e" for s in ("overall_score", "content_score")) + ") select *, case when delta > 0 then 'a' when delta < 0 then 'b' else 'tie' end as winner from p"


def report_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested audit reports as flat rows with defaults; a damaged report counts as an empty one."""
    get = lambda path: F.get_json_object("j", path)
    rows = table(spark, sf_dir, "audits").filter("report_json is not null").select("id", "report_json").distinct()
    good = rows.withColumn("j", F.when(F.json_object_keys("report_json").isNotNull(), F.col("report_json")).otherwise(F.lit("{}")))
    return good.select(
        "id", F.coalesce(get("$.robots.found").cast("boolean"), F.lit(False)).alias("robots_found"), F.coalesce(get("$.robots.score").try_cast("double"), F.lit(0.0)).alias("robots_score"),
        F.coalesce(F.json_array_length(get("$.robots.bots")), F.lit(0)).cast("long").alias("n_bots"), F.coalesce(get("$.content.word_count").try_cast("long"), F.lit(0)).alias("word_count"),
        F.coalesce(get("$.content.context_waste_pct").try_cast("double"), F.lit(0.0)).alias("waste_pct"),
    )


FLATTEN_SQL = r"""with a as (select distinct id, report_json as r from audits where report_json is not null), b as (select id, case when json_valid(r) and json_type(r::json) = 'OBJECT' then r::json else '{}'::json end as j from a)
select id, coalesce((j->>'$.robots.found')::boolean, false) as robots_found, coalesce(try_cast(j->>'$.robots.score' as double), 0.0) as robots_score, coalesce(json_array_length(j->'$.robots.bots'), 0)::bigint as n_bots,
  coalesce(try_cast(j->>'$.content.word_count' as bigint), 0) as word_count, coalesce(try_cast(j->>'$.content.context_waste_pct' as double), 0.0) as waste_pct from b"""


def monthly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.bround(F.avg("overall_score"), 3).alias("avg_score"), F.countDistinct("url").alias("n_urls"))


MONTHLY_SQL = f"with {_AUDITS_SQL} select strftime(ts, '%Y-%m') as month, count(*) as n, round_even(avg(overall_score), 3) as avg_score, count(distinct url) as n_urls from a group by 1"


# ---- answers ------------------------------------------------------------------------------------
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer_analytics.citations(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "url", "domain")


_ADDR = r"""https?://[^\s<>"'')\]]+"""
CITATIONS_SQL = rf"""
with d as (select doc_id, text as t from documents where text is not null),
n as (select doc_id, unnest(list_concat(
   list_transform(range(1, len(regexp_extract_all(t, '\[(\d{{1,9}})\]\((https?://[^\s<>"'')]+)\)', 1)) + 1), lambda i: {{'n': regexp_extract_all(t, '\[(\d{{1,9}})\]\((https?://[^\s<>"'')]+)\)', 1)[i]::int, 'r': 0, 'p': i, 'u': rtrim(regexp_extract_all(t, '\[(\d{{1,9}})\]\((https?://[^\s<>"'')]+)\)', 2)[i], '.,:;!?')}}),
   list_transform(range(1, len(regexp_extract_all(t, '\[(\d{{1,9}})\]:\s*({_ADDR})', 1)) + 1), lambda i: {{'n': regexp_extract_all(t, '\[(\d{{1,9}})\]:\s*({_ADDR})', 1)[i]::int, 'r': 1, 'p': i, 'u': rtrim(regexp_extract_all(t, '\[(\d{{1,9}})\]:\s*({_ADDR})', 2)[i], '.,:;!?')}}),
   list_transform(range(1, len(regexp_extract_all(t, '\[(\d{{1,9}})\]\s*({_ADDR})', 1)) + 1), lambda i: {{'n': regexp_extract_all(t, '\[(\d{{1,9}})\]\s*({_ADDR})', 1)[i]::int, 'r': 2, 'p': i, 'u': rtrim(regexp_extract_all(t, '\[(\d{{1,9}})\]\s*({_ADDR})', 2)[i], '.,:;!?')}}))) as x from d),
f as (select doc_id, x.u as url, 0 as part, x.n as k, row_number() over (partition by doc_id, x.n order by x.r, x.p) as rn from n where regexp_matches(x.u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+')),
i as (select doc_id, rtrim(unnest(regexp_extract_all(t, '{_ADDR}')), '.,:;!?') as url, generate_subscripts(regexp_extract_all(t, '{_ADDR}'), 1) as k from d),
u as (select doc_id, url, part, k from f where rn = 1 union all select doc_id, url, 1, k from i where regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+')),
m as (select doc_id, url, min((part, k)) as o from u group by 1, 2)
select doc_id, row_number() over (partition by doc_id order by o) - 1 as pos, url, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')), '^www\.', '') as domain from m"""


def cited_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations(spark, sf_dir)
    named = rows.select("domain").unionByName(spark.createDataFrame([("en.wikipedia.org",), ("old.reddit.com:443",), ("medium.com",), ("shop.amazon.com",)], "domain string"))
    return named.select(answer_analytics.root_domain(F.col("domain")).alias("root"), answer_analytics.domain_category(F.col("domain")).alias("category")).groupBy("root", "category").agg(F.count("*").alias("n"))


_CATS = ", ".join(f"('{k}', '{v}')" for k, v in answer_analytics.DOMAIN_CATEGORIES.items())
DOMAINS_SQL = f"""with c as ({CITATIONS_SQL}), k(d, category) as (values {_CATS}),
a as (select domain from c union all values ('en.wikipedia.org'), ('old.reddit.com:443'), ('medium.com'), ('shop.amazon.com')),
b as (select lower(regexp_replace(regexp_replace(domain, ':.*$', ''), '\\.+$', '')) as d from a), l as (select d, string_split(d, '.') as s from b),
r as (select case when len(s) <= 2 then d else coalesce(list_filter(list_transform(range(1, len(s)), lambda i: array_to_string(s[i:], '.')), lambda x: x in (select d from k))[1], array_to_string(s[-2:], '.')) end as root from l)
select root, coalesce(category, 'other') as category, count(*) as n from r left join k on root = k.d group by 1, 2"""
# The same with the lists of known domains as a literal: lambdas can't hold subqueries.
DOMAINS_SQL = DOMAINS_SQL.replace("x in (select d from k)", "x in (" + ", ".join(f"'{d}'" for d in answer_analytics.DOMAIN_CATEGORIES) + ")")


def text_brand_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the subject words as tracked names in all documents."""
    brands = spark.createDataFrame([("crawler",), ("structured data",), ("portfolio",), ("Top",)], "brand string")
    return answer_analytics.brand_mentions(table(spark, sf_dir, "documents"), "doc_id", "text", brands, "brand").select("doc_id", "brand", F.col("n").cast("long").alias("n"))


MENTIONS_SQL = """with b(brand) as (values ('crawler'), ('structured data'), ('portfolio'), ('Top'))
select doc_id, brand, (length(text) - length(replace(lower(text), lower(brand), '')))::bigint // length(brand) as n from documents, b where contains(lower(text), lower(brand))"""


def brand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions, answers and sentiments per brand. Days are summed first, so a brand with a third of
    all rows is spread over its days."""
    rows = table(spark, sf_dir, "brand_mentions").filter("brand is not null").dropDuplicates(["mention_id"])
    daily = rows.groupBy("brand", F.to_date("answered_at").alias("day")).agg(
        F.sum("mention_count").alias("n"), F.count("*").alias("n_answers"), F.count_if(F.col("sentiment") == "positive").alias("pos"), F.count_if(F.col("sentiment") == "negative").alias("neg")
    )
    return daily.groupBy("brand").agg(F.sum("n").alias("mentions"), F.sum("n_answers").alias("answers"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"), F.count("*").alias("days"))


BRAND_TOTALS_SQL = """with a as (select * from (select *, row_number() over (partition by mention_id order by loaded_at) as rn from brand_mentions) where rn = 1 and brand is not null)
select brand, sum(mention_count)::bigint as mentions, count(*) as answers, count(*) filter (sentiment = 'positive') as n_positive, count(*) filter (sentiment = 'negative') as n_negative, count(distinct answered_at::date) as days from a group by brand"""


def response_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiments of one answer folded in the order of its mentions."""
    rows = table(spark, sf_dir, "brand_mentions").dropDuplicates(["mention_id"]).filter("response_id is not null")
    lists = rows.groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct("mention_id", "sentiment"))).alias("l"))
    return lists.select("response_id", answer_analytics.fold_sentiments(F.transform("l", lambda x: F.coalesce(x["sentiment"], F.lit("neutral")))).alias("sentiment"))


SENTIMENT_SQL = """with a as (select response_id, mention_id, any_value(sentiment) as s from brand_mentions where response_id is not null group by 1, 2),
l as (select response_id, list(case when s = 'positive' then 1 when s = 'negative' then -1 else 0 end order by mention_id) as v from a group by 1),
f as (select response_id, list_reduce(list_prepend(0, v), lambda x, y: sign(x + y)::int) as t from l)
select response_id, case when t > 0 then 'positive' when t < 0 then 'negative' else 'neutral' end as sentiment from f"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "brand_mentions").filter("brand is not null and response_id is not null").dropDuplicates(["mention_id"])
    return rows.groupBy("response_id", "model").agg(
        F.sort_array(F.collect_set("brand")).alias("brands_mentioned"), F.min_by("brand", F.struct("mention_count", "brand")).alias("recommended_brand"), F.max("run_index").alias("target_brand_position"), F.min("sentiment").alias("sentiment")
    )


def recommendation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the most mentioned brand in the answers per model, with a model that has no answers."""
    judged = durable(_judged(spark, sf_dir))
    top = judged.select(F.explode("brands_mentioned").alias("b")).groupBy("b").count().orderBy(F.desc("count"), "b").limit(1).collect()
    models = judged.select("model").distinct().unionByName(spark.createDataFrame([("unused-model",)], "model string"))
    return answer_analytics.recommendation_share(judged, models, top[0].b if top else "")


SHARE_SQL = """with a as (select * from (select *, row_number() over (partition by mention_id order by loaded_at) as rn from brand_mentions) where rn = 1 and brand is not null and response_id is not null),
j as (select response_id, model, list(distinct brand) as brands, arg_min(brand, (mention_count, brand)) as rec, max(run_index) as pos, min(sentiment) as sentiment from a group by 1, 2),
x as (select unnest(brands) as b from j), t as (select b from x group by b order by count(*) desc, b limit 1),
m as (select model, count(*) as n_judged, avg(list_contains(brands, (select b from t))::int) as mention_rate, avg((rec = (select b from t))::int) as recommendation_rate, avg(pos) as avg_position,
  count(*) filter (sentiment = 'positive') as n_positive, count(*) filter (sentiment = 'neutral') as n_neutral, count(*) filter (sentiment = 'negative') as n_negative from j group by grouping sets ((model), ()))
select * from m union all select 'unused-model', 0, 0.0, 0.0, null, 0, 0, 0"""


def prompt_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by models by three runs."""
    rows = table(spark, sf_dir, "brand_mentions")
    prompts, models = rows.select("prompt").dropna().distinct(), rows.select("model").dropna().distinct()
    return answer_analytics.prompt_plan(prompts, models, 3)


PLAN_SQL = "with p as (select distinct prompt from brand_mentions where prompt is not null), m as (select distinct model from brand_mentions where model is not null) select prompt, model, run_index from p, m, range(3) r(run_index)"


# ---- observations -------------------------------------------------------------------------------
_OBSERVED = [
    # kind, path, method, status, content type, usage header, payment header, body
    (0, "/llms.txt", "GET", 200, "text/plain", None, None, "   "), (0, "/.well-known/llms.txt", "GET", 200, "text/plain", None, None, "# here"), (0, "/", "HEAD", 402, "text/html", "training=no", "1", ""),
    (1, "/llms.txt", "GET", 404, "text/plain", None, None, "no"), (1, "/llms-full.txt", "GET", 200, "text/plain", None, None, "# all"), (1, "/", "HEAD", 200, "text/html", "training=no, search=yes, training=yes", None, ""),
    (1, "/.well-known/mcp.json", "GET", 200, "application/json", None, None, '{"tools": [1, 2, 3]}'), (2, "/AGENTS.md", "GET", 200, "text/markdown", None, None, ""), (2, "/", "GET-MARKDOWN", 200, "text/markdown; charset=utf-8", None, None, "# x"),
    (2, "/.well-known/mcp.json", "GET", 200, "application/json", None, None, "{broken"), (3, "/.well-known/nlweb", "GET", 200, "text/html", None, None, "ok"), (3, "/agents.md", "GET", 200, "application/octet-stream", None, None, "x"), (3, "/", "HEAD", 200, "text/html", "search=maybe", "0xabc", ""),
]


def _site_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.createDataFrame(_OBSERVED, "kind int, path string, method string, status int, ct string, usage string, pay string, body string")
    fetches = _sites(spark, sf_dir).join(broadcast_if_small(seen), "kind").select(
        "site", "path", "method", "status", F.map_filter(F.create_map(F.lit("Content-Type"), "ct", F.lit("Content-Usage"), "usage", F.lit("X-Payment"), "pay"), lambda k, v: v.isNotNull()).alias("headers"), "body", F.lit(None).cast("string").alias("error")
    )
    return endpoints.site_checks(fetches)


def endpoint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of all sites against the observations of their kind."""
    return _site_checks(spark, sf_dir).select("site", "llms_path", "llms_full_path", "agents_path", "markdown_accept", "mcp_score", F.col("mcp_tools").cast("long").alias("mcp_tools"), "has_402", "has_payment_header", "nlweb", "allows_training", "allows_search", "agent_score")


ENDPOINTS_SQL = """with s as (select distinct site, length(site) % 4 as kind from pages where site is not null), k(kind, llms_path, llms_full_path, agents_path, markdown_accept, mcp_score, mcp_tools, has_402, has_payment_header, nlweb, allows_training, allows_search, agent_score) as (values
 (0, '/.well-known/llms.txt', null, null, false, null, null, true, true, false, null, null, 2.0::double), (1, null, '/llms-full.txt', null, false, 4.0::double, 3::bigint, false, false, false, true, true, 4.0),
 (2, null, null, '/AGENTS.md', true, 1.0, null, false, false, false, null, null, 11.0), (3, null, null, null, false, null, null, false, true, true, null, null, 1.5)) select k.* exclude (kind), site from s join k using (kind)"""


def agent_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent score of every site: its endpoints, and the semantics of its main page (the one with the shortest address)."""
    pages = table(spark, sf_dir, "pages").filter("site is not null and url is not null")
    main = pages.groupBy("site").agg(F.min_by("html", F.struct(F.length("url"), "url", "page_id")).alias("html"))
    signals = main.select("site", H.semantic_score(F.col("html")).cast("long").alias("semantic_score"), structured_data.declares_endpoint(H.json_ld_texts(F.col("html"))).alias("nlweb_schema"))
    return endpoints.agent_readiness(_site_checks(spark, sf_dir), signals).select("site", "semantic_score", "nlweb_schema", "agent_score")


AGENT_SQL = rf"""with c as ({ENDPOINTS_SQL}), h as (select site, arg_min(coalesce(html, ''), (length(url), url, page_id)) as html from pages where site is not null and url is not null group by 1),
q as (select site, {_QUIET} as q, regexp_extract_all(html, '(?is)<script[^>]*type\s*=\s*["'']application/ld\+json["''][^>]*>(.*?)</script\s*>', 1) as blocks from h),
g as (select site, (regexp_matches(q, '(?i)<(main|article)[\s/>]'))::bigint + (regexp_matches(q, '(?i)<header[\s/>]') and regexp_matches(q, '(?i)<nav[\s/>]'))::int
  + (len(list_filter(regexp_extract_all(q, '(?i)\srole\s*=\s*["'']?([a-zA-Z]+)', 1), lambda r: lower(r) in ('banner','complementary','contentinfo','form','main','navigation','region','search'))) >= 2)::int as semantic_score,
  len(list_filter(blocks, lambda b: regexp_matches(b, '"@type"\s*:\s*"({'|'.join((*structured_data.ENDPOINT_TYPES, *structured_data.ENDPOINT_ACTIONS))})"'))) > 0 as nlweb_schema from q)
select site, semantic_score, nlweb_schema, least(20.0, agent_score + coalesce(semantic_score, 0) + case when nlweb_schema then 0.5 else 0 end)::double as agent_score from c left join g using (site)"""


def agent_check_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.check_totals(_site_checks(spark, sf_dir))


TOTALS_SQL = f"""with c as ({ENDPOINTS_SQL}), l as (select unnest([{{'k': 'agents_md', 'v': agents_path is not null}}, {{'k': 'markdown_accept', 'v': markdown_accept}}, {{'k': 'mcp', 'v': mcp_score is not null}},
  {{'k': 'llms_txt', 'v': llms_path is not null}}, {{'k': 'x402', 'v': has_402 or has_payment_header}}, {{'k': 'nlweb', 'v': nlweb}}]) as x from c)
select x.k as check, count(*) filter (x.v) as n, round_even(100.0 * count(*) filter (x.v) / count(*), 1)::double as pct from l group by 1""".replace("as check,", 'as "check",')


def site_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _site_rows(spark, sf_dir).withColumn("score", F.col("schema_score") + F.col("content_score"))
    return site_marts.insights(rows, "score", "site", ["has_lists", "has_code_blocks"])


INSIGHTS_SQL = f"""with {_SITE_ROWS_SQL}, u as (select *, schema_score + content_score as score from t)
select count(*) as n, round_even(avg(score), 1) as avg_score, max(score) as best_score, arg_max(site, (score, site)) as best, min(score) as worst_score, arg_min(site, (score, site)) as worst,
  count(*) filter (has_lists) as n_has_lists, count(*) filter (has_code_blocks) as n_has_code_blocks from u"""


def site_owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per owner, the owner found by the longest listed suffix of the host."""
    owners = spark.createDataFrame([("example", "example hosts"), ("test", "test hosts"), ("ranedurk-post0.example", "Ranedurk")], "suffix string, owner string")
    rows = site_marts.lookup_by_suffix(table(spark, sf_dir, "pages").select("page_id", "site"), "site", owners, "suffix", "owner", "Other")
    return rows.groupBy("owner").agg(F.count("*").alias("n"))


OWNERS_SQL = """select case when site = 'ranedurk-post0.example' or ends_with(site, '.ranedurk-post0.example') then 'Ranedurk' when ends_with(site, '.example') then 'example hosts' when ends_with(site, '.test') then 'test hosts' else 'Other' end as owner,
  count(*) as n from pages group by 1"""


def report_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.report_slug(F.col("url")).alias("slug"))


SLUGS_SQL = r"select page_id, replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '/', '_') as slug from pages"


def page_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(generated_texts.page_prompt("Summarise this page.", F.col("url"), F.col("markdown"))).cast("long").alias("n_chars"))


PROMPTS_SQL = "select page_id, length('Summarise this page.' || chr(10) || chr(10) || 'URL: ' || url || chr(10) || chr(10) || left(coalesce(markdown, ''), 8000)) as n_chars from pages"


def watch_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful stream over all audits, run once to the end; its output is a table in the shared folder."""
    from tarnlight.runtime import ensure_checkpoint_dir
    from tarnlight.streaming import watch

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    name = f"watch-{uuid.uuid4().hex}"
    # A file stream reads a folder: the rows go there as a table first.
    folder = f"{base}/{name}"
    source = _audits(spark, sf_dir).select("url", F.col("ts").cast("timestamp").alias("ts"), F.col("overall_score").alias("score"))
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    found = watch.regressions(stream, "url", "ts", "score", 5.0)
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def queries() -> dict:
    return {
        "bot_access": bot_access, "bot_matrix": bot_matrix, "robots_directives": robots_directives, "page_scores": page_scores, "lint_results": lint_results, "page_diagnostics": page_diagnostics,
        "page_recommendations": page_recommendations, "site_scores": site_scores, "site_leaderboard": site_leaderboard, "category_statistics": category_statistics, "category_rollup": category_rollup,
        "headings_split": headings_split, "history_latest": history_latest, "score_regressions": score_regressions, "baseline_comparison": baseline_comparison, "threshold_failures": threshold_failures,
        "pairwise_comparison": pairwise_comparison, "report_flatten": report_flatten, "monthly_scores": monthly_scores, "citations": citations, "cited_domains": cited_domains,
        "text_brand_mentions": text_brand_mentions, "brand_totals": brand_totals, "response_sentiment": response_sentiment, "recommendation_share": recommendation_share, "prompt_plan": prompt_plan,
        "endpoint_checks": endpoint_checks, "watch_regressions": watch_regressions, "agent_check_totals": agent_check_totals, "site_insights": site_insights, "site_overall": site_overall, "lint_verdicts": lint_verdicts, "audit_page_statistics": audit_page_statistics, "agent_readiness": agent_readiness,
        "site_owner_lookup": site_owner_lookup, "report_slugs": report_slugs, "page_prompts": page_prompts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "bot_access": BOT_ACCESS_SQL, "bot_matrix": BOT_MATRIX_SQL, "robots_directives": ROBOTS_SQL, "page_scores": PAGE_SCORES_SQL, "lint_results": LINT_SQL, "page_diagnostics": DIAGNOSTICS_SQL,
        "page_recommendations": RECOMMENDATIONS_SQL, "site_scores": SITE_SCORES_SQL, "site_leaderboard": LEADERBOARD_SQL, "category_statistics": CATEGORY_SQL, "category_rollup": ROLLUP_SQL,
        "headings_split": SPLIT_SQL, "history_latest": HISTORY_SQL, "score_regressions": REGRESSIONS_SQL, "baseline_comparison": BASELINE_SQL, "threshold_failures": THRESHOLD_SQL,
        "pairwise_comparison": PAIRWISE_SQL, "report_flatten": FLATTEN_SQL, "monthly_scores": MONTHLY_SQL, "citations": CITATIONS_SQL, "cited_domains": DOMAINS_SQL,
        "text_brand_mentions": MENTIONS_SQL, "brand_totals": BRAND_TOTALS_SQL, "response_sentiment": SENTIMENT_SQL, "recommendation_share": SHARE_SQL, "prompt_plan": PLAN_SQL, "endpoint_checks": ENDPOINTS_SQL, "agent_check_totals": TOTALS_SQL,
        "site_insights": INSIGHTS_SQL, "site_overall": OVERALL_SQL, "lint_verdicts": VERDICTS_SQL, "audit_page_statistics": AUDIT_PAGES_SQL, "agent_readiness": AGENT_SQL, "site_owner_lookup": OWNERS_SQL, "report_slugs": SLUGS_SQL, "page_prompts": PROMPTS_SQL,
    }
