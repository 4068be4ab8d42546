"""Pillar scores, lint checks, diagnostics and recommendations as column expressions over one wide row.

Expected columns: word_count, has_headings, has_lists, has_code_blocks, readability_grade,
answer_first_ratio, waste_pct, raw_tokens, clean_tokens, schema_types (array), blocks_found,
llms_found, llms_full_found, robots_found, bots (array of struct bot, allowed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of the pillars.
WORD_TIERS = ((1500, 25), (800, 20), (400, 15), (150, 8))
HEADING_POINTS, LIST_POINTS, CODE_POINTS, CONTENT_MAX = 7, 5, 3, 40
SCHEMA_BASE, SCHEMA_HIGH, SCHEMA_OTHER, SCHEMA_MAX = 8, 5, 3, 25
HIGH_VALUE = ("Article", "FAQPage", "HowTo", "Product", "Recipe")
ROBOTS_MAX, LLMS_MAX = 25, 10
RESCALED = {"robots": 20, "llms": 5, "schema": 20, "content": 35}
AGENT_MAX = 20


def content_score(words: Column, headings: Column, lists: Column, code: Column) -> Column:
    tier = F.lit(0)
    for least, points in reversed(WORD_TIERS):
        tier = F.when(words >= least, points).otherwise(tier)
    bonus = headings.cast("int") * HEADING_POINTS + lists.cast("int") * LIST_POINTS + code.cast("int") * CODE_POINTS
    return F.least(F.lit(CONTENT_MAX), tier + bonus)


def schema_score(blocks: Column, types: Column) -> Column:
    kinds = F.array_distinct(types)
    high = F.size(F.array_intersect(kinds, F.array(*map(F.lit, HIGH_VALUE))))
    points = SCHEMA_BASE + SCHEMA_HIGH * high + SCHEMA_OTHER * (F.size(kinds) - high)
    return F.when(blocks > 0, F.least(F.lit(SCHEMA_MAX), points)).otherwise(0)


def llms_score(found: Column, full: Column) -> Column:
    return F.when(found | full, LLMS_MAX).otherwise(0)


def robots_score(found: Column, bots: Column) -> Column:
    n = F.size(bots)
    allowed = F.size(F.filter(bots, lambda b: b["allowed"]))
    return F.when(found & (n > 0), F.bround(ROBOTS_MAX * allowed / F.nullif(n, F.lit(0)), 1)).otherwise(0.0)


def with_scores(df: DataFrame) -> DataFrame:
    """Adds the pillar scores, the overall score, and the overall score on the rescaled pillars."""
    c = F.col
    df = df.withColumns({
        "robots_score": robots_score(c("robots_found"), c("bots")),
        "llms_score": llms_score(c("llms_found"), c("llms_full_found")).cast("double"),
        "schema_score": schema_score(c("blocks_found"), c("schema_types")).cast("double"),
        "content_score": content_score(c("word_count"), c("has_headings"), c("has_lists"), c("has_code_blocks")).cast("double"),
    })
    agent = c("agent_score") if "agent_score" in df.columns else F.lit(0.0)
    scaled = (
        F.bround(c("robots_score") / ROBOTS_MAX * RESCALED["robots"], 1) + F.bround(c("llms_score") / LLMS_MAX * RESCALED["llms"], 1)
        + F.bround(c("schema_score") / SCHEMA_MAX * RESCALED["schema"], 1) + F.bround(c("content_score") / CONTENT_MAX * RESCALED["content"], 1)
    )
    return df.withColumns({
        "overall_score": c("robots_score") + c("llms_score") + c("schema_score") + c("content_score"),
        "rescaled_score": scaled + F.least(F.lit(float(AGENT_MAX)), F.coalesce(agent, F.lit(0.0))),
    })


def lint_checks() -> Column:
    """Array of (name, passed, severity) of the four checks."""
    c = F.col
    blocked = F.size(F.filter("bots", lambda b: ~b["allowed"]))
    bots_ok = ~(c("robots_found") & (blocked > 0))

    def check(name: str, passed: Column, severity: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), passed.alias("passed"), severity.alias("severity"))

    def verdict(passed: Column) -> Column:
        return F.when(passed, "pass").otherwise("fail")

    primitives, structured = c("llms_found") | c("llms_full_found"), c("blocks_found") > 0
    waste = c("waste_pct")
    return F.array(
        check("AI Primitives", primitives, verdict(primitives)),
        check("Bot Access", bots_ok, verdict(bots_ok)),
        check("Data Structuring", structured, verdict(structured)),
        check("Token Efficiency", waste < 70, F.when(waste < 30, "pass").when(waste < 70, "warn").otherwise("fail")),
    )


def diagnostics() -> Column:
    """Array of (code, severity, value) in fixed order; value is the figure that the message is about."""
    c = F.col

    def item(when: Column, code: str, value: Column) -> Column:
        severity = "warn" if code.startswith("WARN") else "info"
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), value.cast("string").alias("value")))

    blocked = F.size(F.filter("bots", lambda b: ~b["allowed"]))
    grade = c("readability_grade")
    level = F.when(grade < 6, "elementary").when(grade < 9, "middle school").when(grade < 13, "high school").otherwise("college level")
    return F.array_compact(F.array(
        item(c("waste_pct") > 70, "WARN-001", F.bround("waste_pct").cast("int")),
        item(~c("has_code_blocks"), "WARN-002", F.lit(None).cast("string")),
        item(~c("has_headings"), "WARN-003", F.lit(None).cast("string")),
        item(c("robots_found") & (blocked > 0), "WARN-004", blocked),
        item(grade.isNotNull(), "INFO-001", level),
        item((c("blocks_found") > 0) & (F.size("schema_types") > 0), "INFO-002", F.array_join(F.slice("schema_types", 1, 5), ", ")),
    ))


def _priority(gap: Column, most: float) -> Column:
    return F.when(gap / most >= 0.5, "high").when(gap / most >= 0.25, "medium").otherwise("low")


def recommendations() -> Column:
    """Array of (rule, pillar, impact, priority), largest impact first, ties by rule."""
    c = F.col
    gaps = {"robots": ROBOTS_MAX - c("robots_score"), "schema": SCHEMA_MAX - c("schema_score"), "content": CONTENT_MAX - c("content_score")}
    blocked = F.size(F.filter("bots", lambda b: ~b["allowed"]))
    missing = F.size(F.array_except(F.array(*map(F.lit, HIGH_VALUE)), c("schema_types")))

    def rec(rule: int, when: Column, pillar: str, impact: Column, priority: Column) -> Column:
        return F.when(when, F.struct(
            (-F.bround(impact.cast("double"), 1)).alias("order"), F.lit(rule).alias("rule"), F.lit(pillar).alias("pillar"),
            F.bround(impact.cast("double"), 1).alias("impact"), priority.alias("priority"),
        ))

    content = gaps["content"]
    open_ = content > 0
    rules = [
        rec(1, (gaps["robots"] > 0) & ~c("robots_found"), "robots", gaps["robots"], _priority(gaps["robots"], ROBOTS_MAX)),
        rec(2, (gaps["robots"] > 0) & c("robots_found") & (blocked > 0), "robots", gaps["robots"], _priority(gaps["robots"], ROBOTS_MAX)),
        rec(3, ~c("llms_found") & ~c("llms_full_found"), "llms_txt", F.lit(float(LLMS_MAX)), F.lit("high")),
        rec(4, c("llms_found") & ~c("llms_full_found"), "llms_txt", F.lit(0.0), F.lit("low")),
        rec(5, (gaps["schema"] > 0) & (c("blocks_found") == 0), "schema", gaps["schema"], _priority(gaps["schema"], SCHEMA_MAX)),
        rec(6, (gaps["schema"] > 0) & (c("blocks_found") > 0) & (missing > 0), "schema", F.least(gaps["schema"], 5.0 * missing), _priority(gaps["schema"], SCHEMA_MAX)),
        rec(7, open_ & (c("word_count") < 400), "content", F.least(content, F.lit(15.0)), _priority(content, CONTENT_MAX)),
        rec(8, open_ & ~c("has_headings"), "content", F.least(content, F.lit(7.0)), _priority(F.least(content, F.lit(7.0)), CONTENT_MAX)),
        rec(9, open_ & ~c("has_lists"), "content", F.least(content, F.lit(5.0)), _priority(F.least(content, F.lit(5.0)), CONTENT_MAX)),
        rec(10, open_ & (c("readability_grade") > 12.0), "content", F.least(content, F.lit(3.0)), F.lit("medium")),
        rec(11, open_ & (c("answer_first_ratio") < 0.3) & c("has_headings"), "content", F.least(content, F.lit(3.0)), F.lit("medium")),
    ]
    return F.transform(F.array_sort(F.array_compact(F.array(*rules))), lambda r: F.struct(r["rule"].alias("rule"), r["pillar"].alias("pillar"), r["impact"].alias("impact"), r["priority"].alias("priority")))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")
