"""Site level: weighted aggregation of pages, rankings, category statistics, splits, heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlight.functions import urls
from tarnlight.runtime import broadcast_if_small, durable


def aggregate_sites(pages: DataFrame, site: str = "site") -> DataFrame:
    """One row per site of pages with url, error, word_count, char_count, flags, schema_score, content_score, blocks_found.

    Scores are means weighted by page depth over the successful pages (no error, or words in spite
    of one), rounded to one decimal; words and characters are plain means, rounded down; pages
    counts all pages. Sites without a successful page have scores 0. Sums combine before the
    shuffle, so one large site is no hot task.
    """
    ok = F.col("error").isNull() | (F.col("word_count") > 0)
    weight = F.when(ok, urls.page_weight(F.col("url")))

    def mean(score: str) -> Column:
        return F.coalesce(F.bround(F.sum(F.col(score) * weight) / F.sum(weight), 1), F.lit(0.0))

    good = F.sum(ok.cast("int"))
    return pages.groupBy(site).agg(
        F.count("*").alias("pages"), F.sum(F.col("error").isNotNull().cast("int")).alias("pages_failed"),
        mean("schema_score").alias("schema_score"), mean("content_score").alias("content_score"),
        F.coalesce(F.sum(F.when(ok, F.col("blocks_found"))), F.lit(0)).alias("blocks_found"),
        F.coalesce(F.floor(F.sum(F.when(ok, F.col("word_count"))) / F.nullif(good, F.lit(0))), F.lit(0)).alias("avg_words"),
        F.coalesce(F.floor(F.sum(F.when(ok, F.col("char_count"))) / F.nullif(good, F.lit(0))), F.lit(0)).alias("avg_chars"),
        F.coalesce(F.bool_or(F.when(ok, F.col("has_headings"))), F.lit(False)).alias("has_headings"),
        F.coalesce(F.bool_or(F.when(ok, F.col("has_lists"))), F.lit(False)).alias("has_lists"),
        F.coalesce(F.bool_or(F.when(ok, F.col("has_code_blocks"))), F.lit(False)).alias("has_code_blocks"),
    )


def ranked(df: DataFrame, order: list[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds 1..n (and, if named, the total n) in the given total order without one sorting task: rows are range-partitioned, ranked
    in their partition and shifted by the sizes of the partitions before."""
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    local = durable(local)  # the partition numbers must not be computed anew
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select("_p", "_off", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"))
    return local.join(broadcast_if_small(before), "_p").withColumn(name, F.col("_off") + F.col("_r")).withColumns({total: F.col("_all")} if total else {}).drop("_p", "_r", "_off", "_all")


def leaderboard(sites: DataFrame, waste: str = "waste_pct", key: str = "site") -> DataFrame:
    """Sites by token waste, least first; missing waste counts as 100, ties by key."""
    return ranked(sites, [F.coalesce(F.col(waste), F.lit(100.0)).asc(), F.col(key).asc()])


def overall(sites: DataFrame, pages: DataFrame, n: int = 5) -> DataFrame:
    """Sites with robots, llms and overall score, their rank (best first, ties by site), and whether they are among the first or last n.

    sites are those of aggregate_sites; robots and llms score are facts of the site and equal on its pages.
    """
    facts = pages.groupBy("site").agg(F.max("robots_score").alias("robots_score"), F.max("llms_score").alias("llms_score"))
    scored = sites.join(facts, "site").withColumn("overall_score", F.bround(F.col("robots_score") + F.col("llms_score") + F.col("schema_score") + F.col("content_score"), 1))
    rows = ranked(scored, [F.col("overall_score").desc(), F.col("site").asc()], total="_total")
    return rows.withColumn("is_top", F.col("rank") <= n).withColumn("is_bottom", F.col("rank") > F.col("_total") - n).drop("_total")


def rag_ready(llms_found: Column, bots: Column, robots_found: Column, waste: Column, threshold: float) -> Column:
    """llms.txt there, no known bot blocked, waste below the threshold."""
    return llms_found & (~robots_found | F.forall(bots, lambda b: b["allowed"])) & (waste < threshold)


def category_stats(df: DataFrame, category: str, score: str, key: str, words: str) -> DataFrame:
    """Count, mean score, mean words and the best member per category (ties: the smaller key)."""
    best = F.min_by(F.col(key), F.struct(-F.col(score), F.col(key)))
    return df.groupBy(category).agg(
        F.count("*").alias("n"), F.bround(F.avg(score), 1).alias("avg_score"), F.bround(F.avg(words), 0).alias("avg_words"), F.max(score).alias("best_score"), best.alias("best")
    )


def split_means(df: DataFrame, flag: str, score: str) -> DataFrame:
    """Mean score with and without a property and the difference, in one row."""
    yes, no = F.avg(F.when(F.col(flag), F.col(score))), F.avg(F.when(~F.col(flag), F.col(score)))
    return df.agg(F.bround(yes, 2).alias("avg_with"), F.bround(no, 2).alias("avg_without"), F.bround(yes - no, 2).alias("difference"), F.count_if(flag).alias("n_with"))


def cross_tab(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Rows by fixed columns: true where any value is true. The columns are given, so nothing is collected to find them."""
    return df.groupBy(row).pivot(column, columns).agg(F.bool_or(value))


def insights(df: DataFrame, score: str, key: str, adoption: list[str]) -> DataFrame:
    """One row over all sites: mean, extremes with their key, and the number of sites with each property."""
    return df.agg(
        F.count("*").alias("n"), F.bround(F.avg(score), 1).alias("avg_score"), F.max(score).alias("best_score"), F.max_by(key, F.struct(score, key)).alias("best"),
        F.min(score).alias("worst_score"), F.min_by(key, F.struct(score, key)).alias("worst"), *[F.count_if(F.coalesce(F.col(a), F.lit(False))).alias(f"n_{a}") for a in adoption],
    )


def lookup_by_suffix(df: DataFrame, domain: str, dimension: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Adds the value of the longest suffix of a domain that the dimension lists, else the default.

    Distinct domains are resolved once: suffixes are exploded, met by an equi join and the longest
    kept; so neither a theta join nor a hot domain costs anything.
    """
    names = df.select(F.col(domain).alias("_d")).dropna().distinct()
    labels = F.split(F.lower("_d"), r"\.")
    n = F.size(labels)
    suffixes = names.select("_d", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))).alias("_i", "_s"))
    known = dimension.select(F.lower(key).alias("_s"), F.col(value).alias("_v")).dropna().groupBy("_s").agg(F.min("_v").alias("_v"))
    found = suffixes.join(known, "_s").groupBy("_d").agg(F.min_by("_v", "_i").alias("_v"))
    return df.join(found, F.col(domain) == F.col("_d"), "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_d", "_v")
