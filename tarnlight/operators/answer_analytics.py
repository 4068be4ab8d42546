"""Citations, brand mentions and sentiment in model answers, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions import urls

# Address pattern, trailing punctuation, sentiment words, window sizes, domain categories.
ADDRESS = r"""https?://[^\s<>"')\]]+"""
TRAILING = ".,:;!?"
POSITIVE = ("best", "excellent", "favorite", "great", "leading", "quality", "recommended", "reliable", "top", "trusted")
NEGATIVE = ("avoid", "bad", "disappointing", "mediocre", "overpriced", "poor", "unreliable", "worst")
SENTIMENT_CHARS, SNIPPET_CHARS = 100, 50
DOMAIN_CATEGORIES = {
    "reddit.com": "reddit", "news.ycombinator.com": "news", "nytimes.com": "news", "bbc.com": "news", "cnn.com": "news", "theverge.com": "news",
    "wirecutter.com": "review_site", "rtings.com": "review_site", "tomsguide.com": "review_site", "amazon.com": "marketplace", "shopee.com": "marketplace",
    "lazada.com": "marketplace", "wikipedia.org": "reference", "medium.com": "blog", "substack.com": "blog", "forbes.com": "news", "techcrunch.com": "news", "wired.com": "news",
}


def clean_address(url: Column) -> Column:
    return F.regexp_replace(url, r"[.,:;!?]+$", "")


def addresses(text: Column) -> Column:
    """All addresses of a text in order, duplicates kept."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ADDRESS), F.lit(0)), clean_address)
    return F.filter(found, urls.is_valid)


def _refs(text: Column, pattern: str, rank: int) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    links = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.transform(
        F.arrays_zip(numbers.alias("n"), links.alias("u")),
        lambda z, i: F.struct(z["n"].cast("int").alias("number"), F.lit(rank).alias("rank"), i.alias("pos"), clean_address(z["u"]).alias("url")),
    )


def numbered_refs(text: Column) -> Column:
    """Array of (number, rank, pos, url) by number; of several addresses of a number the first pattern's first wins."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(
        _refs(t, r"""\[(\d{1,9})\]\((https?://[^\s<>"')]+)\)""", 0), _refs(t, rf"\[(\d{{1,9}})\]:\s*({ADDRESS})", 1), _refs(t, rf"\[(\d{{1,9}})\]\s*({ADDRESS})", 2)
    )
    ordered = F.array_sort(F.filter(found, lambda r: urls.is_valid(r["url"])))
    return F.filter(ordered, lambda r, i: (i == 0) | (r["number"] != F.get(ordered, i - 1)["number"]))


def snippet(text: Column, url: Column) -> Column:
    """Text around the first occurrence of an address."""
    at = F.position(url, text)
    start = F.greatest(at - SNIPPET_CHARS, F.lit(1))
    return F.trim(F.substring(text, start, at + F.length(url) + SNIPPET_CHARS - start))


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, url, domain): numbered references first, then the other addresses, each once."""
    t = F.col(text)
    ordered = F.array_distinct(F.concat(F.transform(numbered_refs(t), lambda r: r["url"]), addresses(t)))
    each = df.select(key, F.posexplode(ordered).alias("pos", "url"))
    return each.withColumn("domain", urls.domain(F.col("url")))


def root_domain(domain: Column) -> Column:
    """The registered suffix of a domain, else its last two labels; ports and trailing dots don't matter."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(domain, r":.*$", ""), r"\.+$", ""))
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    known = F.filter(suffixes, lambda s: s.isin(*DOMAIN_CATEGORIES))
    return F.when(n <= 2, bare).otherwise(F.coalesce(F.get(known, F.lit(0)), F.array_join(F.slice(labels, -2, 2), ".")))


def domain_category(domain: Column) -> Column:
    table = F.create_map(*[x for k, v in DOMAIN_CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, root_domain(domain)), F.lit("other"))


def mention_positions(text: Column, brand: Column) -> Column:
    """Starting positions (from 1) of the occurrences of a brand, not overlapping, whatever the case."""
    parts = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(brand), F.lit(r"\E")))
    size = F.length(brand)
    return F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("next")),
        lambda acc, p: F.struct(F.array_append(acc["at"], acc["next"] + F.length(p)).alias("at"), (acc["next"] + F.length(p) + size).alias("next")),
        lambda acc: acc["at"],
    )


def window_sentiment(text: Column, start: Column, size: Column) -> Column:
    """Sentiment of the words around a mention: 1, 0 or -1."""
    begin = F.greatest(start - SENTIMENT_CHARS, F.lit(1))
    around = F.lower(F.substring(text, begin, start + size + SENTIMENT_CHARS - begin))
    words = F.regexp_extract_all(around, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    good = F.arrays_overlap(words, F.array(*map(F.lit, POSITIVE)))
    bad = F.arrays_overlap(words, F.array(*map(F.lit, NEGATIVE)))
    return F.when(good & ~bad, 1).when(bad & ~good, -1).otherwise(0)


#: Entries of a parameter list (tracked brands, models).
MAX_LIST = 1000


def _short_list(df: DataFrame, column: str) -> list[str]:
    """The distinct values of a parameter list, in order; an error beyond MAX_LIST."""
    rows = df.select(F.col(column).alias("v")).filter("v <> ''").distinct().limit(MAX_LIST + 1).collect()
    if len(rows) > MAX_LIST:
        raise ValueError(f"more than {MAX_LIST} values in the list of {column}")
    return sorted(r.v for r in rows)


def brand_mentions(df: DataFrame, key: str, text: str, brands: DataFrame, brand: str) -> DataFrame:
    """(key, brand, n, sentiment) of every brand of a short list found in a text.

    The list of tracked brands is a parameter of at most MAX_LIST names, held in the plan; the texts
    are scanned once and joined to nothing. NULL and empty brands are ignored.
    """
    few = _short_list(brands, brand)
    text_ = F.lower(F.col("_t"))
    found = F.filter(F.array(*map(F.lit, few)).cast("array<string>"), lambda b: F.contains(text_, F.lower(b)))
    hits = df.select(key, F.col(text).alias("_t")).withColumn("brand", F.explode(found))
    at = mention_positions(F.col("_t"), F.col("brand"))
    hits = hits.withColumn("_at", at).withColumn("_s", F.transform("_at", lambda p: window_sentiment(F.col("_t"), p, F.length("brand"))))
    votes = F.aggregate("_s", F.lit(0), lambda a, s: a + s)
    return hits.select(key, "brand", F.size("_at").alias("n"), F.when(votes > 0, "positive").when(votes < 0, "negative").otherwise("neutral").alias("sentiment"))


def fold_sentiments(labels: Column) -> Column:
    """Folds labels in order: each step keeps the sign of the sum (the order matters)."""
    score = lambda s: F.when(s == "positive", 1).when(s == "negative", -1).otherwise(0)
    total = F.aggregate(labels, F.lit(0), lambda a, s: F.signum(a + score(s)).cast("int"))
    return F.when(total > 0, "positive").when(total < 0, "negative").otherwise("neutral")


def recommendation_share(judged: DataFrame, models: DataFrame, brand: str) -> DataFrame:
    """Per model, and over all (model NULL): judged answers, mention and recommendation rate, mean position, sentiments.

    judged: model, brands_mentioned, recommended_brand, target_brand_position, sentiment. Models
    without answers have zero rates and a NULL position.
    """
    hit = F.coalesce(F.array_contains("brands_mentioned", brand), F.lit(False)).cast("int")
    rec = F.coalesce(F.col("recommended_brand") == brand, F.lit(False)).cast("int")

    def metrics(grouped) -> DataFrame:
        return grouped.agg(
            F.count("sentiment_").alias("n_judged"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("mention_rate"), F.coalesce(F.avg(rec), F.lit(0.0)).alias("recommendation_rate"),
            F.avg("target_brand_position").alias("avg_position"),
            *[F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in ("positive", "neutral", "negative")],
        )

    rows = judged.withColumn("sentiment_", F.lit(1)).join(models.select("model"), "model", "left_semi")
    per_model = metrics(rows.groupBy("model"))
    empty = models.select("model").join(per_model, "model", "left_anti").select(
        "model", F.lit(0).cast("long").alias("n_judged"), F.lit(0.0).alias("mention_rate"), F.lit(0.0).alias("recommendation_rate"), F.lit(None).cast("double").alias("avg_position"),
        *[F.lit(0).cast("long").alias(f"n_{s}") for s in ("positive", "neutral", "negative")],
    )
    overall = metrics(rows.groupBy()).select(F.lit(None).cast("string").alias("model"), "n_judged", "mention_rate", "recommendation_rate", "avg_position", "n_positive", "n_neutral", "n_negative")
    return per_model.unionByName(empty).unionByName(overall)


def prompt_plan(prompts: DataFrame, models: DataFrame, runs: int) -> DataFrame:
    """Every prompt for every model and run: the plan of a benchmark. The models are a parameter list of
    at most MAX_LIST names and, like the runs, are exploded from the plan: no join."""
    names = F.array(*map(F.lit, _short_list(models, "model"))).cast("array<string>")
    return prompts.withColumn("model", F.explode(names)).withColumn("run_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
