"""Marketplaces and completeness scores of product listings, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions import urls

# Host patterns of the marketplaces in order of priority.
MARKETPLACES = (
    ("amazon", r"amazon\.(?:com|co\.uk|de|co\.jp|fr|it|es|ca|com\.au|in|com\.br|sg|nl|sa|ae|pl|se|com\.mx|com\.tr|cn)"),
    ("shopee", r"shopee\.(?:sg|co\.id|com\.my|co\.th|vn|ph|com\.br|tw|com\.co|cl|com\.mx)"),
    ("lazada", r"lazada\.(?:sg|co\.id|com\.my|co\.th|vn|com\.ph)"),
    ("tokopedia", r"tokopedia\.com"),
    ("tiktok_shop", r"tiktok\.com"),
    ("blibli", r"blibli\.com"),
    ("zalora", r"zalora\.(?:sg|co\.id|com\.my|co\.th|vn|com\.ph|com\.hk|com\.tw|com)"),
)


def marketplace(url: Column) -> Column:
    host = urls.hostname(url)
    out = F.lit("generic")
    for name, pattern in reversed(MARKETPLACES):
        out = F.when(host.rlike(pattern), name).otherwise(out)
    return out


def _present(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def _count(c: str) -> Column:
    return F.coalesce(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0))


def with_quality(df: DataFrame) -> DataFrame:
    """Adds schema_points (25), content_points (30), visual_points (15), social_points (20), feed_points (10) and quality_score.

    NULL fields count as missing; a damaged schema_org counts as none.
    """
    json = F.coalesce("schema_org", F.lit("{}"))
    kind = F.get_json_object(json, "$['@type']")
    is_product = F.coalesce((kind == "Product") | (kind.startswith("[") & F.array_contains(F.from_json(kind, "array<string>"), "Product")), F.lit(False))

    def filled(path: str) -> Column:
        v = F.get_json_object(json, path)
        return F.coalesce(~v.isin("", "[]", "{}", "0", "false", "null"), F.lit(False))

    images, alts, bullets = _count("image_urls"), _count("alt_texts"), _count("bullet_points")
    specs = F.coalesce(F.size(F.map_keys("specifications")), F.lit(0))
    has_rating, reviews = F.coalesce(F.col("rating"), F.lit(0.0)), F.coalesce(F.col("review_count"), F.lit(0))
    required = [_present(c) for c in ("title", "description", "url", "price", "currency", "availability")] + [images > 0, _present("brand")]
    rate = sum(r.cast("int") for r in required) / len(required)
    points = {
        "schema_points": is_product.cast("int") * 10.0 + filled("$.offers").cast("int") * 8.0 + filled("$.aggregateRating").cast("int") * 7.0,
        "content_points": F.least(bullets / 5, F.lit(1.0)) * 10 + F.least(F.coalesce(F.length("description"), F.lit(0)) / 200, F.lit(1.0)) * 10
        + F.coalesce("has_aplus_content", F.lit(False)).cast("int") * 5.0 + (specs > 0).cast("int") * 5.0,
        "visual_points": F.least(images / 5, F.lit(1.0)) * 8 + F.when(images > 0, F.least(alts, images) / F.nullif(images, F.lit(0)) * 4).otherwise(0.0)
        + F.coalesce("has_video", F.lit(False)).cast("int") * 3.0,
        "social_points": F.least(F.greatest(reviews, F.lit(0)) / 10, F.lit(1.0)) * 10 + F.least(F.greatest(has_rating, F.lit(0.0)) / 4, F.lit(1.0)) * 5
        + (F.coalesce("qa_count", F.lit(0)) > 0).cast("int") * 5.0,
        "feed_points": rate * 10.0,
    }
    return df.withColumns(points).withColumn("quality_score", F.least(F.lit(100.0), sum(F.col(p) for p in points)))


def feed_fields(df: DataFrame, key: str) -> DataFrame:
    """(key, field, is_present) in long form: required fields and the two recommended ones that listings can have."""
    fields = {c: _present(c) for c in ("title", "description", "url", "price", "currency", "availability", "brand")}
    fields |= {"image_url": _count("image_urls") > 0, "reviews_count": F.coalesce(F.col("review_count") > 0, F.lit(False)), "average_rating": F.coalesce(F.col("rating") > 0, F.lit(False))}
    entries = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("is_present")) for k, v in fields.items()])
    return df.select(key, F.inline(entries))
