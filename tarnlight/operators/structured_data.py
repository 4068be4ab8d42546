"""JSON-LD blocks of pages: one row per object, types and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions import html as H

# Types that declare a natural-language endpoint.
ENDPOINT_TYPES = ("NLWebEndpoint", "NLWebService")
ENDPOINT_ACTIONS = ("NLSearchAction", "NLQueryAction")


def _objects(text: Column) -> Column:
    """The objects of a JSON text: itself, or the objects of its array; nothing for other or damaged JSON."""
    t = F.trim(text)
    whole = F.json_object_keys(t).isNotNull()
    parts = F.from_json(t, "array<string>")
    return F.when(t.startswith("{") & whole, F.array(t)).when(
        t.startswith("["), F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: p.startswith("{") & F.json_object_keys(p).isNotNull())
    ).otherwise(F.array().cast("array<string>"))


def object_type(obj: Column) -> Column:
    """The @type of an object: lists joined by ", ", "Unknown" where it has none."""
    raw = F.get_json_object(obj, "$['@type']")
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), F.lit("Unknown")).when(raw.startswith("["), F.array_join(listed, ", ")).otherwise(raw)


def blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, schema_type, properties) of every JSON-LD object, in order; damaged blocks are skipped."""
    return blocks_of_texts(df.select(key, H.json_ld_texts(F.col(html)).alias("_texts")), key, "_texts")


def blocks_of_texts(df: DataFrame, key: str, texts: str) -> DataFrame:
    objects = F.flatten(F.transform(F.col(texts), _objects))
    each = df.select(key, F.posexplode(objects).alias("pos", "obj"))
    properties = F.filter(F.json_object_keys("obj"), lambda k: ~k.startswith("@"))
    return each.select(key, "pos", object_type(F.col("obj")).alias("schema_type"), F.array_sort(properties).alias("properties"))


def declares_endpoint(texts: Column) -> Column:
    """True where a block is, or has an action, of a natural-language endpoint."""
    objects = F.flatten(F.transform(texts, _objects))
    return F.exists(objects, lambda o: object_type(o).isin(*ENDPOINT_TYPES) | F.coalesce(F.get_json_object(o, "$.potentialAction['@type']").isin(*ENDPOINT_ACTIONS), F.lit(False)))


def product_object(texts: Column) -> Column:
    """The first object of type Product, else the first object."""
    whole = F.filter(texts, lambda t: F.json_object_keys(F.trim(t)).isNotNull())
    return F.coalesce(F.get(F.filter(whole, lambda t: F.get_json_object(t, "$['@type']") == "Product"), F.lit(0)), F.get(whole, F.lit(0)))
