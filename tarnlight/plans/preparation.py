"""Queries of the general data-preparation problems (history, nested records, quantities)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import urls
from tarnlight.operators import history_versions, nested_tables, quantities
from tarnlight.runtime import table


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = table(spark, sf_dir, "audits")
    values = {"overall_score": F.round("overall_score", 1), "content_score": F.round("content_score", 1)}
    return history_versions.versions(audits, urls.entity_key(F.col("url")), "ts", values, "id", "received_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = table(spark, sf_dir, "audits")
    values = {"overall_score": F.round("overall_score", 1), "content_score": F.round("content_score", 1)}
    names = list(values)
    snaps = history_versions.snapshots(audits, urls.entity_key(F.col("url")), "ts", values, "id", "received_at")
    return history_versions.version_starts(snaps, names).select(F.col("_id").alias("id")).distinct()


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_history(spark, sf_dir).select("entity", "id", "overall_score", "content_score", "valid_from", "valid_to", "is_current")


_VERSIONS_SQL = r"""
with a as (
  select id, ts, received_at, round(overall_score, 1) as o, round(content_score, 1) as c,
    lower(regexp_extract(trim(url), '^([^:/?#]+:)?(//[^/?#]*)?'))
      || regexp_replace(regexp_extract(trim(url), '^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)', 3), '/+$', '')
      || regexp_extract(trim(url), '^[^?#]*(\?[^#]*)?', 1) as entity
  from audits where overall_score is not null and content_score is not null and ts is not null and url is not null
), b as (
  select *, row_number() over (partition by entity, ts order by received_at desc nulls last, id desc nulls last, o desc, c desc) as rn from a
), d as (
  select *, lag(o) over w as po, lag(c) over w as pc, row_number() over w as k from b where rn = 1 window w as (partition by entity order by ts)
), v as (select * from d where k = 1 or o <> po or c <> pc)
"""
P2_FOUND_SQL = _VERSIONS_SQL + "select distinct id from v"
P2_HISTORY_SQL = _VERSIONS_SQL + """
select entity, id, o as overall_score, c as content_score, ts as valid_from,
  lead(ts) over (partition by entity order by ts) as valid_to,
  lead(ts) over (partition by entity order by ts) is null as is_current
from v"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        nested_tables.object_paths(table(spark, sf_dir, "products"), "listing_id", "schema_org", "products"),
        nested_tables.object_paths(table(spark, sf_dir, "audits"), "id", "report_json", "audits"),
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir).select("origin", "record_id", "path").distinct()


def p4_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object with the nearest object that holds it, by interval containment."""
    return nested_tables.parents(_objects(spark, sf_dir)).select("origin", "record_id", "path", "parent_path").distinct()


# Records by recursion over the JSON functions of the SQL engine; texts that hold a record as a string are unpacked first.
_NODES_SQL = r"""
with recursive u(origin, record_id, body) as (
  select 'products', listing_id, trim(schema_org, chr(65279) || chr(160) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') from products where schema_org is not null
  union all select 'audits', id, trim(report_json, chr(65279) || chr(160) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') from audits where report_json is not null
  union all
  select origin, record_id, trim(json_extract_string(body, '$'), chr(65279) || chr(160) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') from u where case when json_valid(body) then json_type(body) = 'VARCHAR' else false end
), roots as (
  select distinct origin, record_id, body from u where case when json_valid(body) then json_type(body) in ('OBJECT', 'ARRAY') else false end
), n(origin, record_id, path, parent_path, name, kind, value) as (
  select origin, record_id, '', '', '', json_type(body), body::json from roots
  union all
  select n.origin, n.record_id, case when n.path = '' then e.key else n.path || '/' || e.key end, case when n.kind = 'OBJECT' then n.path else n.parent_path end, e.key, e.type, e.value
  from n, json_each(n.value) e where n.kind in ('OBJECT', 'ARRAY')
)
"""
P4_FOUND_SQL = _NODES_SQL + "select distinct origin, record_id, path from n where kind = 'OBJECT' and path <> ''"
P4_PARENTS_SQL = _NODES_SQL + "select distinct origin, record_id, path, parent_path from n where kind = 'OBJECT' and path <> ''"
P4_OFFERS_SQL = _NODES_SQL + """
select distinct o.record_id, o.path, regexp_replace(o.path, '(^|/)[^/]*$', '') as parent_path,
  max(f.value ->> '$') filter (where f.name = 'price') as price, max(f.value ->> '$') filter (where f.name = 'priceCurrency') as price_currency
from n o left join n f on f.origin = o.origin and f.record_id = o.record_id and f.path = o.path || '/' || f.name and f.kind not in ('OBJECT', 'ARRAY')
where o.origin = 'products' and o.kind = 'OBJECT' and regexp_matches(o.path, '(^|/)offers(/[0-9]+)?$') group by all"""


def p4_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of products as a flat table with the link to the record and the parent path."""
    nodes = nested_tables.flatten(table(spark, sf_dir, "products"), "listing_id", "schema_org", "products").distinct()
    offers = nodes.filter("kind = 'object'").filter(F.col("path").rlike(r"(^|/)offers(/\d+)?$"))
    objects = nodes.filter("kind <> 'scalar'").select("origin", "record_id", F.col("path").alias("parent_path"), F.col("pre").alias("parent_pre"))
    fields = nodes.filter("kind = 'scalar'").groupBy("origin", "record_id", F.col("parent_pre").alias("pre")).agg(
        F.max(F.when(F.col("name") == "price", F.col("value"))).alias("price"),
        F.max(F.when(F.col("name") == "priceCurrency", F.col("value"))).alias("price_currency"),
    )
    linked = offers.select("origin", "record_id", "path", "pre", "parent_pre").join(objects, ["origin", "record_id", "parent_pre"])
    return linked.join(fields, ["origin", "record_id", "pre"], "left").select("record_id", "path", "parent_path", "price", "price_currency").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.stated_amounts(table(spark, sf_dir, "products"), table(spark, sf_dir, "fx_rates"))


def p6_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts without unit with the unit of the highest posterior."""
    rates = table(spark, sf_dir, "fx_rates")
    amounts = quantities.extract(table(spark, sf_dir, "products"), rates)
    model = quantities.fit_unit_mixture(amounts, rates=rates)
    return quantities.infer_units(amounts, model).select("listing_id", "quantity", "source", "number", "unit", "amount", "posterior", "is_uncertain").distinct()


def queries() -> dict:
    return {"p2_found": p2_found, "p2_history": p2_history, "p4_found": p4_found, "p4_parents": p4_parents, "p4_offers": p4_offers, "p6_found": p6_found, "p6_inferred": p6_inferred}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND_SQL, "p2_history": P2_HISTORY_SQL, "p4_found": P4_FOUND_SQL, "p4_parents": P4_PARENTS_SQL, "p4_offers": P4_OFFERS_SQL}
