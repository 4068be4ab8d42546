"""Queries over page texts: addresses, markdown metrics, html signals, structured data, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import html as H
from tarnlight.functions import markdown as M
from tarnlight.functions import urls as U
from tarnlight.operators import discovery, listing_quality, page_markdown, structured_data
from tarnlight.runtime import spread, table

# ---- SQL fragments shared by the oracles -------------------------------------------------------
_WS = r"\s\p{Z}\x{85}\x1c-\x1f"
_URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def _part(column: str, group: int) -> str:
    return f"regexp_extract({column}, '(?s){_URI}', {group})"


def _path(column: str) -> str:
    return f"regexp_replace({_part(column, 5)}, '^/+|/+$', '', 'g')"


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.normalize(u).alias("normalized"), U.depth(u).cast("long").alias("depth"), U.page_weight(u).cast("long").alias("weight"), U.first_segment(u).alias("segment"),
        U.markdown_path(u).alias("md_path"), U.directory_name(u).alias("directory"), U.domain(u).alias("domain"),
    )


URL_PARTS_SQL = f"""
select page_id,
  lower({_part('url', 2)}) || '://' || lower({_part('url', 4)}) || case when regexp_replace({_part('url', 5)}, '/+$', '') = '' then '/' else regexp_replace({_part('url', 5)}, '/+$', '') end as normalized,
  case when {_path('url')} = '' then 0 else len(string_split({_path('url')}, '/')) end as depth,
  case when {_path('url')} = '' or len(string_split({_path('url')}, '/')) = 1 then 3 when len(string_split({_path('url')}, '/')) = 2 then 2 else 1 end::bigint as weight,
  string_split({_path('url')}, '/')[1] as segment,
  case when ltrim({_part('url', 5)}, '/') = '' or {_part('url', 5)} like '%/' then ltrim({_part('url', 5)}, '/') || 'index' else ltrim({_part('url', 5)}, '/') end || '.md' as md_path,
  trim(regexp_replace(regexp_replace({_part('url', 4)} || {_part('url', 5)} || case when {_part('url', 7)} = '' then '' else '_' || {_part('url', 7)} end, '[^a-zA-Z0-9.\\-]', '_', 'g'), '_+', '_', 'g'), '_') as directory,
  regexp_replace(lower(regexp_replace({_part('url', 4)}, ':\\d*$', '')), '^www\\.', '') as domain
from pages"""


def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return discovery.unique_urls(pages, "url", "page_id").select("normalized_url", "page_id")


URL_DEDUPE_SQL = f"with u as ({URL_PARTS_SQL}) select normalized as normalized_url, min(page_id) as page_id from u group by 1"


def diverse_sample_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "site", "url")
    return discovery.diverse_sample(pages, "site", "url", 5, "page_id").select("page_id", "site", F.col("place").cast("long").alias("place"))


DIVERSE_SQL = f"""
with p as (select page_id, site, string_split({_path('url')}, '/')[1] as seg from pages),
t as (select *, row_number() over (partition by site, seg order by page_id) as turn from p),
r as (select *, row_number() over (partition by site order by turn, seg) as place from t)
select page_id, site, place from r where place <= 5"""


def _metrics(rows: DataFrame, key: str, text: str) -> DataFrame:
    out = rows.select(key, *[c.alias(n) for n, c in M.content_metrics(F.col(text)).items()])
    return out.select(key, *[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in out.dtypes if c != key])


def _metrics_sql(source: str, key: str, text: str) -> str:
    t = f"coalesce({text}, '')"
    sections = f"list_filter(regexp_split_to_array(t, '(?m)^#{{1,6}}\\s.*$'), lambda s: regexp_matches(s, '[^{_WS}]'))"
    return f"""
with a as (select {key}, {t} as t from {source}),
b as (select *, regexp_extract_all(t, '[^{_WS}]+') as words, {sections} as secs,
   list_transform(regexp_extract_all(t, '(?m)^(#{{1,6}})\\s', 1), lambda h: length(h)) as levels from a),
c as (select *, list_transform(secs, lambda s: len(regexp_extract_all(s, '[^{_WS}]+'))) as chunk_words,
   list_sum(list_transform(words, lambda w: greatest(1, len(regexp_extract_all(w, '(?i)[aeiou]+'))))) as syllables,
   greatest(1, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: regexp_matches(s, '[^{_WS}]')))) as sentences from b)
select {key}, len(words) as word_count, length(t) as char_count, regexp_matches(t, '(?m)^#{{1,6}}\\s') as has_headings,
  regexp_matches(t, '(?m)^[\\s]*[-*+]\\s') as has_lists, contains(t, '```') as has_code_blocks, len(secs) as chunk_count,
  case when len(secs) = 0 then 0 else list_sum(chunk_words)::bigint // len(secs) end as avg_chunk_words,
  len(list_filter(chunk_words, lambda w: w between 50 and 150)) as chunks_in_sweet_spot,
  case when len(words) >= 30 then round_even((0.39::double * (len(words)::double / sentences) + 11.8::double * (syllables::double / len(words)) - 15.59::double), 1) end as readability_grade,
  len(levels) as heading_count,
  coalesce(list_bool_and(list_transform(range(2, len(levels) + 1), lambda i: levels[i] <= levels[i - 1] + 1)), true) as headings_in_order,
  case when len(secs) = 0 then 0.0 else round_even(len(list_filter(list_transform(secs, lambda s: regexp_replace(s, '^[{_WS}]+|[{_WS}]+$', '', 'g')),
     lambda s: not ends_with(regexp_replace(case when regexp_extract(s, '(?s)^(.*?[.!?])[\\s]', 1) = '' then s else regexp_extract(s, '(?s)^(.*?[.!?])[\\s]', 1) end, '[{_WS}]+$', ''), '?'))) / len(secs), 2) end as answer_first_ratio
from c"""


def content_metrics_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spread(table(spark, sf_dir, "pages").select("page_id", "markdown")), "page_id", "markdown")


def content_metrics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


_QUIET = r"""regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g')"""
_VISIBLE = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '(?is)<nav\b[^>]*>.*?</nav\s*>', ' ', 'g'), '(?is)<header\b[^>]*>.*?</header\s*>', ' ', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
)


def page_token_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, clean = M.token_estimate(F.col("html")), M.token_estimate(F.col("text"))
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "html", H.visible_text(F.col("html")).alias("text"))
    return rows.select("page_id", raw.alias("raw_tokens"), clean.alias("clean_tokens"), M.waste_pct(raw, clean).alias("waste_pct"), M.word_count(F.col("text")).cast("long").alias("words"))


TOKEN_WASTE_SQL = rf"""
with a as (select page_id, html, {_QUIET} as q from pages), b as (select page_id, length(coalesce(html, '')) // 4 as raw, {_VISIBLE} as t from a)
select page_id, raw as raw_tokens, length(t) // 4 as clean_tokens, case when raw = 0 then 0.0 else round_even((raw - length(t) // 4)::double / raw * 100, 1) end as waste_pct,
  len(regexp_extract_all(t, '[^{_WS}]+')) as words from b"""


def html_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    q = H.quiet(h)
    return spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", H.title(h).alias("title"), *[H.has_tag(q, t).alias(f"has_{t}") for t in ("main", "article", "header", "footer", "nav")],
        H.semantic_score(h).cast("long").alias("semantic_score"), F.size(H.hrefs(h)).cast("long").alias("n_links"), H.has_date(h).alias("has_date"), H.has_author(h).alias("has_author"),
        H.any_link(H.hrefs(h), r"(?i)/about(-us)?(/|$)").alias("has_about"), H.any_link(H.hrefs(h), r"(?i)mailto:|tel:|/contact(-us)?(/|$)").alias("has_contact"),
        F.size(F.filter(H.hrefs(h), lambda x: x.rlike("(?i)^https?://") & (U.netloc(x) != U.netloc(F.col("url"))))).cast("long").alias("external_links"),
        F.array_join(H.trust_signals(h, H.hrefs(h)), ",").alias("trust"), H.meta_tag_points(h).alias("meta_points"),
    )


_TAG = lambda t: f"regexp_matches(q, '(?i)<{t}[\\s/>]')"
HTML_SIGNALS_SQL = rf"""
with a as (select page_id, url, coalesce(html, '') as html, {_QUIET} as q from pages),
b as (select *, regexp_extract_all(q, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) as links, regexp_extract_all(q, '(?i)\srole\s*=\s*["'']?([a-zA-Z]+)', 1) as roles from a)
select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title,
  {_TAG('main')} as has_main, {_TAG('article')} as has_article, {_TAG('header')} as has_header, {_TAG('footer')} as has_footer, {_TAG('nav')} as has_nav,
  ({_TAG('main')} or {_TAG('article')})::bigint + ({_TAG('header')} and {_TAG('nav')})::int + (len(list_filter(roles, lambda r: lower(r) in ('banner','complementary','contentinfo','form','main','navigation','region','search'))) >= 2)::int::bigint as semantic_score,
  len(links) as n_links,
  regexp_matches(q, '(?i)<meta[^>]+(?:property|name|itemprop)\s*=\s*["''](?:article:published_time|article:modified_time|og:updated_time|datePublished|dateModified|date|publish[-_]date|last-modified)["'']') or regexp_matches(q, '(?i)<time[^>]+datetime\s*=') as has_date,
  regexp_matches(q, '(?i)<meta[^>]+name\s*=\s*["'']author["''][^>]+content\s*=\s*["''][^"'']') or regexp_matches(q, '(?i)<a[^>]+rel\s*=\s*["''][^"'']*\bauthor\b') or regexp_matches(q, '(?i)itemprop\s*=\s*["'']author') or regexp_matches(q, '(?i)class\s*=\s*["''][^"'']*(?:byline|author)') as has_author,
  len(list_filter(links, lambda x: regexp_matches(x, '(?i)/about(-us)?(/|$)'))) > 0 as has_about, len(list_filter(links, lambda x: regexp_matches(x, '(?i)mailto:|tel:|/contact(-us)?(/|$)'))) > 0 as has_contact,
  len(list_filter(links, lambda x: regexp_matches(x, '(?i)^https?://') and regexp_extract(x, '^[^:]+://([^/?#]*)', 1) <> regexp_extract(url, '^[^:]+://([^/?#]*)', 1))) as external_links,
  concat_ws(',', case when len(list_filter(links, lambda x: regexp_matches(x, '(?i)privacy'))) > 0 or regexp_matches(q, '(?i)privacy') then 'privacy' end, case when len(list_filter(links, lambda x: regexp_matches(x, '(?i)terms'))) > 0 or regexp_matches(q, '(?i)terms (?:of|and)') then 'terms' end) as trust,
  (case when regexp_matches(q, '(?i)<meta[^>]+property\s*=\s*["'']og:title["'']') then 5.0 else 0.0 end + case when regexp_matches(q, '(?i)<meta[^>]+property\s*=\s*["'']og:description["'']') then 5.0 else 0.0 end)::double as meta_points
from b"""


def internal_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = discovery.internal_links(table(spark, sf_dir, "pages").select("url", "html"), "url", "html").select("url", "link").distinct()
    return links.groupBy("url").agg(F.count("*").alias("n_links"), F.min("link").alias("first_link"))


INTERNAL_LINKS_SQL = rf"""
with a as (select distinct url, unnest(regexp_extract_all({_QUIET}, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) as h from pages),
b as (select url, regexp_extract(url, '^[^:]+://[^/?#]*') as base, regexp_replace(h, '#.*$', '') as h from a),
c as (select distinct url, case when h = '' then regexp_replace(url, '#.*$', '') when starts_with(h, '/') then base || h else h end as link, base from b)
select url, count(*) as n_links, min(link) as first_link from c where starts_with(link, base || '/') or link = base or starts_with(link, base || '?') group by 1"""


def structured_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD objects of the listings, as blocks of a page each."""
    texts = table(spark, sf_dir, "products").select("listing_id", "schema_org").filter("schema_org is not null").distinct()
    rows = structured_data.blocks_of_texts(texts.withColumn("t", F.array("schema_org")), "listing_id", "t")
    return rows.select("listing_id", F.col("pos").cast("long").alias("pos"), "schema_type", F.array_join("properties", ",").alias("properties"))


STRUCTURED_SQL = r"""
with a as (select distinct listing_id, trim(schema_org) as j from products where schema_org is not null),
b as (select listing_id, j::json as o from a where starts_with(j, '{') and json_valid(j))
select listing_id, 0::bigint as pos,
  case when (o->'$."@type"') is null then 'Unknown' when json_type(o->'$."@type"') = 'ARRAY' then array_to_string(from_json(o->'$."@type"', '["VARCHAR"]'), ', ') else o->>'$."@type"' end as schema_type,
  array_to_string(list_sort(list_filter(json_keys(o), lambda k: not starts_with(k, '@'))), ',') as properties
from b"""


def listing_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing_quality.with_quality(table(spark, sf_dir, "products"))
    return rows.select("listing_id", "seen_at", "schema_points", "content_points", "visual_points", "social_points", "feed_points", "quality_score")


QUALITY_SQL = r"""
with a as (select *, case when schema_org is not null and json_valid(schema_org) then schema_org::json end as o from products),
b as (select *, coalesce(case when json_type(o->'$."@type"') = 'ARRAY' then list_contains(from_json(o->'$."@type"', '["VARCHAR"]'), 'Product') else (o->>'$."@type"') = 'Product' end, false) as is_product,
  coalesce((o->>'$.offers') not in ('', '[]', '{}', '0', 'false', 'null'), false) as has_offers, coalesce((o->>'$.aggregateRating') not in ('', '[]', '{}', '0', 'false', 'null'), false) as has_rating,
  coalesce(len(image_urls), 0) as ni, coalesce(len(alt_texts), 0) as na, coalesce(len(bullet_points), 0) as nb, coalesce(cardinality(specifications), 0) as ns from a),
c as (select listing_id, seen_at, is_product::int * 10.0::double + has_offers::int * 8.0::double + has_rating::int * 7.0::double as schema_points,
  least(nb / 5.0::double, 1.0) * 10 + least(coalesce(length(description), 0) / 200.0::double, 1.0) * 10 + coalesce(has_aplus_content, false)::int * 5.0::double + (ns > 0)::int * 5.0::double as content_points,
  least(ni / 5.0::double, 1.0) * 8 + case when ni > 0 then least(na, ni)::double / ni * 4 else 0.0 end + coalesce(has_video, false)::int * 3.0::double as visual_points,
  least(greatest(coalesce(review_count, 0), 0) / 10.0::double, 1.0) * 10 + least(greatest(coalesce(rating, 0.0), 0.0) / 4.0::double, 1.0) * 5 + (coalesce(qa_count, 0) > 0)::int * 5.0::double as social_points,
  (coalesce(length(title) > 0, false)::int + coalesce(length(description) > 0, false)::int + coalesce(length(url) > 0, false)::int + coalesce(length(price) > 0, false)::int + coalesce(length(currency) > 0, false)::int + coalesce(length(availability) > 0, false)::int + (ni > 0)::int + coalesce(length(brand) > 0, false)::int)::double / 8 * 10.0::double as feed_points
  from b)
select *, least(100.0, schema_points + content_points + visual_points + social_points + feed_points) as quality_score from c"""


def listing_feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of listings that have each feed field."""
    return listing_quality.feed_fields(table(spark, sf_dir, "products"), "listing_id").groupBy("field").agg(F.count_if("is_present").alias("n_present"), F.count("*").alias("n"))


FEED_SQL = """
with f as (select unnest([{'f': 'title', 'v': length(title) > 0}, {'f': 'description', 'v': length(description) > 0}, {'f': 'url', 'v': length(url) > 0}, {'f': 'price', 'v': length(price) > 0},
  {'f': 'currency', 'v': length(currency) > 0}, {'f': 'availability', 'v': length(availability) > 0}, {'f': 'brand', 'v': length(brand) > 0}, {'f': 'image_url', 'v': len(image_urls) > 0},
  {'f': 'reviews_count', 'v': review_count > 0}, {'f': 'average_rating', 'v': rating > 0}]) as x from products)
select x.f as field, count(*) filter (coalesce(x.v, false)) as n_present, count(*) as n from f group by 1"""


def marketplace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "products").select(listing_quality.marketplace(F.col("url")).alias("detected"), "marketplace")
    return rows.groupBy("detected", "marketplace").agg(F.count("*").alias("n"))


_HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1))"
MARKETPLACE_SQL = (
    "select case " + " ".join(f"when regexp_matches({_HOST}, '{p}') then '{n}'" for n, p in listing_quality.MARKETPLACES) + " else 'generic' end as detected, marketplace, count(*) as n from products group by all"
)


def markdown_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens saved by the conversion to markdown, per page."""
    return page_markdown.reduction(table(spark, sf_dir, "pages").filter("html <> ''"), "page_id", "html")


def llms_txt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_markdown.llms_txt(table(spark, sf_dir, "pages"), "site", "url", "html")


LLMS_TXT_SQL = r"""
with a as (select distinct site, url as u, coalesce(nullif(trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)), ''), url) as t from pages where url is not null and site is not null)
select site, 0::bigint as part, '# ' || site || chr(10) || chr(10) || '## Pages' || chr(10) || string_agg('- [' || t || '](' || u || ')', chr(10) order by u, t) as llms_txt from a group by site"""


def queries() -> dict:
    return {
        "url_parts": url_parts, "url_dedupe": url_dedupe, "diverse_sample_per_site": diverse_sample_per_site, "content_metrics_pages": content_metrics_pages,
        "content_metrics_documents": content_metrics_documents, "page_token_waste": page_token_waste, "html_signals": html_signals, "internal_link_counts": internal_link_counts,
        "structured_blocks": structured_blocks, "listing_quality_scores": listing_quality_scores, "listing_feed_gaps": listing_feed_gaps, "marketplace_counts": marketplace_counts,
        "markdown_reduction": markdown_reduction, "llms_txt_files": llms_txt_files,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "url_parts": URL_PARTS_SQL, "url_dedupe": URL_DEDUPE_SQL, "diverse_sample_per_site": DIVERSE_SQL, "content_metrics_pages": _metrics_sql("pages", "page_id", "markdown"),
        "content_metrics_documents": _metrics_sql("documents", "doc_id", "text"), "page_token_waste": TOKEN_WASTE_SQL, "html_signals": HTML_SIGNALS_SQL, "internal_link_counts": INTERNAL_LINKS_SQL,
        "structured_blocks": STRUCTURED_SQL, "listing_quality_scores": QUALITY_SQL, "listing_feed_gaps": FEED_SQL, "marketplace_counts": MARKETPLACE_SQL, "llms_txt_files": LLMS_TXT_SQL,
    }
