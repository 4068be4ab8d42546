import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnlight import plugins
from tarnlight.functions import dom, html, markdown, readiness, urls
from tarnlight.operators import answer_analytics, discovery, endpoints, generated_texts, listing_quality, page_markdown, product_pages, score_changes, site_marts, structured_data
from tarnlight.sources import files, observations
from tarnlight.streaming import watch


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize(("text", "grade"), [(None, None), ("", None), ("word " * 29, None), ("cat. " * 30, -3.4), ("one " * 30, 7.9 + 0.0)])
def test_readability_needs_thirty_words(spark, text, grade):
    got = one(spark, markdown.readability_grade, text)
    assert (got is None) == (grade is None)


@pytest.mark.parametrize(("text", "valid", "n"), [("# a\n## b\n# c", True, 3), ("# a\n### b", False, 2), ("", True, 0), ("### a\n# b\n## c", True, 3)])
def test_heading_steps(spark, text, valid, n):
    assert one(spark, markdown.headings_in_order, text) is valid
    assert one(spark, lambda c: F.size(markdown.heading_levels(c)), text) == n


@pytest.mark.parametrize(("text", "ratio"), [("", 0.0), ("# a\nIs it? Yes.\n# b\nIt is.", 0.5), ("Only text", 1.0), ("# a\n\n# b\n", 0.0), ("What", 1.0), ("What?", 0.0)])
def test_answer_first(spark, text, ratio):
    assert one(spark, markdown.answer_first_ratio, text) == ratio


def test_chunk_bounds_and_long_texts(spark):
    text = "# h\n" + "w " * 49 + "\n# h\n" + "w " * 50 + "\n# h\n" + "w " * 150 + "\n# h\n" + "w " * 151
    m = markdown.content_metrics(F.col("x"))
    row = spark.createDataFrame([(text,), (None,), ("w " * 300_000,)], "x string").select(*[c.alias(n) for n, c in m.items()]).collect()
    assert (row[0].chunk_count, row[0].chunks_in_sweet_spot, row[0].avg_chunk_words) == (4, 2, 100)
    assert row[1].word_count == 0 and row[2].word_count == 300_000


@pytest.mark.parametrize(("url", "weight"), [("https://a.test", 3), ("https://a.test/x/", 3), ("https://a.test/x/y?q=1", 2), ("https://a.test/x/y/z", 1), ("https://a.test//x//y", 1)])
def test_page_weight(spark, url, weight):
    assert one(spark, urls.page_weight, url) == weight


def test_markdown_engine():
    page = """<html><head><title>t</title></head><body><header>H</header><div class="cookie-bar">C</div><div id="thread-list">over-matched</div><main><h2>Title</h2><p>Long enough text with <a href="/x">a link</a>, <em>em</em> and <code>c</code> to be kept.</p>
    <pre>a
  b</pre><ol><li>one</li><li>two</li></ol><p style="display: none">hidden</p><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table></main><footer>F</footer><!-- c --></body></html>"""
    md = dom.to_markdown(page)
    assert md.startswith("## Title\n\nLong enough text with [a link](/x), *em* and `c` to be kept.")
    assert "```\na\n  b\n```" in md and "1. one\n2. two" in md and "| k | v |\n| --- | --- |\n| 1 | 2 |" in md
    assert not any(x in md for x in ("hidden", "over-matched", "C\n", "F\n"))
    kept = dom.to_markdown(page, dom.MarkdownConfig(strip_footer=False, extract_main=False))
    assert "F" in kept
    assert dom.to_markdown("") == dom.to_markdown(None) == "" and "x" in dom.to_markdown("<p>x<div><b>y" + "<i>" * 2000)


def test_main_content_falls_back():
    text = "long " * 12
    assert dom.main_content(dom.parse(f"<main>short</main><article>{text}</article><article>{text}{text}</article>")).text() == text + text
    assert dom.main_content(dom.parse(f"<div role=main>{text}</div>")).attrs["role"] == "main"
    assert dom.main_content(dom.parse("<body>x</body>")).tag == "body" and dom.main_content(dom.parse("x")).tag == "#document"


def test_bulk_markdown(spark):
    pages = spark.createDataFrame([(1, "<p>Some text</p>" * 20), (2, None), (3, "")], "page_id long, html string")
    rows = {r.page_id: r for r in page_markdown.reduction(pages, "page_id", "html").collect()}
    assert rows[1].reduction_pct > 30 and rows[2].reduction_pct == 0.0 and rows[3].raw_tokens == 0


def test_json_ld(spark):
    page = """<script type="application/ld+json">{"@type": ["A", "B"], "name": "x", "@id": 1}</script><script type='application/ld+json'>[{"@type": "C"}, {"u": 2}, 3]</script><script type="application/ld+json">{bad</script><script type="application/ld+json"></script>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "id long, html string")
    got = [(r.id, r.pos, r.schema_type, r.properties) for r in structured_data.blocks(df, "id", "html").orderBy("pos").collect()]
    assert got == [(1, 0, "A, B", ["name"]), (1, 1, "C", []), (1, 2, "Unknown", ["u"])]
    texts = spark.createDataFrame([(['{"@type": "X", "potentialAction": {"@type": "NLSearchAction"}}'],), (['{"@type": "X"}'],)], "t array<string>")
    assert [r[0] for r in texts.select(structured_data.declares_endpoint(F.col("t"))).collect()] == [True, False]
    first = spark.createDataFrame([(['{"a": 1}', '{"@type": "Product", "n": 2}'],)], "t array<string>").select(structured_data.product_object(F.col("t"))).collect()[0][0]
    assert '"n": 2' in first


def test_html_signals(spark):
    page = '<main></main><header></header><nav></nav><div role="search"></div><div role=banner></div><script>var a = "<article>";</script><meta name="author" content="X"><time datetime="2024"></time>'
    row = spark.createDataFrame([(page,)], "h string").select(html.semantic_score(F.col("h")).alias("s"), html.has_tag(html.quiet(F.col("h")), "article").alias("a"), html.has_author(F.col("h")).alias("w"), html.has_date(F.col("h")).alias("d")).collect()[0]
    assert (row.s, row.a, row.w, row.d) == (3, False, True, True)


def test_robots_rules(spark):
    rows = [("a", None), ("b", ""), ("c", "User-agent: *\nDisallow: /"), ("d", "User-agent: GPTBot\nDisallow: /")]
    got = {(r.site, r.bot): r.allowed for r in discovery.robots_access(spark.createDataFrame(rows, "site string, body string"), ["GPTBot", "Grok"]).collect()}
    assert got == {("b", "GPTBot"): True, ("b", "Grok"): True, ("c", "GPTBot"): False, ("c", "Grok"): False, ("d", "GPTBot"): False, ("d", "Grok"): True}
    pages = spark.createDataFrame([("d", "https://d/x"), ("z", "https://z/x")], "site string, url string")
    left = discovery.allowed_urls(pages, spark.createDataFrame(rows, "site string, body string"), "GPTBot").collect()
    assert [r.site for r in left] == ["z"]


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<sitemapindex {ns}>" + "".join(f"<sitemap><loc> https://s/{i}.xml </loc></sitemap>" for i in range(12)) + "</sitemapindex>"
    child = lambda i: f"<urlset {ns}><url><loc>https://s/p{i}</loc></url></urlset>"
    rows = [("s", "https://s/sitemap.xml", index)] + [("s", f"https://s/{i}.xml", child(i)) for i in range(12)] + [("t", "https://t/sitemap.xml", "<urlset><url><loc>x</loc></url></urlset>"), ("u", "https://u/sitemap.xml", "<broken"), ("v", "https://v/s", None)]
    got = discovery.sitemap_pages(spark.createDataFrame(rows, "site string, url string, body string")).collect()
    pages = {r.url for r in got}
    assert {f"https://s/p{i}" for i in range(10)} <= pages and all(r.site == "s" for r in got)


def test_internal_links(spark):
    page = '<a href="/x#a">1</a><a href="y">2</a><a href="https://o.test/">3</a><a href="mailto:a@b">4</a><a href="/x">5</a><a href="http://[bad">6</a>'
    got = discovery.internal_links(spark.createDataFrame([("https://a.test/d/", page), (None, None)], "url string, html string"), "url", "html").orderBy("pos").collect()
    assert [r.link for r in got] == ["https://a.test/x", "https://a.test/d/y"]


def test_endpoints(spark):
    row = lambda site, path, method="GET", status=200, headers=None, body="", error=None: (site, path, method, status, headers or {}, body, error)
    rows = [
        row("a", "/llms.txt", body=" "), row("a", "/.well-known/llms.txt", body="x"), row("a", "/", "HEAD", 200, {"CONTENT-USAGE": "training=no, search=yes, training=yes"}), row("a", "/.well-known/mcp.json", body='{"tools": 3}'),
        row("b", "/", "HEAD", 402, {"Pay": "1"}), row("b", "/.well-known/mcp.json", body="{bad"), row("b", "/llms.txt", error="timeout", status=None), row("b", "/", "GET-MARKDOWN", 200, {"content-type": "text/x-markdown"}),
    ]
    df = spark.createDataFrame(rows, "site string, path string, method string, status int, headers map<string,string>, body string, error string")
    got = {r.site: r for r in endpoints.site_checks(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.llms_path, a.allows_training, a.allows_search, a.mcp_score, a.mcp_tools, a.agent_score) == ("/.well-known/llms.txt", True, True, 4.0, None, 4.0)
    assert (b.llms_path, b.has_402, b.has_payment_header, b.mcp_score, b.markdown_accept, b.agent_score) == (None, True, True, 1.0, True, 8.0)


def test_headers_and_generated_texts(spark):
    row = spark.createDataFrame([({"Connection": "x", "Accept": "text/markdown"}, "T", "D", [("H", [("a", "https://a", "note"), (None, "https://b", None)])], ["h", "h"], ["/x"])], "h map<string,string>, t string, d string, s array<struct<heading:string,links:array<struct<title:string,url:string,description:string>>>>, hs array<string>, ls array<string>").select(
        endpoints.forwarded_headers(F.col("h")).alias("f"), endpoints.wants_markdown(F.col("h")["Accept"]).alias("w"), endpoints.is_html(F.lit("Text/HTML; x")).alias("i"), generated_texts.llms_txt(F.col("t"), F.col("d"), F.col("s")).alias("l"),
        generated_texts.agents_md(F.col("t"), F.col("d"), F.col("hs"), F.col("ls")).alias("a"), generated_texts.json_ld("Organization", {"name": F.col("t"), "url": F.lit(None).cast("string")}).alias("j"), F.length(generated_texts.page_prompt("Do.", F.lit("u"), F.repeat(F.lit("x"), 9000))).alias("p"),
    ).collect()[0]
    assert row.f == {"Accept": "text/markdown"} and row.w and row.i
    assert row.l == "# T\n\n> D\n\n## H\n\n- [a](https://a): note\n- [https://b](https://b)\n"
    assert row.a == "# T\n\nD\n\n## Sections\n\n- h\n\n## Links\n\n- /x" and '"@type" : "Organization"' in row.j and "url" not in row.j and row.p == 8000 + 13


def test_sitemap_else_links(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    fetches = spark.createDataFrame([("s", "https://s/sitemap.xml", f"<urlset {ns}><url><loc>https://s/1</loc></url></urlset>")], "site string, url string, body string")
    pages = spark.createDataFrame([("s", "https://s/", '<a href="/2">x</a>'), ("t", "https://t/", '<a href="/3">x</a><a href="/3">y</a>')], "site string, url string, html string")
    assert sorted(map(tuple, discovery.discovered(fetches, pages).collect())) == [("s", "https://s/1", "sitemap"), ("t", "https://t/3", "links")]


def test_robots_directives(spark):
    text = "Sitemap: https://a/1\r\ncrawl-delay: soon\nCrawl-Delay: 2.5\nCrawl-delay: 9\nUser-agent: gptbot\nUser-Agent: GPTBot\nuser-agent: GPTBot\nSITEMAP: https://a/2"
    d = endpoints.robots_directives(F.col("x"))
    row = spark.createDataFrame([(text,), (None,)], "x string").select(*[c.alias(n) for n, c in d.items()]).collect()
    assert (row[0].sitemaps, row[0].crawl_delay, row[0].ai_agents) == (["https://a/1", "https://a/2"], 2.5, ["GPTBot"])
    assert row[1].sitemaps == [] and row[1].crawl_delay is None


def test_citations(spark):
    text = "See [2](https://www.b.test/x). [1]: https://a.test/y, and https://c.test:80/z! (https://a.test/y) [1] https://d.test"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = [(r.url, r.domain) for r in answer_analytics.citations(df, "id", "t").orderBy("pos").collect()]
    assert got == [("https://a.test/y", "a.test"), ("https://www.b.test/x", "b.test"), ("https://c.test:80/z", "c.test"), ("https://d.test", "d.test")]
    assert one(spark, lambda c: answer_analytics.snippet(c, F.lit("https://x.test")), "a" * 80 + " https://x.test " + "b" * 80) == "a" * 49 + " https://x.test " + "b" * 49


def test_domains(spark):
    for domain, root, category in [("en.wikipedia.org", "wikipedia.org", "reference"), ("www.Reddit.com:80", "reddit.com", "reddit"), ("a.b.c.test.", "c.test", "other"), ("x", "x", "other"), ("", "", "other")]:
        assert one(spark, answer_analytics.root_domain, domain) == root and one(spark, answer_analytics.domain_category, domain) == category


def test_brand_mentions(spark):
    texts = spark.createDataFrame([(1, "The best is Acme. acme! " + "x " * 120 + "ACME is bad and poor"), (2, "a.c"), (3, None)], "id long, t string")
    brands = spark.createDataFrame([("Acme",), ("",), (None,), ("a.c",), ("absent",)], "b string")
    got = {(r.id, r.brand): (r.n, r.sentiment) for r in answer_analytics.brand_mentions(texts, "id", "t", brands, "b").collect()}
    assert got == {(1, "Acme"): (3, "positive"), (2, "a.c"): (1, "neutral")}


@pytest.mark.parametrize(("labels", "want"), [(["positive", "negative", "negative"], "negative"), (["negative", "negative", "positive"], "neutral"), ([], "neutral"), (["odd", "positive"], "positive")])
def test_sentiment_fold_keeps_the_order(spark, labels, want):
    assert one(spark, answer_analytics.fold_sentiments, labels, "array<string>") == want


def test_marketplaces_and_quality(spark):
    assert one(spark, listing_quality.marketplace, "https://www.amazon.co.uk/dp/1") == "amazon" and one(spark, listing_quality.marketplace, "https://shop.test") == "generic" and one(spark, listing_quality.marketplace, "") == "generic"
    schema = "title string, description string, url string, price string, currency string, availability string, image_urls array<string>, brand string, rating double, review_count long, bullet_points array<string>, specifications map<string,string>, has_video boolean, has_aplus_content boolean, qa_count long, schema_org string, alt_texts array<string>"
    full = ("t", "d" * 200, "u", "1", "USD", "in", ["i"] * 5, "b", 4.0, 10, ["x"] * 5, {"k": "v"}, True, True, 1, '{"@type": ["Product"], "offers": {"p": 1}, "aggregateRating": {"r": 1}}', ["a"] * 9)
    empty = (None, "", None, None, None, None, None, None, None, None, None, None, None, None, None, "{bad", None)
    got = listing_quality.with_quality(spark.createDataFrame([full, empty], schema)).select("quality_score").collect()
    assert [r[0] for r in got] == [100.0, 0.0]


def test_product_pages(spark):
    amazon = '<span id="productTitle"> Kettle </span><span class="a-price-whole">$12.50</span><a id="bylineInfo">Acme</a><span id="acrPopover" title="4.5 out of 5"></span><span id="acrCustomerReviewText">1,234 ratings</span><div id="feature-bullets"><span class="a-list-item">One</span></div><table id="productDetails_techSpec_section_1"><tr><th>W</th><td>1 kg</td></tr></table><div id="altImages"><img src="i.jpg" alt="front"></div>'
    graph = '<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": "Product", "name": "Pan", "brand": {"name": "B"}, "offers": [{"price": 9, "priceCurrency": "EUR"}], "aggregateRating": {"ratingValue": "4,2", "reviewCount": "7"}}]}</script>'
    og = '<meta property="og:title" content="Lamp"><meta property="product:price:amount" content="5">'
    rows = [("u1", amazon, "amazon"), ("u2", graph, "generic"), ("u3", og, "other"), ("u4", None, "amazon"), ("u5", "<script type='application/ld+json'>{x</script>", "shopee")]
    got = {r.url: r for r in product_pages.parse_pages(spark.createDataFrame(rows, "url string, html string, m string"), "url", "html", "m").collect()}
    a = got["u1"]
    assert (a.title, a.price, a.currency, a.brand, a.rating, a.review_count, a.bullet_points, a.specifications, a.image_urls, a.alt_texts) == ("Kettle", "$12.50", "USD", "Acme", 4.5, 1234, ["One"], {"W": "1 kg"}, ["i.jpg"], ["front"])
    assert (got["u2"].title, got["u2"].currency, got["u2"].rating, got["u2"].review_count, got["u2"].brand) == ("Pan", "EUR", 4.2, 7, "B")
    assert (got["u3"].title, got["u3"].price) == ("Lamp", "5") and got["u4"].title is None and got["u5"].title is None


def test_changes(spark):
    t = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([("u", t, 80.0, 30.0), ("u", t + dt.timedelta(1), 75.0, 30.0), ("u", t + dt.timedelta(2), 69.9, 20.0), ("v", t, 10.0, 1.0)], "url string, ts timestamp_ntz, overall double, content double")
    got = score_changes.regressions(h, "url", ["ts"], "overall", ["content"]).collect()
    assert [(r.overall, r.delta_overall, r.delta_content) for r in got] == [(69.9, -5.1, -10.0)]
    fails = score_changes.threshold_failures(h, "url", {"overall": 75.0, "content": None}, {"content": 29.0}).collect()
    assert sorted((r.url, r.pillar, r.actual) for r in fails) == [("u", "content", 30.0), ("u", "content", 30.0), ("u", "overall", 69.9), ("v", "overall", 10.0)]
    now, base = h.filter("overall = 69.9"), h.filter("overall = 80.0")
    assert {r.pillar for r in score_changes.against_baseline(now, base, "url", ["overall", "content"]).collect()} == {"overall", "content"}
    assert {r.winner for r in score_changes.pairwise(now, base, "url", ["overall"]).collect()} == {"b"}


def test_previous_rows_across_days(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else "u", i, t + dt.timedelta(hours=7 * (i // 2)), float(i * 37 % 101) if i % 5 else None) for i in range(200)]
    got = score_changes.with_previous(spark.createDataFrame(rows, "url string, id int, ts timestamp_ntz, s double"), "url", ["ts", "id"], ["s"]).collect()
    last, want = {}, {}
    for url, i, _, s in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = last.get(url)
        last[url] = s
    assert {r.id: r.prev_s for r in got} == want


def test_large_sites_get_several_files(spark):
    pages = spark.createDataFrame([("s", f"https://s/{i}", f"<title>T{i}</title>") for i in range(250)] + [("t", "https://t/", None), (None, "x", ""), ("u", None, "")], "site string, url string, html string")
    got = page_markdown.llms_txt(pages, "site", "url", "html", 100).collect()
    assert sum(r.llms_txt.count("- [") for r in got if r.site == "s") == 250 and len([r for r in got if r.site == "s"]) == 3
    assert [r.llms_txt for r in got if r.site == "t"] == ["# t\n\n## Pages\n- [https://t/](https://t/)"]


def test_ranks_are_total_and_gapless(spark):
    df = spark.createDataFrame([(f"s{i:03}", float(i % 7) if i % 5 else None) for i in range(300)], "site string, waste_pct double").repartition(7)
    got = site_marts.leaderboard(df).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 301))
    want = sorted(got, key=lambda r: (100.0 if r.waste_pct is None else r.waste_pct, r.site))
    assert [r["rank"] for r in want] == list(range(1, 301))


def test_site_aggregate_counts_pages_with_words_in_spite_of_errors(spark):
    rows = [("s", "https://s/", None, 100, 500, 10.0, 20.0, 1, True), ("s", "https://s/a/b/c", "slow", 50, 100, 0.0, 40.0, 0, False), ("s", "https://s/x", "gone", 0, 0, 0.0, 0.0, 0, False), ("t", "https://t/", "gone", 0, 0, 0.0, 0.0, 0, False)]
    df = spark.createDataFrame(rows, "site string, url string, error string, word_count int, char_count int, schema_score double, content_score double, blocks_found int, has_headings boolean").withColumns({"has_lists": F.lit(False), "has_code_blocks": F.lit(False)})
    got = {r.site: r for r in site_marts.aggregate_sites(df).collect()}
    assert (got["s"].content_score, got["s"].schema_score, got["s"].avg_words, got["s"].pages, got["s"].pages_failed) == (25.0, 7.5, 75, 3, 2)
    assert (got["t"].content_score, got["t"].avg_words) == (0.0, 0)


def test_recommendation_share_keeps_models_without_answers(spark):
    judged = spark.createDataFrame([("m", ["A", "B"], "A", 1, "positive"), ("m", ["B"], "B", None, "odd"), ("x", ["A"], "A", 3, "neutral")], "model string, brands_mentioned array<string>, recommended_brand string, target_brand_position int, sentiment string")
    got = {r.model: r for r in answer_analytics.recommendation_share(judged, spark.createDataFrame([("m",), ("n",)], "model string"), "A").collect()}
    assert (got["m"].mention_rate, got["m"].recommendation_rate, got["m"].avg_position, got["m"].n_positive, got["m"].n_neutral) == (0.5, 0.5, 1.0, 1, 0)
    assert (got["n"].n_judged, got["n"].mention_rate, got["n"].avg_position) == (0, 0.0, None) and got[None].n_judged == 2


def test_recommendations_by_impact(spark):
    row = spark.createDataFrame([(0, False, False, False, None, 0.0, 0.0, 0, 0, [], 0, False, False, False, [])], "word_count int, has_headings boolean, has_lists boolean, has_code_blocks boolean, readability_grade double, answer_first_ratio double, waste_pct double, raw_tokens int, clean_tokens int, schema_types array<string>, blocks_found int, llms_found boolean, llms_full_found boolean, robots_found boolean, bots array<struct<bot:string,allowed:boolean>>")
    scored = readiness.with_scores(row)
    recs = scored.select(F.explode(readiness.recommendations()).alias("r")).select("r.*").collect()
    assert [r.rule for r in recs] == [1, 5, 7, 3, 8, 9] and [r.impact for r in recs] == [25.0, 25.0, 15.0, 10.0, 7.0, 5.0]
    checks = {r.name: r.severity for r in scored.select(F.inline(readiness.lint_checks())).collect()}
    assert checks == {"AI Primitives": "fail", "Bot Access": "pass", "Data Structuring": "fail", "Token Efficiency": "pass"}


def test_file_sources(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# c\n\n a.test \nhttps://b.test\n")
    (tmp_path / "u.csv").write_text("url,x\na.test,1\nLink,2\n#no,3\n,4\n")
    assert [r.url for r in files.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://a.test", "https://b.test"]
    assert [r.url for r in files.url_list(spark, str(tmp_path / "u.csv")).collect()] == ["https://a.test"]
    (tmp_path / "p.csv").write_text('Prompt, category\n"a, b",x\n  ,y\nc,\n')
    (tmp_path / "p.txt").write_text("one\n\n two \n")
    assert [(r.prompt, r.category, r.intent) for r in files.prompt_list(spark, str(tmp_path / "p.csv")).collect()] == [("a, b", "x", None), ("c", None, None)]
    assert [r.prompt for r in files.prompt_list(spark, str(tmp_path / "p.txt")).collect()] == ["one", "two"]
    (tmp_path / "e.txt").write_text("")
    assert files.prompt_list(spark, str(tmp_path / "e.txt")).count() == 0


def test_history_store_and_sinks(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    store = files.HistoryStore(spark, str(tmp_path / "h"))
    for k in range(3):
        store.append(spark.createDataFrame([(k, "u", t + dt.timedelta(days=k), 1.0 * k), (10 + k, "v", t, 0.0)], "id long, url string, ts timestamp_ntz, score double"))
    assert [r.id for r in store.entries("u", 2).collect()] == [2, 1]
    assert store.without("u", str(tmp_path / "h2")) == 3 and spark.read.parquet(str(tmp_path / "h2")).count() == 3
    scores = spark.createDataFrame([("u", 1.5, ["A", "B"])], "url string, score double, codes array<string>")
    files.save_baseline(scores.select("url", "score"), str(tmp_path / "b"))
    assert files.load_baseline(spark, str(tmp_path / "b"), "url string, score double").collect()[0].score == 1.5
    files.export_csv(scores, str(tmp_path / "c"), ["url", "codes"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).collect()[0].codes == "A,B"
    files.export_pages(spark.createDataFrame([("a/b.md", "x"), ("index.md", "y")], "path string, markdown string"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert '"score":1.5' in files.webhook_payload(scores).collect()[0].payload


def test_observations_retry(spark):
    def fetch(url, method):
        if url.endswith("bad"):
            raise OSError("no route")
        return (503 if url.endswith("busy") else 200), {"a": "b"}, "ok"

    probes = spark.createDataFrame([("s", f"https://s/{p}", f"/{p}", "GET") for p in ("x", "bad", "busy")], "site string, url string, path string, method string")
    got = {r.path: r for r in observations.observe(probes, fetch, retries=1, pause=0.0, partitions=2).collect()}
    assert got["/x"].status == 200 and got["/bad"].error.startswith("OSError") and got["/busy"].status == 503


def test_plugins(spark):
    plugins.clear()
    plugins.register("og", lambda: html.meta_tag_points(F.col("html")), 10.0)
    row = plugins.apply(spark.createDataFrame([('<meta property="og:title" content="x">',)], "html string")).collect()[0]
    assert row.plugin_og == 5.0 and plugins.names() == ["og"] and plugins.load_entry_points() == []
    plugins.clear()


def test_watch_stream_over_two_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "url string, ts timestamp, score double"
    source, out = tmp_path / "in", tmp_path / "out"

    def run():
        found = watch.regressions(spark.readStream.schema(schema).parquet(str(source)))
        found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.url, r.previous, r.current) for r in spark.read.schema(found.schema).parquet(str(out)).collect())

    spark.createDataFrame([("u", t, 80.0), ("u", t + dt.timedelta(1), 74.0), ("v", t, 50.0), ("v", None, 1.0), ("w", t, None)], schema).write.parquet(str(source))
    assert run() == [("u", 80.0, 74.0)]
    spark.createDataFrame([("u", t + dt.timedelta(2), 60.0), ("u", t - dt.timedelta(9), 1.0), ("v", t + dt.timedelta(1), 45.0)], schema).write.mode("append").parquet(str(source))
    assert run() == [("u", 74.0, 60.0), ("u", 80.0, 74.0)]


def test_windowed_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("u", t, 1.0), ("u", t + dt.timedelta(hours=1), 3.0), ("u", t + dt.timedelta(days=2), 5.0)], "url string, ts timestamp, score double").write.parquet(str(tmp_path / "in"))
    stream = watch.windowed_scores(spark.readStream.schema("url string, ts timestamp, score double").parquet(str(tmp_path / "in")), "ts", "score", ["url"])
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.avg_score) for r in spark.table("w").collect()) == [(1, 5.0), (2, 2.0)]
