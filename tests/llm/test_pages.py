from tarnlight.llm import page_tree as T
from tarnlight.llm import residue as R
from tarnlight.runtime import table

DATA = "/root/testdata/sf0.1"

PROSE = "The older dosage of Tenox is gone; its place went to an inflammation, a clinic and a nurse of the ward."
PAGE = f"""<!doctype html><html><head><title>T</title><script>var q="</p>";</script></head><body><a href="#main">Skip to content</a><nav><a href="/a">Home</a><a href="/b">Pricing</a></nav>
<div class="crumbs">Home / x / T</div><div class="col-2"><h1>T</h1><p>{PROSE}</p><div class="ad-slot">Sponsored</div><ul><li>Whisk</li><li><a href="/z">A linked item</a></li></ul><p><b>{PROSE} Two.<br><p><h2>Sub</h2><table><tr><td>cat</td><td>1</td></tr></table><pre>x = 1
y = 2</pre><p>Short.</p></div>
<div>29 comments</div><aside><h3>You may also like</h3><a href="/q">Other</a></aside><footer><p>© 2024 X. All rights reserved.</p></footer><div class="cookie-bar"><p>This site uses cookies.</p><button>Accept all</button></div></body></html>"""
MARKDOWN = f"""[Skip to content](#main)

- [Home](/a)
- [Pricing](/b)

Home / x / T

# T

{PROSE}

Sponsored
Acme: Nova −47 %

- Whisk
- [A linked item](/z)

{PROSE} Two.

## Sub

| cat | 1 |

```
x = 1
y = 2
```

Short.

29 comments

### You may also like
- [Other](/q)

© 2024 X. All rights reserved.

This site remembers your visit with cookies to count visits and tailor what you see.
Accept all
"""


def kept(html, markdown):
    lines = markdown.split("\n")
    return [lines[n - 1] for n in T.markdown_lines(html, markdown)]


BODY = ["# T", PROSE, "- Whisk", "- [A linked item](/z)", PROSE + " Two.", "## Sub", "| cat | 1 |", "```", "x = 1", "y = 2", "```", "Short."]


def test_body_by_the_tree_of_the_html():
    assert kept(PAGE, MARKDOWN) == BODY


def test_body_by_the_markdown_alone():
    assert kept(None, MARKDOWN) == BODY
    tight = "\n".join(x for x in MARKDOWN.split("\n") if x)
    assert kept("", tight) == BODY


def test_no_markdown_no_lines():
    assert T.markdown_lines(PAGE, None) == T.markdown_lines(PAGE, "") == T.markdown_lines(None, " \n") == []


def test_any_text_gives_a_tree():
    for text in ("", "<", "<p", "</p></div>", "<!-- open", "<script>", "<p>" * 5000, "<div><p>x</div></p>", "<table><td>a<td>b", "\x00<p>é"):
        T.body_nodes(T.parse(text))
    long = "<div>" + f"<p>{PROSE}</p>" * 20000 + "</div>"
    assert len(T.block_texts(T.body_nodes(T.parse(long)))) == 20000


CASES = [
    "{{ title }}", "# #{author}", "Your headline goes here", "[Insert body here]", "<author to be added>", "TODO: write title", "page summary: XXXXX", "Feature 1: description of item 2", "Lorem ipsum dolor sit amet elit sed quis.",
    "Page not found", "Seite nicht gefunden. Der Link ist veraltet.", "502 Bad Gateway", "404", "Please enable JavaScript to continue.", "Veuillez activer JavaScript.", "Loading…", "Test test test", "Dur sost maroth pan rorakil tilax tater dum zanex zobererk nirk",
]
CONTENT = [PROSE, "# The proxy answered 503 Service Unavailable for 9 minutes while Gufakom moved its cache, then traffic returned, and the log of that morning kept every request that failed.", "Whisk", "In the shell, ${HOME} expands to a folder of the user.", "Depuis 9 ans, Voror rassemble des données sur les épices."]


def test_seed_words_name_kinds_of_short_lines_only():
    assert {R.kind_of(x, R.SEEDS) for x in ("Your headline goes here", "TODO: write title", "page summary: XXXXX")} == {"prompt"}
    assert R.kind_of("Page not found", R.SEEDS) == "error" and R.kind_of("Please enable JavaScript", R.SEEDS) == "script" and R.kind_of("Lorem ipsum dolor", R.SEEDS) == "filler"
    assert R.kind_of(PROSE, R.SEEDS) is None and R.kind_of("Page not found " + PROSE * 2, R.SEEDS) is None


def test_slots_inside_ordinary_records():
    assert R.slots("Buy {{ item }} from ${price}, __city__ and %TITLE% or <%= x %>") == ["{{ item }}", "${price}", "__city__", "%TITLE%", "<%= x %>"]
    assert R.slots("100% of 50 % and __init__ing a_b") == [] or R.slots(None) == []


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, html string, markdown string, url string, HTML string, kind string")
    return {r.page_id for r in R.judge_pages(df, **how).collect()}, df


def row(html, markdown, site="s", page=None):
    row.n += 1
    return html, markdown, f"https://{site}.example/{row.n if page is None else page}", "x", "y"


row.n = 0


def test_substitutes_with_and_without_furniture(spark):
    shell = "<body><nav><a href='/'>Home</a></nav><p>{}</p><footer>© 2024 X.</footer></body>"
    rows = [row(shell.format(c.replace("<", "&lt;")), None) for c in CASES] + [row(None, c) for c in CASES]
    got, df = found(spark, rows)
    assert got == set(range(len(rows)))
    assert R.main_bodies(df).count() == 0


def test_content_is_no_case(spark):
    quoting = f"<body><article><h1>Errors</h1><p>{PROSE}</p><p>Page not found</p></article><noscript><p>Please enable JavaScript to use comments.</p></noscript></body>"
    rows = [row(quoting, "# Errors\n\n" + PROSE + "\n\nPage not found"), row(None, "# x\n\n" + PROSE), row("", ""), row(None, None), row(" ", "\n"), row(PAGE, MARKDOWN)]
    got, df = found(spark, rows)
    assert got == set()
    lines = {(r.page_id, r.line_no) for r in R.main_bodies(df).collect()}
    assert {n for p, n in lines if p == 0} == {1, 3, 5} and not any(p in (2, 3, 4) for p, _ in lines)


def wheel(i, site, page=None):
    return row(f"<body><p>Our hamster wheel number {i} is being oiled.</p></body>", None, site, page)


def test_unknown_messages_are_mined(spark):
    full = [row(PAGE, MARKDOWN.replace("T", f"T{i}")) for i in range(3)]
    rows = [wheel(i, f"site{i % 5}") for i in range(20)] + full
    assert found(spark, rows)[0] == set(range(20))
    rows = [wheel(i, "one") for i in range(20)] + full  # all of one site
    assert found(spark, rows)[0] == set(range(20))
    assert found(spark, rows[:1] + full)[0] == set()  # a single page tells nothing
    assert found(spark, [wheel(1, "one", 7), wheel(1, "ONE", "7/"), *full])[0] == set()  # nor does the same page again


def test_messages_are_mined_from_pages_with_a_heading_too(spark):
    full = [row(PAGE.replace("Short.", f"{PROSE} {PROSE} Short {i}."), MARKDOWN) for i in range(9)]
    rows = [row(f"<body><h1>Hamster house {i}</h1><p>The wheel, sadly, is being oiled.</p></body>", None, f"site{i}") for i in range(4)] + full
    assert found(spark, rows)[0] == set(range(4))


def test_verdicts_come_from_the_templates(spark):
    pages = table(spark, DATA, "pages")
    whole, unseeded, untold = (R.judge_pages(pages, **how).count() for how in ({}, {"seeds": {}}, {"templates": []}))
    assert unseeded >= 0.9 * whole and untold < 0.5 * whole


def test_miner_masks_variables():
    miner = R.TemplateMiner()
    for i in range(5):
        miner.add(R.tokens(f"Error {i}: reference ab{i} of mike"))
    miner.add(R.tokens("Error 7: reference cd9 of anna"))
    assert [(t[0], t[1]) for t in miner.templates()] == [(("error", "<*>", ":", "reference", "<*>", "of", "<*>"), 6)]


def test_names_in_front_are_found_from_the_end():
    lines = [f"{n} needs a modern wheel with oil." for n in ("Sitath", "Radirk", "Tukas")]
    back = R.TemplateMiner()
    for x in lines:
        back.add(R.tokens(x)[::-1])
    assert [(t[0][-1], t[1]) for t in back.templates()] == [("<*>", 3)]


def test_empty_table(spark):
    got, df = found(spark, [])
    assert got == set() and R.main_bodies(df).count() == 0


def test_long_lines_and_long_pages_count_whole(spark):
    head = "the hamster, " + "wheel of our own site is being oiled by the men of the day " * 3
    assert len(R.tokens(head)) > 40
    tail = "and from there the road goes on to the lake, the mill and the old town of the north"
    rows = [row(None, head.strip(), f"site{i}") for i in range(6)] + [row(None, f"{head}{tail}", "site9")]
    assert found(spark, rows)[0] == set(range(6))
    line = "Our wheel, it is being oiled."
    filled = [f"Line {i} of the page, {'abcdefg'[i % 7]} tells of the mill and the lake." for i in range(45)]
    rows = [row(None, line, f"site{i}") for i in range(3)] + [row(None, "\n\n".join([f"# Page {i}", line, *filled[i:]]), f"site{i}") for i in range(9)]
    assert found(spark, rows)[0] == set()


def test_slots_of_ordinary_pages_have_their_places(spark):
    rows = [row(f"<body><h1>T</h1><p>{PROSE} Buy {{{{ item }}}} now.</p></body>", f"# T\n\n{PROSE} ${{price}} or %TITLE%"), row(None, None), row(PAGE, MARKDOWN)]
    df = found(spark, rows)[1]
    got = sorted((r.page_id, r.column, r.slot) for r in R.slot_places(df).collect())
    assert got == [(0, "html", "{{ item }}"), (0, "markdown", "${price}"), (0, "markdown", "%TITLE%")]
    assert all(rows[r.page_id][r.column == "markdown"][r.position :].startswith(r.slot) for r in R.slot_places(df).collect())
