import random

from tarnlight.llm import contamination as C

rng = random.Random(5)


def made(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))


ITEMS = [(i, made(60, i) + " which of these statements fits the passage best") for i in range(8)]


def brute_share(item, doc):
    """Longest common subsequence of the words, over the item's words: an upper bound of what a document takes over."""
    a, b = C.words(item), C.words(doc)
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1] / len(a)


def leaks(spark, docs, items=ITEMS, more="", extra=()):
    d = spark.createDataFrame([(i, t, *extra) for i, t in enumerate(docs)], "doc_id long, text string" + more)
    return C.leaks(d, spark.createDataFrame(items, "item_id long, item_text string"))


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.select("doc_id", "item_id").collect()}


def test_whole_part_markup_case_and_changed_words(spark):
    text = ITEMS[3][1]
    ws = text.split()
    changed = [("zzz" if i % 7 == 3 else w) for i, w in enumerate(ws)]
    docs = [
        text, "Before. " + " ".join(ws[10:40]) + " after.", text.upper().replace(" ", ",\n"), "<p>" + "</p>\n<p>".join([" ".join(ws[:20]), "**" + " ".join(ws[20:40]) + "**", "[" + " ".join(ws[40:]) + "](https://x.test/y)"]),
        " ".join(changed), " ".join(ws[:14]) + " something else stands here " + " ".join(ws[30:44]), " ".join(ws[:8]), " ".join(ws[60:]), " ".join(sorted(ws)), made(70, 99), "", None,
    ]
    got = pairs(leaks(spark, docs))
    assert got == {(i, 3) for i in range(6)}
    for i, d in enumerate(docs):
        if d and (i, 3) in got:
            assert brute_share(text, d) >= 1 / 3


def test_spans_see_through_references_and_invisible_characters():
    text = "A s&#101;cond <b>bold</b> w\u200bord, exam-\nple &amp; [link](http://x.y/z) R&D; end"
    assert [(w, text[a:b]) for w, a, b in C.spans(text)] == [("a", "A"), ("second", "s&#101;cond"), ("bold", "bold"), ("word", "w\u200bord"), ("example", "exam-\nple"), ("link", "link"), ("r", "R"), ("d", "D"), ("end", "end")]


def test_order_of_the_item_counts(spark):
    ws = ITEMS[2][1].split()
    chunks = [ws[i : i + 6] for i in range(0, 60, 6)]
    backwards = " ".join(" ".join(c) for c in reversed(chunks))
    assert pairs(leaks(spark, [backwards])) == set()


def test_shared_wording_starts_nothing(spark):
    shared = "every item of this test ends with the very same long sentence that says nothing about its own names"
    items = [(1, "alpha beta gamma delta " + shared), (2, "one two three four " + shared)]
    assert pairs(leaks(spark, [shared], items)) == set()
    assert pairs(leaks(spark, ["alpha beta gamma delta " + shared], items)) == {(0, 1)}


def test_random_documents_agree_with_brute_force(spark):
    docs, want = [], set()
    for i in range(120):
        parts, taken = [made(rng.randrange(5, 60), 1000 + i)], rng.choice([0, 8, 20, 40, 60])
        item = rng.randrange(8)
        ws = ITEMS[item][1].split()
        at = rng.randrange(0, 61 - taken)
        parts.append(" ".join(ws[at : at + taken]))
        docs.append(" ".join(parts + [made(10, 5000 + i)]))
        if taken >= (len(ws) / 3):
            want.add((i, item))
    assert pairs(leaks(spark, docs)) == want


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs = [t for _, t in ITEMS]
    whole = pairs(leaks(spark, docs))
    monkeypatch.setattr(C, "MAX_NGRAMS", 100)
    frame = spark.createDataFrame(ITEMS, "item_id long, item_text string")
    assert C.item_blocks(frame)[1] > 3 and pairs(leaks(spark, docs)) == whole == {(i, i) for i in range(8)}


def test_wording_shared_over_blocks_starts_nothing(spark, monkeypatch):
    shared = "every item of this test ends with the very same long sentence that says nothing about its own names"
    items = [(i, f"{made(4, 300 + i)} {shared}") for i in range(12)]
    docs = [shared, items[3][1], made(5, 9) + " " + shared]
    whole = pairs(leaks(spark, docs, items))
    monkeypatch.setattr(C, "MAX_NGRAMS", 40)
    assert pairs(leaks(spark, docs, items)) == whole == {(1, 3)}


def test_spans_are_removed(spark):
    docs = ["Keep this start. " + ITEMS[0][1] + " Keep this end. " + made(120, 77), "untouched", ITEMS[1][1], None]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = leaks(spark, docs)
    rows = {r.doc_id: r.text for r in C.remove_spans(d, found).collect()}
    assert set(rows) == {0, 1, 3} and rows[1] == "untouched" and rows[3] is None
    assert rows[0].startswith("Keep this start. ") and "Keep this end." in rows[0] and ITEMS[0][1][:40] not in rows[0]


def test_empty_long_and_clashing(spark):
    assert pairs(leaks(spark, [])) == set() and pairs(leaks(spark, ["x"], [])) == set()
    assert pairs(leaks(spark, [None], [(1, None), (None, "a b c d e f g"), (2, "too short")])) == set()
    long = made(60000, 333) + " " + ITEMS[5][1] + " " + made(60000, 444)
    got = leaks(spark, [long, long], more=", TEXT string, share double, item_id int", extra=("x", 1.0, 9))
    assert pairs(got) == {(0, 5), (1, 5)} and got.count() == 2


def test_changed_words_hide_no_passage(spark):
    ws = made(60, 42).split()
    items = [(99, " ".join(ws)), *ITEMS]
    part = " ".join("zzz" if i in (5, 11, 17) else w for i, w in enumerate(ws[:20]))
    docs = [part, *(" ".join("zzz" if i % n == n - 1 else w for i, w in enumerate(ws)) for n in (3, 4, 5, 6, 7)), " ".join(ws[:15])]
    assert pairs(leaks(spark, docs, items)) == {(i, 99) for i in range(6)}
