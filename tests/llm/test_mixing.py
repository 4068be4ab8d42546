import pytest

from tarnlight.llm import mixing as M

TEXT = "The quick brown fox jumps over the lazy dog, twice; naïve façade 1234 — end.\n\n"


def test_rake_meets_sources_and_caps():
    cells = {("a", "en", "x"): 100.0, ("a", "de", "x"): 100.0, ("b", "en", "y"): 50.0, ("b", "de", "x"): 10.0}
    w = M.rake(cells, 200.0, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2})
    assert sum(cells[c] * w[c] for c in w if c[0] == "a") == pytest.approx(100) and sum(cells[c] * w[c] for c in w if c[0] == "b") == pytest.approx(100)
    assert all(w[c] <= (1 if c[0] == "a" else 2) + 1e-9 for c in w)


def test_rake_meets_languages_where_it_can():
    cells = {("a", "en", "x"): 300.0, ("a", "de", "x"): 100.0, ("b", "en", "x"): 100.0, ("b", "de", "x"): 300.0}
    w = M.rake(cells, 200.0, {"a": 0.8, "b": 0.2}, {"a": 1, "b": 1})
    en = sum(cells[c] * w[c] for c in w if c[1] == "en")
    assert en == pytest.approx(100, rel=1e-3)


def test_total_goes_as_far_as_the_scarcest_source():
    total, shares = M.feasible_total({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.4, 4), "c": (0.1, 9)})
    assert shares == pytest.approx({"a": 5 / 9, "b": 4 / 9}) and total == pytest.approx(90)
    assert M.feasible_total({}, {"a": (1.0, 1)}) == (0.0, {})


def docs(spark, rows, more="", extra=()):
    return spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string" + more)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats long")


def test_shares_are_met(spark):
    rows = [(i, TEXT * (1 + i % 7), "en" if i % 3 else "de", ["Web Page", "web-page ", "docs"][i % 3] if i % 10 else "rare") for i in range(1500)]
    sample, report = M.mix(docs(spark, rows), targets(spark, [("web_page", 0.5, 1), ("docs", 0.2, 2), ("rare", 0.2, 4), ("absent", 0.1, 4)]))
    got = {r.source: r for r in report.collect()}
    assert got["web_page"].actual_share == pytest.approx(0.5 / 0.9, abs=0.01) and got["rare"].actual_share == pytest.approx(0.2 / 0.9, abs=0.01) and got["absent"].actual_share == 0
    copies = {r.doc_id: (r.source, r.copies) for r in sample.collect()}
    assert max(n for s, n in copies.values() if s == "web_page") == 1 and max(n for s, n in copies.values() if s == "rare") <= 4
    again = {r.doc_id: (r.source, r.copies) for r in M.mix(docs(spark, rows), targets(spark, [("web_page", 0.5, 1), ("docs", 0.2, 2), ("rare", 0.2, 4), ("absent", 0.1, 4)]))[0].collect()}
    assert again == copies
    assert all(r.gap < 0.02 for r in got.values()) and abs(sum(r.reachable_share for r in got.values()) - 1) < 1e-9
    assert sum(r.mixed_tokens for r in got.values()) == sum(r.n_tokens * r.copies for r in sample.collect())


def test_nulls_empty_texts_and_unknown_sources(spark):
    rows = [(1, None, None, "a"), (2, "", "EN", "a"), (3, TEXT, "en-EN", "a"), (4, TEXT, "en", None), (None, TEXT, "en", "A "), (5, TEXT, "en", "zzz"), (3, TEXT, "en", "a")]
    sample, report = M.mix(docs(spark, rows, ", LANG string, weight double, topic int", ("x", 1.0, 2)), targets(spark, [("a", 1.0, None), (None, 0.5, 1)]))
    assert {r.source: r.n_documents for r in report.collect()} == {"a": 5}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in sample.collect()) == [(False, 3), (False, 3), (True, 0)]


def test_empty_tables(spark):
    for rows, goals in (([], [("a", 1.0, 1)]), ([(1, TEXT, "en", "a")], [])):
        sample, report = M.mix(docs(spark, rows), targets(spark, goals))
        assert sample.count() == 0 and all(r.actual_share == 0 for r in report.collect())


def test_tokens_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [TEXT, "", "日本語 <|endoftext|> x", "a" * 5000, None]
    got = {r.doc_id: r.n_tokens for r in M.count_tokens(docs(spark, [(i, x, "en", "a") for i, x in enumerate(texts)])).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) if x else 0 for i, x in enumerate(texts)}
