import random

import numpy as np
import pytest

from tarnlight.llm import subjects as S

AREAS = {"law": "court judge statute verdict tenant lease appeal clause", "food": "soup oven butter cheese whisk broth stew cream", "sport": "coach team match goal referee striker pitch trophy"}
FRAME = ["Nobody expected that the {} outruns a {} so early.", "Most guides treat the {} as an old {}.", "In Luno, every {} came with some {}.", "The report lists the {} and the {} of Kima."]
REMARK = ["This page was last checked 9 days ago.", "The site map lists 12 addresses in this section.", "Our crawler log shows 9 visits."]


def sentence(rng, area):
    a, b = rng.sample(AREAS[area].split(), 2)
    return rng.choice(FRAME).format(a, b)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        main, second = rng.sample(sorted(AREAS), 2)
        two = i % 4 == 0
        body = [sentence(rng, main) for _ in range(6)] + [sentence(rng, second) for _ in range(5 if two else i % 2)] + rng.sample(REMARK, 2)
        docs.append((i, f"# {main[:0]}Notes\n\n" + " ".join(body)))
        truth[i] = {main, second} if two else {main}
    return docs, truth


def run(spark, docs, labels, areas=tuple(AREAS), more="", extra=()):
    d = spark.createDataFrame([(*x, *extra) for x in docs], "doc_id long, text string" + more)
    got = S.subject_areas(d, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(a, "") for a in areas], "subject string, scope_note string"))
    out = {}
    for r in got.collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    return out


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    known = [i for i in range(400) if i % 3 == 0]
    labels = [(i, s) for i in known for s in truth[i]] + [(9, s) for s in truth[9]] + [(18, "law"), (999, "law"), (None, "food"), (24, None), (33, "unknown")]
    got = run(spark, docs, labels)
    held = [i for i in truth if i not in known]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.95
    assert all(1 <= len(v) <= 2 for v in got.values()) and set(got) == set(truth)


def test_calibrated_and_ranked(spark):
    docs, truth = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, s) for i in range(80) for s in truth[i]], "doc_id long, subject string")
    areas = spark.createDataFrame([(x,) for x in AREAS], "subject string")
    encoded = S.encode_table(d)
    model, curves = S.train(encoded, labels, areas)
    assert all(0 < -a / curves.slope < 0.45 for a in curves.intercepts)
    rows = S.classify(encoded, model, curves).collect()
    assert all(0 <= r.posterior <= 1 and 0 <= r.share <= 1 for r in rows)
    assert sum(r["rank"] == 1 for r in rows) == 200
    report = S.calibration_report(d, labels, areas).collect()
    assert {r.subject for r in report} == set(AREAS) and all(r.n_held_out > 0 and r.gap < 0.15 for r in report)


def test_nulls_empty_long_and_repeated_texts(spark):
    docs, truth = corpus(120)
    docs += [(1000, None), (1001, ""), (1002, "12 34"), (1003, " ".join(x for _, x in docs[:40]) * 20), (1, docs[1][1])]
    got = run(spark, docs, [(i, s) for i in range(60) for s in truth[i]], more=", TEXT string, subject string, rank int", extra=("x", "y", 1))
    assert all(len(got[k]) >= 1 for k in (1000, 1001, 1002, 1003)) and got[1] == truth[1]


def test_empty_tables(spark):
    docs, truth = corpus(20)
    assert run(spark, [], [(1, "law")]) == {}
    assert run(spark, docs, [], areas=()) == {}
    assert set(run(spark, docs, [])) == set(truth)  # nothing learnt: the first area by name


def test_words_keep_their_slots_and_none_is_left_out(spark):
    docs, _ = corpus(50)
    by = S.Encoder()
    for r in S.encode_table(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        plain = S.sentences(docs[r.doc_id][1])
        assert r.lens == [len(ws) for _, ws in plain]
        assert r.words == [by.first[lang] + by.slot(w) for lang, ws in plain for w in ws]


def test_soft_counts_agree_with_a_walk(spark):
    docs, truth = corpus(60)
    encoded = S.encode_table(spark.createDataFrame(docs, "doc_id long, text string"))
    model = S.Model(sorted(AREAS), np.zeros(0, int), np.zeros((0, 3)), np.zeros(0, int))
    at, counts, holders = S._expected_counts(encoded, model, {})
    want = {}
    for r in encoded.collect():
        for w in set(r.words):
            want[w] = want.get(w, 0) + 1
    assert dict(zip(at.tolist(), holders.tolist())) == want
    assert abs(counts.sum() - sum(len(r.words) for r in encoded.collect())) < 1e-6


def test_too_many_areas_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_AREAS", 2)
    with pytest.raises(ValueError):
        run(spark, corpus(5)[0], [])
