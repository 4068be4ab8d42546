import datetime as dt
import random

from pyspark.sql import functions as F

from tarnlight.functions import urls
from tarnlight.operators import history_versions as H

SCHEMA = "id long, url string, ts timestamp_ntz, a double, b double, received_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def brute(rows):
    """Versions by a plain walk: {url: [(id, a, b, from, to)]}."""
    last = {}
    for i, url, ts, a, b, rec in rows:
        if None in (url, ts, a, b):
            continue
        key = (url, ts)
        rank = (rec is not None, rec or T0, i is not None, i or 0, a, b)
        if key not in last or rank > last[key][0]:
            last[key] = (rank, i, a, b)
    out = {}
    for (url, ts), (_, i, a, b) in sorted(last.items(), key=lambda x: (x[0][0], x[0][1])):
        runs = out.setdefault(url, [])
        if not runs or (runs[-1][1], runs[-1][2]) != (a, b):
            if runs:
                runs[-1][4] = ts
            runs.append([i, a, b, ts, None])
    return {(u, *r) for u, rs in out.items() for r in rs}


def versions(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    v = H.versions(df, F.col("url"), "ts", {"a": F.col("a"), "b": F.col("b")}, "id", "received_at")
    return {(r.entity, r.id, r.a, r.b, r.valid_from, r.valid_to) for r in v.collect()}, v


def test_equals_a_plain_walk_over_random_rows(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        # One entity holds most rows, so its runs cross words of 32 positions and hours.
        url = rng.choice(["hot"] * 6 + ["u1", "u2", None])
        ts = T0 + dt.timedelta(minutes=rng.randrange(4000)) if rng.random() > 0.02 else None
        rows.append((i, url, ts, rng.choice([1.0, 1.0, 1.0, 2.0, None]), rng.choice([5.0, 5.0, 5.0, 5.0, 6.0]), T0 + dt.timedelta(seconds=rng.randrange(10**6))))
    rows += rows[:200]  # delivered twice
    got, v = versions(spark, rows)
    assert got == brute(rows)
    assert v.filter("is_current <> (valid_to is null)").count() == 0


def test_long_runs_cross_words_without_a_cut(spark):
    rows = [(i, "u", T0 + dt.timedelta(minutes=i), 1.0, 1.0, T0) for i in range(200)] + [(200, "u", T0 + dt.timedelta(minutes=200), 2.0, 1.0, T0)]
    got, _ = versions(spark, rows)
    assert {(g[1], g[5]) for g in got} == {(0, T0 + dt.timedelta(minutes=200)), (200, None)}


def test_a_value_that_returns_opens_a_new_version(spark):
    rows = [(i, "u", T0 + dt.timedelta(hours=i), v, 0.0, T0) for i, v in enumerate([1.0, 2.0, 1.0])]
    assert len(versions(spark, rows)[0]) == 3


def test_ties_in_time_and_receipt_take_the_larger_id(spark):
    rows = [(1, "u", T0, 1.0, 1.0, T0), (2, "u", T0, 9.0, 1.0, T0), (3, "u", T0, 5.0, 1.0, None)]
    assert {g[1] for g in versions(spark, rows)[0]} == {2}


def test_empty_table_and_clashing_columns(spark):
    assert versions(spark, [])[0] == set()
    rows = [(1, "u", T0, 1.0, 1.0, T0, "x", 3, "y")]
    got, _ = versions(spark, rows, SCHEMA + ", _e string, _pos int, URL string")
    assert len(got) == 1


def test_state_at_a_time(spark):
    rows = [(1, "u", T0, 1.0, 1.0, T0), (2, "u", T0 + dt.timedelta(days=2), 2.0, 1.0, T0)]
    _, v = versions(spark, rows)
    at = H.state_at(v, F.lit(T0 + dt.timedelta(days=1)).cast("timestamp_ntz")).collect()
    assert [r.id for r in at] == [1]


def test_entity_key(spark):
    same = ["https://A.test/x", "https://a.test/x/", "https://a.test/x#f", " https://a.TEST/x "]
    other = ["https://a.test/X", "https://a.test/x?q=1"]
    rows = spark.createDataFrame([(u,) for u in same + other], "u string").select(urls.entity_key(F.col("u")).alias("k")).collect()
    keys = [r.k for r in rows]
    assert len(set(keys[:4])) == 1 and len(set(keys)) == 3
