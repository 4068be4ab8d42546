import datetime as dt
import math
import random
from fractions import Fraction

import pytest

from tarnlight.operators import quantities as Q

RATES = [("USD", 1.0, "$"), ("SGD", 0.74, "S$"), ("IDR", 6.4e-05, "Rp"), ("EUR", 1.08, "€"), ("JPY", 0.0067, "¥"), ("THB", 0.0288, "฿")]


@pytest.mark.parametrize(("text", "value"), [
    ("1.345", 1345), ("1,345.50", 1345.5), ("1.345,50", 1345.5), ("1 534,99", 1534.99), ("1 534,99", 1534.99), ("0.750", 0.75), ("12,5", 12.5), ("3 1/2", 3.5), ("3/4", 0.75), ("2.326.000", 2326000), ("7", 7),
])
def test_numbers(text, value):
    assert Q.number(text) == Fraction(str(value))


def test_zero_denominator_is_no_number():
    assert Q.number("1/0") is None


@pytest.mark.parametrize(("key", "value", "want"), [
    ("Weight", "2 lb 6 oz", {"mass": 1077}), ("Berat", "~3 1/2 kg", {"mass": 3500}), ("Gewicht [g]", "1,950", {"mass": 1950}), ("Size in mm", "10000", {"length": 10000}), ("Size", "2'8\"", {"length": 813}),
    ("Length", "52.4-inch", {"length": 1331}), ("Volume", "62.6 fl. oz.", {"volume": 1851}), ("Kapasitas", "20 oz", {"volume": 591}), ("Power", "ca. 1,350 Watt (net)", {"power": 1350}), ("Wattage", "1.7kW", {"power": 1700}),
    ("Info", "1'11\" long, draws 38 w, weighs 7.600 gramm.", {"length": 584, "power": 38, "mass": 7600}), ("Notes", "Holds 30.4 fl. oz..", {"volume": 899}), ("Weight", "580", {}), ("Warranty", "12 months", {}),
    ("Voltage", "110-240V", {}), ("Model", "KS 2792 L", {}), ("Weight", "", {}), ("Weight", None, {}), ("Colour", "3 g", {}), ("Details", "no amounts here", {}),
])
def test_stated_amounts(key, value, want):
    assert {q: Q.nearest(a) for q, a, _ in Q.stated(key, value)} == want


@pytest.mark.parametrize(("price", "currency", "cents"), [
    ("$ 5", None, 500), ("S$5.00", None, 370), ("5,50", "EUR", 594), ("12,000", "JPY", 8040), ("294rb", "IDR", 1882), ("Rp 1.249.000", None, 7994), ("only ฿1,234.50!", "Baht", 3555), ("6990 c", "USD", 6990), ("4290 cents", "usd", 4290),
    ("129K", "Rp", 826), ("5.00", None, None), ("free", "USD", None), ("", "USD", None), (None, "USD", None), ("5.00", "XYZ", None), ("47.99 SGD / piece", None, 3551),
])
def test_prices(price, currency, cents):
    got = Q.Prices(RATES).cents(price, currency)
    assert (None if got is None else Q.nearest(got)) == cents


def products(spark, rows, more=""):
    return spark.createDataFrame(rows, "listing_id long, seen_at timestamp_ntz, price string, currency string, specifications map<string,string>" + more)


def test_latest_sighting_counts_once(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, t, "$1", None, {"Weight": "1 kg"}), (1, t + dt.timedelta(days=1), "$2", None, {"Weight": "2 kg", "Zweites Gewicht": "9 kg"}), (1, t, "$1", None, {"Weight": "1 kg"}), (2, None, None, None, None), (None, t, "$1", None, {})]
    got = Q.stated_amounts(products(spark, rows), spark.createDataFrame(RATES, "currency string, usd_per_unit double, symbol string"))
    assert {tuple(r) for r in got.collect()} == {(1, "price", 200), (1, "mass", 2000)}


def test_empty_and_clashing(spark):
    rates = spark.createDataFrame(RATES, "currency string, usd_per_unit double, symbol string")
    assert Q.stated_amounts(products(spark, []), rates).count() == 0
    rows = [(1, None, "$1", None, {"Weight": "1 kg"}, "x", 2.0)]
    assert Q.stated_amounts(products(spark, rows, ", quantity string, PRICE double"), rates).count() == 2


def test_mixture_finds_the_units(spark):
    """Amounts with their unit taken away: the mixture gives nearly all of them back, or flags them."""
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(1500):
        grams = math.exp(rng.gauss(math.log(1500), 0.45))
        if i % 3:
            rows.append((i, None, None, None, {"Weight": f"{grams:.0f} g"}))
        else:
            unit = rng.choice(["g", "kg"])
            truth[i] = unit
            rows.append((i, None, None, None, {"Weight": f"{grams:.0f}" if unit == "g" else f"{grams / 1000:.2f}"}))
    amounts = Q.extract(products(spark, rows), spark.createDataFrame(RATES, "currency string, usd_per_unit double, symbol string"))
    got = Q.infer_units(amounts, Q.fit_unit_mixture(amounts, {"mass": ("g", "kg")})).collect()
    assert len(got) == len(truth)
    sure = [r for r in got if not r.is_uncertain]
    assert len(sure) > 0.9 * len(got) and sum(r.unit == truth[r.listing_id] for r in sure) >= 0.99 * len(sure)


def rate_table(spark):
    return spark.createDataFrame(RATES, "currency string, usd_per_unit double, symbol string")


def test_mixture_has_every_unit_and_the_weights_of_each_seller(spark):
    """Pounds against kilograms lie too near each other for one set of weights; decilitres and currencies had no component."""
    rng = random.Random(5)
    habits = {1: ("lb", "dl"), 2: ("kg", "ml"), 3: ("pfund", "cl"), 4: ("g", "l")}
    rows, truth = [], {}
    for i in range(1600):
        grams, ml, cents = math.exp(rng.gauss(math.log(2000), 0.5)), math.exp(rng.gauss(math.log(500), 0.3)), rng.uniform(1500, 3000)
        if i % 2:
            rows.append((i, None, f"${cents / 100:.2f}", None, {"Weight": f"{grams:.0f} g", "Volume": f"{ml:.0f} ml"}, None))
        else:
            seller = i // 2 % 4 + 1
            mass, volume = habits[seller]
            typed = f"{grams / float(Q.UNITS['mass'][mass]):.2f}", f"{ml / float(Q.UNITS['volume'][volume]):.2f}"
            rows.append((i, None, f"{cents / 100 / 6.4e-05:.0f}", " ", {"Weight": typed[0], "Volume": typed[1]}, seller))
            truth |= {(i, "mass"): mass, (i, "volume"): volume, (i, "price"): "IDR"}
    rates = rate_table(spark)
    amounts = Q.extract(products(spark, rows, ", seller_id long"), rates)
    got = Q.infer_units(amounts, Q.fit_unit_mixture(amounts, rates=rates)).collect()
    assert len(got) == len(truth) == 2400
    for quantity, share in (("price", 1), ("volume", 0.97)):
        mine = [r for r in got if r.quantity == quantity]
        assert sum(r.unit == truth[r.listing_id, quantity] for r in mine) >= share * len(mine)
    # A Pfund is 500 g, a pound 454 g: told apart by no one for sure, but from kilograms they are.
    mass = [(r, truth[r.listing_id, "mass"]) for r in got if r.quantity == "mass"]
    assert sum((r.unit == want) or {r.unit, want} == {"lb", "pfund"} for r, want in mass) >= 0.97 * len(mass)
    assert {r.unit for r, want in mass if want in ("g", "kg") and not r.is_uncertain} == {"g", "kg"}


def test_fit_sees_exact_amounts_until_nothing_moves(spark):
    """Centre, spread and weights are those of the plain algorithm over single amounts."""
    rng = random.Random(7)
    known = [math.exp(rng.gauss(math.log(700), 0.06)) for _ in range(300)]
    free = [math.exp(rng.gauss(math.log(700), 0.06)) / (453.59237 if i % 3 else 500) for i in range(300)]
    rows = [(i, None, "mass", a, None, True, "Weight", None) for i, a in enumerate(known)] + [(i, None, "mass", a, None, False, "Weight", None) for i, a in enumerate(free)]
    amounts = spark.createDataFrame(rows, "listing_id long, seen_at timestamp_ntz, quantity string, amount double, rounded long, is_stated boolean, source string, seller string")
    shape = Q.fit_unit_mixture(amounts, {"mass": ("lb", "pfund")}).shapes["mass"]
    logs, shift = [math.log(a) for a in known], [math.log(453.59237), math.log(500)]
    mu = sum(logs) / 300
    var, w = (sum((x - mu) ** 2 for x in logs) + 1) / 301, [0.5, 0.5]
    for _ in range(3000):
        posts = []
        for a in free:
            p = [w[u] * math.exp(-((math.log(a) + shift[u] - mu) ** 2) / 2 / var) for u in (0, 1)]
            posts += [(p[u] / sum(p), math.log(a) + shift[u], u) for u in (0, 1)]
        mu = (sum(p * x for p, x, _ in posts) + sum(logs)) / 600
        var = (sum(p * (x - mu) ** 2 for p, x, _ in posts) + sum((x - mu) ** 2 for x in logs) + 1) / 601
        last, w = w, [(sum(p for p, _, v in posts if v == u) + 1) / 302 for u in (0, 1)]
        if abs(last[0] - w[0]) < 1e-9:
            break
    assert (shape.centre, shape.spread, *shape.weights) == pytest.approx((mu, math.sqrt(var), *w), abs=1e-4)


def test_quantity_never_stated_is_uncertain(spark):
    rows = [(i, None, None, None, {"Weight": str(500 + i)}) for i in range(20)] + [(99, None, "12", "XYZ", {"Power": ""})]
    rates = rate_table(spark)
    amounts = Q.extract(products(spark, rows), rates)
    got = Q.infer_units(amounts, Q.fit_unit_mixture(amounts, rates=rates)).collect()
    assert len(got) == 20 and all(r.is_uncertain for r in got)
    assert Q.infer_units(amounts.limit(0), Q.fit_unit_mixture(amounts.limit(0), rates=rates)).count() == 0
