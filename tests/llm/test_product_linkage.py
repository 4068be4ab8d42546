import datetime as dt
import random

from pyspark.sql import functions as F

from tarnlight.llm import product_linkage as P

T = dt.datetime(2025, 1, 1)
SCHEMA = "listing_id long, seller_id long, title string, description string, brand string, specifications map<string,string>, seen_at timestamp_ntz"
BRANDS = [(1, "Acme", ["Zorro"], None), (2, "Tônebum", [], None)]


def row(lid, title, description=None, brand="Acme", specs=None, at=T):
    return lid, 1, title, description, brand, specs or {}, at


def groups(spark, rows, brands=True, more="", extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + more)
    ref = spark.createDataFrame(BRANDS, "brand_id long, canonical_brand string, aliases array<string>, home_market string") if brands else None
    out = {}
    for r in P.same_products(df, ref).collect():
        out.setdefault(r.class_id, set()).add(r.listing_id)
    return sorted(map(sorted, out.values()))


def test_codes_in_any_spelling(spark):
    rows = [
        row(1, "kettle | CC 7853 D | red", specs={"Weight": "1.2 kg"}), row(2, "Water kettle Lotinul 31 Rot", specs={"Model": "cc7853-d", "Gewicht": "42.3 oz"}), row(3, "kettle CC/7853D", "Finish: ruby red.", "ZORRO Inc."),
        row(4, "kettle CC7854D red", specs={"Weight": "1.2 kg"}),
    ]
    assert groups(spark, rows) == [[1, 2, 3], [4]]


def test_what_is_no_code():
    for title in ("gift idea 913 fl oz", "pan 200mm", "runs at 1350w", "jug 1100W", "sale 950ML", "60 cm"):
        assert P.code_of({}, title, "") is None, title
    assert P.code_of({}, "WH-1000XM red", "") == "WH1000XM" and P.code_of({"MPN": "ks 2792 l"}, "AB1234C", "") == "KS2792L" and P.code_of({}, "x AB1234C", "Ref: CD-2345-E") == "CD2345E"


def test_listings_without_code_go_by_series_size_and_colour(spark):
    rows = [
        row(1, "Lotinul 31 kettle AB1234C red", specs={"Weight": "1.2 kg"}), row(2, "Lotinul 31 kettle AB1235C blue", specs={"Weight": "1.2 kg"}), row(3, "Lotinul 31 kettle AB1236C red", specs={"Weight": "2.4 kg"}),
        row(4, "merah kettle - Lotinul 31 - hot sale", specs={"Berat": "1200 g"}), row(5, "Lotinul 31 kettle", "Comes in Navy blue. From the Lotinul 31 line.", specs={"Net weight": "2 lb 10 oz"}), row(6, "Lotinul 31 kettle red", specs={"Weight": "85 oz"}),
        row(7, "Lotinul 31 kettle yellow", specs={"Weight": "1.2 kg"}), row(8, "kuning Lotinul 31", specs={"Weight [g]": "1200"}),
    ]
    assert groups(spark, rows) == [[1, 4], [2, 5], [3, 6], [7, 8]]


def test_ambiguous_listings_stay_alone(spark):
    rows = [row(1, "Lotinul 31 AB1234C red"), row(2, "Lotinul 31 AB1235C blue"), row(3, "Lotinul 31 kettle")]
    assert groups(spark, rows) == [[1], [2], [3]]


def test_one_code_of_two_makers(spark):
    rows = [row(1, "Acme Lotinul 31 AB1234C red", specs={"Weight": "1 kg"}), row(2, "Lotinul 31 AB 1234 C red", specs={"Weight": "1 kg"}), row(3, "Somatul 9 AB1234C blue", brand="Tonebum", specs={"Weight": "7 kg"})]
    assert groups(spark, rows) == [[1, 2], [3]]


def test_sightings_nulls_and_ties(spark):
    later = T + dt.timedelta(days=1)
    rows = [row(1, "x AB1234C"), row(1, "x AB1234D", at=later), row(2, "y AB1234D"), row(2, "y AB1234D"), row(3, None, None, None, None), row(4, "", "", "", {}), (None, 1, "x AB1234C", None, None, None, T), (5, None, None, None, None, None, None)]
    assert groups(spark, rows) == [[1, 2], [3], [4], [5]]


def test_hot_product_and_long_texts(spark):
    rng = random.Random(4)
    rows = [row(i, rng.choice(["Lotinul 31", "AB1234C Lotinul 31"]) + " red kettle " + "word " * (20000 if i == 0 else 3), specs={"Weight": rng.choice(["1.2 kg", "1200 g", "42.3 oz"])}) for i in range(400)]
    rows += [row(1000 + i, f"Fogalol {i % 30} CD{1000 + i % 30}E blue kettle", specs={"Weight": "3 kg"}) for i in range(60)]
    got = groups(spark, rows)
    assert list(range(400)) in got and len(got) == 31


def test_without_brand_list_and_with_clashing_columns(spark):
    rows = [row(1, "Lotinul 31 AB1234C red", brand="Nova GmbH"), row(2, "Lotinul 31 red kettle", brand="nova")]
    assert groups(spark, rows, brands=False, more=", TITLE string, code string, class_id int, node string", extra=("q", "c", 1, "n")) == [[1, 2]]


def test_empty_table(spark):
    assert groups(spark, []) == []


def test_pairs_are_all_pairs(spark):
    classes = spark.createDataFrame([(3, "a"), (1, "a"), (2, "a"), (4, "b")], "listing_id long, class_id string")
    assert sorted(map(tuple, P.pairs_of(classes).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_weights_learn_from_known_and_unknown_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        match = i % 3 == 0
        level = lambda m, u: None if rng.random() < 0.3 else int(rng.random() < (m if match else u))
        rows.append((match if i % 10 == 0 else None, level(0.98, 0.8), level(0.97, 0.1), level(0.95, 0.3), level(0.95, 0.3), level(0.95, 0.3), level(0.95, 0.3)))
    w = P.fit_weights(spark.createDataFrame(rows, "known boolean, " + ", ".join(f"is_{f} int" for f in P.FIELDS)).withColumn("times", F.lit(1)))
    assert abs(w["prior"] - 1 / 3) < 0.05 and abs(w["colour"][0] - 0.97) < 0.03 and abs(w["colour"][1] - 0.1) < 0.04 and abs(w["mass"][1] - 0.3) < 0.06


def test_mistyped_code_joins_by_the_other_fields(spark):
    rows, want = [], []
    for i in range(40):  # codes far apart; each product in three listings
        code, colour, mass = f"{'ABCDEFGH'[i % 8]}{'KLMNP'[i % 5]}{1000 + 173 * i}C", ("red", "blue", "green", "white")[i % 4], 1000 + 150 * i
        want.append([10 * i, 10 * i + 1, 10 * i + 2])
        rows += [row(10 * i + k, f"Lotinul {i // 4} kettle {code} {colour}", specs={"Weight": f"{mass} g", "Power": f"{mass} W"}) for k in range(3)]
    rows += [row(3, "Lotinul 0 kettle AK1001C red", specs={"Weight": "1000 g", "Power": "1000 W"}), row(4, "Lotinul 0 kettle AK1010C blue", specs={"Weight": "1000 g"})]
    want[0].append(3)
    assert groups(spark, rows) == sorted([*want, [4]])


def test_one_code_and_series_of_two_makers(spark):
    rows = [row(i, f"Lotinul 31 AB1234C {c}", brand=b, specs={"Weight": w, "Power": p}) for i, (c, b, w, p) in enumerate([("red", "Acme", "1 kg", "100 W"), ("rot", "Acme", "1000 g", "100 W"), ("blue", "Tonebum", "7 kg", "900 W"), ("blau", "Tonebum", "7000 g", "900 W")])]
    assert groups(spark, rows) == [[0, 1], [2, 3]]


def test_every_product_of_a_block_and_incomplete_listings_among_themselves(spark):
    rows = [row(2 * i + k, "Lotinul 31 kettle red", specs={"Weight": f"{1000 * (i + 1)} g" if k == 0 else f"{i + 1} kg", "Power": f"{100 * (i + 1)} W"}) for i in range(8) for k in range(2)]
    rows += [row(100, "Fogalol 7 pan", specs={"Weight": "4.95 kg", "Power": "900 W"}), row(101, "pan Fogalol 7", specs={"Weight": "174.6 oz", "Power": "900 W"})]
    assert groups(spark, rows) == [*([2 * i, 2 * i + 1] for i in range(8)), [100, 101]]


def test_hot_class_in_parts(spark, monkeypatch):
    classes = spark.createDataFrame([(i, "a" if i < 40 else f"c{i // 3}") for i in range(60)], "listing_id long, class_id string")
    whole = sorted(map(tuple, P.pairs_of(classes).collect()))
    monkeypatch.setattr(P, "MEMBERS", 7)
    assert sorted(map(tuple, P.pairs_of(classes).collect())) == whole and len(whole) == len(set(whole)) == 40 * 39 // 2 + 19


def test_long_brand_lists_give_the_same(spark):
    rows = [row(1, "Lotinul 31 kettle AB1234C red"), row(2, "Lotinul 31 red kettle by Zorro", brand=None), row(3, "red Lotinul 31", brand="ACME Inc.")]
    df = spark.createDataFrame(rows, SCHEMA)
    more = [(100 + i, f"Wabe{i:05d}x", [], None) for i in range(21_000)]
    refs = [spark.createDataFrame(b, "brand_id long, canonical_brand string, aliases array<string>, home_market string") for b in (BRANDS, BRANDS + more)]
    got = [sorted(map(tuple, P.attributes(df, r).select("listing_id", "brand").collect())) for r in refs]
    assert got[0] == got[1] == [(1, "1"), (2, "1"), (3, "1")]
