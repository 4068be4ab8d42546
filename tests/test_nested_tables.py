import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.operators import nested_tables as N

JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


def brute(value, path=""):
    """Paths of the objects below the root, by plain recursion."""
    out = []
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, c in items:
        p = f"{path}/{k}" if path else str(k)
        if isinstance(c, dict):
            out.append(p)
        out += brute(c, p)
    return out


@settings(max_examples=200, deadline=None)
@given(JSON.filter(lambda v: isinstance(v, (dict, list))))
def test_paths_and_intervals(value):
    if any("" == k for k in str(value).split()):
        return
    nodes = list(N.walk(value))
    found = [p for p, _, kind, depth, *_ in nodes if kind == "object" and depth]
    plain = sorted(brute(value))
    if "''" not in repr(value):  # an empty key joins nothing at the root
        assert sorted(found) == plain
        assert sorted(p for p, *_ in N._objects(value)) == plain
        assert {(p, pre, post) for p, pre, post in N._objects(value)} == {(n[0], n[4], n[5]) for n in nodes if n[2] == "object" and n[3]}
    spans = {n[4]: n[5] for n in nodes}
    for _, _, _, depth, pre, post, parent, _ in nodes:
        assert pre < post
        if depth:
            assert parent < pre and post < spans[parent]
    assert len(nodes) == len(spans)


def paths(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    return {(r.record_id, r.path) for r in N.object_paths(df, "id", "j", "x").collect()}


def test_forms_of_a_record(spark):
    record = {"a": {"b": [{"c": 1}, 2]}}
    text = json.dumps(record)
    forms = [text, " \n" + text, "﻿" + text, json.dumps(text), json.dumps("﻿ " + text), json.dumps(json.dumps(text)), json.dumps([record])]
    got = paths(spark, forms)
    for i in range(6):
        assert {p for r, p in got if r == i} == {"a", "a/b/0"}
    assert {p for r, p in got if r == 6} == {"0", "0/a", "0/a/b/0"}


def test_no_rows_for_what_is_no_record(spark):
    bad = [None, "", " ", "{", '{"a": {"b": 1}', "3", '"x"', "NaN", '{"a": NaN}', "[", "{}", "[]", '{"a": {}} x', "[" * 100000]
    assert paths(spark, bad) == set()


def test_deep_and_long_records(spark):
    deep = "1"
    for _ in range(900):
        deep = '{"k": ' + deep + "}"
    long = json.dumps({f"k{i}": {"v": "x" * 50} for i in range(5000)})
    got = paths(spark, [deep, long, '{"a": {"\\ud800": {}}}'])
    assert sum(r == 0 for r, _ in got) == 899 and sum(r == 1 for r, _ in got) == 5000 and (2, "a") in got


@settings(max_examples=300, deadline=None)
@given(JSON, st.integers(0, 40), st.sampled_from(["", "}", "]", ",", ":", '"', "x", "1", " "]))
def test_deep_parser_agrees_with_the_plain_one(value, at, more):
    text = json.dumps(value)
    for t in (text, text[:at] + more + text[at:], json.dumps(value, indent=1), text[:at]):
        try:
            want = N._decode(t)
        except ValueError:
            want = None
        assert N._decode_deep(t) == want


def test_records_of_any_depth():
    deep = '{"k":[' * 100_000 + "1" + "]}" * 100_000
    record = N.parse_record(json.dumps(deep))
    for _ in range(99_999):
        record = record["k"][0]
    assert record == {"k": [1]}
    assert N.parse_record(deep + "]") is None
    middle = '{"k":' * 5000 + "{}" + "}" * 5000
    assert sum(1 for _ in N._objects(N.parse_record(middle))) == 5000


def test_parents_by_containment(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [{"c": {"d": {}}}, {}]}}'), (2, '[{"a": {}}]')], "id long, j string")
    got = {(r.record_id, r.path, r.parent_path) for r in N.parents(N.object_paths(df, "id", "j", "x")).collect()}
    assert got == {(1, "a", ""), (1, "a/b/0", "a"), (1, "a/b/0/c", "a/b/0"), (1, "a/b/0/c/d", "a/b/0/c"), (1, "a/b/1", "a"), (2, "0", ""), (2, "0/a", "0")}


def test_tables_link_to_parents(spark):
    rows = [(1, '{"offers": [{"p": "1"}, {"p": "2", "q": {"z": 1}}]}'), (1, '{"offers": [{"p": "1"}, {"p": "2", "q": {"z": 1}}]}'), (None, '{"offers": [{"p": "9"}]}')]
    df = spark.createDataFrame(rows, "id long, j string")
    nodes = N.flatten(df, "id", "j", "x")
    table = N.node_table(nodes, "offers/*")
    assert {(r.path, r.fields["p"]) for r in table.filter("record_id = 1").collect()} == {("offers/0", "1"), ("offers/1", "2")}
    inside = N.contained(N.node_table(nodes, "offers/*/q"), table).select("path", "ancestor_path").distinct().collect()
    assert [(r.path, r.ancestor_path) for r in inside] == [("offers/1/q", "offers/1")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, j string, J string, path string")
    assert N.object_paths(df, "id", "j", "x").count() == 0 and N.flatten(df, "id", "j", "x").count() == 0
