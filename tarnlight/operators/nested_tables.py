"""Deeply nested JSON records as flat tables that keep parent-child links.

A depth-first walk gives every node an interval (pre-order number, post-order number): a node
contains another iff its interval encloses the other's. Node tables per type are selections of
one node relation and are joined by containment or, for direct children, by parent_pre.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.runtime import spread, unambiguous

NODE_SCHEMA = (
    "origin string, record_id bigint, path string, name string, kind string, depth int, "
    "pre int, post int, parent_pre int, value string"
)
#: Characters of paths that one batch holds.
FLUSH = 16_000_000
PATH_SCHEMA = "record_id bigint, path string, pre int, post int"


def _no_constant(text: str):
    raise ValueError(text)


_decode = json.JSONDecoder(parse_constant=_no_constant, strict=False).decode


def parse_record(text: str | None):
    """The record in a text, or None.

    White space and byte order marks around it do not matter; a JSON string that holds a record, at
    whatever remove, counts as that record. Text that is no complete JSON, a bare scalar, NaN and
    Infinity give None. Nesting may be of any depth.
    """
    while text is not None:
        text = text.strip(" \t\r\n\f\v ﻿")
        try:
            value = _decode(text)
        except RecursionError:
            value = _decode_deep(text)
        except ValueError:
            return None
        if not isinstance(value, str):
            return value if isinstance(value, (dict, list)) else None
        text = value
    return None


_NEXT = re.compile(r'[ \t\r\n]*([{}\[\],:"]|-?[0-9][0-9.eE+-]*|true|false|null|)')


def _decode_deep(text: str):
    """The value of a JSON text, with a stack of its own in place of the interpreter's; None where it is no JSON."""
    top: list = []
    holders: list = [top]
    keys: list = [None]
    at, expects = 0, "value"  # value, item (value or end), key, name (key or end), colon, more (comma or end)
    while True:
        m = _NEXT.match(text, at)
        token, at = m[1], m.end()
        inside = holders[-1]
        if token == "":
            return top[0] if at == len(text) and expects == "more" and len(holders) == 1 else None
        ends = (token == "}" and type(inside) is dict) or (token == "]" and type(inside) is list and len(holders) > 1)
        if ends and expects in ("more", "item", "name"):
            holders.pop()
            keys.pop()
            expects = "more"
        elif expects == "more":
            if token != "," or len(holders) == 1:
                return None
            expects = "key" if type(inside) is dict else "value"
        elif expects == "colon":
            if token != ":":
                return None
            expects = "value"
        elif token in "}],:" or (expects in ("key", "name") and token != '"'):
            return None
        else:
            try:
                if token == '"':
                    value, at = json.decoder.scanstring(text, at, False)
                else:
                    value = {} if token == "{" else [] if token == "[" else _decode(token)
            except ValueError:
                return None
            if expects in ("key", "name"):
                keys[-1], expects = value, "colon"
                continue
            if type(inside) is dict:
                inside[keys[-1]] = value
            else:
                inside.append(value)
            expects = "more"
            if token in "{[":
                holders.append(value)
                keys.append(None)
                expects = "name" if token == "{" else "item"


def walk(root) -> Iterator[tuple]:
    """(path, name, kind, depth, pre, post, parent_pre, value) of every node; the root has pre 0 and path "".

    Pre and post numbers come from one counter, so a node encloses exactly its descendants.
    """
    clock = 1
    open_nodes = [["", None, root, 0, 0, -1, _children(root)]]
    while open_nodes:
        node = open_nodes[-1]
        for name, child in node[6]:
            kids = _children(child)
            path = f"{node[0]}/{name}" if node[0] else str(name)
            if kids is None:
                yield path, str(name), "scalar", node[3] + 1, clock, clock + 1, node[4], _scalar(child)
                clock += 2
                continue
            open_nodes.append([path, str(name), child, node[3] + 1, clock, node[4], kids])
            clock += 1
            break
        else:
            open_nodes.pop()
            path, name, value, depth, pre, parent, _ = node
            yield path, name, "object" if isinstance(value, dict) else "array", depth, pre, clock, parent, None
            clock += 1


def _children(value):
    if isinstance(value, dict):
        return iter(value.items())
    if isinstance(value, list):
        return iter(enumerate(value))
    return None


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def _clean(text: str | None) -> str | None:
    """Lone surrogates, which JSON can escape but UTF-8 cannot hold, become U+FFFD."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def flatten(df: DataFrame, record_id: str, json_col: str, origin: str) -> DataFrame:
    """All nodes of the records in json_col as one relation (NODE_SCHEMA).

    NULL, empty, damaged and scalar texts have no nodes. Repeated records give repeated nodes;
    use distinct_paths, or drop duplicates, where a record may occur twice.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("origin", pa.string()), ("record_id", pa.int64()), ("path", pa.string()), ("name", pa.string()),
            ("kind", pa.string()), ("depth", pa.int32()), ("pre", pa.int32()), ("post", pa.int32()),
            ("parent_pre", pa.int32()), ("value", pa.string()),
        ])
        for batch in batches:
            out: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = parse_record(text)
                if record is None:
                    continue
                for path, name, kind, depth, pre, post, parent, value in walk(record):
                    out.append((origin, rid, _clean(path), _clean(name), kind, depth, pre, post, parent, _clean(value)))
            columns = list(zip(*out)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return unambiguous(df).select(F.col(record_id).cast("long"), F.col(json_col).cast("string")).mapInArrow(nodes, NODE_SCHEMA)


def object_paths(df: DataFrame, record_id: str, json_col: str, origin: str) -> DataFrame:
    """The intervals of the objects below the root only: (origin, record_id, path, pre, post).

    The numbers are those of flatten; the nodes are kept to the ones asked for before they leave the worker.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, pres, posts, size = [], [], [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(pres, pa.int32()), pa.array(posts, pa.int32())], names=["record_id", "path", "pre", "post"])

        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = parse_record(text)
                if record is None:
                    continue
                for path, pre, post in _objects(record):
                    ids.append(rid)
                    found.append(_clean(path))
                    pres.append(pre)
                    posts.append(post)
                    size += len(path)
                    if size > FLUSH:  # paths of deep records are long
                        yield full()
                        ids, found, pres, posts, size = [], [], [], [], 0
        yield full()

    texts = unambiguous(df).select(F.col(record_id).cast("long"), F.col(json_col).cast("string")).filter(F.col(json_col).isNotNull())
    return spread(texts).mapInArrow(paths, PATH_SCHEMA).select(F.lit(origin).alias("origin"), "*")


def _objects(root) -> Iterator[tuple[str, int, int]]:
    """(path, pre, post) of the objects below the root, numbered as by walk; scalars are stepped over."""
    clock = 1
    stack: list = [["", 0, None, iter(root.items() if type(root) is dict else enumerate(root))]]
    while stack:
        top = stack[-1]
        prefix = top[0]
        for name, child in top[3]:
            kind = type(child)
            if kind is dict or kind is list:
                path = f"{prefix}{name}"
                stack.append([path + "/", clock, path if kind is dict else None, iter(child.items() if kind is dict else enumerate(child))])
                clock += 1
                break
            clock += 2
        else:
            stack.pop()
            if top[2] is not None:
                yield top[2], top[1], clock
            clock += 1


def parents(objects: DataFrame) -> DataFrame:
    """objects (origin, record_id, path, pre, post) with parent_path, the nearest object that encloses them.

    Of the enclosing intervals the nearest has the longest path; "" is the root's.
    """
    plain = objects.select("origin", "record_id", "path", "pre", "post").distinct()
    linked = contained(plain, plain).groupBy("origin", "record_id", "path", "pre", "post").agg(F.max_by("ancestor_path", F.length("ancestor_path")).alias("parent_path"))
    return plain.join(linked, ["origin", "record_id", "path", "pre", "post"], "left").withColumn("parent_path", F.coalesce("parent_path", F.lit("")))


def type_name(nodes: DataFrame) -> DataFrame:
    """Adds node_type: the path with list positions replaced by "*", the name of the node's table."""
    return nodes.withColumn("node_type", F.regexp_replace("path", r"(^|/)\d+(?=/|$)", "$1*"))


def node_table(nodes: DataFrame, node_type: str) -> DataFrame:
    """The objects of one type with their scalar fields as map and the link to the parent node.

    Fields are pre-aggregated per node, so no group is larger than one object. Of records that occur
    twice with different values the larger value counts.
    """
    typed = type_name(nodes)
    rows = typed.filter((F.col("kind") == "object") & (F.col("node_type") == node_type))
    single = typed.filter(F.col("kind") == "scalar").groupBy("origin", "record_id", F.col("parent_pre").alias("pre"), "name").agg(F.max("value").alias("value"))
    fields = single.groupBy("origin", "record_id", "pre").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))
    return rows.select("origin", "record_id", "path", "pre", "post", "parent_pre").distinct().join(fields, ["origin", "record_id", "pre"], "left")


def contained(children: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) of the same record, by interval containment."""
    a = ancestors.select("origin", "record_id", F.col("path").alias("ancestor_path"), F.col("pre").alias("_apre"), F.col("post").alias("_apost"))
    return children.join(a, ["origin", "record_id"]).filter((F.col("pre") > F.col("_apre")) & (F.col("post") < F.col("_apost"))).drop("_apre", "_apost")
