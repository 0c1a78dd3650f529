"""Nested records: against plain recursion, damaged texts, depth."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.operators import nested as N


def brute(tree):
    out = []

    def go(node, path):
        if isinstance(node, dict):
            for k, v in node.items():
                at = f"{path}.{k}"
                if k in N.TAGS:
                    if isinstance(v, dict):
                        out.append((k, at, path))
                    elif isinstance(v, list):
                        out.extend((k, f"{at}[{i}]", path) for i, x in enumerate(v) if isinstance(x, dict))
                go(v, at)
        elif isinstance(node, list):
            for i, x in enumerate(node):
                go(x, f"{path}[{i}]")

    go(tree, "$")
    return sorted(out)


trees = st.recursive(st.one_of(st.none(), st.integers(-5, 5), st.text(max_size=3)), lambda s: st.one_of(st.lists(s, max_size=3), st.dictionaries(st.sampled_from(["body", "names", "comparators", "test", "x.y"]), s, max_size=3)), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(trees)
def test_visit_equals_recursion(tree):
    assert sorted(r[:3] for r in N.visit(tree)) == brute(tree)


@settings(max_examples=150, deadline=None)
@given(trees)
def test_deep_parser_equals_json(tree):
    for indent in (None, 1):
        assert N._parse_deep(json.dumps(tree, indent=indent)) == tree


def test_texts():
    ok = '{"body": [{"_type": "If"}, 1, [{"_type": "x"}]]}'
    assert [r[:3] for r in N.visit(N.parse_tree(ok))] == [("body", "$.body[0]", "$")]
    assert N.parse_tree("﻿" + ok) == N.parse_tree(ok) == N.parse_tree(json.dumps(ok)) == N.parse_tree(json.dumps(json.dumps(ok)))
    for bad in (None, "", " ", ok[:-1], ok + "x", "{'a': 1}", '{"a": NaN}', '"{"'):
        assert N.parse_tree(bad) is None


def test_depth_beyond_recursion():
    text = '{"body":[' * 30_000 + "1" + "]}" * 30_000
    tree = N.parse_tree(text)
    n, node = 0, tree
    while isinstance(node, dict):
        n, node = n + 1, node["body"][0]
    assert n == 30_000


def test_tables(spark):
    text = json.dumps({"_type": "Module", "body": [{"_type": "Import", "lineno": 1, "names": [{"_type": "alias", "name": "os", "asname": None}]}, {"_type": "If", "test": {"comparators": {"_type": "Constant", "value": 3}}}]})
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c"), (4, "{", "d"), (1, text, "e")], "ast_id long, ast string, tag string")
    flat = N.flatten_records(df, "ast_id", "ast")
    assert flat.count() == 2 * 4
    names = N.table_of(flat, "names").collect()
    assert {(r["record_id"], r["path"], r["parent_path"], r["name"], r["asname"]) for r in names} == {(1, "$.body[0].names[0]", "$.body[0]", "os", None)}
    comparator = N.table_of(flat, "comparators").collect()[0]
    assert (comparator["path"], comparator["value"]) == ("$.body[1].test.comparators", "3")
    assert N.flatten_records(df.limit(0), "ast_id", "ast").count() == 0


def test_write_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"body": {"_type": "Pass"}}')], "i long, t string")
    N.write_tables(N.flatten_records(df, "i", "t"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("tag = 'body'").count() == 1
