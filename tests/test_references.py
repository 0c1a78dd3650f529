"""References without a record: against brute force, and the cases of the docstring."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphmill.operators import references as R

T0 = datetime(2024, 1, 1)
day = lambda n: T0 + timedelta(days=n)
PARENT = "k string, b timestamp_ntz, e timestamp_ntz, key string, starts int"
REF = "ref_table string, ref_field string, row_id long, ref_key string, at timestamp_ntz, status string, part int"


def run(spark, refs, parents, **kw):
    p = R.parent_intervals(spark.createDataFrame([(k, b, e, "x", 1) for k, b, e in parents], PARENT), "k", "b", "e")
    r = spark.createDataFrame([("t", "f", i, k, at, "clash", 9) for i, (k, at) in enumerate(refs)], REF)
    return {x["row_id"]: x["status"] for x in R.classify_references(r, p, **kw).collect()}


def brute(refs, parents):
    norm = lambda k: None if k is None else k.replace("\\", "/").strip(" \t\r\n")
    out = {}
    for i, (k, at) in enumerate(refs):
        k = norm(k)
        if not k or at is None:
            continue
        own = [(b, e) for q, b, e in parents if norm(q) == k and b is not None]
        begun = [(b, e) for b, e in own if b <= at]
        out[i] = "valid" if any(e is None or e > at for _, e in begun) else "deleted" if begun else "late" if own else "missing"
    return out


def test_cases(spark):
    refs = [("a", day(5)), ("a", day(1)), ("b", day(5)), ("gone", day(9)), (" a\\x ", day(5)), (None, day(5)), ("", day(5)), ("  ", day(5)), ("a", None), ("a", day(2)), ("A", day(5))]
    parents = [("a", day(2), None), ("a", day(2), None), ("gone", day(1), day(9)), ("a/x", day(1), None), (None, day(1), None), ("b", None, None)]
    want = brute(refs, parents)
    assert want[0] == "valid" and want[1] == "late" and want[3] == "deleted" and want[4] == "valid" and want[9] == "valid" and want[10] == "missing"
    assert run(spark, refs, parents) == want


def test_empty_tables(spark):
    assert run(spark, [], [("a", day(1), None)]) == {}
    assert run(spark, [("a", day(1))], []) == {0: "missing"}


def test_hot_key_is_split(spark):
    refs = [("hot", day(i % 20)) for i in range(3000)] + [("rare", day(3))]
    parents = [("hot", day(5), day(9)), ("hot", day(12), None), ("rare", day(1), None)]
    assert run(spark, refs, parents, hot_share=0.01, salts=4) == brute(refs, parents)
    assert run(spark, refs, parents, hot_share=2.0, salts=2, hot_rows=100) == brute(refs, parents)  # by rows alone


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c\\d", "c/d", "", None]), st.integers(0, 9)), max_size=25), st.lists(st.tuples(st.sampled_from(["a", "b", "c/d", None]), st.integers(0, 9), st.one_of(st.none(), st.integers(0, 12))), max_size=10))
def test_brute_force(spark, refs, parents):
    refs = [(k, day(n)) for k, n in refs]
    parents = [(k, day(b), None if e is None else day(e)) for k, b, e in parents]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_report(spark):
    df = spark.createDataFrame([("t", "f", 1, day(1), "late"), ("t", "f", 2, day(2), "late")], "ref_table string, ref_field string, row_id long, at timestamp_ntz, status string")
    row = R.orphan_report(df).collect()[0]
    assert (row["month"], row["orphans"]) == ("2024-01", 2)


@pytest.mark.parametrize("key,want", [("a\\b", "a/b"), ("\t a \r\n", "a"), ("a b", "a b")])
def test_compared_key(spark, key, want):
    df = spark.createDataFrame([(key,)], "k string")
    assert df.select(R.compared_key(df["k"]).alias("k")).collect()[0]["k"] == want
