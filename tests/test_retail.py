"""Cleaning, features and recommendations on hand-made transactions."""

from datetime import datetime

import pytest

from graphmill.operators import recommend as R
from graphmill.operators import transactions as T

SCHEMA = "invoice_no string, stock_code string, description string, quantity long, invoice_date timestamp_ntz, unit_price double, customer_id long, country string"
at = lambda d, h=10: datetime(2024, 1, d, h)
ROWS = [
    ("1", "A10", "lamp", 2, at(1), 1.5, 7, "UK"),
    ("1", "A10", "lamp", 2, at(1), 1.5, 7, "UK"),
    ("C2", "A11", "box", -1, at(3), 2.0, 7, "UK"),
    ("3", "POST", "postage", 1, at(4), 3.0, 7, "UK"),
    ("4", "B1", "one digit", 1, at(4), 3.0, 7, "UK"),
    ("5", "A12", "Next Day Carriage", 1, at(5), 3.0, 7, "UK"),
    ("6", "A13", "free", 1, at(6), 0.0, 7, "UK"),
    ("7", "A14", None, 1, at(6), 1.0, 7, "UK"),
    ("8", "A15", "cup", 1, at(7), 1.0, None, "UK"),
    ("9", "A16", "cup", 4, at(9, 12), 1.0, 8, "FR"),
    ("10", "A16", "cup", 4, at(9, 11), -1.0, 8, "FR"),
]


@pytest.fixture
def tx(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_clean(tx):
    kept = {(r["invoice_no"], r["transaction_status"], r["description"]) for r in T.clean(tx).collect()}
    assert kept == {("1", "Completed", "LAMP"), ("C2", "Cancelled", "BOX"), ("9", "Completed", "CUP")}
    assert T.clean(tx).count() == 3


def test_missing_and_assert(tx):
    assert T.drop_missing(tx).where("customer_id is null or description is null").isEmpty()
    with pytest.raises(ValueError):
        T.assert_no_nulls(tx)
    T.assert_no_nulls(T.drop_missing(tx))
    with pytest.raises(KeyError):
        T.drop_missing(tx.drop("description"))
    with pytest.raises(KeyError):
        T.with_status(tx.drop("invoice_no"))


def test_features(tx):
    c = T.clean(tx)
    r = {x["customer_id"]: x for x in T.rfm(c).collect()}
    assert r[7]["total_transactions"] == 2 and r[7]["total_products_purchased"] == 1 and r[7]["total_spend"] == 1.0
    assert {x["customer_id"]: x["days_since_last_purchase"] for x in T.recency(c).collect()} == {7: 6, 8: 0}
    assert {x["customer_id"]: x["average_days_between_purchases"] for x in T.purchase_gaps(c).collect()} == {7: 2.0}
    assert {x["customer_id"]: x["cancellation_rate"] for x in T.cancellations(c).collect()} == {7: 0.5, 8: 0.0}
    assert [x["customer_id"] for x in T.customer_features(c, "UK").collect()] == [7]
    season = {x["customer_id"]: x for x in T.seasonality(c).collect()}
    assert season[8]["monthly_spending_std"] == 0 and season[8]["spending_trend"] == 0


def test_tie_goes_to_least_value(spark):
    df = spark.createDataFrame([("1", "A1", "x", 1, at(2, 9), 1.0, 1, "B"), ("2", "A1", "x", 1, at(1, 8), 1.0, 1, "A")], SCHEMA)
    assert T.main_country(df, "A").collect()[0]["country"] == "A"
    assert T.favourite_times(df).collect()[0]["hour"] == 8


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.customer_features(T.clean(empty), "UK").count() == 0


def test_recommendations(spark):
    tx = spark.createDataFrame([("1", f"S{i}", f"d{i}", 10 - i, at(1), 1.0, 1, "UK") for i in range(4)] + [("2", "S0", "d0", 1, at(1), 1.0, 2, "UK"), ("3", "S9", "d9", 99, at(1), 1.0, 9, "UK")], SCHEMA)
    customers = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "customer_id long, cluster int")
    outliers = spark.createDataFrame([(9,)], "customer_id long")
    got = {r["customer_id"]: [r[f"rec{i}_code"] for i in (1, 2, 3)] for r in R.recommendations(tx, outliers, customers).collect()}
    assert got == {1: [None] * 3, 2: ["S1", "S2", "S3"], 3: ["S0", "S1", "S2"], 4: [None] * 3}
