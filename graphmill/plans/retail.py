"""Queries over retail transactions: cleaning and customer features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import transactions as T
from graphmill.sources.retail import HOME, TRANSACTIONS_SQL, transactions


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned transactions."""
    return T.clean(transactions(spark, sf))


def _over(view, step):
    return lambda spark, sf: step(view(spark, sf))


QUERIES = {
    "f1_missing_values": _over(transactions, lambda tx: T.drop_missing(tx).groupBy("country").agg(F.count("*").alias("n_rows"))),
    "f1_null_counts": _over(transactions, T.null_counts),
    "f2_duplicates": _over(transactions, lambda tx: T.drop_duplicates(tx, ("customer_id", "stock_code")).select("customer_id", "stock_code", "invoice_date")),
    "f3_anomalous_codes": _over(transactions, T.anomalous_codes),
    "f3_kept_codes": _over(transactions, lambda tx: T.drop_anomalous_codes(tx).groupBy("stock_code").agg(F.count("*").alias("n_rows"))),
    "f4_service_rows": _over(transactions, lambda tx: T.drop_service_rows(tx).groupBy("description").agg(F.count("*").alias("n_rows"))),
    "f5_positive_price": _over(transactions, lambda tx: T.positive_price(tx).groupBy("country").agg(F.count("*").alias("n_rows"), F.round(F.min("unit_price"), 4).alias("least_price"))),
    "f6_status": _over(transactions, lambda tx: T.with_status(tx).where("transaction_status = 'Cancelled'").groupBy("customer_id").agg(F.count("*").alias("n_rows"))),
    "pj1_transaction_status": _over(transactions, lambda tx: T.with_status(tx).groupBy("transaction_status").agg(F.count("*").alias("n_rows"), F.count_distinct("invoice_no").alias("invoices"))),
    "pj3_total_spend": _over(transactions, lambda tx: T.with_spend(tx).groupBy("stock_code").agg(F.round(F.sum("total_spend"), 2).alias("total_spend"))),
    "pj4_calendar": _over(transactions, lambda tx: T.with_calendar(tx).groupBy("year", "month", "day_of_week", "hour").agg(F.count("*").alias("n_rows"), F.min("day").alias("first_day"))),
    "pj7_encoded_codes": _over(transactions, T.encoded_codes),
    "clean_transactions": _over(cleaned, lambda tx: tx.select("invoice_no", "stock_code", "description", "quantity", "customer_id", "transaction_status")),
    "a1_recency": _over(cleaned, T.recency),
    "a2_rfm": _over(cleaned, T.rfm),
    "a6_purchase_gaps": _over(cleaned, T.purchase_gaps),
    "w1_row_gaps": _over(cleaned, T.row_gaps),
    "a7_favourite_times": _over(cleaned, T.favourite_times),
    "a8_main_country": _over(cleaned, lambda tx: T.main_country(tx, HOME)),
    "a9_country_share": _over(cleaned, T.country_share),
    "a10_cancellations": _over(cleaned, T.cancellations),
    "a11_monthly_spend": _over(cleaned, lambda tx: T.monthly_spend(tx).select("customer_id", "year", "month", F.round("spend", 4).alias("spend"))),
    "a12_seasonality": _over(cleaned, T.seasonality),
    "customer_features": _over(cleaned, lambda tx: T.customer_features(tx, HOME)),
}

_CLEAN = f"""{TRANSACTIONS_SQL},
dd as (select *, row_number() over (partition by invoice_no, stock_code, description, customer_id, quantity order by invoice_date, unit_price, country) rn from tx where customer_id is not null and description is not null),
c as (select invoice_no, stock_code, upper(description) description, quantity, invoice_date, unit_price, customer_id, country, case when invoice_no like 'C%' then 'Cancelled' else 'Completed' end transaction_status
  from dd where rn = 1 and length(regexp_replace(stock_code, '[^0-9]', '', 'g')) > 1 and description not in ('Next Day Carriage', 'High Resolution Image') and unit_price > 0)
"""
CLEAN_SQL = _CLEAN
_PARTS = {
    "rfm": "select customer_id, count(distinct invoice_no) total_transactions, sum(quantity)::bigint total_products_purchased, round(sum(unit_price * quantity), 4) total_spend, count(distinct stock_code) unique_products_purchased, round(round(sum(unit_price * quantity), 4) / count(distinct invoice_no), 4) average_transaction_value from c group by 1",
    "recency": "select customer_id, date_diff('day', max(invoice_date)::date, (select max(invoice_date)::date from c)) days_since_last_purchase from c group by 1",
    "gaps": "select customer_id, round(date_diff('day', min(invoice_date)::date, max(invoice_date)::date) / (count(*) - 1), 6) average_days_between_purchases from c group by 1 having count(*) > 1",
    "times": "select d.customer_id, d.v day_of_week, h.v as hour from (select customer_id, v, row_number() over (partition by customer_id order by n desc, v) r from (select customer_id, isodow(invoice_date) - 1 v, count(*) n from c group by 1, 2)) d join (select customer_id, v, row_number() over (partition by customer_id order by n desc, v) r from (select customer_id, hour(invoice_date) v, count(*) n from c group by 1, 2)) h on d.customer_id = h.customer_id and d.r = 1 and h.r = 1",
    "country": f"select customer_id, country, (country = '{HOME}')::int is_uk from (select customer_id, country, row_number() over (partition by customer_id order by count(*) desc, country) r from c group by 1, 2) where r = 1",
    "cancel": "select customer_id, count(distinct case when transaction_status = 'Cancelled' then invoice_no end) cancellation_frequency, round(count(distinct case when transaction_status = 'Cancelled' then invoice_no end) / count(distinct invoice_no), 6) cancellation_rate from c group by 1",
    "season": "select customer_id, round(avg(spend), 4) monthly_spending_mean, round(case when count(*) = 1 then 0 else stddev_samp(spend) end, 4) monthly_spending_std, round(case when count(*) = 1 then 0 else regr_slope(spend, p) end, 4) spending_trend from (select *, row_number() over (partition by customer_id order by y, m) - 1 p from (select customer_id, year(invoice_date) y, month(invoice_date) m, sum(unit_price * quantity) spend from c group by 1, 2, 3)) group by 1",
}
_ALL = lambda body: f"with {TRANSACTIONS_SQL} {body}"
_C = lambda body: f"with {_CLEAN} {body}"

SQL = {
    "f1_missing_values": _ALL("select country, count(*) n_rows from tx where customer_id is not null and description is not null group by 1"),
    "f1_null_counts": _ALL(" union all ".join(f"select '{c}' column_name, count(*) filter ({c} is null) nulls from tx" for c in ("invoice_no", "stock_code", "description", "quantity", "invoice_date", "unit_price", "customer_id", "country"))),
    "f2_duplicates": _ALL("select customer_id, stock_code, min(invoice_date) invoice_date from tx group by 1, 2"),
    "f3_anomalous_codes": _ALL("select distinct stock_code from tx where length(regexp_replace(stock_code, '[^0-9]', '', 'g')) <= 1"),
    "f3_kept_codes": _ALL("select stock_code, count(*) n_rows from tx where length(regexp_replace(stock_code, '[^0-9]', '', 'g')) > 1 group by 1"),
    "f4_service_rows": _ALL("select upper(description) description, count(*) n_rows from tx where description is null or description not in ('Next Day Carriage', 'High Resolution Image') group by 1"),
    "f5_positive_price": _ALL("select country, count(*) n_rows, round(min(unit_price), 4) least_price from tx where unit_price > 0 group by 1"),
    "f6_status": _ALL("select customer_id, count(*) n_rows from tx where invoice_no like 'C%' group by 1"),
    "pj1_transaction_status": _ALL("select case when invoice_no like 'C%' then 'Cancelled' else 'Completed' end transaction_status, count(*) n_rows, count(distinct invoice_no) invoices from tx group by 1"),
    "pj3_total_spend": _ALL("select stock_code, round(sum(unit_price * quantity), 2) total_spend from tx group by 1"),
    "pj4_calendar": _ALL('select year(invoice_date) "year", month(invoice_date) "month", isodow(invoice_date) - 1 day_of_week, hour(invoice_date) "hour", count(*) n_rows, min(invoice_date::date) first_day from tx group by 1, 2, 3, 4'),
    "pj7_encoded_codes": _ALL("select distinct stock_code, hex(encode(stock_code)) code_hex from tx"),
    "clean_transactions": _C("select invoice_no, stock_code, description, quantity, customer_id, transaction_status from c"),
    "a1_recency": _C(_PARTS["recency"]),
    "a2_rfm": _C(_PARTS["rfm"]),
    "a6_purchase_gaps": _C(_PARTS["gaps"]),
    "w1_row_gaps": _C("select customer_id, sum(g)::bigint gap_days, count(g) gaps from (select customer_id, date_diff('day', lag(invoice_date::date) over (partition by customer_id order by invoice_date, invoice_no, stock_code, quantity), invoice_date::date) g from c) group by 1"),
    "a7_favourite_times": _C(_PARTS["times"]),
    "a8_main_country": _C(_PARTS["country"]),
    "a9_country_share": _C("select country, round(count(*) / sum(count(*)) over (), 8) share from c group by 1"),
    "a10_cancellations": _C(_PARTS["cancel"]),
    "a11_monthly_spend": _C('select customer_id, year(invoice_date) "year", month(invoice_date) "month", round(sum(unit_price * quantity), 4) spend from c group by 1, 2, 3'),
    "a12_seasonality": _C(_PARTS["season"]),
    "customer_features": _C(
        "select r.*, days_since_last_purchase, average_days_between_purchases, day_of_week, hour, is_uk, cancellation_frequency, cancellation_rate, monthly_spending_mean, monthly_spending_std, spending_trend"
        f" from ({_PARTS['rfm']}) r join ({_PARTS['recency']}) using (customer_id) join ({_PARTS['gaps']}) using (customer_id) join ({_PARTS['times']}) using (customer_id)"
        f" left join ({_PARTS['country']}) using (customer_id) left join ({_PARTS['cancel']}) using (customer_id) join ({_PARTS['season']}) using (customer_id)"
    ),
}
