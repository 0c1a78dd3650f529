"""Retail transactions: cleaning steps and per-customer features.

A transaction row has invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id,
country. Every feature is one aggregation per customer (partial sums combine before the shuffle); features of
the same grain share one aggregation instead of being joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.session import cut

#: Descriptions of service rows, the invoice mark of a cancellation.
SERVICE_ROWS = ("Next Day Carriage", "High Resolution Image")
CANCELLED_MARK = "C"
DEDUP_KEYS = ("invoice_no", "stock_code", "description", "customer_id", "quantity")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or KeyError where a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


# ---- cleaning


def drop_missing(tx: DataFrame) -> DataFrame:
    """Rows with a customer and a description."""
    return require(tx, "customer_id", "description").dropna(subset=["customer_id", "description"])


def null_counts(tx: DataFrame) -> DataFrame:
    """(column_name, nulls) of every column, from one pass."""
    counts = tx.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in tx.columns))
    return counts.unpivot([], tx.columns, "column_name", "nulls").select("column_name", F.coalesce("nulls", F.lit(0)).alias("nulls"))


def assert_no_nulls(tx: DataFrame) -> DataFrame:
    """tx, or ValueError where any column still has nulls."""
    if not null_counts(tx).where("nulls > 0").isEmpty():
        raise ValueError("missing values are left")
    return tx


def drop_duplicates(tx: DataFrame, keys: tuple[str, ...] = DEDUP_KEYS) -> DataFrame:
    """The first row (least of the other columns, in order) per key; a plain aggregation, so copies combine before the shuffle."""
    rest = [c for c in ("invoice_date", "unit_price", "country") if c in tx.columns and c not in keys] + [c for c in tx.columns if c not in keys and c not in ("invoice_date", "unit_price", "country")]
    first = tx.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("first"))
    return first.select(*keys, "first.*").select(*tx.columns)


def with_status(tx: DataFrame) -> DataFrame:
    """transaction_status: Cancelled for invoices with the mark, else Completed."""
    require(tx, "invoice_no")
    return tx.withColumn("transaction_status", F.when(F.col("invoice_no").startswith(CANCELLED_MARK), "Cancelled").otherwise("Completed"))


def digits(col) -> F.Column:
    """Number of digits of a code."""
    return F.length(F.regexp_replace(col, "[^0-9]", ""))


def drop_anomalous_codes(tx: DataFrame) -> DataFrame:
    """Rows whose stock code has at least two digits."""
    return tx.where(digits(F.col("stock_code")) > 1)


def anomalous_codes(tx: DataFrame) -> DataFrame:
    """Distinct codes with no or one digit."""
    return tx.select("stock_code").where(digits(F.col("stock_code")) <= 1).distinct()


def drop_service_rows(tx: DataFrame) -> DataFrame:
    """Rows that are no service rows (exact, null kept), the description in capitals afterwards."""
    return tx.where(F.col("description").isNull() | ~F.col("description").isin(*SERVICE_ROWS)).withColumn("description", F.upper("description"))


def positive_price(tx: DataFrame) -> DataFrame:
    """Rows with a price above zero."""
    return tx.where("unit_price > 0")


def clean(tx: DataFrame) -> DataFrame:
    """All cleaning steps in order."""
    return positive_price(drop_service_rows(drop_anomalous_codes(with_status(drop_duplicates(drop_missing(tx))))))


# ---- derived columns


def with_spend(tx: DataFrame) -> DataFrame:
    return tx.withColumn("total_spend", F.col("unit_price") * F.col("quantity"))


def with_calendar(tx: DataFrame) -> DataFrame:
    """day, day_of_week (Monday 0), hour, year, month."""
    at = F.col("invoice_date")
    return tx.withColumns({"day": F.to_date(at), "day_of_week": F.weekday(at), "hour": F.hour(at), "year": F.year(at), "month": F.month(at)})


def encoded_codes(tx: DataFrame) -> DataFrame:
    """Distinct stock codes with their UTF-8 bytes as hex."""
    return tx.select("stock_code").distinct().withColumn("code_hex", F.hex(F.encode("stock_code", "UTF-8")))


# ---- features per customer


def recency(tx: DataFrame) -> DataFrame:
    """days_since_last_purchase: from the customer's last day to the last day of all."""
    last = tx.groupBy("customer_id").agg(F.max(F.to_date("invoice_date")).alias("last_day"))
    end = last.agg(F.max("last_day").alias("end_day"))
    return last.join(F.broadcast(end)).select("customer_id", F.datediff("end_day", "last_day").alias("days_since_last_purchase"))  # one row is broadcast


def rfm(tx: DataFrame) -> DataFrame:
    """Transactions, products, spend, average transaction and distinct products. Cancelled rows count. Rows are added up per invoice first, and codes made distinct, so no row is repeated for a distinct count."""
    invoices = tx.groupBy("customer_id", "invoice_no").agg(F.sum("quantity").alias("quantity"), F.sum(F.col("unit_price") * F.col("quantity")).alias("spend"))
    sums = invoices.groupBy("customer_id").agg(F.count("invoice_no").alias("total_transactions"), F.sum("quantity").alias("total_products_purchased"), F.round(F.sum("spend"), 4).alias("total_spend"))
    codes = tx.select("customer_id", "stock_code").distinct().groupBy("customer_id").agg(F.count("stock_code").alias("unique_products_purchased"))
    base = sums.join(codes, sums["customer_id"].eqNullSafe(codes["customer_id"])).select(sums["customer_id"], "total_transactions", "total_products_purchased", "total_spend", "unique_products_purchased")
    return base.withColumn("average_transaction_value", F.round(F.try_divide("total_spend", "total_transactions"), 4))


def purchase_gaps(tx: DataFrame) -> DataFrame:
    """average_days_between_purchases over rows in time order; it telescopes to span / (rows - 1). Customers with one row drop out."""
    day = F.to_date("invoice_date")
    span = tx.groupBy("customer_id").agg(F.datediff(F.max(day), F.min(day)).alias("span"), F.count("*").alias("n"))
    return span.where("n > 1").select("customer_id", F.round(F.col("span") / (F.col("n") - 1), 6).alias("average_days_between_purchases"))


def row_gaps(tx: DataFrame) -> DataFrame:
    """The difference in days to the customer's previous row, summed per customer (the window form of the gap)."""
    own = Window.partitionBy("customer_id").orderBy("invoice_date", "invoice_no", "stock_code", "quantity")
    gap = F.datediff(F.to_date("invoice_date"), F.lag(F.to_date("invoice_date")).over(own))
    return tx.select("customer_id", gap.alias("gap")).groupBy("customer_id").agg(F.sum("gap").alias("gap_days"), F.count("gap").alias("gaps"))


def most_frequent(tx: DataFrame, value: F.Column, name: str) -> DataFrame:
    """The value with most rows per customer, the least one on a tie: counts first, then an argmax aggregation without a window."""
    counts = tx.groupBy("customer_id", value.alias(name)).agg(F.count("*").alias("n"))
    return counts.groupBy("customer_id").agg(F.min(F.struct((-F.col("n")).alias("rank"), name)).alias("best")).select("customer_id", F.col(f"best.{name}").alias(name))


def favourite_times(tx: DataFrame) -> DataFrame:
    """Favourite weekday and hour."""
    return most_frequent(tx, F.weekday("invoice_date"), "day_of_week").join(most_frequent(tx, F.hour("invoice_date"), "hour"), "customer_id")


def main_country(tx: DataFrame, home: str) -> DataFrame:
    """The country of most rows (the least name on a tie) and whether it is ``home``."""
    return most_frequent(tx, F.col("country"), "country").withColumn("is_uk", (F.col("country") == home).cast("int"))


def country_share(tx: DataFrame) -> DataFrame:
    """Share of rows per country."""
    counts = tx.groupBy("country").agg(F.count("*").alias("n"))
    return counts.select("country", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("share"))  # a row per country


def cancellations(tx: DataFrame) -> DataFrame:
    """Distinct cancelled invoices and their share of all distinct invoices, by customer."""
    cancelled = F.when(F.col("transaction_status") == "Cancelled", F.col("invoice_no"))
    base = tx.groupBy("customer_id").agg(F.count_distinct("invoice_no").alias("invoices"), F.count_distinct(cancelled).alias("cancellation_frequency"))
    return base.select("customer_id", "cancellation_frequency", F.round(F.try_divide("cancellation_frequency", "invoices"), 6).alias("cancellation_rate"))


def monthly_spend(tx: DataFrame) -> DataFrame:
    """Spend per customer and month."""
    return tx.groupBy("customer_id", F.year("invoice_date").alias("year"), F.month("invoice_date").alias("month")).agg(F.sum(F.col("unit_price") * F.col("quantity")).alias("spend"))


def seasonality(tx: DataFrame) -> DataFrame:
    """Mean and sample deviation of the monthly spend and its least-squares slope over the month's position; single months give 0."""
    month = monthly_spend(tx).withColumn("position", F.row_number().over(Window.partitionBy("customer_id").orderBy("year", "month")) - 1)
    grouped = month.groupBy("customer_id").agg(F.avg("spend").alias("mean"), F.stddev_samp("spend").alias("sd"), F.regr_slope("spend", "position").alias("slope"), F.count("*").alias("n"))
    single = F.col("n") == 1
    zero = lambda c: F.round(F.when(single, 0.0).otherwise(F.col(c)), 4)
    return grouped.select("customer_id", F.round("mean", 4).alias("monthly_spending_mean"), zero("sd").alias("monthly_spending_std"), zero("slope").alias("spending_trend"))


def customer_totals(tx: DataFrame) -> DataFrame:
    """All features of one grain: rows are added up per invoice first, so distinct invoices are counted as rows and no row is repeated for a distinct count; distinct codes likewise."""
    day = F.to_date("invoice_date")
    invoices = tx.groupBy("customer_id", "invoice_no").agg(
        F.sum("quantity").alias("quantity"), F.sum(F.col("unit_price") * F.col("quantity")).alias("spend"), F.max((F.col("transaction_status") == "Cancelled").cast("int")).alias("cancelled"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n")
    )
    codes = tx.groupBy("customer_id", "stock_code").agg(F.lit(1).alias("one")).groupBy("customer_id").agg(F.count("stock_code").alias("unique_products_purchased"))
    base = invoices.groupBy("customer_id").agg(
        F.count("invoice_no").alias("total_transactions"), F.sum("quantity").alias("total_products_purchased"), F.round(F.sum("spend"), 4).alias("total_spend"),
        F.sum(F.when(F.col("invoice_no").isNotNull(), F.col("cancelled")).otherwise(0)).alias("cancellation_frequency"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("n").alias("n"),
    ).join(codes, "customer_id")
    end = base.agg(F.max("last_day").alias("end_day"))
    return base.join(F.broadcast(end)).select(  # one row is broadcast
        "customer_id", "total_transactions", "total_products_purchased", "total_spend", "unique_products_purchased",
        F.round(F.try_divide("total_spend", "total_transactions"), 4).alias("average_transaction_value"), F.datediff("end_day", "last_day").alias("days_since_last_purchase"),
        F.when(F.col("n") > 1, F.round(F.datediff("last_day", "first_day") / (F.col("n") - 1), 6)).alias("average_days_between_purchases"),
        "cancellation_frequency", F.round(F.try_divide("cancellation_frequency", "total_transactions"), 6).alias("cancellation_rate"),
    )


def favourites(tx: DataFrame, home: str) -> DataFrame:
    """Favourite weekday and hour and whether the main country is ``home``, from one pass: each row votes for all three, votes combine before the shuffle."""
    vote = lambda kind, number, text: F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("number"), text.cast("string").alias("text"))
    votes = F.array(vote("day", F.weekday("invoice_date"), F.lit(None)), vote("hour", F.hour("invoice_date"), F.lit(None)), vote("country", F.lit(None), F.col("country")))
    counts = tx.select("customer_id", F.explode(votes).alias("v")).groupBy("customer_id", "v.kind", "v.number", "v.text").agg(F.count("*").alias("n"))
    best = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("n"), F.col(c))))[c]
    top = counts.groupBy("customer_id").agg(best("day", "number").alias("day_of_week"), best("hour", "number").alias("hour"), best("country", "text").alias("country"))
    return top.select("customer_id", "day_of_week", "hour", (F.col("country") == home).cast("int").alias("is_uk"))


def customer_features(tx: DataFrame, home: str) -> DataFrame:
    """The whole feature frame. Customers with one row drop out, as gaps are joined inner.

    The cleaned rows are written once, so that their joins and their deduplication do not run again for every feature.
    """
    needed = ("customer_id", "invoice_no", "stock_code", "quantity", "unit_price", "invoice_date", "country", "transaction_status")
    tx = cut(tx.select(*needed))
    return (
        customer_totals(tx)
        .where("average_days_between_purchases is not null")
        .join(favourites(tx, home), "customer_id")
        .join(seasonality(tx), "customer_id")
    )
