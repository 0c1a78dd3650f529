"""The transaction view over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.sources.tables import load

HOME = "NATION_0"


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as retail transactions, with the gaps, services and cancellations that the cleaning steps look for."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    parts = load(spark, sf, "part").select("p_partkey", "p_name")
    places = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(load(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    part = F.col("l_partkey")
    return rows.select(
        F.concat(F.when(F.col("o_orderstatus") == "P", "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("invoice_no"),
        F.when(part % 37 == 0, "POST").otherwise(F.concat(F.lit("P"), part.cast("string"))).alias("stock_code"),
        F.when(part % 23 == 0, F.lit(None)).when(part % 29 == 0, "Next Day Carriage").when(part % 31 == 0, "High Resolution Image").otherwise(F.col("p_name")).alias("description"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.expr("timestampadd(HOUR, cast(o_orderkey % 24 as int), o_orderdate)").alias("invoice_date"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("customer_id"),
        F.col("n_name").alias("country"),
    )


#: The same view in SQL.
TRANSACTIONS_SQL = """
tx as (select case when o_orderstatus = 'P' then 'C' else '' end || o_orderkey::varchar invoice_no,
  case when l_partkey % 37 = 0 then 'POST' else 'P' || l_partkey::varchar end stock_code,
  case when l_partkey % 23 = 0 then null when l_partkey % 29 = 0 then 'Next Day Carriage' when l_partkey % 31 = 0 then 'High Resolution Image' else p_name end description,
  l_quantity::bigint quantity, o_orderdate + to_hours((o_orderkey % 24)::int) invoice_date,
  case when l_discount = 0 then 0.0 else l_extendedprice / l_quantity end unit_price,
  case when o_orderkey % 17 = 0 then null else o_custkey end customer_id, n_name country
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)
"""
