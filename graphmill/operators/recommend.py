"""Product recommendations from what is bought in a customer's cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.session import cut


def without_customers(tx: DataFrame, outliers: DataFrame) -> DataFrame:
    """Transactions of customers that are no outliers; rows without a customer stay."""
    return tx.join(outliers.select("customer_id").distinct(), "customer_id", "left_anti")


def top_products(tx: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    """The n products of greatest quantity per cluster (stock code, then description, on a tie). A code with two descriptions may rank twice.

    Quantities are added up per product before anything is ranked, so a cluster's window holds products, not rows.
    """
    sold = tx.join(customers.select("customer_id", "cluster"), "customer_id").groupBy("cluster", "stock_code", "description").agg(F.sum("quantity").alias("quantity"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("quantity"), "stock_code", "description"))
    return sold.withColumn("rank", rank).where(F.col("rank") <= n)


def purchases(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Quantity per customer, cluster and product."""
    return tx.join(customers.select("customer_id", "cluster"), "customer_id").groupBy("customer_id", "cluster", "stock_code").agg(F.sum("quantity").alias("quantity"))


def unbought(top: DataFrame, bought: DataFrame, customers: DataFrame) -> DataFrame:
    """Top products of the cluster that a customer has no purchase of, whatever its sign. ``top`` has n rows per cluster."""
    offered = customers.select("customer_id", "cluster").join(top.select("cluster", "stock_code", "description", "rank"), "cluster")
    return offered.join(bought.select("customer_id", "cluster", "stock_code"), ["customer_id", "cluster", "stock_code"], "left_anti")


def recommendations(tx: DataFrame, outliers: DataFrame, customers: DataFrame, top: int = 10, keep: int = 3) -> DataFrame:
    """(customer_id, cluster, rec1_code, rec1_description, ...): the first unbought top products, short lists padded with null."""
    # added up once and written, as both the cluster's and the customer's products come from it
    kept = cut(without_customers(tx, outliers).groupBy("customer_id", "stock_code", "description").agg(F.sum("quantity").alias("quantity")))
    open_ = unbought(top_products(kept, customers, top), purchases(kept, customers), customers)
    # at most ``top`` offers per customer: the first ``keep`` by rank in one aggregation
    listed = open_.groupBy("customer_id", "cluster").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "stock_code", "description"))), 1, keep).alias("recs"))
    wide = customers.select("customer_id", "cluster").join(listed, ["customer_id", "cluster"], "left")
    each = [c for i in range(1, keep + 1) for c in (F.try_element_at("recs", F.lit(i))["stock_code"].alias(f"rec{i}_code"), F.try_element_at("recs", F.lit(i))["description"].alias(f"rec{i}_description"))]
    return wide.select("customer_id", "cluster", *each)
