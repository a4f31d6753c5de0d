"""The five raw order tables, read from the order star schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespark.sources.star import table

WINDOW = (datetime(1996, 1, 1), datetime(2000, 12, 31, 23, 59, 59))
EXCLUDED = ("P",)
STATE_REGION = {f"NATION_{i}": name for i, name in enumerate(["Norte", "Nordeste", "Sudeste", "Sul"] * 5)}
GROUPS = {
    "Primeira linha": {f"Brand#{i}": f"Marca {i}" for i in range(1, 9)},
    "Segunda linha": {f"Brand#{i}": f"Marca {i}" for i in range(9, 21)},
}


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    nation = table(spark, folder, "nation")
    code = F.col("l_orderkey").cast("string").alias("order_id")
    shipped = F.date_add(F.to_date("o_orderdate"), F.pmod("o_orderkey", F.lit(45)).cast("int")).cast("timestamp_ntz")
    return {
        "orders": orders.select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            shipped.alias("order_delivered_customer_date"),
            F.date_add(F.to_date("o_orderdate"), 20).cast("timestamp_ntz").alias("order_estimated_delivery_date"),
        ),
        "order_items": lines.select(
            code,
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_tax").alias("freight_value"),
        ),
        "customers": table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.col("n_name").alias("customer_state"),
        ),
        "products": table(spark, folder, "part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category_name")
        ),
        "order_reviews": lines.where(F.col("l_returnflag") == "R").select(
            code, (1 + F.pmod(F.col("l_quantity").cast("int"), F.lit(5))).alias("review_score")
        ),
    }


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as deliveries: promised on the order date, delivered on the ship date, scored 1 to 5."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    customers = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("l_linestatus").alias("status"),
        F.col("r_name").alias("region"),
        F.col("o_orderdate").alias("purchased_at"),
        F.col("o_orderdate").alias("estimated_at"),
        F.col("l_shipdate").alias("delivered_at"),
        F.col("l_tax").alias("freight"),
        (1 + F.pmod(F.col("l_quantity").cast("int"), F.lit(5))).alias("review_score"),
    )
