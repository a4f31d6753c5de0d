"""The flat sales table over an order star schema (lineitem, orders, part, customer, nation, region)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas are stated so that opening a table starts no inference job.
TABLES = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

SALES_COLUMNS = [
    "order_id", "date", "category", "region", "product", "units", "unit_price", "revenue", "cost", "profit",
    "customer_id",
]
COST_PCT = 65  # the schema carries no cost: by convention 65% of the list price


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame, per_core: int = 1) -> DataFrame:
    """Deal out the rows of a scan with fewer splits than `per_core` for each core, before costly work on every row.

    A file of one row group is one split, whatever split size the session asks for, so a session setting can't do
    this. A table with enough splits is returned as it is; results are the same either way. Several tasks per core
    make up for unequal cores and keep each of them short.
    """
    parts = per_core * scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= parts else scan.repartition(parts)


def _rounded_pct(cents: Column, pct: Column) -> Column:
    """That many percent of an amount in cents, a half cent rounded up."""
    return F.floor((cents * pct + 50) / F.lit(100))


def _customer_code(key: Column) -> Column:
    """`C00042`; longer keys keep all their digits."""
    digits = key.cast("string")
    return F.concat(F.lit("C"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))


def sales(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Sales rows with only the asked columns, joining only the tables those columns need.

    Inner joins are not removed by the optimizer, so the choice is made here: a query on revenue by
    day reads two tables, not six. Join strategies are left to the optimizer and the actual sizes.
    """
    wanted = list(columns) if columns is not None else SALES_COLUMNS
    need = set(wanted)
    # cents and whole percents as integers: exact, and cheaper than decimals on every row
    price = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    revenue = _rounded_pct(price, 100 - F.rint(F.col("l_discount") * 100).cast("bigint"))
    cost = _rounded_pct(price, F.lit(COST_PCT))
    definitions = {
        "order_id": F.col("l_orderkey").cast("string"),
        "date": F.col("o_orderdate"),
        "category": F.col("p_type"),
        "region": F.col("r_name"),
        "product": F.col("p_name"),
        "units": F.col("l_quantity").cast("bigint"),
        "unit_price": revenue / 100.0 / F.nullif(F.col("l_quantity"), F.lit(0.0)),
        "revenue": revenue / 100.0,
        "cost": cost / 100.0,
        "profit": (revenue - cost) / 100.0,
        "customer_id": F.col("customer_code"),
    }
    rows = table(spark, folder, "lineitem")
    if need & {"date", "customer_id", "region"}:
        orders = table(spark, folder, "orders").withColumn("customer_code", _customer_code(F.col("o_custkey")))
        if "region" in need:  # told per order, so that no line is dealt out by customer
            places = table(spark, folder, "nation").join(
                table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
            )
            customers = table(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if need & {"category", "product"}:
        rows = rows.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*[definitions[name].alias(name) for name in wanted])
