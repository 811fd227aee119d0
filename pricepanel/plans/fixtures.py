"""Panels and result tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricepanel.functions.timegrid import floor_to


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_panel(spark: SparkSession, sf_dir: str, node: str = "event_type") -> DataFrame:
    """Mean value per node and quarter hour. Raw rows of a busy node are reduced
    before the shuffle; afterwards a node has at most 96 rows per day."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col(node).cast("string").alias("node"), floor_to("ts", 15).alias("timestamp"))
        .agg(F.round(F.avg("value"), 6).alias("price"))
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("node"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("price"),
        F.col("event_id").alias("seq"),
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices with many duplicates per (timestamp, node)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("node"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("seq"),
    )


def ship_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("node"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("price"),
        # Order and line repeat in the test data; the part makes the position unique.
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("seq"),
    )


def results(spark: SparkSession, sf_dir: str, node: str = "c_mktsegment") -> DataFrame:
    """A results-shaped table: market, node, model, revenue, runtime."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col(node).cast("string").alias("node")
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderstatus").alias("iso"),
        "node",
        F.col("o_orderpriority").alias("model"),
        F.col("o_totalprice").alias("revenue"),
        (F.col("o_orderkey") % 1000 / 8).alias("runtime_seconds"),
    )
