"""Session helpers: task width and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the cluster is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Hash-partition on ``keys`` over the full configured width.

    Used in front of CPU-heavy steps. A partition count that is given explicitly
    is kept by adaptive execution, which would otherwise merge partitions by
    their byte size and leave a small but expensive stage on a few cores. Later
    aggregations and joins on the same keys reuse this exchange.
    """
    return df.repartition(width(df.sparkSession), *keys)


def _shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        # A folder of one machine does for local runs and tests alone.
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pricepanel-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder (nothing is created)."""
    return f"{_shared_dir(spark)}/pricepanel-{uuid.uuid4().hex}/{name}"
