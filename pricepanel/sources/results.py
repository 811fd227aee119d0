"""Result documents and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricepanel.operators.metrics import flatten_results
from pricepanel.sources.store import _exists

RESULT = (
    "struct<model:string,revenue:double,runtime_seconds:double,forecast_model:string,"
    "horizon:int,percentile:double,window_size:int,dispatch_summary:struct<timestamps:bigint,"
    "mean_price:double,mean_revenue:double,total_mwh_deployed:double>>"
)
# Subfolder and label of each market.
MARKETS = {"ercot": "ERCOT", "nyiso": "NYISO"}


def _nested(spark: SparkSession, path: str) -> DataFrame:
    """(node, results) from a combined document, per-node files, or a table."""
    if _exists(spark, f"{path}/combined_results.json"):
        text = spark.read.text(f"{path}/combined_results.json", wholetext=True)
        parsed = F.from_json("value", f"map<string,array<{RESULT}>>")
        return text.select(F.explode(parsed).alias("node", "results"))
    if _exists(spark, f"{path}/_SUCCESS"):
        rows = spark.read.schema(f"node string, r {RESULT}").json(path)
        return rows.groupBy("node").agg(F.collect_list("r").alias("results"))
    files = spark.read.text(f"{path}/*_results.json", wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_results\.json$", 1)
    return files.select(
        stem.alias("node"), F.from_json("value", f"array<{RESULT}>").alias("results")
    )


def read_results(spark: SparkSession, path: str, iso: str | None = None) -> DataFrame:
    """One row per (node, model), tagged with the market; ``BOTH`` reads the
    subfolder of each market."""
    if iso == "BOTH":
        parts = [
            read_results(spark, f"{path}/{sub}", label)
            for sub, label in MARKETS.items()
            if _exists(spark, f"{path}/{sub}")
        ]
        if not parts:
            raise FileNotFoundError(f"no market folder below {path}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    flat = flatten_results(_nested(spark, path))
    return flat if iso is None else flat.withColumn("iso", F.lit(iso))


def write_results(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Schedule summaries as JSON, one folder per node."""
    have = set(summary.columns)

    def col(name: str, source: str, dtype: str):
        c = F.col(source) if source in have else F.lit(None)
        return c.cast(dtype).alias(name)

    result = F.struct(
        col("model", "model", "string"),
        col("revenue", "revenue", "double"),
        col("runtime_seconds", "runtime_seconds", "double"),
        col("forecast_model", "forecast_model", "string"),
        col("horizon", "horizon", "int"),
        col("percentile", "percentile", "double"),
        col("window_size", "window_size", "int"),
        F.struct(
            col("timestamps", "timestamps", "bigint"),
            col("mean_price", "mean_price", "double"),
            col("mean_revenue", "mean_revenue", "double"),
            col("total_mwh_deployed", "total_mwh", "double"),
        ).alias("dispatch_summary"),
    )
    (
        summary.select("node", result.alias("r"))
        .repartition("node")
        .write.mode(mode)
        .partitionBy("node")
        .json(path)
    )


def write_metrics(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each metric table as a CSV folder of its name."""
    for name, df in tables.items():
        df.write.mode(mode).option("header", True).csv(f"{path}/{name}")
