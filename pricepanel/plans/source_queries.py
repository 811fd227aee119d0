"""Readers and writers, on files and documents that Spark derives from the tables."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pricepanel.operators import dispatch, metrics as mt, panel as op
from pricepanel.plans import fixtures as fx, sql
from pricepanel.plans.metric_queries import _DET, _r
from pricepanel.plans.registry import query
from pricepanel.session import scratch
from pricepanel.sources import reports, results, store

_DELIVERED = """SELECT o_orderkey AS seq, o_orderpriority AS node, o_totalprice AS price,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 4 * 15 AS INTEGER)) AS timestamp
  FROM orders"""


def _delivered(spark, d):
    """Orders as quarter-hour prices with their delivery columns as text."""
    o = fx.table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.to_date("o_orderdate").cast("string").alias("date"),
        (F.col("o_orderkey") % 24 + 1).cast("string").alias("hour"),
        (F.col("o_orderkey") % 4 + 1).cast("string").alias("quarter"),
        F.col("o_orderpriority").alias("node"),
        F.col("o_totalprice").cast("string").alias("price"),
    )


def _write_documents(spark, d) -> str:
    """Report documents of up to 1,000 rows, one per line."""
    path = scratch(spark, "reports")
    fields = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(i).alias("cardinality"))
            for i, n in enumerate(
                ("deliveryDate", "deliveryHour", "deliveryInterval", "settlementPoint", "settlementPointPrice"), 1
            )
        ]
    )
    row = F.array("date", "hour", "quarter", "node", "price")
    docs = (
        _delivered(spark, d)
        .groupBy(F.floor(F.col("seq") / 1000).alias("doc"))
        .agg(F.sort_array(F.collect_list(F.struct("seq", row.alias("row")))).alias("_r"))
        .select(fields.alias("fields"), F.col("_r.row").alias("data"))
    )
    docs.write.json(path)
    return path


@query("a1_report_json", f"""SELECT node, timestamp, price FROM ({_DELIVERED}) WHERE node IN ('1-URGENT', '3-MEDIUM')""")
def a1(spark, d):
    path = _write_documents(spark, d)
    return reports.read_report_json(spark, path, ["1-URGENT", "3-MEDIUM"], one_per_file=False)


@query("a2_concat_reports", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS "deliveryDate", CAST(o_orderkey % 24 + 1 AS VARCHAR) AS "deliveryHour",
       CAST(o_orderkey % 4 + 1 AS VARCHAR) AS "deliveryInterval", o_orderpriority AS "settlementPoint",
       o_totalprice AS price FROM orders""")
def a2(spark, d):
    rows = reports.concat_reports(spark, _write_documents(spark, d), one_per_file=False)
    return rows.withColumn("price", F.col("settlementPointPrice").cast("double")).drop("settlementPointPrice")


@query("a3_zone_csv", f"""WITH {sql.TICKS} SELECT node, time_bucket(INTERVAL '1 minute', timestamp) AS timestamp, price FROM ticks""")
def a3(spark, d):
    path = scratch(spark, "zones")
    t = fx.event_ticks(spark, d)
    t.select(
        F.date_format("timestamp", "MM/dd/yyyy HH:mm").alias("Time Stamp"),
        F.col("node").alias("Name"),
        F.col("seq").alias("PTID"),
        F.col("price").alias("LBMP ($/MWHr)"),
    ).write.option("header", True).csv(path)
    return reports.read_zone_csv(spark, path)


def _archive(pdf: pd.DataFrame) -> pd.DataFrame:
    """Zip up to 1,000 rows as two CSV members and a note."""
    buffer = io.BytesIO()
    half = len(pdf) // 2
    rows = pdf[["Time Stamp", "Name", "LBMP ($/MWHr)"]]
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", rows.iloc[:half].to_csv(index=False))
        z.writestr("b.csv", rows.iloc[half:].to_csv(index=False))
        z.writestr("readme.txt", "not data")
    return pd.DataFrame({"path": [f"{pdf['doc'].iloc[0]}.zip"], "content": [buffer.getvalue()]})


@query("a4_zipped_csv", f"WITH {sql.TICKS} SELECT node, time_bucket(INTERVAL '1 second', timestamp) AS timestamp, price FROM ticks")
def a4(spark, d):
    rows = fx.event_ticks(spark, d).select(
        F.floor(F.col("seq") / 1000).alias("doc"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Time Stamp"),
        F.col("node").alias("Name"),
        F.col("price").alias("LBMP ($/MWHr)"),
    )
    files = rows.groupBy("doc").applyInPandas(_archive, "path string, content binary")
    return reports.unzip_csv(files).select("node", "timestamp", "price")


@query("a5_read_tidy", f"WITH {sql.DAILY} SELECT timestamp, node, price FROM daily")
def a5(spark, d):
    path = scratch(spark, "tidy")
    fx.order_ticks(spark, d).select(
        F.col("timestamp").alias("Time Stamp"), F.col("node").alias("zone"), F.col("price").alias("LBMP ($/MWHr)")
    ).write.option("header", True).csv(path)
    return reports.read_tidy(spark, path)


@query("a6_read_wide", f"""WITH {sql.P}
SELECT t.timestamp, n.node, p.price FROM (SELECT DISTINCT timestamp FROM p) t
CROSS JOIN (SELECT DISTINCT node FROM p) n LEFT JOIN p ON p.timestamp = t.timestamp AND p.node = n.node""")
def a6(spark, d):
    path = scratch(spark, "wide")
    wide = op.to_wide(fx.events_panel(spark, d)).withColumnRenamed("timestamp", "DateTime")
    wide.write.option("header", True).csv(path)
    return reports.read_wide(spark, path)


_MEAN = f"""{sql.DAILY}, m AS (SELECT timestamp, node, round(avg(price), 6) AS price FROM daily GROUP BY 1, 2)"""


def _daily_panel(spark, d):
    return op.dedup_mean(fx.order_ticks(spark, d)).withColumn("price", _r("price"))


@query("a8_load_prices", f"""WITH {_MEAN}
SELECT timestamp, node, price FROM m WHERE node IN ('1-URGENT', '5-LOW') AND price IS NOT NULL
AND timestamp BETWEEN TIMESTAMP '1996-05-01' AND TIMESTAMP '2001-06-30'""")
def a8(spark, d):
    """Tidy years, one wide year and one year of raw documents."""
    root = scratch(spark, "store")
    p = _daily_panel(spark, d)
    year, nodes = F.year("timestamp"), op.node_names(p)
    store.write_tidy(p.filter((year < 1999) | (year > 2000)), root, "ERCOT", store.DAY_AHEAD)
    store.write_wide(p.filter(year == 1999), store.wide_path(root, "ERCOT", store.DAY_AHEAD, 1999), nodes)
    raw = p.filter(year == 2000).select(
        F.array(
            F.struct(F.lit("deliveryDate").alias("name"), F.lit(1).alias("cardinality")),
            F.struct(F.lit("deliveryHour").alias("name"), F.lit(2).alias("cardinality")),
            F.struct(F.lit("settlementPoint").alias("name"), F.lit(3).alias("cardinality")),
            F.struct(F.lit("settlementPointPrice").alias("name"), F.lit(4).alias("cardinality")),
        ).alias("fields"),
        F.array(
            F.array(F.to_date("timestamp").cast("string"), F.lit("1"), "node", F.col("price").cast("string"))
        ).alias("data"),
    )
    raw.write.json(store.raw_path(root, "ERCOT", store.DAY_AHEAD, 2000) + "/json")
    loaded = store.load_prices(
        spark, root, "ERCOT", "1996-05-01", "2001-06-30", ["1-URGENT", "5-LOW"], "1D", native="1D"
    )
    return loaded.filter("price is not null")


@query("a9_write_tidy", f"WITH {_MEAN} SELECT timestamp, node, price, CAST(year(timestamp) AS BIGINT) AS year FROM m")
def a9(spark, d):
    root = scratch(spark, "store")
    store.write_tidy(_daily_panel(spark, d), root, "NYISO", store.DAY_AHEAD)
    back = spark.read.parquet(f"{root}/tidy")
    return back.select("timestamp", "node", "price", F.col("year").cast("bigint").alias("year"))


@query("a10_write_wide", f"WITH {_MEAN} PIVOT m ON node USING avg(price) GROUP BY timestamp")
def a10(spark, d):
    path = scratch(spark, "wide")
    panel = _daily_panel(spark, d)
    store.write_wide(panel, path, op.node_names(panel))
    back = spark.read.option("header", True).csv(path)
    return back.select(
        op.as_timestamp(F.col("timestamp")).alias("timestamp"),
        *[F.col(f"`{n}`").cast("double").alias(n) for n in back.columns if n != "timestamp"],
    )


_BY_NODE = f"""{sql.RES}, {_DET}, n AS (SELECT node, model, avg(revenue) AS revenue, avg(runtime_seconds) AS runtime_seconds
  FROM det GROUP BY 1, 2)"""


@query("a11_read_results", f"""WITH {_BY_NODE}
SELECT iso, node, model, round(revenue, 6) AS revenue, round(runtime_seconds, 6) AS runtime_seconds
FROM n CROSS JOIN (VALUES ('ERCOT'), ('NYISO')) i(iso)""")
def a11(spark, d):
    """Written once per market and read back as both."""
    path = scratch(spark, "results")
    rows = mt.mean_results(mt.mean_results(fx.results(spark, d)).drop("iso"))
    for sub in results.MARKETS:
        results.write_results(rows, f"{path}/{sub}")
    back = results.read_results(spark, path, "BOTH")
    return back.select("iso", "node", "model", _r("revenue").alias("revenue"), _r("runtime_seconds").alias("runtime_seconds"))


@query("a12_write_metrics", f"""WITH {sql.RES_CUST}, {_DET},
nodes AS (SELECT DISTINCT iso, node FROM det), models AS (SELECT DISTINCT model FROM det),
every AS (SELECT nodes.*, model, revenue, runtime_seconds FROM nodes CROSS JOIN models LEFT JOIN det USING (iso, node, model)),
two AS (SELECT iso, node, max(revenue) FILTER (WHERE model = '1-URGENT') AS o, max(revenue) FILTER (WHERE model = '2-HIGH') AS r,
        max(revenue) FILTER (WHERE model = '3-MEDIUM') AS n FROM det GROUP BY 1, 2)
SELECT written, iso, node, item, round(value, 6) AS value FROM (
  SELECT 'detailed_results' AS written, iso, node, model || ' revenue' AS item, revenue AS value FROM det
  UNION ALL SELECT 'detailed_results', iso, node, model || ' runtime_seconds', runtime_seconds FROM det
  UNION ALL SELECT 'revenue_by_node_model', iso, node, model, revenue FROM every
  UNION ALL SELECT 'runtime_by_node_model', iso, node, model, runtime_seconds FROM every
  UNION ALL SELECT 'relative_performance', iso, node, model || '_vs_oracle', revenue / nullif(o, 0) * 100
            FROM every JOIN two USING (iso, node) WHERE model <> '1-URGENT'
  UNION ALL SELECT 'relative_performance', iso, node, 'ridge_vs_naive', (r - n) / nullif(n, 0) * 100 FROM two)""")
def a12(spark, d):
    """All four tables written, read back and put one below the other."""
    path = scratch(spark, "metrics")
    detailed = mt.mean_results(fx.results(spark, d, "c_custkey"))
    written = {
        "detailed_results": detailed,
        "revenue_by_node_model": mt.pivot_models(detailed, "revenue", None),
        "runtime_by_node_model": mt.pivot_models(detailed, "runtime_seconds", None),
        "relative_performance": mt.relative(detailed, None, "1-URGENT", "2-HIGH", "3-MEDIUM"),
    }
    results.write_metrics(written, path)
    parts = []
    for name in written:
        back = spark.read.option("header", True).csv(f"{path}/{name}")
        keys = [c for c in ("iso", "node", "model") if c in back.columns]
        values = [F.col(f"`{c}`").cast("double").alias(c) for c in back.columns if c not in keys]
        tall = back.select(*keys, *values).unpivot(keys, [c for c in back.columns if c not in keys], "of", "value")
        item = F.concat_ws(" ", "model", "of") if "model" in keys else F.col("of")
        parts.append(tall.select(F.lit(name).alias("written"), "iso", "node", item.alias("item"), _r("value").alias("value")))
    return reduce(DataFrame.unionByName, parts)



@query("i14_flatten_results", f"""WITH {_BY_NODE}
SELECT node, model, round(revenue, 6) AS revenue, round(runtime_seconds, 6) AS runtime_seconds,
       CASE WHEN model = '2-HIGH' THEN 'ridge' END AS forecast_model,
       CASE WHEN model = '5-LOW' THEN 10.0::DOUBLE END AS percentile FROM n""")
def i14(spark, d):
    rows = mt.mean_results(mt.mean_results(fx.results(spark, d)).drop("iso"))
    nested = rows.groupBy("node").agg(
        F.collect_list(
            F.struct(
                "model", "revenue", "runtime_seconds",
                F.when(F.col("model") == "2-HIGH", F.lit("ridge")).alias("forecast_model"),
                F.when(F.col("model") == "5-LOW", F.lit(10.0)).alias("percentile"),
            )
        ).alias("results")
    )
    flat = mt.flatten_results(nested)
    return flat.select(
        "node", "model", _r("revenue").alias("revenue"), _r("runtime_seconds").alias("runtime_seconds"),
        "forecast_model", "percentile",
    )


@query("i15_forecaster_table", f"""WITH RECURSIVE {sql.P}, {sql.models()}, {sql.SCEN}, {sql.LEDGER}
SELECT model, round(sum(revenue), 3) AS revenue, round(sum(mwh), 5) AS deployed_mwh
FROM ledger WHERE scenario = 1 GROUP BY 1""")
def i15(spark, d):
    led = dispatch.threshold_dispatch(fx.events_panel(spark, d))
    t = mt.forecaster_table(led)
    return t.select("model", _r("revenue", 3).alias("revenue"), _r("deployed_mwh", 5).alias("deployed_mwh"))
