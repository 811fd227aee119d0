"""The streaming forms, run to completion over the event file."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.plans import fixtures as fx, sql
from pricepanel.plans.registry import query
from pricepanel.session import scratch
from pricepanel.streaming import ledger

def _ticks(spark, d, end):
    schema = fx.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ticks = raw.select(
        F.col("event_type").alias("node"), F.col("ts").alias("timestamp"), F.col("value").alias("price")
    )
    return ledger.ended_by(ticks, end)


@query("e2_resample_stream", f"WITH {sql.P} SELECT node, timestamp, price FROM p")
def e2_stream(spark, d):
    end = scratch(spark, "end")
    panel = ledger.naive(ledger.panel_stream(_ticks(spark, d, end)))
    out = ledger.run_available(panel, scratch(spark, "panel"), scratch(spark, "state"), end=end)
    return out.withColumn("price", F.round("price", 6))


@query("h10_stream_ledger", f"""WITH RECURSIVE {sql.P}, {sql.models((10,))}, {sql.SCEN}, {sql.LEDGER}
SELECT node, timestamp, price, CAST(signal AS BIGINT) AS signal, round(mwh, 6) AS mwh,
       round(revenue, 10) AS revenue, round(soc, 6) AS soc FROM ledger WHERE scenario = 1""")
def h10(spark, d):
    end = scratch(spark, "end")
    rows = ledger.ledger_stream(_ticks(spark, d, end))
    out = ledger.run_available(rows, scratch(spark, "ledger"), scratch(spark, "state"), end=end)
    return out.select(
        "node", "timestamp", "price", "signal",
        F.round("mwh", 6).alias("mwh"), F.round("revenue", 10).alias("revenue"), F.round("soc", 6).alias("soc"),
    )
