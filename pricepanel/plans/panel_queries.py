"""Columns, filters, duplicates, reshaping and the time grid over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.functions import scalars, timegrid as tg
from pricepanel.operators import dispatch, panel as op
from pricepanel.plans import fixtures as fx, sql
from pricepanel.plans.registry import query
from pricepanel.session import scratch



def _r(c, digits=6):
    return F.round(c, digits)


# --- B: columns and filters ----------------------------------------------------


@query("b1_delivery_to_ts", """
SELECT o_orderkey AS seq,
       CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
         + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 4 * 15 AS INTEGER)) AS timestamp
FROM orders""")
def b1(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        tg.delivery_to_ts(
            F.to_date("o_orderdate").cast("string"),
            F.col("o_orderkey") % 24 + 1,
            F.col("o_orderkey") % 4 + 1,
        ).alias("timestamp"),
    )


@query("b2_ts_to_delivery", """
SELECT event_id AS seq, strftime(ts, '%Y-%m-%d') AS delivery_date, hour(ts) + 1 AS delivery_hour,
       minute(ts) // 15 + 1 AS delivery_interval FROM events""")
def b2(spark, d):
    t = fx.event_ticks(spark, d)
    return t.select("seq", *tg.delivery_columns("timestamp")).select(
        "seq",
        F.col("delivery_date").cast("string").alias("delivery_date"),
        F.col("delivery_hour").cast("bigint").alias("delivery_hour"),
        F.col("delivery_interval").cast("bigint").alias("delivery_interval"),
    )


@query("b3_standard_columns", f"WITH {sql.DAILY} SELECT timestamp, node, price, seq FROM daily")
def b3(spark, d):
    odd = fx.order_ticks(spark, d).withColumnsRenamed(
        {"timestamp": "Time Stamp", "node": "SettlementPoint", "price": "settlementPointPrice"}
    )
    return op.standardise_columns(odd)


@query("b4_filter_nodes", f"""WITH {sql.DAILY}
SELECT timestamp, node, price, seq FROM daily WHERE node IN ('1-URGENT', '5-LOW')""")
def b4(spark, d):
    return op.filter_nodes(fx.order_ticks(spark, d), ["1-URGENT", "5-LOW"])


@query("b5_between", f"""WITH {sql.DAILY} SELECT timestamp, node, price, seq FROM daily
WHERE timestamp BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1997-03-15'""")
def b5(spark, d):
    return op.between(fx.order_ticks(spark, d), "1996-02-01", "1997-03-15")


@query("b6_filter_range", f"""WITH {sql.DAILY} SELECT timestamp, node, price, seq FROM daily
WHERE timestamp >= TIMESTAMP '1996-03-01' AND timestamp < TIMESTAMP '1998-01-01'""")
def b6(spark, d):
    return op.filter_range(fx.order_ticks(spark, d), "1996-03", "1997-12")


@query("b7_filter_week", f"""WITH {sql.TICKS} SELECT node, timestamp, price, seq FROM ticks
WHERE CAST(timestamp AS DATE) < (SELECT CAST(min(timestamp) AS DATE) + 7 FROM ticks)""")
def b7(spark, d):
    return op.filter_week(fx.event_ticks(spark, d))


@query("b8_clean_price", f"""WITH {sql.DAILY}
SELECT node, timestamp, seq, price FROM daily WHERE seq % 7 <> 0""")
def b8(spark, d):
    raw = fx.order_ticks(spark, d).withColumn(
        "price", F.when(F.col("seq") % 7 == 0, F.lit("n/a")).otherwise(F.col("price").cast("string"))
    )
    return op.clean_price(raw).select("node", "timestamp", "seq", "price")


@query("b8_bad_prices", f"""WITH {sql.DAILY}
SELECT node, count(*) AS rows, count(*) FILTER (WHERE seq % 7 = 0) AS bad_rows FROM daily GROUP BY node""")
def b8_count(spark, d):
    raw = fx.order_ticks(spark, d).withColumn(
        "price", F.when(F.col("seq") % 7 == 0, F.lit("n/a")).otherwise(F.col("price").cast("string"))
    )
    return op.count_bad_prices(raw)


@query("b9_first_nodes", f"""WITH {sql.SHIP}
SELECT timestamp, node, price, seq FROM ship WHERE node IN (
  SELECT node FROM (SELECT node, min(seq) AS f FROM ship GROUP BY node) ORDER BY f, node LIMIT 5)""")
def b9(spark, d):
    return op.first_nodes(fx.ship_ticks(spark, d), 5, "seq")


@query("b10_node_series", f"WITH {sql.P} SELECT node, timestamp, price FROM p WHERE node = 'purchase'")
def b10(spark, d):
    return op.node_series(fx.events_panel(spark, d), "purchase")


@query("b10_node_fallback", f"""WITH {sql.DAILY} SELECT node, timestamp, price, seq FROM daily
WHERE node = (SELECT arg_min(node, seq) FROM daily)""")
def b10_fallback(spark, d):
    return op.node_series(fx.order_ticks(spark, d), "no such node", fallback=True, seq="seq")


@query("b11_with_revenue", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, price, (l_quantity - l_discount) * 0.25::DOUBLE AS mwh,
       ((l_quantity - l_discount) * 0.25::DOUBLE) * price AS revenue
FROM (SELECT *, l_extendedprice AS price FROM lineitem)""")
def b11(spark, d):
    rows = fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.col("l_extendedprice").alias("price")
    )
    return dispatch.with_revenue(rows, "l_quantity", "l_discount")


@query("b12_scalars", """
SELECT o_orderkey AS seq, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') AS padded, lower(o_orderpriority) AS low,
       date_trunc('month', o_orderdate)::TIMESTAMP AS month_start,
       CAST(isodow(o_orderdate) - 1 AS BIGINT) AS dow, CAST(month(o_orderdate) - 1 AS BIGINT) AS mon,
       abs(o_totalprice - 100000) AS gap, greatest(o_totalprice, 50000) AS floor_price,
       '$' || CAST(CAST(round_even(o_totalprice / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' AS label
FROM orders""")
def b12(spark, d):
    o = fx.table(spark, d, "orders")
    cal = dict(zip(("hr", "qtr", "dow", "mon"), tg.calendar("o_orderdate")))
    return o.select(
        F.col("o_orderkey").alias("seq"),
        scalars.two_digits(F.col("o_orderkey") % 24).alias("padded"),
        F.lower("o_orderpriority").alias("low"),
        F.to_timestamp_ntz(F.trunc(F.to_date("o_orderdate"), "month").cast("string")).alias("month_start"),
        cal["dow"].cast("bigint").alias("dow"),
        cal["mon"].cast("bigint").alias("mon"),
        F.abs(F.col("o_totalprice") - 100000).alias("gap"),
        F.greatest(F.col("o_totalprice"), F.lit(50000.0)).alias("floor_price"),
        scalars.dollars_k(F.col("o_totalprice")).alias("label"),
    )


@query("a13_node_list", f"""WITH {sql.SHIP}
SELECT node, timestamp, price, seq FROM ship
WHERE node IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 5)""")
def a13(spark, d):
    listed = fx.table(spark, d, "supplier").filter("s_nationkey < 5").select(
        F.col("s_suppkey").cast("string").alias("node")
    )
    return op.with_node_list(fx.ship_ticks(spark, d), listed)


@query("a7_layouts", f"""WITH {sql.P},
w AS (SELECT t.timestamp, n.node FROM (SELECT DISTINCT timestamp FROM p) t CROSS JOIN (SELECT DISTINCT node FROM p) n)
SELECT layout, node, count(*) AS rows, count(price) AS priced, round(sum(price), 6) AS total,
       min(timestamp) AS first_ts, max(timestamp) AS last_ts
FROM (SELECT 'tidy' AS layout, node, timestamp, price FROM p
      UNION ALL SELECT 'zone', node, timestamp, price FROM p
      UNION ALL SELECT 'long', node, timestamp, price FROM p
      UNION ALL SELECT 'wide', w.node, w.timestamp, p.price FROM w LEFT JOIN p USING (node, timestamp))
GROUP BY 1, 2""")
def a7(spark, d):
    p = fx.events_panel(spark, d)
    long_form = p.select(*tg.delivery_columns("timestamp"), "node", "price").select(
        F.col("delivery_date").cast("string").alias("deliveryDate"),
        F.col("delivery_hour").alias("deliveryHour"),
        F.col("delivery_interval").alias("deliveryInterval"),
        F.col("node").alias("settlementPoint"),
        F.col("price").alias("settlementPointPrice"),
    )
    layouts = {
        "tidy": p,
        "zone": p.withColumnRenamed("node", "zone"),
        "long": long_form,
        "wide": op.to_wide(p),
    }
    parts = [
        op.normalise_panel(f).withColumn("layout", F.lit(name)) for name, f in layouts.items()
    ]
    return (
        op.concat(parts)
        .groupBy("layout", "node")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("price").alias("priced"),
            _r(F.sum("price")).alias("total"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        )
    )


# --- C: duplicates, unions, sorts, joins ---------------------------------------


@query("c1_dedup_last", f"""WITH {sql.SHIP} SELECT timestamp, node, price, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY timestamp, node ORDER BY seq DESC) AS k FROM ship) WHERE k = 1""")
def c1(spark, d):
    return op.dedup(fx.ship_ticks(spark, d), "seq", "last")


@query("c2_dedup_first", f"""WITH {sql.SHIP} SELECT timestamp, node, price, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY timestamp, node ORDER BY seq) AS k FROM ship) WHERE k = 1""")
def c2(spark, d):
    return op.dedup(fx.ship_ticks(spark, d), "seq", "first")


@query("c3_dedup_mean", f"""WITH {sql.SHIP}
SELECT timestamp, node, round(avg(price), 6) AS price FROM ship GROUP BY 1, 2""")
def c3(spark, d):
    return op.dedup_mean(fx.ship_ticks(spark, d)).withColumn("price", _r("price"))


@query("c4_duplicate_count", f"""WITH {sql.SHIP}
SELECT node, CAST(sum(c - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE c > 1) AS repeated_keys
FROM (SELECT node, timestamp, count(*) AS c FROM ship GROUP BY 1, 2) GROUP BY node""")
def c4(spark, d):
    return op.duplicate_count(fx.ship_ticks(spark, d))


@query("c5_concat", f"""WITH {sql.DAILY}, {sql.P}
SELECT node, timestamp, price, seq FROM daily UNION ALL SELECT node, timestamp, price, -1 FROM p""")
def c5(spark, d):
    both = op.concat([fx.order_ticks(spark, d), fx.events_panel(spark, d)])
    return both.fillna({"seq": -1})


@query("c6_sorted_panel", f"WITH {sql.P} SELECT node, timestamp, price FROM p ORDER BY timestamp, node")
def c6(spark, d):
    return op.sorted_panel(fx.events_panel(spark, d))


@query("c8_distinct_counts", f"""WITH {sql.SHIP}
SELECT count(DISTINCT node) AS nodes, count(DISTINCT timestamp) AS intervals FROM ship""")
def c8(spark, d):
    return op.distinct_counts(fx.ship_ticks(spark, d))


@query("c8_day_sketches", f"""WITH {sql.SHIP}
SELECT node, year(timestamp) AS year, count(DISTINCT timestamp) AS intervals, TRUE AS near FROM ship GROUP BY 1, 2""")
def c8_sketches(spark, d):
    """Sketches stored day by day, some days twice, merged by year; ``near`` tells that
    the estimate is within three standard errors of the exact count beside it."""
    ticks, path = fx.ship_ticks(spark, d), scratch(spark, "sketches")
    for part in (F.month("timestamp") <= 7, F.month("timestamp") >= 6):
        op.day_sketches(ticks.filter(part)).write.mode("append").parquet(path)
    stored = spark.read.parquet(path).withColumn("year", F.year("day").cast("bigint"))
    merged = op.merged_counts(stored, "node", "year").withColumnRenamed("intervals", "estimate")
    exact = ticks.groupBy("node", F.year("timestamp").cast("bigint").alias("year")).agg(F.countDistinct("timestamp").alias("intervals"))
    error = 3 * 1.04 / 2**6
    near = F.abs(F.col("estimate") - F.col("intervals")) <= error * F.col("intervals")
    return exact.join(merged, ["node", "year"]).select("node", "year", "intervals", near.alias("near"))


# --- D: reshape ----------------------------------------------------------------

# Columns are the nodes that the data have, on both sides.
_WIDE = f"WITH {sql.P} PIVOT p ON node USING avg(price) GROUP BY timestamp"


@query("d1_to_wide", _WIDE)
def d1(spark, d):
    return op.to_wide(fx.events_panel(spark, d))


@query("d2_to_wide_strict", _WIDE)
def d2(spark, d):
    return op.to_wide_strict(fx.events_panel(spark, d))


@query("d3_daily_mean_wide", f"""WITH {sql.DAILY}, by_day AS (SELECT strftime(timestamp, '%Y-%m-%d') AS date, node, price FROM daily)
PIVOT by_day ON node USING round(avg(price), 6) GROUP BY date""")
def d3(spark, d):
    wide = op.daily_mean_wide(fx.order_ticks(spark, d))
    nodes = [c for c in wide.columns if c != "date"]
    return wide.select(F.col("date").cast("string").alias("date"), *[_r(F.col(f"`{n}`")).alias(n) for n in nodes])


@query("d4_wide_to_tidy", f"""WITH {sql.P}
SELECT t.timestamp, n.node, p.price FROM (SELECT DISTINCT timestamp FROM p) t
CROSS JOIN (SELECT DISTINCT node FROM p) n LEFT JOIN p ON p.timestamp = t.timestamp AND p.node = n.node""")
def d4(spark, d):
    return op.wide_to_tidy(op.to_wide(fx.events_panel(spark, d)))


# --- E: time grid --------------------------------------------------------------

_STEP = """
gaps AS (SELECT node, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY node ORDER BY timestamp)) AS us
         FROM {src}),
cnt AS (SELECT node, us, count(*) AS c FROM gaps WHERE us IS NOT NULL GROUP BY 1, 2),
best AS (SELECT node, us, c FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c DESC, us) AS k FROM cnt) WHERE k = 1),
nodes AS (SELECT DISTINCT node FROM {src})
SELECT nodes.node, coalesce(c, 0) AS times,
       CASE WHEN us IS NULL THEN '1D' WHEN us = 60000000 THEN '1min' WHEN us = 300000000 THEN '5min'
            WHEN us = 900000000 THEN '15T' WHEN us = 3600000000 THEN '1H' WHEN us = 86400000000 THEN '1D'
            ELSE CAST(us // 1000000 AS VARCHAR) || 'S' END AS step
FROM nodes LEFT JOIN best USING (node)"""


@query("e1_infer_step", f"WITH {sql.P}, " + _STEP.format(src="p"))
def e1(spark, d):
    return op.infer_step(fx.events_panel(spark, d))


@query("e1_infer_step_ticks", f"WITH {sql.SHIP}, " + _STEP.format(src="ship"))
def e1_ticks(spark, d):
    return op.infer_step(fx.ship_ticks(spark, d))


@query("e2_resample_hourly", """WITH b AS (
  SELECT event_type AS node, time_bucket(INTERVAL '60 minutes', ts) AS timestamp, avg(value) AS price
  FROM events GROUP BY 1, 2),
grid AS (SELECT node, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL '60 minutes')) AS timestamp
         FROM b GROUP BY node)
SELECT node, timestamp, round(price, 6) AS price FROM grid LEFT JOIN b USING (node, timestamp)""")
def e2(spark, d):
    return op.resample(fx.event_ticks(spark, d), 60).select("node", "timestamp", _r("price").alias("price"))


@query("e3_regular_grid", f"WITH {sql.P}, {sql.GRID} SELECT node, timestamp, price FROM g")
def e3(spark, d):
    return op.regular_grid(fx.events_panel(spark, d), 15)


@query("e4_completeness", f"""WITH {sql.SHIP}, y AS (
  SELECT CAST(year(timestamp) AS BIGINT) AS year, count(DISTINCT timestamp) AS intervals FROM ship GROUP BY 1)
SELECT year, intervals, CAST(make_date(year + 1, 1, 1) - make_date(year, 1, 1) AS BIGINT) AS expected,
       round(intervals / (make_date(year + 1, 1, 1) - make_date(year, 1, 1))::DOUBLE, 6) AS ratio FROM y""")
def e4(spark, d):
    c = op.completeness(fx.ship_ticks(spark, d), per_day=1)
    return c.select(F.col("year").cast("bigint").alias("year"), "intervals", "expected", _r("ratio").alias("ratio"))


@query("e5_profile", f"""WITH {sql.P}
SELECT count(*) AS rows, count(DISTINCT node) AS nodes, count(DISTINCT timestamp) AS intervals,
       min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM p""")
def e5(spark, d):
    return op.profile(fx.events_panel(spark, d))


def _folds_sql(k: int, test: str, gap: int) -> str:
    return f"""WITH {sql.P},
num AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY timestamp) AS rn,
        count(*) OVER (PARTITION BY node) AS n FROM p),
par AS (SELECT *, {test} AS t FROM num),
st AS (SELECT *, (n - t - {k - 1} * (t + {gap})) // {k - 1} + t + {gap} AS step FROM par),
f AS (SELECT st.*, i, n - i * step AS test_end FROM st CROSS JOIN range({k}) x(i)),
use AS (SELECT *, test_end - t AS test_start, test_end - t - {gap} AS train_end FROM f WHERE test_end - t - {gap} > 0),
cnt AS (SELECT *, max(i) OVER (PARTITION BY node) + 1 AS usable FROM use)
SELECT node, timestamp, price, rn, usable - i AS fold,
       CASE WHEN rn <= train_end THEN 'train' ELSE 'test' END AS split
FROM cnt WHERE rn <= train_end OR (rn > test_start AND rn <= test_end)"""


@query("e6_folds_share", _folds_sql(3, "CAST(floor(n * 0.2::DOUBLE) AS BIGINT)", 0))
def e6(spark, d):
    f = op.walk_forward_folds(fx.events_panel(spark, d), 3, 0.2, 0)
    return f.withColumn("fold", F.col("fold").cast("bigint"))


@query("e6_folds_gap", _folds_sql(5, "12", 6))
def e6_gap(spark, d):
    f = op.walk_forward_folds(fx.events_panel(spark, d), 5, 12, 6)
    return f.withColumn("fold", F.col("fold").cast("bigint"))
