"""Result analytics over a results-shaped table made of orders and customers.

The market is the order status, the node the market segment (or the customer), and
the order priorities stand in for the models.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.operators import metrics as mt
from pricepanel.plans import fixtures as fx, sql
from pricepanel.plans.registry import query

ROLE = dict(oracle="1-URGENT", ridge="2-HIGH", naive="3-MEDIUM")

_DET = """det AS (SELECT iso, node, model, avg(revenue) AS revenue, avg(runtime_seconds) AS runtime_seconds
  FROM res GROUP BY 1, 2, 3)"""
_SEG = f"{sql.RES}, {_DET}"
_CUST = f"{sql.RES_CUST}, {_DET}"
_TWO = """two AS (SELECT iso, node, max(revenue) FILTER (WHERE model = '1-URGENT') AS o,
  max(revenue) FILTER (WHERE model = '2-HIGH') AS r, max(revenue) FILTER (WHERE model = '3-MEDIUM') AS n
  FROM det GROUP BY 1, 2)"""
_VS = """orc AS (SELECT iso, node, revenue AS o FROM det WHERE model = '1-URGENT'),
vs AS (SELECT det.*, o, revenue / nullif(o, 0) * 100 AS pct FROM det JOIN orc USING (iso, node))"""


def _r(c, digits=6):
    return F.round(c, digits)


def _all_rounded(df, keys, digits=6):
    return df.select(*keys, *[_r(F.col(f"`{c}`"), digits).alias(c) for c in df.columns if c not in keys])


def _segments(spark, d):
    return mt.mean_results(fx.results(spark, d))


def _customers(spark, d):
    return mt.mean_results(fx.results(spark, d, "c_custkey"))


@query("i1_model_names", f"""WITH {sql.RES}
SELECT CASE WHEN model = '1-URGENT' THEN 'oracle_lp' WHEN model = '2-HIGH' THEN 'online_mpc_ridge' ELSE model END AS model,
       count(*) AS n FROM res GROUP BY 1""")
def i1(spark, d):
    names = {"1-URGENT": "oracle_lp", "2-HIGH": "online_mpc_ridge"}
    return (
        mt.normalise_models(fx.results(spark, d), names)
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("i2_mean_results", f"""WITH {_SEG}
SELECT iso, node, model, round(revenue, 6) AS revenue, round(runtime_seconds, 6) AS runtime_seconds FROM det""")
def i2(spark, d):
    return _all_rounded(_segments(spark, d), ["iso", "node", "model"])


@query("i2_mean_runtime", f"""WITH {sql.RES}
SELECT model, round(avg(runtime_seconds), 6) AS runtime_seconds FROM res GROUP BY 1""")
def i2_runtime(spark, d):
    return _all_rounded(mt.mean_runtime(fx.results(spark, d)), ["model"])


# Columns of pivots are the models or nodes that the data have, on both sides.


@query("i3_pivot_revenue", f"WITH {_CUST} PIVOT (SELECT iso, node, model, revenue FROM det) ON model USING round(avg(revenue), 6) GROUP BY iso, node")
def i3(spark, d):
    return _all_rounded(mt.pivot_models(_customers(spark, d), "revenue", None), ["iso", "node"])


@query("i3_pivot_runtime", f"""WITH {_CUST}
PIVOT (SELECT iso, node, model, runtime_seconds FROM det) ON model USING round(avg(runtime_seconds), 6) GROUP BY iso, node""")
def i3_runtime(spark, d):
    return _all_rounded(mt.pivot_models(_customers(spark, d), "runtime_seconds", None), ["iso", "node"])


@query("i3_pivot_nodes", f"WITH {sql.RES} PIVOT (SELECT model, node, revenue FROM res) ON node USING round(avg(revenue), 6) GROUP BY model")
def i3_nodes(spark, d):
    return _all_rounded(mt.pivot_nodes(fx.results(spark, d)), ["model"])


@query("c7_join_oracle", f"""WITH {_CUST}, {_VS}
SELECT iso, node, model, round(revenue, 6) AS revenue, round(runtime_seconds, 6) AS runtime_seconds,
       round(o, 6) AS oracle_revenue, round(pct, 6) AS pct_of_oracle FROM vs""")
def c7(spark, d):
    return _all_rounded(mt.vs_oracle(_customers(spark, d), ROLE["oracle"]), ["iso", "node", "model"])


@query("i4_percent_of_oracle", f"""WITH {_CUST}, {_VS}
SELECT * FROM (SELECT DISTINCT iso, node FROM det) LEFT JOIN (
  PIVOT (SELECT iso, node, model || '_vs_oracle' AS m, pct FROM vs WHERE model <> '1-URGENT') ON m USING round(avg(pct), 6) GROUP BY iso, node)
USING (iso, node)""")
def i4(spark, d):
    r = mt.relative(_customers(spark, d), None, ROLE["oracle"], "none", "none")
    return _all_rounded(r, ["iso", "node"])


@query("i5_ridge_vs_naive", f"""WITH {_CUST}, {_TWO}
SELECT iso, node, round((r - n) / nullif(n, 0) * 100, 6) AS ridge_vs_naive FROM two""")
def i5(spark, d):
    r = mt.relative(_customers(spark, d), None, ROLE["oracle"], ROLE["ridge"], ROLE["naive"])
    return r.select("iso", "node", _r("ridge_vs_naive").alias("ridge_vs_naive"))


@query("i6_model_summary", f"""WITH {_CUST}
SELECT coalesce(iso, 'OVERALL') AS iso, model, round(avg(revenue), 4) AS revenue_mean,
       round(stddev_samp(revenue), 4) AS revenue_std, round(avg(runtime_seconds), 6) AS runtime_mean, count(*) AS nodes
FROM det GROUP BY GROUPING SETS ((iso, model), (model))""")
def i6(spark, d):
    s = mt.model_summary(_customers(spark, d))
    return s.select(
        "iso", "model", _r("revenue_mean", 4).alias("revenue_mean"), _r("revenue_std", 4).alias("revenue_std"),
        _r("runtime_mean").alias("runtime_mean"), "nodes",
    )


@query("i7_relative_summary", f"""WITH {_CUST}, {_VS}
SELECT coalesce(iso, 'OVERALL') AS iso, model, round(avg(pct), 6) AS pct_mean, round(stddev_samp(pct), 6) AS pct_std
FROM vs WHERE model <> '1-URGENT' GROUP BY GROUPING SETS ((iso, model), (model))""")
def i7(spark, d):
    return _all_rounded(mt.relative_summary(_customers(spark, d), ROLE["oracle"]), ["iso", "model"])


@query("i8_win_counts", f"""WITH {_CUST}, {_TWO}
SELECT coalesce(iso, 'OVERALL') AS iso, count(*) FILTER (WHERE (r - n) / nullif(n, 0) > 0) AS ridge_wins,
       count(*) AS nodes, round(count(*) FILTER (WHERE (r - n) / nullif(n, 0) > 0) / count(*)::DOUBLE * 100, 6) AS share
FROM two GROUP BY GROUPING SETS ((iso), ())""")
def i8(spark, d):
    w = mt.win_counts(_customers(spark, d), ROLE["ridge"], ROLE["naive"])
    return w.withColumn("share", _r("share"))


@query("i9_market_comparison", f"""WITH {_CUST}, {_TWO}, a AS (SELECT
  avg(o) FILTER (WHERE iso = 'F') AS oracle_first, avg(o) FILTER (WHERE iso = 'O') AS oracle_second,
  avg(r / nullif(o, 0) * 100) FILTER (WHERE iso = 'F') AS ridge_pct_first,
  avg(r / nullif(o, 0) * 100) FILTER (WHERE iso = 'O') AS ridge_pct_second,
  avg((r - n) / nullif(n, 0) * 100) FILTER (WHERE iso = 'F') AS improvement_first,
  avg((r - n) / nullif(n, 0) * 100) FILTER (WHERE iso = 'O') AS improvement_second FROM two)
SELECT round(oracle_first, 4) AS oracle_first, round(oracle_second, 4) AS oracle_second,
  round(ridge_pct_first, 4) AS ridge_pct_first, round(ridge_pct_second, 4) AS ridge_pct_second,
  round(improvement_first, 4) AS improvement_first, round(improvement_second, 4) AS improvement_second,
  round(oracle_second / nullif(oracle_first, 0), 6) AS oracle_ratio FROM a""")
def i9(spark, d):
    m = mt.compare_markets(_customers(spark, d), "F", "O", **ROLE)
    return m.select(
        *[_r(c, 4).alias(c) for c in m.columns if c != "oracle_ratio"], _r("oracle_ratio").alias("oracle_ratio")
    )


_CMP = f"""{_TWO}, cmp AS (SELECT iso, node, o, r, n, (r - n) / nullif(abs(n), 0) * 100 AS gain,
  (o - n) / nullif(o, 0) * 100 AS ngap, (o - r) / nullif(o, 0) * 100 AS rgap
  FROM two WHERE o IS NOT NULL AND r IS NOT NULL AND n IS NOT NULL)"""


@query("i10_naive_comparison", f"""WITH {_CUST}, {_CMP}
SELECT iso, node, round(gain, 6) AS naive_vs_ridge, round(ngap, 6) AS naive_vs_oracle, round(rgap, 6) AS ridge_vs_oracle FROM cmp""")
def i10(spark, d):
    c = mt.naive_comparison(_customers(spark, d), **ROLE)
    return _all_rounded(c.select("iso", "node", "naive_vs_ridge", "naive_vs_oracle", "ridge_vs_oracle"), ["iso", "node"])


@query("i10_naive_summary", f"""WITH {_CUST}, {_CMP}
SELECT count(*) AS nodes, count(*) FILTER (WHERE gain < 0) AS naive_better,
  round(count(*) FILTER (WHERE gain < 0) / count(*)::DOUBLE * 100, 6) AS naive_better_pct,
  round(avg(gain), 6) AS avg_ridge_gain, round(avg(ngap), 6) AS avg_naive_gap, round(avg(rgap), 6) AS avg_ridge_gap FROM cmp""")
def i10_summary(spark, d):
    s = mt.naive_summary(mt.naive_comparison(_customers(spark, d), **ROLE))
    return _all_rounded(s, ["nodes", "naive_better"])


@query("i11_better_forecaster", f"""WITH {_CUST}, {_CMP}
SELECT CASE WHEN gain > 0 THEN 'ridge' ELSE 'naive' END AS better_forecaster, count(*) AS nodes,
       round(avg(abs(gain)), 6) AS improvement FROM cmp GROUP BY 1""")
def i11(spark, d):
    b = mt.better_forecasters(mt.naive_comparison(_customers(spark, d), **ROLE))
    return _all_rounded(b, ["better_forecaster", "nodes"])


_STATS = ", ".join(
    f"round({f}({c}), 2) AS {c}_{n}"
    for c in ("revenue", "runtime_seconds")
    for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
)


@query("i12_summary_table", f"""WITH {_SEG}
SELECT model, {_STATS}, round(avg(revenue) / (SELECT avg(revenue) FROM res WHERE model = '1-URGENT') * 100, 1) AS pct_of_oracle
FROM res GROUP BY 1""")
def i12(spark, d):
    return mt.summary_table(fx.results(spark, d), ROLE["oracle"])


@query("i13_histogram", f"""WITH {_CUST}, {_VS},
x AS (SELECT model, pct AS x FROM vs WHERE model <> '1-URGENT' AND pct IS NOT NULL),
span AS (SELECT model, min(x) AS lo, max(x) AS hi, avg(x) AS mean FROM x GROUP BY 1)
SELECT x.model, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean,
       CAST(coalesce(least(floor((x - lo) / nullif(hi - lo, 0) * 15), 14), 0) AS BIGINT) AS bin, count(*) AS nodes
FROM x JOIN span USING (model) GROUP BY 1, 2, 3, 4, 5""")
def i13(spark, d):
    h = mt.oracle_histogram(_customers(spark, d), 15, ROLE["oracle"])
    return h.select(
        "model", *[_r(c).alias(c) for c in ("lo", "hi", "mean")], F.col("bin").cast("bigint").alias("bin"), "nodes"
    )
