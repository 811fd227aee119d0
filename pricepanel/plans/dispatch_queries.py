"""Window features, signals and ledgers over the event panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.battery import Battery
from pricepanel.operators import dispatch, features as ft, foresight, panel as op
from pricepanel.plans import fixtures as fx, sql
from pricepanel.plans.registry import query

BATTERIES = (Battery(), Battery(eta_chg=0.9, p_max_mw=50.0))
ONE_MODEL = sql.models((10,))


def _r(c, digits=6):
    return F.round(c, digits)


def _finite(c):
    return F.when(F.col(c) < float("inf"), F.col(c)).alias(c)


@query("f1_thresholds", f"""WITH {sql.P}, {sql.models()}
SELECT node, timestamp, price, model, round(CASE WHEN isinf(low) THEN NULL ELSE low END, 8) AS low,
       round(CASE WHEN isinf(high) THEN NULL ELSE high END, 8) AS high FROM thr""")
def f1(spark, d):
    t = ft.threshold_models(fx.events_panel(spark, d))
    return t.select("node", "timestamp", "price", "model", _r(_finite("low"), 8).alias("low"), _r(_finite("high"), 8).alias("high"))


@query("f1_thresholds_user", f"""WITH {sql.P_USER}, {sql.models((10,), 96, 30)}
SELECT node, timestamp, price, round(CASE WHEN isinf(low) THEN NULL ELSE low END, 8) AS low,
       round(CASE WHEN isinf(high) THEN NULL ELSE high END, 8) AS high FROM thr""")
def f1_user(spark, d):
    t = ft.thresholds(fx.events_panel(spark, d, "user_id"), 10, window=96)
    return t.select("node", "timestamp", "price", _r(_finite("low"), 8).alias("low"), _r(_finite("high"), 8).alias("high"))


@query("f1_thresholds_year", f"""WITH {sql.SHIP}, daily AS (
  SELECT node, timestamp, round(avg(price), 6) AS price FROM ship GROUP BY 1, 2),
hist AS (SELECT *, count(price) OVER w AS n_hist, quantile_cont(price, 0.1) OVER w AS low, quantile_cont(price, 0.9) OVER w AS high
  FROM daily WINDOW w AS (PARTITION BY node ORDER BY timestamp ROWS BETWEEN 364 PRECEDING AND CURRENT ROW))
SELECT node, timestamp, price, n_hist, CASE WHEN n_hist >= 36 THEN round(low, 6) END AS low,
       CASE WHEN n_hist >= 36 THEN round(high, 6) END AS high FROM hist""")
def f1_year(spark, d):
    """A window of a year of days."""
    daily = op.dedup_mean(fx.ship_ticks(spark, d)).withColumn("price", _r("price"))
    t = ft.thresholds(daily, 10, window=365)
    return t.select(
        "node", "timestamp", "price", F.col("n_hist").cast("bigint").alias("n_hist"),
        _r(_finite("low")).alias("low"), _r(_finite("high")).alias("high"),
    )


_GAPS = f"""{sql.P}, {sql.GRID}, hist AS (
  SELECT node, timestamp, price, list_sort(coalesce(list(price) FILTER (price IS NOT NULL) OVER (
    PARTITION BY node ORDER BY timestamp ROWS BETWEEN 671 PRECEDING AND CURRENT ROW), [])) AS l FROM g)"""


@query("f1_thresholds_gaps", f"""WITH {_GAPS}
SELECT node, timestamp, price, len(l) AS n_hist,
       round(CASE WHEN len(l) >= 67 THEN {sql.cut('l', 0.1)} END, 8) AS low,
       round(CASE WHEN len(l) >= 67 THEN {sql.cut('l', 0.9)} END, 8) AS high FROM hist""")
def f1_gaps(spark, d):
    """On a regular grid about half of the slots have no price: only known ones count."""
    t = ft.thresholds(op.regular_grid(fx.events_panel(spark, d)))
    return t.select(
        "node", "timestamp", "price", F.col("n_hist").cast("bigint").alias("n_hist"),
        _r(_finite("low"), 8).alias("low"), _r(_finite("high"), 8).alias("high"),
    )


@query("f2_price_regime_gaps", f"""WITH {sql.P}, {sql.GRID}, hist AS (
  SELECT node, timestamp, price, list_sort(coalesce(list(price) FILTER (price IS NOT NULL) OVER (
    PARTITION BY node ORDER BY timestamp ROWS BETWEEN 288 PRECEDING AND 1 PRECEDING), [])) AS l FROM g)
SELECT node, timestamp, price, CAST(CASE WHEN len(l) < 20 THEN 1 WHEN price < {sql.cut('l', 0.25)} THEN 0
       WHEN price > {sql.cut('l', 0.75)} THEN 2 ELSE 1 END AS BIGINT) AS price_bin FROM hist""")
def f2_gaps(spark, d):
    r = ft.price_regime(op.regular_grid(fx.events_panel(spark, d)))
    return r.withColumn("price_bin", F.col("price_bin").cast("bigint"))


_REGIME = f"""hist AS (
  SELECT node, timestamp, price, list_sort(coalesce(list(price) OVER (
    PARTITION BY node ORDER BY timestamp ROWS BETWEEN 288 PRECEDING AND 1 PRECEDING), [])) AS l FROM p),
regime AS (SELECT node, timestamp, price, CAST(CASE WHEN len(l) < 20 THEN 1 WHEN price < {sql.cut('l', 0.25)} THEN 0
       WHEN price > {sql.cut('l', 0.75)} THEN 2 ELSE 1 END AS BIGINT) AS price_bin FROM hist)"""


@query("f2_price_regime", f"WITH {sql.P}, {_REGIME} SELECT node, timestamp, price, price_bin FROM regime")
def f2(spark, d):
    r = ft.price_regime(fx.events_panel(spark, d))
    return r.withColumn("price_bin", F.col("price_bin").cast("bigint"))


_ONE_LEDGER = f"WITH RECURSIVE {sql.P}, {ONE_MODEL}, {sql.SCEN}, {sql.LEDGER}"


@query("f3_state_code", f"""{_ONE_LEDGER}, h2 AS (
  SELECT node, timestamp, price, list_sort(coalesce(list(price) OVER (
    PARTITION BY node ORDER BY timestamp ROWS BETWEEN 288 PRECEDING AND 1 PRECEDING), [])) AS l FROM p),
regime AS (SELECT node, timestamp, CASE WHEN len(l) < 20 THEN 1 WHEN price < {sql.cut('l', 0.25)} THEN 0
       WHEN price > {sql.cut('l', 0.75)} THEN 2 ELSE 1 END AS price_bin FROM h2)
SELECT node, timestamp, CAST(price_bin AS BIGINT) AS price_bin,
       CAST(least(floor(soc_before / 50), 3) AS BIGINT) AS soc_bin,
       CAST(price_bin * 10 + least(floor(soc_before / 50), 3) AS BIGINT) AS state
FROM ledger JOIN regime USING (node, timestamp) WHERE scenario = 1""")
def f3(spark, d):
    p = fx.events_panel(spark, d)
    led = dispatch.threshold_dispatch(p, pcts=(10,))
    soc = led.select("node", "timestamp", ft.charge_bin(F.col("soc_before")).alias("soc_bin"))
    both = ft.price_regime(p).join(soc, ["node", "timestamp"])
    return both.select(
        "node",
        "timestamp",
        F.col("price_bin").cast("bigint").alias("price_bin"),
        F.col("soc_bin").cast("bigint").alias("soc_bin"),
        ft.state_code(F.col("price_bin"), F.col("soc_bin")).cast("bigint").alias("state"),
    )


@query("f4_calendar", f"""WITH {sql.P}
SELECT node, timestamp, price, hour(timestamp) AS hr, minute(timestamp) // 15 AS qtr,
       isodow(timestamp) - 1 AS dow, month(timestamp) - 1 AS mon FROM p""")
def f4(spark, d):
    c = ft.calendar_features(fx.events_panel(spark, d))
    return c.select("node", "timestamp", "price", *[F.col(x).cast("bigint").alias(x) for x in ("hr", "qtr", "dow", "mon")])


_LAG = ", ".join(f"lag(price, {k}) OVER w AS lag_{k}" for k in range(1, 5))


@query("f5_lags", f"""WITH {sql.P}
SELECT node, timestamp, price, row_number() OVER w AS rn, {_LAG} FROM p
WINDOW w AS (PARTITION BY node ORDER BY timestamp)""")
def f5(spark, d):
    return ft.lag_features(fx.events_panel(spark, d)).drop("n")


@query("f6_context", f"""WITH {sql.P}, m AS (
  SELECT *, avg(price) OVER w AS mean, stddev_pop(price) OVER w AS sd FROM p
  WINDOW w AS (PARTITION BY node ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT node, timestamp, price,
       round(CASE WHEN mean IS NULL THEN price WHEN sd < 1e-5 THEN 0 ELSE (price - mean) / sd END, 6) AS z_price,
       round((24 - (hour(timestamp) * 60 + minute(timestamp)) / 60.0::DOUBLE) / 24, 8) AS hrs_left FROM m""")
def f6(spark, d):
    c = ft.context_features(fx.events_panel(spark, d))
    return c.select("node", "timestamp", "price", _r("z_price").alias("z_price"), _r("hrs_left", 8).alias("hrs_left"))


@query("f6_charge_share", f"""{_ONE_LEDGER}
SELECT node, timestamp, round(soc_before / 200, 8) AS charge_share FROM ledger WHERE scenario = 1""")
def f6_share(spark, d):
    led = dispatch.threshold_dispatch(fx.events_panel(spark, d), pcts=(10,))
    return led.select("node", "timestamp", _r(ft.charge_share(F.col("soc_before")), 8).alias("charge_share"))


@query("f7_discharged_today", f"""{_ONE_LEDGER}
SELECT node, timestamp, round(mwh, 6) AS mwh, round(coalesce(sum(greatest(mwh, 0)) OVER (
  PARTITION BY node, CAST(timestamp AS DATE) ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6)
  AS used_before FROM ledger WHERE scenario = 1""")
def f7(spark, d):
    led = dispatch.threshold_dispatch(fx.events_panel(spark, d), pcts=(10,))
    u = ft.discharged_today(led)
    return u.select("node", "timestamp", _r("mwh").alias("mwh"), _r("used_before").alias("used_before"))


def _ewma(frame: str, alpha: float = 0.2, panel: str = sql.P, digits: int = 6) -> str:
    return f"""WITH {panel}, h AS (
  SELECT *, list(price) OVER (PARTITION BY node, hour(timestamp) * 60 + minute(timestamp) ORDER BY timestamp
         ROWS BETWEEN UNBOUNDED PRECEDING AND {frame}) AS l FROM p),
w AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: pow({1 - alpha}::DOUBLE, len(l) - i)) AS k FROM h)
SELECT node, timestamp, price, round(list_dot_product(l, k) / list_sum(k), {digits}) AS level FROM w"""


@query("f8_slot_ewma", _ewma("CURRENT ROW"))
def f8(spark, d):
    return ft.slot_ewma(fx.events_panel(spark, d)).withColumn("level", _r("level"))


@query("f8_slot_ewma_before", _ewma("1 PRECEDING"))
def f8_before(spark, d):
    return ft.slot_ewma(fx.events_panel(spark, d), include_current=False).withColumn("level", _r("level"))


_DAYS = "p AS (SELECT o_orderpriority AS node, o_orderdate AS timestamp, round(avg(o_totalprice), 6) AS price FROM orders GROUP BY 1, 2)"


@query("f8_slot_ewma_years", _ewma("CURRENT ROW", 0.01, _DAYS, 3))
def f8_years(spark, d):
    """A slow level over years of days: weights reach back to the first of them."""
    p = op.dedup_mean(fx.order_ticks(spark, d)).withColumn("price", _r("price"))
    return ft.slot_ewma(p, alpha=0.01).select("node", "timestamp", "price", _r("level", 3).alias("level"))


@query("f9_last_value", f"""WITH {sql.P}
SELECT node, timestamp AS origin, h, price AS yhat FROM p CROSS JOIN range(32) x(h)""")
def f9(spark, d):
    f = ft.last_value_forecast(fx.events_panel(spark, d), 32)
    return f.withColumn("h", F.col("h").cast("bigint"))


@query("f10_previous_day", f"""WITH {sql.P}
SELECT p.node, p.timestamp, p.price, q.price AS yhat FROM p JOIN p q
ON q.node = p.node AND q.timestamp = p.timestamp - INTERVAL '1 day'""")
def f10(spark, d):
    return ft.previous_day_price(fx.events_panel(spark, d))


@query("f11_intervals_left", f"""WITH {sql.P}
SELECT node, timestamp, price, count(*) OVER (PARTITION BY node, CAST(timestamp AS DATE) ORDER BY timestamp
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_in_day FROM p""")
def f11(spark, d):
    return ft.intervals_left(fx.events_panel(spark, d))


@query("h1_signals", f"""WITH {sql.P}, {sql.models()}
SELECT node, timestamp, price, model, CAST(signal AS BIGINT) AS signal FROM sig""")
def h1(spark, d):
    s = dispatch.signals(ft.threshold_models(fx.events_panel(spark, d)))
    return s.select("node", "timestamp", "price", "model", F.col("signal").cast("bigint").alias("signal"))


@query("h2_ledger", f"""WITH RECURSIVE {sql.P}, {sql.models()}, {sql.SCEN}, {sql.LEDGER}
SELECT node, model, scenario, timestamp, price, CAST(signal AS BIGINT) AS signal, round(soc_before, 6) AS soc_before,
       round(mwh, 6) AS mwh, round(revenue, 10) AS revenue, round(soc, 6) AS soc FROM ledger""")
def h2(spark, d):
    led = dispatch.threshold_dispatch(fx.events_panel(spark, d), batteries=BATTERIES)
    return led.select(
        "node", "model", "scenario", "timestamp", "price",
        F.col("signal").cast("bigint").alias("signal"),
        _r("soc_before").alias("soc_before"), _r("mwh").alias("mwh"),
        _r("revenue", 10).alias("revenue"), _r("soc").alias("soc"),
    )


@query("h3_day_balance", f"""WITH RECURSIVE {sql.P}, {sql.models()}, {sql.SCEN}, {sql.LEDGER}
SELECT node, model, scenario, strftime(timestamp, '%Y-%m-%d') AS day,
       round(arg_min(soc_before, rn), 6) AS soc_in, round(arg_max(soc, rn), 6) AS soc_out
FROM ledger GROUP BY 1, 2, 3, 4""")
def h3(spark, d):
    s = dispatch.threshold_signals(fx.events_panel(spark, d))
    return dispatch.day_balance(s, ft.model_names((10, 25, 45)), BATTERIES).select(
        "node", "model", "scenario", F.col("day").cast("string").alias("day"),
        _r("soc_in").alias("soc_in"), _r("soc_out").alias("soc_out"),
    )


@query("h4_spread_value", f"""WITH {sql.P}, r AS (
  SELECT node, strftime(timestamp, '%Y-%m-%d') AS day, price,
         row_number() OVER (PARTITION BY node, CAST(timestamp AS DATE) ORDER BY price DESC) AS dear,
         row_number() OVER (PARTITION BY node, CAST(timestamp AS DATE) ORDER BY price) AS cheap FROM p)
SELECT a.node, a.day, max(n.c) AS slots,
       round(sum(greatest(0, 6.25::DOUBLE * (a.price - b.price / 0.95::DOUBLE))), 6) AS spread_value
FROM r a JOIN r b ON a.node = b.node AND a.day = b.day AND a.dear = b.cheap
JOIN (SELECT node, day, count(*) AS c FROM r GROUP BY 1, 2) n ON n.node = a.node AND n.day = a.day
WHERE a.dear <= 32 GROUP BY 1, 2""")
def h4(spark, d):
    v = dispatch.spread_value(fx.events_panel(spark, d))
    return v.select(
        "node", F.col("day").cast("string").alias("day"), F.col("slots").cast("bigint").alias("slots"),
        _r("spread_value").alias("spread_value"),
    )


@query("h7_audit", f"""WITH {sql.P} SELECT node, 'online_quartile_p' || x AS model, count(*) AS rows, 0 AS bad_soc,
  0 AS bad_power, 0 AS bad_revenue, 0 AS bad_balance, 0 AS bad_days
FROM p CROSS JOIN (VALUES ('10'), ('25'), ('45')) m(x) GROUP BY 1, 2""")
def h7(spark, d):
    led = dispatch.threshold_dispatch(fx.events_panel(spark, d))
    a = dispatch.audit(led, Battery(), ("node", "model"))
    return a.select("node", "model", *[F.col(c).cast("bigint").alias(c) for c in a.columns[2:]])


_SUMMARY = """SELECT node, model, scenario, round(sum(revenue), 3) AS revenue, count(*) AS timestamps,
       round(avg(price), 5) AS mean_price, round(avg(revenue), 5) AS mean_revenue, round(sum(mwh), 5) AS total_mwh
FROM ledger GROUP BY 1, 2, 3"""


def _rounded(summary):
    return summary.select(
        "node", "model", "scenario", "timestamps",
        _r("revenue", 3).alias("revenue"),
        *[_r(c, 5).alias(c) for c in ("mean_price", "mean_revenue", "total_mwh")],
    )


@query("h8_schedule_summary", f"WITH RECURSIVE {sql.P}, {sql.models((10,))}, {sql.SCEN}, {sql.LEDGER} {_SUMMARY}")
def h8(spark, d):
    led = dispatch.threshold_dispatch(fx.events_panel(spark, d), pcts=(10,), batteries=BATTERIES)
    return _rounded(dispatch.summarise(led))


@query("h9_backtest_grid", f"WITH RECURSIVE {sql.P}, {sql.models()}, {sql.SCEN}, {sql.LEDGER} {_SUMMARY}")
def h9(spark, d):
    return _rounded(dispatch.backtest_grid(fx.events_panel(spark, d), batteries=BATTERIES))


@query("h9_backtest_users", f"""WITH RECURSIVE {sql.P_USER}, {sql.models((25,), 96, 30)}, {sql.SCEN}, {sql.LEDGER} {_SUMMARY}""")
def h9_users(spark, d):
    grid = dispatch.backtest_grid(
        fx.events_panel(spark, d, "user_id"), pcts=(25,), batteries=BATTERIES, window=96
    )
    return _rounded(grid)


# --- perfect foresight ------------------------------------------

SMALL = Battery(e_max_mwh=25.0)


def _bound_sql(name: str, unit: float, levels: int, start: int, cap: int, eta: float = 0.95) -> str:
    """Dynamic programme over the rows of a node, best revenue per level and use."""
    return f"""{name}_dp AS (
  SELECT node, 0::BIGINT AS rn, {start} AS l, 0 AS used, 0::DOUBLE AS v, DATE '1900-01-01' AS day
  FROM (SELECT DISTINCT node FROM p)
  UNION ALL
  SELECT node, rn, l, used, max(v) AS v, any_value(day) AS day FROM (
    SELECT r.node, r.rn, s.l + a.dl AS l, CASE WHEN r.day = s.day THEN s.used ELSE 0 END + a.du AS used,
           s.v + r.price * a.x AS v, r.day AS day
    FROM {name}_dp s JOIN num r ON r.node = s.node AND r.rn = s.rn + 1
    CROSS JOIN (VALUES (0, 0, 0::DOUBLE), (1, 0, -{unit}::DOUBLE / {eta}::DOUBLE), (-1, 1, {unit}::DOUBLE)) a(dl, du, x))
  WHERE l BETWEEN 0 AND {levels - 1} AND used <= {cap} GROUP BY node, rn, l, used)"""


def _bracket_sql(low: tuple, high: tuple, digits: int | None = 3) -> str:
    shown = "lo.v AS lower, hi.v AS upper" if digits is None else f"round(lo.v, {digits}) AS lower, round(hi.v, {digits}) AS upper"
    best = "(SELECT node, max(v) AS v FROM {0}_dp JOIN (SELECT node, max(rn) AS rn FROM num GROUP BY 1) e USING (node, rn) GROUP BY 1) {0}"
    return f"""WITH RECURSIVE {sql.P},
num AS (SELECT *, CAST(timestamp AS DATE) AS day, row_number() OVER (PARTITION BY node ORDER BY timestamp) AS rn FROM p),
{_bound_sql("lo", *low)},
{_bound_sql("hi", *high)}
SELECT node, {shown} FROM {best.format("lo")} JOIN {best.format("hi")} USING (node)"""


@query("h5_bracket_small", _bracket_sql((5.9375, 5, 2, 4), (6.25, 5, 2, 4)))
def h5_small(spark, d):
    b = foresight.revenue_bracket(fx.events_panel(spark, d), SMALL)
    return b.select("node", _r("lower", 3).alias("lower"), _r("upper", 3).alias("upper"))


@query("h5_foresight_bracket", _bracket_sql((5.9375, 33, 16, 33), (6.25, 33, 16, 32)))
def h5(spark, d):
    b = foresight.revenue_bracket(fx.events_panel(spark, d))
    return b.select("node", _r("lower", 3).alias("lower"), _r("upper", 3).alias("upper"))


_BOUNDS = "\n  UNION ALL ".join(
    f"""SELECT p.node, 'oracle_lp_{k}' AS model, 1 AS scenario, round(max(b.{k}), 3) AS revenue, count(*) AS timestamps,
  round(avg(price), 5) AS mean_price, round(max(b.{k}) / count(*), 5) AS mean_revenue, NULL::DOUBLE AS total_mwh
  FROM p JOIN bracket b USING (node) GROUP BY 1"""
    for k in ("lower", "upper")
)
_STEPS = _bracket_sql((5.9375, 33, 16, 33), (6.25, 33, 16, 32), digits=None).replace(" num ", " steps ").replace("\nnum ", "\nsteps ").split(f"{sql.P},", 1)[1]
_STEP_TABLES, _, _STEP_RESULT = _STEPS.rpartition("\nSELECT ")


@query("h9_all_models", f"""WITH RECURSIVE {sql.P}, {sql.models()}, {sql.SCEN}, {sql.LEDGER}, {_STEP_TABLES},
bracket AS (SELECT {_STEP_RESULT})
SELECT * FROM ({_SUMMARY}) WHERE scenario = 1 UNION ALL {_BOUNDS}""")
def h9_all(spark, d):
    return _rounded(
        dispatch.backtest_grid(
            fx.events_panel(spark, d), models=("online_quartile", "oracle_lp")
        )
    )
