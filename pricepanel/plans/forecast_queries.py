"""Refit schedules, ridge fits and forecast evaluation over the event panel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pricepanel.functions import kernels as kn
from pricepanel.operators import forecast as fc
from pricepanel.operators.panel import regular_grid
from pricepanel.plans import fixtures as fx, ridge_sql as rs, sql
from pricepanel.plans.registry import query

# The refit rule played step by step: refit without a model, after 96 calls
# without one, or when the training size moved by more than 67.
_RULE = """step AS (
  SELECT 1::BIGINT AS rn, 1::BIGINT AS refit_rn, 1::BIGINT AS size, 0::BIGINT AS waited, 0::BIGINT AS refit
  UNION ALL
  SELECT rn + 1, CASE WHEN hit THEN rn + 1 ELSE refit_rn END, CASE WHEN hit THEN least(rn + 1, 672) ELSE size END,
         CASE WHEN hit THEN 0 ELSE waited + 1 END, refit + CASE WHEN hit THEN 1 ELSE 0 END
  FROM (SELECT *, waited >= 96 OR abs(least(rn + 1, 672) - size) > 67 AS hit FROM step)
  WHERE rn < (SELECT max(c) FROM (SELECT count(*) AS c FROM p GROUP BY node))),
num AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY timestamp) AS rn FROM p)"""

_TRAIN = """fits AS (SELECT node, refit, refit_rn FROM step JOIN (SELECT node, count(*) AS n FROM p GROUP BY node) c
         ON step.rn <= c.n WHERE step.rn = refit_rn),
train AS (SELECT num.*, refit, refit_rn FROM num JOIN fits
          ON num.node = fits.node AND num.rn BETWEEN fits.refit_rn - 671 AND fits.refit_rn)"""


def _r(c, digits=6):
    return F.round(c, digits)


@query("g1_refit_schedule", f"""WITH RECURSIVE {sql.P}, {_RULE}
SELECT node, timestamp, num.rn, refit, refit_rn FROM num JOIN step ON num.rn = step.rn""")
def g1(spark, d):
    s = fc.refit_schedule(fx.events_panel(spark, d))
    return s.select("node", "timestamp", "rn", "refit", "refit_rn")


@query("g2_ridge_gram", f"""WITH RECURSIVE {sql.P}, {_RULE}, {_TRAIN},
f AS (SELECT node, refit, rn, price, unnest([0, hour(timestamp),
        CASE WHEN minute(timestamp) > 0 THEN 23 + minute(timestamp) // 15 ELSE 0 END,
        CASE WHEN isodow(timestamp) > 1 THEN 25 + isodow(timestamp) ELSE 0 END,
        CASE WHEN month(timestamp) > 1 THEN 31 + month(timestamp) ELSE 0 END]) AS i,
        unnest([0, 1, 2, 3, 4]) AS family FROM train),
act AS (SELECT * FROM f WHERE family = 0 OR i > 0)
SELECT a.node, a.refit, a.i, b.i AS j, count(*) AS cnt, round(sum(a.price), 6) AS total
FROM act a JOIN act b ON a.node = b.node AND a.refit = b.refit AND a.rn = b.rn AND a.i <= b.i GROUP BY 1, 2, 3, 4""")
def g2_gram(spark, d):
    cells = fc.window_cells(fx.events_panel(spark, d))
    return cells.withColumn("total", _r("total"))


def _levels():
    """The intercept and each level's coefficient but the first, as rounded columns."""
    return [
        _r("fit.intercept", 4).alias("intercept"),
        *[_r(F.col("fit")[name][i], 4).alias(f"{name}_{i}") for name, count in kn.LEVELS.items() for i in range(1, count)],
    ]


@query("g2_ridge_fit", f"""WITH RECURSIVE {sql.P}, {_RULE}, {_TRAIN}, {rs.calendar_fit("train", "node, refit")}
SELECT node, refit, n_train, {rs.coefficients()} FROM fit""")
def g2_fit(spark, d):
    f = fc.ridge_fits(fx.events_panel(spark, d))
    return f.select("node", "refit", F.col("n_train").cast("bigint").alias("n_train"), *_levels())


@query("g3_ridge_forecast", f"""WITH RECURSIVE {sql.P}, {_RULE}, {_TRAIN}, {rs.calendar_fit("train", "node, refit")},
steps AS (SELECT num.node, num.timestamp AS origin, h, num.timestamp + to_minutes(CAST(15 * h AS INTEGER)) AS slot, refit
          FROM num JOIN step USING (rn) CROSS JOIN range(32) r(h))
SELECT node, origin, h, round({rs.calendar_value("slot")}, 2) AS yhat FROM steps JOIN fit USING (node, refit)""")
def g3(spark, d):
    f = fc.explode_paths(fc.ridge_paths(fx.events_panel(spark, d)))
    return f.withColumn("yhat", _r("yhat", 2)).withColumn("h", F.col("h").cast("bigint"))


_ORIGINS = """pos AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY timestamp) - 1 AS pos,
        count(*) OVER (PARTITION BY node) AS n FROM g),
org AS (SELECT * FROM pos WHERE pos >= 1344 AND (pos - 1344) % 32 = 0 AND pos < n - 32)"""


_WHOLE = f"""ks AS (SELECT DISTINCT node, (pos - 1344) // 32 AS k, pos AS upto FROM pos WHERE pos >= 1344 AND (pos - 1344) % 32 = 0),
hist AS (SELECT ks.node, ks.k, pos.timestamp, pos.price FROM ks JOIN pos ON pos.node = ks.node AND pos.pos < ks.upto AND pos.price IS NOT NULL),
{rs.calendar_fit("hist", "node, k")}"""


@query("g4_whole_history_fit", f"""WITH RECURSIVE {sql.P}, {sql.GRID}, {_ORIGINS}, {_WHOLE}
SELECT node, k, n_train, {rs.coefficients()} FROM fit""")
def g4(spark, d):
    f = fc.whole_history_fits(fc.gridded(fx.events_panel(spark, d)))
    return f.select("node", "k", "n_train", *_levels())


_Z = rs.Z
_PRICES = {1, 2, 3, 4, 8}


def _large(a: int, b: int) -> bool:
    """Products of two prices are compared by their root, which keeps six digits
    meaningful and cannot fall on a rounding tie."""
    return a in _PRICES and b in _PRICES


_MOMENTS = ", ".join(
    f"round({'sqrt' if _large(a, b) else ''}(sum({_Z[a]} * {_Z[b]})), 6) AS m{a}_{b}"
    for a in range(9)
    for b in range(a, 9)
)


def _moments(m):
    return m.select(
        "node",
        F.col("block").cast("bigint").alias("block"),
        *[
            _r(F.sqrt(f"m{a}_{b}") if _large(a, b) else f"m{a}_{b}").alias(f"m{a}_{b}")
            for a in range(9)
            for b in range(a, 9)
        ],
    )


@query("g5_block_moments", f"WITH {sql.P}, {rs.lag_rows('p')} SELECT node, block, {_MOMENTS} FROM b GROUP BY 1, 2")
def g5_moments(spark, d):
    return _moments(fc.block_moments(fx.events_panel(spark, d)))


@query("g5_block_moments_gaps", f"WITH {sql.P}, {sql.GRID}, {rs.lag_rows('g')} SELECT node, block, {_MOMENTS} FROM b GROUP BY 1, 2")
def g5_moments_gaps(spark, d):
    """On a regular grid, whose empty slots are no prices."""
    return _moments(fc.block_moments(regular_grid(fx.events_panel(spark, d))))


@query("g5_lag_ridge", f"""WITH RECURSIVE {sql.P}, {sql.GRID}, {rs.lag_fit("g")}
SELECT node, round(alpha, 6) AS alpha, round(score, 4) AS score, round(intercept, 4) AS intercept,
       {", ".join(f"round(beta[{k + 1}], 4) AS beta_{k}" for k in range(7))} FROM fit""")
def g5(spark, d):
    f = fc.lag_ridge_fits(regular_grid(fx.events_panel(spark, d)))
    return f.select(
        "node", _r("fit.alpha").alias("alpha"), _r(F.array_max("fit.scores"), 4).alias("score"),
        _r("fit.intercept", 4).alias("intercept"),
        *[_r(F.col("fit.beta")[k], 4).alias(f"beta_{k}") for k in range(7)],
    )


_ONE = f"""SELECT node, coalesce(seen, timestamp) + INTERVAL 15 MINUTE AS timestamp, round({rs.one_step("l", "coalesce(seen, timestamp)")}, 3) AS yhat
FROM lst LEFT JOIN fit USING (node)"""


@query("g6_one_step", f"WITH RECURSIVE {sql.P}, g AS (SELECT * FROM p), {rs.lag_fit('g')}, {rs.LAST} {_ONE}")
def g6(spark, d):
    return fc.one_step_forecast(fx.events_panel(spark, d)).withColumn("yhat", _r("yhat", 3))


@query("g6_one_step_gaps", f"WITH RECURSIVE {sql.P}, {sql.GRID}, {rs.lag_fit('g')}, {rs.LAST} {_ONE}")
def g6_gaps(spark, d):
    """A slot without a price repeats the forecast in force."""
    return fc.one_step_forecast(regular_grid(fx.events_panel(spark, d))).withColumn("yhat", _r("yhat", 3))


@query("g6_day_path", f"""WITH RECURSIVE {sql.P}, {sql.GRID}, {rs.lag_fit("g")}, {rs.LAST}, {rs.PATHS}
SELECT node, origin, h, round(yhat, 2) AS yhat FROM path""")
def g6_path(spark, d):
    f = fc.day_paths(regular_grid(fx.events_panel(spark, d)))
    steps = f.select("node", "origin", F.posexplode("path").alias("h", "yhat"))
    return steps.select("node", "origin", (F.col("h") + 1).cast("bigint").alias("h"), _r("yhat", 2).alias("yhat"))


_FORECASTS = """ew AS (
  SELECT node, timestamp, pos, n, list_dot_product(list_transform(l, lambda x: coalesce(x, 0)), k)
         / nullif(list_dot_product(list_transform(l, lambda x: CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), k), 0) AS level
  FROM (SELECT *, list_transform(range(1, len(l) + 1), lambda i: pow(0.8::DOUBLE, len(l) - i)) AS k
        FROM (SELECT *, list(price) OVER (PARTITION BY node, hour(timestamp) * 60 + minute(timestamp)
              ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM pos))),
lv AS (SELECT node, timestamp, pos, n, last_value(price IGNORE NULLS) OVER (PARTITION BY node ORDER BY timestamp
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS level FROM pos),
fc AS (
  SELECT 'last_value' AS model, org.node, org.timestamp AS origin, h, level AS yhat
  FROM org JOIN lv USING (node, timestamp) CROSS JOIN range(32) x(h)
  UNION ALL SELECT 'ewma', org.node, org.timestamp, h, level FROM org JOIN ew USING (node, timestamp) CROSS JOIN range(32) x(h)
  UNION ALL SELECT 'previous_day', org.node, org.timestamp, h, q.price FROM org CROSS JOIN range(32) x(h)
  JOIN g q ON q.node = org.node AND q.timestamp = org.timestamp + to_minutes(CAST(h * 15 AS INTEGER)) - INTERVAL '1 day'),
ev AS (SELECT fc.*, p.price AS actual FROM fc JOIN p ON p.node = fc.node
       AND p.timestamp = fc.origin + to_minutes(CAST(h * 15 AS INTEGER)) WHERE yhat IS NOT NULL)"""
_EVAL = f"WITH {sql.P}, {sql.GRID}, {_ORIGINS}, {_FORECASTS}"
SIMPLE = ("last_value", "previous_day", "ewma")


@query("g7_mae", f"{_EVAL} SELECT model, round(avg(abs(yhat - actual)), 6) AS mae, count(*) AS n FROM ev GROUP BY 1")
def g7(spark, d):
    e = fc.walk_forward(fx.events_panel(spark, d), SIMPLE)
    return fc.mean_absolute_error(e).withColumn("mae", _r("mae"))


@query("g7_mae_by_step", f"""{_EVAL}
SELECT model, h, round(avg(abs(yhat - actual)), 6) AS mae, count(*) AS n FROM ev GROUP BY 1, 2""")
def g7_step(spark, d):
    e = fc.walk_forward(fx.events_panel(spark, d), SIMPLE)
    m = fc.mean_absolute_error(e, "model", "h").withColumn("mae", _r("mae"))
    return m.withColumn("h", F.col("h").cast("bigint"))


_RIDGE = f"""{_WHOLE},
al AS (SELECT * FROM ev UNION ALL
       SELECT 'ridge' AS model, o.node, o.timestamp AS origin, o.h, {rs.calendar_value("o.slot")} AS yhat, p.price AS actual
       FROM (SELECT org.*, (pos - 1344) // 32 AS k, h, timestamp + to_minutes(CAST(h * 15 AS INTEGER)) AS slot FROM org CROSS JOIN range(32) r(h)) o
       JOIN fit USING (node, k) JOIN p ON p.node = o.node AND p.timestamp = o.slot)"""


@query("g7_mae_ridge", f"""WITH RECURSIVE {sql.P}, {sql.GRID}, {_ORIGINS}, {_FORECASTS}, {_RIDGE}
SELECT model, round(avg(abs(yhat - actual)), 4) AS mae, count(*) AS n FROM al GROUP BY 1""")
def g7_ridge(spark, d):
    e = fc.walk_forward(fx.events_panel(spark, d), (*SIMPLE, "ridge"))
    return fc.mean_absolute_error(e).withColumn("mae", _r("mae", 4))


def _day_mean(train, t0, horizon):
    return np.full(horizon, train.iloc[-96:].mean())


_G8 = f"""WITH {sql.P}, {sql.GRID}, {_ORIGINS}
SELECT org.node, org.timestamp AS origin, h, round(m, 4) AS yhat FROM (
  SELECT org.node, org.timestamp, avg(q.price) AS m FROM org JOIN pos q
  ON q.node = org.node AND q.pos BETWEEN org.pos - 96 AND org.pos - 1 GROUP BY 1, 2) org CROSS JOIN range(32) x(h)"""


@query("g8_registered_function", _G8)
def g8(spark, d):
    f = fc.from_function(_day_mean, history=96)(fc.gridded(fx.events_panel(spark, d)), 1344, 32)
    return f.select("node", "origin", F.col("h").cast("bigint").alias("h"), _r("yhat", 4).alias("yhat"))


@query("g8_sql_function", _G8)
def g8_sql(spark, d):
    fc.sql_function(spark, "day_mean", _day_mean, history=96)
    grid = fc.gridded(fx.events_panel(spark, d))
    return spark.sql(
        "SELECT node, origin, CAST(h AS BIGINT) AS h, round(yhat, 4) AS yhat"
        " FROM day_mean(TABLE({slots}) PARTITION BY (node, part) ORDER BY rn)",
        slots=fc.slots(grid, 96),
    )
