"""Price forecasts: refit schedule, ridge fits, evaluation, forecaster registry."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricepanel.functions import kernels as kn
from pricepanel.functions.timegrid import calendar, plus_minutes
from pricepanel.operators import features as ft
from pricepanel.operators.ordering import in_chunks, lagged, last_known, number_rows, previous
from pricepanel.operators.panel import regular_grid
from pricepanel.session import scratch, spread

COEFFICIENTS = T.StructType(
    [
        T.StructField("intercept", T.DoubleType()),
        *[T.StructField(name, T.ArrayType(T.DoubleType())) for name in kn.LEVELS],
    ]
)


@dataclass(frozen=True)
class RefitPlan:
    """Which row refits a model that sees one more row per step.

    A refit happens at the first row, when the training size moved by more than a
    tenth of the window, or ``every`` rows after the last one. Training sizes
    depend on the row number only, so the schedule is plain arithmetic.
    """

    window: int = 672
    every: int = 96

    @property
    def step(self) -> int:
        return self.window // 10 + 1

    @property
    def last_growth(self) -> int:
        return (self.window - 1) // self.step if self.step <= self.every + 1 else 0

    @property
    def last_growth_row(self) -> int:
        return 1 + self.last_growth * self.step

    def index(self, rn: Column) -> Column:
        """Number, from 0, of the latest refit at or before the row (-1 before any)."""
        early = F.floor((rn - 1) / self.step)
        late = self.last_growth + F.floor((rn - self.last_growth_row) / (self.every + 1))
        return F.when(rn < self.last_growth_row, early).otherwise(late)

    def row(self, index: Column) -> Column:
        """Row number of a refit."""
        return F.when(index <= self.last_growth, 1 + index * self.step).otherwise(
            self.last_growth_row + (index - self.last_growth) * (self.every + 1)
        )

    def rows(self, first: int, count: int) -> np.ndarray:
        """Row numbers of ``count`` refits from index ``first`` on."""
        index = np.arange(first, first + count)
        late = self.last_growth_row + (index - self.last_growth) * (self.every + 1)
        return np.where(index <= self.last_growth, 1 + index * self.step, late)


def known(panel: DataFrame) -> DataFrame:
    """Rows with a price: gaps of a regular grid are no training data."""
    return panel.filter(F.col("price").isNotNull() & ~F.isnan("price"))


def refit_schedule(panel: DataFrame, plan: RefitPlan = RefitPlan()) -> DataFrame:
    """Row number and the refit in force per row with a price."""
    numbered = number_rows(known(panel)).withColumn("refit", plan.index(F.col("rn")))
    return numbered.withColumn("refit_rn", plan.row(F.col("refit")))


#: Refits that one task's group holds: their windows share nearly all rows.
TOGETHER = 64


def _window_systems(panel: DataFrame, plan: RefitPlan, schema: T.StructType, made: Callable, sums: Callable = kn.window_grams) -> DataFrame:
    """Calls ``made(node, refits, *sums(...))`` for stretches of ``TOGETHER`` refits.

    A row goes to the stretches whose windows it is in: one, or two where the window of
    a stretch's first refit reaches back into the one before. A group holds at most
    ``TOGETHER`` refit distances and one window of rows.
    """
    first = plan.index(F.col("rn") - 1) + 1
    last = plan.index(F.least(F.col("rn") + plan.window - 1, F.col("n")))
    rows = (
        number_rows(known(panel))
        .withColumn("_lo", first)
        .withColumn("_hi", last)
        .filter("_lo <= _hi")
        .withColumn("_part", F.explode(F.sequence(F.floor(F.col("_lo") / TOGETHER), F.floor(F.col("_hi") / TOGETHER))))
        .select("node", "_part", "rn", *calendar("timestamp"), "price")
    )

    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas().sort_values("rn")
        begin, end, part = int(pdf["rn"].iloc[0]), int(pdf["rn"].iloc[-1]), int(pdf["_part"].iloc[0])
        at = plan.rows(part * TOGETHER, TOGETHER)
        at = at[at <= end]
        starts, ends = np.maximum(at - plan.window, begin - 1) - begin + 1, at - begin + 1
        found = sums(pdf[list(kn.LEVELS)].to_numpy(), pdf["price"].to_numpy(), starts, ends)
        return pa.Table.from_pylist(made(pdf["node"].iloc[0], part * TOGETHER + np.arange(len(at)), *found), to_arrow_schema(schema))

    return spread(rows, "node", "_part").groupBy("node", "_part").applyInArrow(run, schema)


_KEY = [T.StructField("node", T.StringType()), T.StructField("refit", T.LongType())]


def window_cells(panel: DataFrame, plan: RefitPlan = RefitPlan()) -> DataFrame:
    """Normal equations of every refit as cells ``(i, j, cnt, total)`` with ``i <= j``."""
    cell = T.StructType([T.StructField(c, T.LongType()) for c in ("i", "j", "cnt")] + [T.StructField("total", T.DoubleType())])
    schema = T.StructType([*_KEY, T.StructField("cells", T.ArrayType(cell))])

    def made(node, refits, gram, total):
        for r, g, y in zip(refits.tolist(), gram, total):
            i, j = np.nonzero(g)
            cells = zip(i.tolist(), j.tolist(), g[i, j].astype(int).tolist(), y[i, j].tolist())
            yield {"node": node, "refit": r, "cells": [dict(zip(("i", "j", "cnt", "total"), c)) for c in cells]}

    return _window_systems(panel, plan, schema, lambda *a: list(made(*a)), kn.window_totals).select("node", "refit", F.inline("cells"))


def _active_features() -> Column:
    """Indices of the one-hot features a row switches on; 0 is the intercept."""
    codes = [F.lit(0)]
    for name, offset in kn.OFFSETS.items():
        codes.append(F.when(F.col(name) > 0, F.col(name) + offset))
    return F.filter(F.array(*codes), lambda c: c.isNotNull())


def gram_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normal equations of calendar fits as summed cells ``(i, j)`` with ``i <= j``.

    Partial sums are formed before the shuffle, so the result has at most 990
    cells per fit, however many rows it covers.
    """
    return (
        rows.withColumn("_f", _active_features())
        .withColumn("i", F.explode("_f"))
        .withColumn("j", F.explode("_f"))
        .filter("i <= j")
        .groupBy(*keys, "i", "j")
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum("price").alias("total"))
    )


def ridge_fits(
    panel: DataFrame, plan: RefitPlan = RefitPlan(), alpha: float = 1.0
) -> DataFrame:
    """Coefficients per node and refit, trained on the trailing window, whose normal
    equations are differences of prefix sums."""
    schema = T.StructType([*_KEY, T.StructField("n_train", T.LongType()), T.StructField("fit", COEFFICIENTS)])

    def made(node, refits, gram, right):
        return [
            {"node": node, "refit": r, "n_train": n, "fit": kn.spread_coefficients(b0, beta)}
            for r, n, b0, beta in zip(refits.tolist(), gram[:, 0, 0].astype(int).tolist(), *kn.solve_grams(gram, right, alpha))
        ]

    return _window_systems(panel, plan, schema, made)


def _calendar_value(fit: Column, ts: Column) -> Column:
    hr, qtr, dow, mon = calendar(ts)
    return (
        fit["intercept"] + fit["hr"][hr] + fit["qtr"][qtr] + fit["dow"][dow] + fit["mon"][mon]
    )


def ridge_paths(
    panel: DataFrame,
    horizon: int = 32,
    plan: RefitPlan = RefitPlan(),
    alpha: float = 1.0,
    minutes: int = 15,
) -> DataFrame:
    """Forecast path of every row as an array; step 0 is the row's own interval."""
    rows = refit_schedule(panel, plan).select("node", "timestamp", "price", "refit")
    fits = ridge_fits(panel, plan, alpha).select("node", "refit", "fit")
    path = F.transform(
        F.sequence(F.lit(0), F.lit(horizon - 1)),
        lambda h: _calendar_value(
            F.col("fit"),
            F.col("timestamp")
            + F.make_dt_interval(F.lit(0), F.lit(0), h * minutes, F.lit(0).cast("decimal(18,6)")),
        ),
    )
    return rows.join(fits, ["node", "refit"]).select(
        "node", "timestamp", "price", path.alias("path")
    )


def explode_paths(paths: DataFrame) -> DataFrame:
    return paths.select(
        "node", F.col("timestamp").alias("origin"), F.posexplode("path").alias("h", "yhat")
    )


# --- whole history at chosen origins -------------------------------------------


def whole_history_fits(
    grid: DataFrame, first: int = 1344, stride: int = 32, alpha: float = 1.0
) -> DataFrame:
    """Ridge on all rows before each origin, origin ``k`` being slot
    ``first + k * stride`` of the grid.

    Normal equations are summed once per stretch between origins and accumulated
    over stretches; no row is read again for a later origin.
    """
    block = F.greatest(F.lit(-1), F.floor((F.col("rn") - 1 - first) / stride))
    rows = grid.filter("price is not null").select(
        "node",
        F.floor((F.col("n") - 1 - first) / stride).alias("last_k"),
        block.alias("k"),
        *calendar("timestamp"),
        "price",
    )
    cell = Window.partitionBy("node", "i", "j").orderBy("k")
    so_far = cell.rowsBetween(Window.unboundedPreceding, 0)
    running = gram_cells(rows, ["node", "last_k", "k"]).select(
        "node", "i", "j", "k", "last_k",
        F.sum("cnt").over(so_far).alias("cnt"),
        F.sum("total").over(so_far).alias("total"),
        F.lead("k").over(cell).alias("_next"),
    )
    # A running cell holds for every later origin up to the one that changes it.
    valid = running.withColumn("_to", F.coalesce("_next", "last_k")).filter("k < _to")
    dense = valid.withColumn("k", F.explode(F.sequence(F.col("k") + 1, F.col("_to"))))

    @F.pandas_udf(COEFFICIENTS)
    def solve(cells: pd.Series) -> pd.DataFrame:
        gram, right = map(np.array, zip(*map(kn.gram_of_cells, cells)))
        fits = [kn.spread_coefficients(b0, beta) for b0, beta in zip(*kn.solve_grams(gram, right, alpha))]
        return pd.DataFrame(fits, columns=["intercept", *kn.LEVELS])

    size = F.filter("_c", lambda c: (c["i"] == 0) & (c["j"] == 0))[0]["cnt"]
    return (
        spread(dense, "node", "k")
        .groupBy("node", "k")
        .agg(F.sort_array(F.collect_list(F.struct("i", "j", "cnt", "total"))).alias("_c"))
        .select("node", "k", size.alias("n_train"), solve("_c").alias("fit"))
    )


# --- lag and calendar ridge ----------------------------------------------------

# Ten penalties from 1e-2 to 1e3, evenly spaced in the exponent.
PENALTIES = [float(a) for a in np.logspace(-2, 3, 10)]
LAGS = 4
_FEATURES = [*[f"lag_{k}" for k in range(1, LAGS + 1)], "hr", "qtr", "dow"]


def lag_frame(panel: DataFrame) -> DataFrame:
    """Complete rows of lag and calendar features with their position. Rows without a
    price are left out first, so lags are the last known prices."""
    rows = lagged(number_rows(known(panel)), range(1, LAGS + 1)).filter(F.col("rn") > LAGS)
    hr, qtr, dow, _ = calendar("timestamp")
    return rows.select(
        "node", "timestamp", "price",
        (F.col("rn") - LAGS).alias("pos"), (F.col("n") - LAGS).alias("total"),
        *[f"lag_{k}" for k in range(1, LAGS + 1)], hr, qtr, dow,
    )


def block_moments(panel: DataFrame, n_splits: int = 5) -> DataFrame:
    """Sums of products of ``(1, features, price)`` per node and validation block.

    Blocks 1..n are the test sets of an expanding split, block 0 is what precedes
    them. All sums are partial aggregates.
    """
    test = F.floor(F.col("total") / (n_splits + 1))
    block = F.greatest(
        F.lit(0), n_splits - F.floor((F.col("total") - F.col("pos")) / test)
    )
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in _FEATURES], F.col("price")]
    sums = [
        F.sum(z[a] * z[b]).alias(f"m{a}_{b}") for a in range(len(z)) for b in range(a, len(z))
    ]
    return (
        lag_frame(panel)
        .filter(F.col("total") > n_splits)
        .withColumn("block", block.cast("int"))
        .groupBy("node", "block")
        .agg(*sums)
    )


def lag_ridge_fits(
    panel: DataFrame, penalties: Sequence[float] = PENALTIES, n_splits: int = 5
) -> DataFrame:
    """Penalty chosen by expanding validation and the final fit, per node."""
    penalties = [float(a) for a in penalties]
    size = len(_FEATURES) + 2
    result = T.StructType(
        [
            T.StructField("alpha", T.DoubleType()),
            T.StructField("scores", T.ArrayType(T.DoubleType())),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("beta", T.ArrayType(T.DoubleType())),
        ]
    )
    upper = [(a, b) for a in range(size) for b in range(a, size)]

    @F.pandas_udf(result)
    def choose(blocks: pd.Series) -> pd.DataFrame:
        out = []
        for rows in blocks:
            mats = []
            for r in rows:
                m = np.zeros((size, size))
                for (a, b), v in zip(upper, r["m"]):
                    m[a, b] = m[b, a] = v
                mats.append(m)
            out.append(kn.choose_alpha(mats, penalties))
        return pd.DataFrame(out, columns=[f.name for f in result])

    moments = F.array(*[F.col(f"m{a}_{b}") for a, b in upper]).alias("m")
    return (
        block_moments(panel, n_splits)
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("block", moments))).alias("_b"))
        .select("node", choose("_b").alias("fit"))
    )


def one_step_forecast(panel: DataFrame, minutes: int = 15) -> DataFrame:
    """Price of the interval after the last known one, from the last four known prices
    and its calendar; a row without a price repeats the forecast in force.

    With fewer known prices, or too few to fit, their mean is used (0 for none).
    """
    nxt = plus_minutes(F.coalesce("_last_ts", "timestamp"), minutes)
    x = [*[F.col("_last")[k] for k in range(LAGS)], *[c.cast("double") for c in calendar(nxt)[:3]]]
    dot = F.col("fit.intercept")
    for k, c in enumerate(x):
        dot = dot + F.col("fit.beta")[k] * c
    size = F.size("_last")
    mean = F.when(size > 0, F.aggregate("_last", F.lit(0.0), lambda a, v: a + v) / size).otherwise(0.0)
    rows = last_known(panel, LAGS).join(lag_ridge_fits(panel), "node", "left")
    return rows.select(
        "node",
        nxt.alias("timestamp"),
        F.when((size == LAGS) & F.col("fit").isNotNull(), dot).otherwise(mean).alias("yhat"),
    )


_PATHS = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("origin", T.TimestampNTZType()),
        T.StructField("path", T.ArrayType(T.DoubleType())),
    ]
)


def day_paths(panel: DataFrame, minutes: int = 15) -> DataFrame:
    """Forecast path of every row to the end of its day: node, origin, path, with as
    many steps as the day has rows from the origin on; step h is for h intervals
    after the origin.

    Each forecast is a lag of the next one. The recurrence is solved by powers of its
    companion matrix, so that all steps of all origins of a node within a batch are
    two matrix products. The first step's calendar follows the last known price, as
    ``one_step_forecast`` has it.
    """

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            out = [None] * len(pdf)
            for _, part in pdf.groupby(["intercept", *[f"b{k}" for k in range(LAGS + 3)]], dropna=False, sort=False):
                weights = part.iloc[0][[f"b{k}" for k in range(LAGS + 3)]].to_numpy(float)
                steps = int(part["_left"].max())
                ahead = part["timestamp"].to_numpy()[:, None] + np.arange(1, steps + 1) * np.timedelta64(minutes, "m")
                ahead[:, 0] = part["_last_ts"].fillna(part["timestamp"]).to_numpy() + np.timedelta64(minutes, "m")
                last = [list(x) for x in part["_last"]]
                if np.isnan(weights[0]):  # no fit: the mean of what is known
                    paths = kn.lag_paths([[float(np.mean(x)) if x else 0.0] for x in last], np.zeros(ahead.shape), np.ones(1))
                else:
                    minute = ahead.astype("datetime64[m]").astype("int64")
                    hr, qtr, dow = minute // 60 % 24, minute % 60 // 15, (minute // 1440 + 3) % 7  # day 0 was a Thursday
                    inputs = part["intercept"].iloc[0] + weights[LAGS] * hr + weights[LAGS + 1] * qtr + weights[LAGS + 2] * dow
                    paths = kn.lag_paths(last, inputs, weights[:LAGS])
                for i, row, n in zip(part.index, paths, part["_left"]):
                    out[i] = row[:n]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["node", "origin", "path"]
            )

    beta = [F.col("fit.beta")[k].alias(f"b{k}") for k in range(LAGS + 3)]
    rows = last_known(panel, LAGS).join(lag_ridge_fits(panel), "node", "left")
    plain = rows.select("node", "timestamp", "_last", "_last_ts", "_left", F.col("fit.intercept").alias("intercept"), *beta)
    return plain.mapInArrow(run, _PATHS)


# --- walk-forward evaluation and registry --------------------------------------

Forecaster = Callable[[DataFrame, int, int], DataFrame]


def gridded(panel: DataFrame, minutes: int = 15) -> DataFrame:
    """Numbered regular grid; ``rn`` counts slots, gaps included."""
    return number_rows(regular_grid(panel, minutes))


def is_origin(first: int, stride: int, horizon: int) -> Column:
    """Every ``stride``-th slot after ``first``, leaving a whole horizon to compare."""
    pos = F.col("rn") - 1
    return (pos >= first) & ((pos - first) % stride == 0) & (pos < F.col("n") - horizon)


def _steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))


def _flat(rows: DataFrame, level: str, horizon: int) -> DataFrame:
    return rows.select(
        "node", F.col("timestamp").alias("origin"), _steps(horizon).alias("h"), F.col(level).alias("yhat")
    )


def forecast_last_value(grid: DataFrame, first: int, horizon: int) -> DataFrame:
    rows = previous(grid, F.col("price"), "level").filter(is_origin(first, horizon, horizon))
    return _flat(rows, "level", horizon)


def forecast_ewma(grid: DataFrame, first: int, horizon: int) -> DataFrame:
    rows = ft.slot_ewma(grid, include_current=False).filter(is_origin(first, horizon, horizon))
    return _flat(rows, "level", horizon)


def forecast_previous_day(grid: DataFrame, first: int, horizon: int) -> DataFrame:
    target = plus_minutes("origin", F.col("h") * 15)
    origins = _flat(
        grid.filter(is_origin(first, horizon, horizon)).withColumn("level", F.lit(None)), "level", horizon
    ).select("node", "origin", "h", plus_minutes(target, -1440).alias("timestamp"))
    return origins.join(grid.select("node", "timestamp", "price"), ["node", "timestamp"]).select(
        "node", "origin", "h", F.col("price").alias("yhat")
    )


def forecast_ridge(grid: DataFrame, first: int, horizon: int) -> DataFrame:
    """Calendar ridge on the whole history before each origin."""
    fits = whole_history_fits(grid, first, horizon)
    origins = grid.filter(is_origin(first, horizon, horizon)).withColumn(
        "k", F.floor((F.col("rn") - 1 - first) / horizon)
    )
    steps = origins.join(fits, ["node", "k"]).select(
        "node", F.col("timestamp").alias("origin"), _steps(horizon).alias("h"), "fit"
    )
    return steps.select(
        "node", "origin", "h",
        _calendar_value(F.col("fit"), plus_minutes("origin", F.col("h") * 15)).alias("yhat"),
    )


FORECASTERS: dict[str, Forecaster] = {
    "last_value": forecast_last_value,
    "previous_day": forecast_previous_day,
    "ewma": forecast_ewma,
    "ridge": forecast_ridge,
}


def register(name: str, forecaster: Forecaster) -> None:
    """Add a forecaster ``(grid, first, horizon) -> (node, origin, h, yhat)``."""
    FORECASTERS[name] = forecaster


Function = Callable[[pd.Series, pd.Timestamp, int], np.ndarray]


def register_function(name: str, function: Function, history: int = 672) -> None:
    """Add a plain function to the registry, see :func:`from_function`."""
    register(name, from_function(function, history))


def from_function(function: Function, history: int = 672) -> Forecaster:
    """A forecaster from a plain function ``(train, t0, horizon) -> values``.

    ``train`` is the series of the ``history`` slots before ``t0``. Each call is
    one group of at most that many rows.
    """

    def forecaster(grid: DataFrame, first: int, horizon: int) -> DataFrame:
        # Slots feed the origins that follow within ``history`` rows.
        pos = F.col("rn") - 1
        lo = F.greatest(F.lit(0), F.ceil((pos + 1 - first) / horizon))
        hi = F.floor((F.least(pos + history, F.col("n") - horizon - 1) - first) / horizon)
        feeds = (
            grid.withColumn("_lo", lo)
            .withColumn("_hi", hi)
            .filter("_lo <= _hi")
            .withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
            .withColumn(
                "origin",
                plus_minutes("timestamp", (first + F.col("_k") * horizon - pos) * 15),
            )
            .select("node", "origin", "timestamp", "price")
        )

        def call(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("timestamp")
            train = pd.Series(pdf["price"].to_numpy(), index=pd.DatetimeIndex(pdf["timestamp"]))
            t0 = pdf["origin"].iloc[0]
            yhat = np.asarray(function(train, t0, horizon), dtype=float)
            return pd.DataFrame(
                {"node": pdf["node"].iloc[0], "origin": t0, "h": range(horizon), "yhat": yhat}
            )

        return feeds.groupBy("node", "origin").applyInPandas(
            call, "node string, origin timestamp_ntz, h int, yhat double"
        )

    return forecaster


#: Slots that the table function takes in one partition, besides the lead-in.
STRETCH = 4096


def slots(grid: DataFrame, history: int = 672) -> DataFrame:
    """The table a SQL forecaster takes: numbered slots cut to stretches with the
    ``history`` slots before them, so that no partition holds a whole node."""
    return in_chunks(grid, STRETCH, lookback=history).withColumnsRenamed({"_chunk": "part", "_own": "own"})


def sql_function(
    spark: SparkSession, name: str, function: Function, history: int = 672, first: int = 1344, horizon: int = 32
) -> None:
    """Make a plain function a table function of SQL:

    ``SELECT * FROM name(TABLE(slots) PARTITION BY (node, part) ORDER BY rn)`` over a
    view of :func:`slots`. Rows of a stretch stream by in time order; only the
    ``history`` slots before the current one are held.
    """

    class Forecast:
        def __init__(self):
            self.times, self.prices = deque(maxlen=history), deque(maxlen=history)

        def eval(self, row: Row):
            place, at = row["rn"] - 1, row["timestamp"]
            if row["own"] and place >= first and (place - first) % horizon == 0 and place < row["n"] - horizon:
                train = pd.Series(np.array(self.prices, dtype=float), index=pd.DatetimeIndex(list(self.times)))
                for h, y in enumerate(np.asarray(function(train, pd.Timestamp(at), horizon), dtype=float).tolist()):
                    yield row["node"], at, h, y
            self.times.append(at)
            self.prices.append(row["price"])

    spark.udtf.register(name, F.udtf(Forecast, returnType="node string, origin timestamp_ntz, h int, yhat double"))


def walk_forward(
    panel: DataFrame,
    models: Sequence[str] = ("last_value", "previous_day", "ewma", "ridge"),
    first: int = 1344,
    horizon: int = 32,
) -> DataFrame:
    """Forecasts of every model next to the actual price; missing actuals drop out.

    The numbered grid, which every model starts from, is written once to the shared
    folder: the panel is scanned and numbered once however many models run.
    """
    spark = panel.sparkSession
    grid, path = gridded(panel), scratch(spark, "grid")
    grid.write.parquet(path)
    grid = spark.read.schema(grid.schema).parquet(path)
    parts = None
    for name in models:
        f = FORECASTERS[name](grid, first, horizon).withColumn("model", F.lit(name))
        parts = f if parts is None else parts.unionByName(f)
    actual = known(grid).select(
        "node", F.col("timestamp").alias("_ts"), F.col("price").alias("actual")
    )
    return (
        parts.filter("yhat is not null")
        .withColumn("_ts", plus_minutes("origin", F.col("h") * 15))
        .join(actual, ["node", "_ts"])
        .drop("_ts")
    )


def mean_absolute_error(evaluated: DataFrame, *keys: str) -> DataFrame:
    """Error per model (or finer), best first."""
    by = list(keys) or ["model"]
    return (
        evaluated.groupBy(*by)
        .agg(
            F.avg(F.abs(F.col("yhat") - F.col("actual"))).alias("mae"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("mae")
    )
