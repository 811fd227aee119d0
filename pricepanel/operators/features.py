"""Window features of a price panel, split over time chunks where frames allow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricepanel.functions.kernels import trailing_cuts, trailing_known
from pricepanel.functions.timegrid import calendar, minute_of_day, plus_minutes
from pricepanel.operators.ordering import (
    expanding_moments,
    in_chunks,
    lagged,
    number_rows,
)
from pricepanel.session import spread

WEEK = 672  # quarter hours
INF = float("inf")


def min_history(window: int) -> int:
    """Smallest sample a threshold is computed from."""
    return max(30, window // 10)


def trailing_quantiles(
    panel: DataFrame,
    shares: Sequence[float],
    window: int = WEEK,
    with_current: bool = True,
) -> DataFrame:
    """Add ``cuts`` (one quantile per share over the known prices among the last
    ``window`` rows of the node) and ``n_hist`` (how many are known).

    Rows are grouped into chunks of two windows plus one window of lead-in. A chunk is
    one Arrow value; a rank index over it answers every window in a few steps, so long
    windows cost little more than short ones.
    """
    shares = [float(s) for s in shares]
    lookback = window - 1 if with_current else window
    chunks = spread(in_chunks(number_rows(panel), 2 * window, lookback), "node", "_chunk")
    grouped = (
        chunks.groupBy("node", "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "timestamp", "price", "_own"))).alias("_r"))
        .select("node", "_r.rn", "_r.timestamp", "_r.price", "_r._own")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rn, ts, price, own = (batch.column(c)[i].values for c in range(1, 5))
                first = int(np.argmax(own.to_numpy(zero_copy_only=False)))  # own rows follow the lead-in
                values = price.to_numpy(zero_copy_only=False).astype(float)
                found = trailing_cuts(values, window, shares, with_current, first)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.full(n, i))),
                        *(c.slice(first) for c in (ts, price, rn)),
                        pa.array(trailing_known(values, window, with_current)[first:]),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(shares), pa.int32()), pa.array(found.ravel())),
                    ],
                    names=["node", "timestamp", "price", "rn", "n_hist", "cuts"],
                )

    fields = "node string, timestamp timestamp_ntz, price double, rn bigint, n_hist int, cuts array<double>"
    return grouped.mapInArrow(run, fields)


def _threshold(cut: Column, min_samples: int) -> Column:
    return F.when(F.col("n_hist") < min_samples, F.lit(INF)).otherwise(cut)


def thresholds(
    panel: DataFrame,
    pct: float = 10.0,
    window: int = WEEK,
    min_samples: int | None = None,
) -> DataFrame:
    """Lower and upper trailing percentile; both infinite below the minimum sample."""
    need = min_history(window) if min_samples is None else min_samples
    q = trailing_quantiles(panel, [pct / 100, (100 - pct) / 100], window)
    return q.select(
        "node", "timestamp", "price", "n_hist",
        _threshold(F.col("cuts")[0], need).alias("low"),
        _threshold(F.col("cuts")[1], need).alias("high"),
    )


def threshold_pairs(
    panel: DataFrame,
    pcts: Sequence[float] = (10, 25, 45),
    window: int = WEEK,
    min_samples: int | None = None,
) -> DataFrame:
    """Thresholds of several percentiles from one pass over the sorted windows, as
    an array ``pairs`` of ``(low, high)`` in the order of ``pcts``."""
    need = min_history(window) if min_samples is None else min_samples
    shares = [p / 100 for p in pcts] + [(100 - p) / 100 for p in pcts]
    q = trailing_quantiles(panel, shares, window)
    pairs = F.array(
        *[
            F.struct(
                _threshold(F.col("cuts")[i], need).alias("low"),
                _threshold(F.col("cuts")[i + len(pcts)], need).alias("high"),
            )
            for i in range(len(pcts))
        ]
    )
    return q.select("node", "timestamp", "price", pairs.alias("pairs"))


def model_names(pcts: Sequence[float]) -> list[str]:
    return [f"online_quartile_p{p:g}" for p in pcts]


def threshold_models(panel: DataFrame, pcts: Sequence[float] = (10, 25, 45), **options) -> DataFrame:
    """Thresholds with one row per (node, timestamp, model)."""
    rows = threshold_pairs(panel, pcts, **options)
    models = [
        F.struct(
            F.lit(m).alias("model"),
            F.col("pairs")[i]["low"].alias("low"),
            F.col("pairs")[i]["high"].alias("high"),
        )
        for i, m in enumerate(model_names(pcts))
    ]
    return rows.select("node", "timestamp", "price", F.inline(F.array(*models)))


def price_regime(panel: DataFrame, window: int = 288, min_samples: int = 20) -> DataFrame:
    """0 below the first, 2 above the third quartile of the previous prices, else 1."""
    q = trailing_quantiles(panel, [0.25, 0.75], window, with_current=False)
    regime = (
        F.when(F.col("n_hist") < min_samples, 1)
        .when(F.col("price") < F.col("cuts")[0], 0)
        .when(F.col("price") > F.col("cuts")[1], 2)
        .otherwise(1)
    )
    return q.select("node", "timestamp", "price", regime.alias("price_bin"))


def charge_bin(soc: Column, width: float = 50.0, top: int = 3) -> Column:
    return F.least(F.floor(soc / width), F.lit(top)).cast("int")


def state_code(price_bin: Column, soc_bin: Column) -> Column:
    return price_bin * 10 + soc_bin


def calendar_features(panel: DataFrame) -> DataFrame:
    return panel.select("*", *calendar("timestamp"))


def lag_features(panel: DataFrame, max_lag: int = 4) -> DataFrame:
    return lagged(number_rows(panel), range(1, max_lag + 1))


def context_features(panel: DataFrame) -> DataFrame:
    """Expanding z-score over strictly earlier rows and hours left in the day.

    Without history the mean is 0 and the variance 1; a zero spread gives 0.
    """
    m = expanding_moments(panel)
    mean = F.coalesce(F.col("mean_before"), F.lit(0.0))
    std = F.sqrt(F.coalesce(F.col("var_before"), F.lit(1.0)))
    return m.select(
        "node", "timestamp", "price",
        F.when(std == 0, F.lit(0.0)).otherwise((F.col("price") - mean) / std).alias("z_price"),
        ((24 - minute_of_day("timestamp") / 60) / 24).alias("hrs_left"),
    )


def charge_share(soc: Column, e_max: float | Column = 200.0) -> Column:
    return soc / e_max


def discharged_today(schedule: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Energy discharged since midnight before each row (a day is a bounded group)."""
    w = (
        Window.partitionBy(*keys, F.to_date("timestamp"))
        .orderBy("timestamp")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return schedule.withColumn(
        "used_before", F.coalesce(F.sum(F.greatest("mwh", F.lit(0.0))).over(w), F.lit(0.0))
    )


def slot_ewma(
    panel: DataFrame, alpha: float = 0.2, include_current: bool = True, block: int = 64
) -> DataFrame:
    """Exponentially weighted level of the same time-of-day slot, over all history.

    Weights are normalised. A null price on a regular grid ages the level without
    entering it. A slot's rows, one a day, are cut into blocks: the weighted sums of
    a block are folded inside it, and those of earlier blocks are carried over, aged
    by the rows since. The result doesn't depend on ``block``.
    """
    keep = 1.0 - alpha
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    slot = panel.withColumn("_slot", minute_of_day("timestamp"))
    series = Window.partitionBy("node", "_slot")
    place = F.row_number().over(series.orderBy("timestamp")) - 1
    rows = slot.withColumn("_b", F.floor(place / block))
    inside = Window.partitionBy("node", "_slot", "_b").orderBy("timestamp")

    def fold(frame) -> Column:
        return F.aggregate(
            F.collect_list(F.struct("price")).over(frame),
            zero,
            lambda s, x: F.struct(
                (s["num"] * keep + F.coalesce(x["price"], F.lit(0.0))).alias("num"),
                (s["den"] * keep + x["price"].isNotNull().cast("double")).alias("den"),
            ),
        )

    upto = (Window.unboundedPreceding, 0 if include_current else -1)
    rows = rows.withColumn("_s", fold(inside.rowsBetween(*upto))).withColumn(
        "_k", F.count(F.lit(1)).over(inside.rowsBetween(*upto))
    )
    ends = (
        slot.withColumn("_b", F.floor(place / block))
        .groupBy("node", "_slot", "_b")
        .agg(F.sort_array(F.collect_list(F.struct("timestamp", "price"))).alias("_r"))
        .select(
            "node", "_slot", "_b",
            F.size("_r").alias("_n"),
            F.aggregate(
                "_r",
                zero,
                lambda s, x: F.struct(
                    (s["num"] * keep + F.coalesce(x["price"], F.lit(0.0))).alias("num"),
                    (s["den"] * keep + x["price"].isNotNull().cast("double")).alias("den"),
                ),
            ).alias("_t"),
        )
    )
    earlier = series.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "node", "_slot", "_b",
        F.aggregate(
            F.collect_list(F.struct("_n", "_t")).over(earlier),
            zero,
            lambda s, x: F.struct(
                (s["num"] * F.pow(F.lit(keep), x["_n"]) + x["_t"]["num"]).alias("num"),
                (s["den"] * F.pow(F.lit(keep), x["_n"]) + x["_t"]["den"]).alias("den"),
            ),
        ).alias("_c"),
    )
    aged = F.pow(F.lit(keep), F.col("_k"))
    num = F.col("_c.num") * aged + F.col("_s.num")
    den = F.col("_c.den") * aged + F.col("_s.den")
    return rows.join(carried, ["node", "_slot", "_b"]).select(
        *panel.columns, F.when(den > 0, num / den).alias("level")
    )


def last_value_forecast(panel: DataFrame, horizon: int = 32) -> DataFrame:
    """The current price for every step of the horizon, step 0 being the row itself."""
    return panel.select(
        "node",
        F.col("timestamp").alias("origin"),
        F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"),
        F.col("price").alias("yhat"),
    )


def previous_day_price(panel: DataFrame) -> DataFrame:
    """The same slot one day earlier; rows without one are dropped."""
    earlier = panel.select(
        "node",
        plus_minutes("timestamp", 1440).alias("timestamp"),
        F.col("price").alias("yhat"),
    )
    return panel.join(earlier, ["node", "timestamp"])


def intervals_left(panel: DataFrame) -> DataFrame:
    """Rows left in the day, the current one included."""
    w = (
        Window.partitionBy("node", F.to_date("timestamp"))
        .orderBy("timestamp")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    return panel.withColumn("left_in_day", F.count(F.lit(1)).over(w))
