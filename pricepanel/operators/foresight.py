"""Value of perfect price knowledge, as bounds over the whole horizon.

The optimal plan is a chain over days that passes on only the charge level. Per
(node, day) a transfer table gives the best revenue for every opening and closing
level; tables compose with (max, +) products. Days become months in parallel and
months are folded per node, so no group holds more than a month of tables.

Two level grids bracket the continuous optimum: one unit per charging interval
slightly more than the charger can store (upper), or exactly what it can store and
slightly less than can be delivered (lower).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pricepanel.battery import Battery
from pricepanel.functions import kernels as kn
from pricepanel.session import spread

_TABLE = T.ArrayType(T.DoubleType())
_EPS = 1e-9


@dataclass(frozen=True)
class Grid:
    unit: float
    levels: int
    start: int
    cap: int


def upper_grid(b: Battery) -> Grid:
    """Relaxation: room below and above the start, and the allowance, rounded up."""
    u = b.discharge_step
    below = ceil(b.start_soc / u - _EPS)
    above = ceil((b.e_max_mwh - b.start_soc) / u - _EPS)
    return Grid(u, below + above + 1, below, ceil(b.e_max_mwh / u - _EPS))


def lower_grid(b: Battery) -> Grid:
    """Restriction: levels that full-power charging reaches, rounded down."""
    u = b.charge_step
    below = floor(b.start_soc / u + _EPS)
    above = floor((b.e_max_mwh - b.start_soc) / u + _EPS)
    return Grid(u, below + above + 1, below, floor(b.e_max_mwh / u + _EPS))


def day_tables(panel: DataFrame, grid: Grid, eta: float) -> DataFrame:
    """Flattened transfer table per (node, day)."""

    @F.pandas_udf(_TABLE)
    def table(prices: pd.Series) -> pd.Series:
        return pd.Series(
            [kn.day_transfer(p, grid.levels, grid.cap, grid.unit, eta).ravel() for p in prices]
        )

    day = F.to_date("timestamp").alias("day")
    return (
        spread(panel.filter("price is not null").select("node", day, "timestamp", "price"), "node", "day")
        .groupBy("node", "day")
        .agg(F.sort_array(F.collect_list(F.struct("timestamp", "price"))).alias("_r"))
        .select("node", "day", table("_r.price").alias("table"))
    )


def composed_by(tables: DataFrame, period: Column, levels: int) -> DataFrame:
    """Tables of consecutive days multiplied per (node, period)."""

    @F.pandas_udf(_TABLE)
    def product(parts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                kn.compose([np.asarray(t, dtype=float).reshape(levels, levels) for t in p]).ravel()
                for p in parts
            ]
        )

    return (
        tables.withColumn("period", period)
        .groupBy("node", "period")
        .agg(F.sort_array(F.collect_list(F.struct("day", "table"))).alias("_t"))
        .select("node", "period", product("_t.table").alias("table"))
    )


def best_revenue(panel: DataFrame, grid: Grid, eta: float) -> DataFrame:
    """Best revenue per node from the start level to any final level."""
    k = grid.levels
    months = composed_by(day_tables(panel, grid, eta), F.trunc("day", "month"), k)
    never = F.lit(float("-inf"))
    start = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.when(i == grid.start, F.lit(0.0)).otherwise(never),
    )

    def step(value: Column, month: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda j: F.array_max(
                F.transform(value, lambda v, i: v + F.get(month["table"], i * k + j))
            ),
        )

    return (
        months.groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("period", "table"))).alias("_m"))
        .select("node", F.array_max(F.aggregate("_m", start, step)).alias("revenue"))
    )


def revenue_bracket(panel: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """Lower and upper bound of the perfect-foresight revenue per node."""
    low = best_revenue(panel, lower_grid(battery), battery.eta_chg)
    high = best_revenue(panel, upper_grid(battery), battery.eta_chg)
    return low.withColumnRenamed("revenue", "lower").join(
        high.withColumnRenamed("revenue", "upper"), "node"
    )
