"""Threshold dispatch as table operators: signals, capped ledgers, audits.

The charge level is a running balance with clamps, which no window sum can
express. The daily discharge allowance restarts at midnight, so a day passes on
one number only. How the closing charge depends on the opening one is a map of a
few linear pieces, and maps compose associatively. The ledger is a tree of them:

1. up: per (node, day), independently, the day's map; per (node, year) the maps of
   its days composed to one; per node one short row per year, followed in order;
2. down: per (node, year) the opening charge of every day, from that of the year;
3. per (node, day), independently: the rows, played from the opening charge.

No group holds more than a day of prices or a year of maps, whatever the length of a
node. Models and batteries are handled side by side in arrays: prices are shuffled
once, to their day, however many models and batteries are run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pricepanel.battery import Battery
from pricepanel.functions import storage
from pricepanel.operators.features import model_names, threshold_pairs
from pricepanel.session import spread


def signal(price: Column, low: Column, high: Column) -> Column:
    """1 charge, -1 discharge, 0 hold. 2 marks a price that meets both thresholds:
    it charges, or discharges when the battery is full."""
    return (
        F.when((price <= low) & (price >= high), 2)
        .when(price <= low, 1)
        .when(price >= high, -1)
        .otherwise(0)
    )


def signals(thresholds: DataFrame) -> DataFrame:
    return thresholds.withColumn(
        "signal", signal(F.col("price"), F.col("low"), F.col("high"))
    )


def with_revenue(
    df: DataFrame, p_discharge: str = "p_discharge", p_charge: str = "p_charge", delta_t: float = 0.25
) -> DataFrame:
    """Energy delivered and its value from the two power columns."""
    mwh = (F.col(p_discharge) - F.col(p_charge)) * F.lit(delta_t)
    return df.withColumn("mwh", mwh).withColumn("revenue", F.col("mwh") * F.col("price"))


def _day_rows(signal_sets: DataFrame) -> DataFrame:
    """One row per (node, day) with the day's steps in time order.

    Maps and rows both start here and read the same columns, so they share the
    exchange (the null filters keep the two plans identical).
    """
    day = F.to_date("timestamp")
    rows = spread(
        signal_sets.filter(day.isNotNull() & F.col("node").isNotNull()).select(
            "node", day.alias("day"), "timestamp", "price", "signals"
        ),
        "node",
        "day",
    )
    steps = rows.groupBy("node", "day").agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "price", "signals"))).alias("steps")
    )
    return steps.select("node", "day", "steps.timestamp", "steps.price", "steps.signals")


class _Runs:
    """Every model with every battery, as arrays in the order of ``runs``: a run's
    signal, scenario, model and battery."""

    def __init__(self, models: Sequence[str], batteries: Sequence[Battery]):
        grid = [(k, m, i, b) for k, m in enumerate(models) for i, b in enumerate(batteries, start=1)]
        self.signal, self.model, self.scenario = (list(c) for c in list(zip(*grid))[:3])
        of = lambda name: np.array([getattr(b, name) for *_, b in grid], dtype=float)
        self.eta, self.chg, self.dis, self.e_max, self.start = map(
            of, ("eta_chg", "charge_step", "discharge_step", "e_max_mwh", "start_soc")
        )

    def __len__(self) -> int:
        return len(self.signal)

    def batteries(self, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """chg, dis and e_max of every run of every item."""
        return tuple(np.tile(v, items) for v in (self.chg, self.dis, self.e_max))

    def signals(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Signals with a row per item and run, padded with 0, and steps per item."""
        counts = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        own = flat.flatten().fill_null(0).to_numpy().reshape(len(flat), -1)[:, self.signal]
        out = np.zeros((len(counts), len(self), int(counts.max(initial=0))), np.int8)
        row = np.repeat(np.arange(len(counts)), counts)
        out[row, :, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = own
        return out.reshape(len(counts) * len(self), -1), counts


#: Days that are worked on at a time.
_SLICE = 128
_MAP = "counts array<int>, x array<double>, soc array<double>, slope array<double>"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = _SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _written(maps: storage.Maps, runs: int) -> list[pa.Array]:
    """Maps of all runs of an item as one row: pieces per run, then the pieces."""
    real = np.isfinite(maps[0])
    counts = real.sum(axis=1).reshape(-1, runs)
    ends = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
    pieces = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(m[real])) for m in maps]
    whole = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * runs, pa.int32()), pa.array(counts.ravel(), pa.int32()))
    return [whole, *pieces]


def _read(counts: pa.ListArray, *pieces: pa.ListArray) -> storage.Maps:
    return storage.ragged(tuple(p.flatten().to_numpy() for p in pieces), counts.flatten().to_numpy())


def _day_maps(days: DataFrame, runs: _Runs) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            signals, counts = runs.signals(batch.column(2))
            maps = storage.day_maps(signals, *runs.batteries(len(counts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_written(maps, len(runs))], names=["node", "day", *_names(_MAP)])

    return days.select("node", "day", "signals").mapInArrow(run, f"node string, day date, {_MAP}")


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _stretches(maps: DataFrame, key: str, group: Column) -> DataFrame:
    """Maps of a node gathered by ``group`` (null: all of it), in the order of ``key``."""
    by = ["node"] if group is None else ["node", group.alias("part")]
    gathered = maps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(key, *_names(_MAP)))).alias("m"))
    kept = ["node"] if group is None else ["node", "part"]
    return gathered.select(*kept, *[f"m.{c}" for c in (key, *_names(_MAP))])


def _in_turn(columns: list[pa.ListArray], runs: _Runs) -> Iterator[tuple[np.ndarray, storage.Maps]]:
    """For the first, second, ... map of every row that has so many: the rows' numbers
    (one per run) and their maps."""
    counts, *pieces = columns
    sizes = np.diff(counts.offsets.to_numpy())
    begin = np.cumsum(sizes) - sizes
    per_item = counts.flatten()
    maps = _read(per_item, *(p.flatten() for p in pieces))
    for t in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > t)
        at = ((begin[has] + t)[:, None] * len(runs) + np.arange(len(runs))).ravel()
        yield (has[:, None] * len(runs) + np.arange(len(runs))).ravel(), tuple(m[at] for m in maps)


def _composed(stretches: DataFrame, runs: _Runs) -> DataFrame:
    """One map per (node, part): its maps in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 32):
            n, maps = batch.num_rows, None
            e_max = runs.batteries(n)[2]
            for rows, step in _in_turn(batch.columns[3:], runs):
                if maps is None:  # every row has a first one
                    maps = step
                    continue
                some = storage.compose(tuple(m[rows] for m in maps), step, e_max[rows])
                maps = storage.merged(maps, rows, some)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_written(maps, len(runs))], names=["node", "part", *_names(_MAP)])

    return stretches.mapInArrow(run, f"node string, part int, {_MAP}")


def _followed(stretches: DataFrame, runs: _Runs, key: str, kind: str) -> DataFrame:
    """Opening and closing charges of each map's runs, from those of the stretch in
    ``soc_in`` where there is such a column, else from the battery's start."""
    names = stretches.columns
    opened = "soc_in" in names
    at = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 32):
            n, r = batch.num_rows, len(runs)
            soc = batch.column(names.index("soc_in")).flatten().to_numpy().copy() if opened else np.tile(runs.start, n)
            e_max = runs.batteries(n)[2]
            column = batch.column(at)
            sizes = np.diff(column.offsets.to_numpy())
            begin = np.cumsum(sizes) - sizes
            out = np.empty((2, int(sizes.sum()), r))
            for t, (rows, step) in enumerate(_in_turn(batch.columns[at + 1 : at + 5], runs)):
                item = begin[rows[::r] // r] + t
                out[0, item] = soc[rows].reshape(-1, r)
                soc[rows] = storage.follow(step, soc[rows], e_max[rows])
                out[1, item] = soc[rows].reshape(-1, r)
            ends = pa.array(np.arange(out.shape[1] + 1) * r, pa.int32())
            node = batch.column(0).take(pa.array(np.repeat(np.arange(n), sizes)))
            charges = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in out]
            yield pa.RecordBatch.from_arrays([node, column.flatten(), *charges], names=["node", key, "soc_in", "soc_out"])

    return stretches.mapInArrow(run, f"node string, {key} {kind}, soc_in array<double>, soc_out array<double>")


def _openings(days: DataFrame, runs: _Runs) -> DataFrame:
    """node, day, soc_in, soc_out with an entry per run: the tree up and down."""
    by_year = _stretches(_day_maps(days, runs), "day", F.year("day"))
    years = _composed(by_year, runs)
    opened = _followed(_stretches(years, "part", None), runs, "part", "int")
    return _followed(by_year.join(opened.select("node", "part", "soc_in"), ["node", "part"]).drop("part"), runs, "day", "date")


def day_balance(
    signal_sets: DataFrame, models: Sequence[str], batteries: Sequence[Battery] = (Battery(),)
) -> DataFrame:
    """Opening and closing charge per node, day, model and battery."""
    runs = _Runs(models, batteries)
    labels = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("scenario")) for m, i in zip(runs.model, runs.scenario)])
    each = F.arrays_zip(labels.alias("run"), "soc_in", "soc_out")
    rows = _openings(_day_rows(signal_sets), runs).select("node", "day", F.explode(each).alias("e"))
    return rows.select("node", "e.run.model", "e.run.scenario", "day", "e.soc_in", "e.soc_out")


def storage_ledger(
    signal_sets: DataFrame, models: Sequence[str], batteries: Sequence[Battery] = (Battery(),)
) -> DataFrame:
    """Energy, revenue and charge per row for every model and battery.

    ``signal_sets`` holds ``(node, timestamp, price, signals ARRAY<INT>)`` with one
    signal per model. The opening charges come back as one small row per day, so
    the days themselves stay where they are.
    """
    runs, days = _Runs(models, batteries), _day_rows(signal_sets)
    opened = days.join(_openings(days, runs).select("node", "day", "soc_in"), ["node", "day"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models_of, scenarios = pa.array(runs.model), np.array(runs.scenario, np.int32)
        for batch in _slices(batches):
            signals, counts = runs.signals(batch.column(3))
            n, r = len(counts), len(runs)
            before, flow = storage.play(signals, batch.column(4).flatten().to_numpy(), *runs.batteries(n))
            # Rows of the output: steps of an item within a run of it.
            item, which = np.divmod(np.arange(n * r), r)
            sizes = counts[item]
            row = np.repeat(np.arange(n * r), sizes)
            col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            source = (np.cumsum(counts) - counts)[item][row] + col
            own, out = which[row], flow[row, col]
            mwh = np.where(out < 0, out / runs.eta[own], out)
            price = batch.column(2).flatten().take(pa.array(source))
            missing = price.is_null().to_numpy(zero_copy_only=False)
            revenue = mwh * price.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(item[row])),
                    models_of.take(pa.array(own)),
                    pa.array(scenarios[own]),
                    batch.column(1).flatten().take(pa.array(source)),
                    price,
                    pa.array(signals[row, col].astype(np.int32)),
                    pa.array(before[row, col]),
                    pa.array(mwh),
                    pa.array(revenue, mask=missing),
                    pa.array(before[row, col] - out),
                ],
                names=_names(_ROW),
            )

    return opened.select("node", "timestamp", "price", "signals", "soc_in").mapInArrow(run, _ROW)


_ROW = (
    "node string, model string, scenario int, timestamp timestamp_ntz, price double, signal int, "
    "soc_before double, mwh double, revenue double, soc double"
)


def threshold_signals(
    panel: DataFrame,
    pcts: Sequence[float] = (10, 25, 45),
    window: int = 672,
    min_samples: int | None = None,
) -> DataFrame:
    """Signals of the threshold policies, one array element per percentile."""
    rows = threshold_pairs(panel, pcts, window, min_samples)
    return rows.select(
        "node",
        "timestamp",
        "price",
        F.array(
            *[
                signal(F.col("price"), F.col("pairs")[i]["low"], F.col("pairs")[i]["high"])
                for i in range(len(pcts))
            ]
        ).alias("signals"),
    )


def threshold_dispatch(
    panel: DataFrame,
    pcts: Sequence[float] = (10, 25, 45),
    batteries: Sequence[Battery] = (Battery(),),
    **options,
) -> DataFrame:
    """Full schedule of the threshold policies."""
    return storage_ledger(
        threshold_signals(panel, pcts, **options), model_names(pcts), batteries
    )


def summarise(schedule: DataFrame, keys: Sequence[str] = ("node", "model", "scenario")) -> DataFrame:
    """Totals and means of each schedule."""
    return schedule.groupBy(*keys).agg(
        F.sum("revenue").alias("revenue"),
        F.count(F.lit(1)).alias("timestamps"),
        F.avg("price").alias("mean_price"),
        F.avg("revenue").alias("mean_revenue"),
        F.sum("mwh").alias("total_mwh"),
    )


def backtest_grid(
    panel: DataFrame,
    models: Sequence[str] = ("online_quartile",),
    pcts: Sequence[float] = (10, 25, 45),
    batteries: Sequence[Battery] = (Battery(),),
    **options,
) -> DataFrame:
    """Schedule summary of every node, enabled model and battery in one job.

    The optimum is given by its bounds, as models ``oracle_lp_lower`` and
    ``oracle_lp_upper``; a bound has no schedule, so its energy is null.
    """
    from pricepanel.operators import foresight

    unknown = sorted(set(models) - {"online_quartile", "oracle_lp"})
    if unknown or not models:
        raise ValueError(f"unknown models {unknown}" if unknown else "no model given")
    parts = []
    if "online_quartile" in models:
        parts.append(summarise(threshold_dispatch(panel, pcts=pcts, batteries=batteries, **options)))
    if "oracle_lp" in models:
        seen = panel.groupBy("node").agg(F.count(F.lit(1)).alias("timestamps"), F.avg("price").alias("mean_price"))
        for b_no, b in enumerate(batteries, start=1):
            bounds = foresight.revenue_bracket(panel, b).select(
                "node", F.explode(F.create_map(*[x for k in ("lower", "upper") for x in (F.lit(f"oracle_lp_{k}"), F.col(k))])).alias("model", "revenue")
            )
            parts.append(
                bounds.join(seen, "node").select(
                    "node", "model",
                    F.lit(b_no).alias("scenario"),
                    "revenue", "timestamps", "mean_price",
                    (F.col("revenue") / F.col("timestamps")).alias("mean_revenue"),
                    F.lit(None).cast("double").alias("total_mwh"),
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spread_value(panel: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """Top/bottom spread per node and day: the k-th dearest slot against the k-th
    cheapest, as many pairs as fill the battery, each counted when it pays.

    A metric, not a bound: the order of slots within the day is ignored.
    """
    step = battery.discharge_step
    pairs = int(battery.e_max_mwh / step)
    cheap = F.slice(F.col("_p"), 1, F.least(F.size("_p"), F.lit(pairs)))
    dear = F.slice(F.reverse("_p"), 1, F.least(F.size("_p"), F.lit(pairs)))
    gain = F.zip_with(
        dear, cheap, lambda d, c: F.greatest(F.lit(0.0), F.lit(step) * (d - c / battery.eta_chg))
    )
    return (
        panel.groupBy("node", F.to_date("timestamp").alias("day"))
        .agg(F.sort_array(F.collect_list("price")).alias("_p"))
        .select(
            "node", "day",
            F.size("_p").alias("slots"),
            F.aggregate(gain, F.lit(0.0), lambda a, x: a + x).alias("spread_value"),
        )
    )


def audit(
    schedule: DataFrame,
    battery: Battery = Battery(),
    keys: Sequence[str] = ("node",),
    tolerance: float = 1e-6,
) -> DataFrame:
    """Rows per key that break a physical rule; all counts are 0 for a valid schedule."""
    tol = F.lit(tolerance)
    within = daily_window(keys)
    out, into = F.greatest("mwh", F.lit(0.0)), F.greatest(-F.col("mwh"), F.lit(0.0))
    change = battery.eta_chg * into - out
    step = battery.discharge_step
    rows = schedule.select(
        *keys,
        "timestamp",
        "soc",
        out.alias("_out"),
        (F.col("soc") - change).alias("_opening"),
        ((F.col("soc") < -tol) | (F.col("soc") > battery.e_max_mwh + tol)).alias("_soc"),
        ((out > step + tol) | (into > step + tol)).alias("_power"),
        (F.abs(F.col("revenue") - F.col("mwh") * F.col("price")) > tol).alias("_value"),
        (F.abs(F.lag("soc").over(within) + change - F.col("soc")) > tol).alias("_balance"),
    )
    # Rows are compared inside the day; days are compared through their ends.
    days = rows.groupBy(*keys, F.to_date("timestamp").alias("_day")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c).alias(c) for c in ("_soc", "_power", "_value", "_balance")],
        F.sum("_out").alias("_total"),
        F.min_by("_opening", "timestamp").alias("_first"),
        F.max_by("soc", "timestamp").alias("_last"),
    )
    handed_over = F.coalesce(
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day")),
        F.lit(battery.start_soc),
    )
    days = days.withColumn(
        "_break", (F.abs(handed_over - F.col("_first")) > tol).cast("int")
    )
    return days.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("_soc").alias("bad_soc"),
        F.sum("_power").alias("bad_power"),
        F.sum("_value").alias("bad_revenue"),
        F.sum(F.col("_balance") + F.col("_break")).alias("bad_balance"),
        F.count_if(F.col("_total") > battery.e_max_mwh + tol).alias("bad_days"),
    )


def daily_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, F.to_date("timestamp")).orderBy("timestamp")
