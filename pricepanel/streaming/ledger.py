"""The threshold ledger on a stream of raw ticks.

Ticks become a quarter-hour panel by a watermarked tumbling window; ticks behind
the watermark are dropped. Closed windows reach a keyed processor in time order,
which keeps the charge, the day's use and the trailing prices of each node, the
latter as a list that is appended to. A window without a known price is a gap: it
ages the history, counts for nothing and moves no energy.

A stream may start from a batch ledger (``state_after``), and end: a mark in a second
source, put there when the first one is exhausted, moves event time past the last
window, so that it closes as well (``ended_by``, ``run_available``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pricepanel.battery import Battery
from pricepanel.functions.kernels import trailing_cuts, trailing_known
from pricepanel.functions.timegrid import from_instant, to_instant
from pricepanel.operators.features import WEEK, min_history
from pricepanel.operators.ordering import number_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE = T.StructType(
    [
        T.StructField("soc", T.DoubleType()),
        T.StructField("used", T.DoubleType()),
        T.StructField("day", T.StringType()),
    ]
)
PRICE = T.StructType([T.StructField("price", T.DoubleType())])
TICK = "node string, timestamp timestamp_ntz, price double"
OUTPUT = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("signal", T.LongType()),
        T.StructField("mwh", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("soc", T.DoubleType()),
    ]
)


class LedgerProcessor(StatefulProcessor):
    """One battery per node under a threshold policy."""

    def __init__(self, battery: Battery, pct: float, window: int, min_samples: int):
        self.battery, self.pct, self.window, self.need = battery, pct, window, min_samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", STATE)
        self.prices = handle.getListState("prices", PRICE)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        self.state.update((float(row["soc"]), float(row["used"]), row["day"]))
        self.prices.put([(None if p is None or np.isnan(p) else float(p),) for p in row["prices"]])

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        b = self.battery
        fresh = pd.concat(list(rows)).sort_values("us")
        soc, used, day = self.state.get() if self.state.exists() else (b.start_soc, 0.0, None)
        kept = [np.nan if p is None else p for (p,) in self.prices.get()] if self.prices.exists() else []
        added = fresh["price"].astype(float).to_numpy()
        prices = np.concatenate([kept, added])
        shares = [self.pct / 100, (100 - self.pct) / 100]
        cuts = trailing_cuts(prices, self.window, shares, True, len(kept))
        known = trailing_known(prices, self.window, True)[len(kept) :]
        out = []
        for us, today, price, (low, high), n in zip(fresh["us"], fresh["day"], added, cuts, known):
            if today != day:
                used, day = 0.0, today
            if n < self.need:
                low = high = np.inf
            take = give = 0.0
            # Comparisons with an unknown price are false.
            if price <= low and soc < b.e_max_mwh:
                take = min(b.charge_step, b.e_max_mwh - soc)
            elif price >= high:
                give = min(b.discharge_step, soc, b.e_max_mwh - used)
            signal = 2 if low >= price >= high else 1 if price <= low else -1 if price >= high else 0
            soc, used = soc + take - give, used + give
            mwh = give - take / b.eta_chg
            out.append((key[0], us, price, signal, mwh, mwh * price, soc))
        self.state.update((float(soc), float(used), day))
        as_rows = [(None if np.isnan(p) else float(p),) for p in (prices[1 - self.window :] if len(prices) > 2 * self.window else added)]
        # Prices are appended; the list is cut back once it holds two windows.
        if len(prices) > 2 * self.window:
            self.prices.put(as_rows)
        elif self.prices.exists():
            self.prices.appendList(as_rows)
        else:
            self.prices.put(as_rows)
        yield pd.DataFrame(out, columns=[f.name for f in OUTPUT])

    def close(self) -> None:
        pass


def panel_stream(ticks: DataFrame, delay: str = "10 minutes", freq: str = "15 minutes") -> DataFrame:
    """Closed windows of a tick stream ``(node, timestamp, price)``."""
    timed = ticks.withColumn("timestamp", to_instant("timestamp")).withWatermark(
        "timestamp", delay
    )
    # Marks of the end have no node. A filter on the node itself would be moved below
    # the watermark, which then never saw them; one on a count stays above it.
    closed = timed.groupBy("node", F.window("timestamp", freq).alias("_w")).agg(F.avg("price").alias("price"), F.count("node").alias("_n"))
    return closed.filter("_n > 0").select("node", F.col("_w.start").alias("timestamp"), "price")


def ended_by(ticks: DataFrame, folder: str) -> DataFrame:
    """``ticks`` and the marks of the end that ``run_available`` puts into ``folder``."""
    spark = ticks.sparkSession
    spark.createDataFrame([], TICK).write.mode("ignore").parquet(folder)
    return ticks.unionByName(spark.readStream.schema(TICK).parquet(folder))


def state_after(schedule: DataFrame, window: int = WEEK) -> DataFrame:
    """What a stream has to know to go on after a batch ledger of one model and
    battery: node, soc, used, day and the last prices."""
    last = number_rows(schedule).filter(F.col("rn") > F.col("n") - window)
    day = F.to_date("timestamp")
    closing = schedule.groupBy("node", day.alias("day")).agg(
        F.sum(F.greatest("mwh", F.lit(0.0))).alias("used"), F.max_by("soc", "timestamp").alias("soc")
    )
    at_end = closing.groupBy("node").agg(F.max(F.struct("day", "used", "soc")).alias("x"))
    prices = last.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rn", "price"))).alias("r"))
    return at_end.join(prices, "node").select(
        "node", "x.soc", "x.used", F.col("x.day").cast("string").alias("day"), F.col("r.price").alias("prices")
    )


def ledger_stream(
    ticks: DataFrame,
    battery: Battery = Battery(),
    pct: float = 10.0,
    window: int = WEEK,
    min_samples: int | None = None,
    delay: str = "10 minutes",
    initial: DataFrame | None = None,
) -> DataFrame:
    """Schedule rows as windows close, from the state ``initial`` where a node has one.
    Needs the RocksDB state store."""
    need = min_history(window) if min_samples is None else min_samples
    # Times enter Python as numbers, so no worker applies a time zone to them.
    panel = panel_stream(ticks, delay).select(
        "node",
        F.unix_micros("timestamp").alias("us"),
        F.to_date(from_instant("timestamp")).cast("string").alias("day"),
        F.round("price", 6).alias("price"),
    )
    rows = panel.groupBy("node").transformWithStateInPandas(
        statefulProcessor=LedgerProcessor(battery, pct, window, need),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="None",
        initialState=None if initial is None else initial.groupBy("node"),
    )
    return naive(rows.withColumn("timestamp", F.timestamp_micros("us"))).select(
        "node", "timestamp", "price", "signal", "mwh", "revenue", "soc"
    )


def naive(rows: DataFrame) -> DataFrame:
    """Event times of a stream back as naive local time."""
    return rows.withColumn("timestamp", from_instant("timestamp"))


def run_available(
    stream: DataFrame, path: str, checkpoint: str, stores: int | None = None, end: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Process what the source holds now into Parquet at ``path`` and read it back.

    A stream keeps the number of state stores it is first started with; ``stores``
    sets it, and the session's shuffle width is the default. The call returns when
    the source is exhausted, however long that takes. Rows of the window that the
    watermark has not passed stay in the checkpoint and come with the next call, or
    at once if ``end`` names the folder of ``ended_by``: a mark there moves event time
    two delays and an hour ahead, and later ticks of that stretch would be late.
    """
    spark: SparkSession = stream.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if stores is not None:
        settings["spark.sql.shuffle.partitions"] = str(stores)
    before = {k: spark.conf.get(k, None) for k in settings}

    def run() -> StreamingQuery:
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            q = (
                stream.writeStream.outputMode("append")
                .format("parquet")
                .option("path", path)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
            )
        finally:
            # A started stream has its own copy of them.
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        q.awaitTermination()
        return q

    q = run()
    reached = [p["eventTime"]["watermark"] for p in q.recentProgress if "watermark" in (p["eventTime"] or {})]
    if end is not None and reached:
        past = F.to_timestamp_ltz(F.lit(max(reached))) + F.expr(f"INTERVAL {delay}") * 2 + F.expr("INTERVAL 1 hour")
        mark = spark.range(1).select(F.lit(None).cast("string").alias("node"), from_instant(past).alias("timestamp"), F.lit(None).cast("double").alias("price"))
        mark.write.mode("append").parquet(end)
        run()
    return spark.read.schema(stream.schema).parquet(path)
