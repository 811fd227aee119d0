"""The stream over several micro-batches equals the batch ledger."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pricepanel.operators import dispatch, panel as op
from pricepanel.streaming import ledger


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    rng = np.random.default_rng(9)
    start = dt.datetime(2024, 3, 10)
    rows = [
        (node, start + dt.timedelta(minutes=float(m)), float(np.round(rng.exponential(40), 2)))
        for node in ("A", "B")
        for m in np.sort(rng.uniform(0, 3 * 1440, 900))
    ]
    rows.sort(key=lambda r: r[1])
    late = ("A", start + dt.timedelta(minutes=5), 9999.0)
    schema = "node string, timestamp timestamp_ntz, price double"
    source = str(tmp_path / "in")
    parts = [rows[:600], rows[600:1200], rows[1200:] + [late]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    ticks = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    out = ledger.run_available(
        ledger.ledger_stream(ticks, pct=25, window=96, min_samples=30),
        str(tmp_path / "out"),
        str(tmp_path / "ckpt"),
    ).toPandas()
    clean = spark.createDataFrame(rows, schema)
    panel = op.bucket_mean(clean, "15 minutes").withColumn("price", F.round("price", 6))
    want = dispatch.threshold_dispatch(panel, pcts=(25,), window=96, min_samples=30).toPandas()
    closed = rows[-1][1] - dt.timedelta(minutes=10)
    want = want[want.timestamp + dt.timedelta(minutes=15) <= closed]
    a = out.sort_values(["node", "timestamp"]).reset_index(drop=True)
    b = want.sort_values(["node", "timestamp"]).reset_index(drop=True)
    assert len(a) == len(b) > 300
    assert (a.timestamp == b.timestamp).all()
    assert np.allclose(a[["price", "mwh", "soc"]], b[["price", "mwh", "soc"]])


def ticks_with_nulls(seed=4, minutes=4 * 1440):
    """One tick a quarter hour; every third price is missing."""
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 3, 10)
    return [
        ("A", start + dt.timedelta(minutes=15 * i + 3), None if i % 3 == 1 else float(np.round(rng.exponential(40), 2)))
        for i in range(minutes // 15)
    ]


def ledger_of(spark, rows, tmp_path, name, **options):
    source = str(tmp_path / name)
    for k in range(0, len(rows), 150):
        spark.createDataFrame(rows[k : k + 150], ledger.TICK).coalesce(1).write.mode("append").parquet(source)
    ticks = spark.readStream.schema(ledger.TICK).option("maxFilesPerTrigger", 1).parquet(source)
    end = str(tmp_path / f"{name}-end")
    stream = ledger.ledger_stream(ledger.ended_by(ticks, end), pct=25, window=96, min_samples=30, **options)
    out = ledger.run_available(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"), end=end)
    return out.toPandas().sort_values("timestamp").reset_index(drop=True)


def batch_of(spark, rows):
    panel = op.bucket_mean(spark.createDataFrame(rows, ledger.TICK), "15 minutes").withColumn("price", F.round("price", 6))
    return dispatch.threshold_dispatch(panel, pcts=(25,), window=96, min_samples=30)


def assert_same(got, want):
    want = want.sort_values("timestamp").reset_index(drop=True)
    assert len(got) == len(want) > 100
    assert (got.timestamp == want.timestamp).all() and (got.signal == want.signal).all()
    assert (got.revenue.isna() == got.price.isna()).all()
    assert np.allclose(got[["price", "mwh", "soc", "revenue"]], want[["price", "mwh", "soc", "revenue"]], equal_nan=True)


def test_missing_prices_are_gaps_and_the_last_window_closes(spark, tmp_path):
    rows = ticks_with_nulls()
    got = ledger_of(spark, rows, tmp_path, "a")
    want = batch_of(spark, rows).toPandas()
    assert got.price.isna().sum() == len(rows) // 3
    assert_same(got, want)


def test_stream_goes_on_from_a_batch_ledger(spark, tmp_path):
    rows = ticks_with_nulls()
    half = len(rows) // 2 + 5
    initial = ledger.state_after(batch_of(spark, rows[:half]), window=96)
    got = ledger_of(spark, rows[half:], tmp_path, "b", initial=initial)
    whole = batch_of(spark, rows).toPandas()
    assert_same(got, whole[whole.timestamp > rows[half - 1][1]])
