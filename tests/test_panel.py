"""Layouts, filters, reshaping and folds on small hand-made panels."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricepanel.operators import metrics as mt, ordering, panel as op


def day_panel(spark, nodes=("HB_HOUSTON", "HB_NORTH", "HB_WEST"), days=1, step=15):
    n = days * 1440 // step
    rows = [
        (node, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=step * i), 20 + 10 * float(np.sin(i / 15)) + k)
        for k, node in enumerate(nodes)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "node string, timestamp timestamp_ntz, price double")


def as_long(df):
    return df.select(
        F.to_date("timestamp").cast("string").alias("deliveryDate"),
        (F.hour("timestamp") + 1).alias("deliveryHour"),
        (F.minute("timestamp") / 15 + 1).cast("int").alias("deliveryInterval"),
        F.col("node").alias("settlementPoint"),
        F.col("price").alias("settlementPointPrice"),
    )


def test_long_report_to_wide(spark):
    p = day_panel(spark)
    wide = op.to_wide_strict(op.normalise_panel(as_long(p)))
    assert wide.columns == ["timestamp", "HB_HOUSTON", "HB_NORTH", "HB_WEST"]
    assert wide.count() == 96
    assert wide.dropna().count() == 96
    assert op.node_series(p, "HB_HOUSTON").count() == 96
    assert op.profile(p).first()["rows"] == 288


def test_unknown_node(spark):
    p = day_panel(spark)
    with pytest.raises(ValueError):
        op.node_series(p, "nowhere")
    assert op.node_series(p, "nowhere", fallback=True).select("node").distinct().count() == 1


def test_strict_pivot_rejects_duplicates(spark):
    p = day_panel(spark)
    with pytest.raises(Exception, match="duplicate timestamp-node"):
        op.to_wide_strict(p.unionByName(p), ["HB_WEST"]).collect()


def test_open_end_keeps_last_row(spark):
    p = day_panel(spark)
    assert op.filter_range(p).count() == 288
    assert op.filter_range(p, "2024-01", "2024-01").count() == 288
    assert op.month_bounds("2024-02", "2024-12") == ("2024-02-01", "2025-01-01")


def test_hourly_report_without_interval(spark):
    rows = spark.createDataFrame(
        [("2024-01-01", "24", "A", "5.5"), ("bad", "1", "A", "x")],
        "DeliveryDate string, DeliveryHour string, SettlementPoint string, SettlementPointPrice string",
    )
    got = op.normalise_panel(rows).collect()
    assert got[0]["timestamp"] == dt.datetime(2024, 1, 1, 23)
    assert got[1]["timestamp"] is None and got[1]["price"] is None


@pytest.mark.parametrize(
    "minutes,label", [(15, "15T"), (60, "1H"), (1440, "1D"), (5, "5min"), (1, "1min"), (30, "1800S")]
)
def test_step_labels(spark, minutes, label):
    p = day_panel(spark, ("A",), days=4, step=minutes)
    assert op.infer_step(p).first()["step"] == label


def test_single_row_counts_as_daily(spark):
    p = day_panel(spark, ("A",)).limit(1)
    assert op.infer_step(p).first()["step"] == "1D"


@pytest.mark.parametrize(
    "k,test,gap,want",
    [
        (3, 24, 0, [(132, 133, 156), (264, 265, 288)]),
        (3, 0.2, 0, [(1, 2, 58), (116, 117, 173), (231, 232, 288)]),
        (2, 24, 12, [(252, 265, 288)]),
    ],
)
def test_walk_forward_folds(spark, k, test, gap, want):
    p = day_panel(spark, ("A",), days=3)
    f = op.walk_forward_folds(p, k, test, gap)
    got = (
        f.groupBy("fold")
        .agg(
            F.max(F.when(F.col("split") == "train", F.col("rn"))).alias("train_end"),
            F.min(F.when(F.col("split") == "test", F.col("rn"))).alias("a"),
            F.max(F.when(F.col("split") == "test", F.col("rn"))).alias("z"),
        )
        .orderBy("fold")
        .collect()
    )
    assert [(r["train_end"], r["a"], r["z"]) for r in got] == want


def test_fold_errors(spark):
    p = day_panel(spark, ("A",))
    with pytest.raises(ValueError):
        op.walk_forward_folds(p, 1, 24)
    with pytest.raises(ValueError):
        op.walk_forward_folds(p, 3, 1.5)
    with pytest.raises(Exception, match="too few rows"):
        op.walk_forward_folds(p, 3, 90).collect()


def test_dedup_of_a_key_repeated_without_bound(spark):
    hot = spark.range(50_000).select(
        F.lit("A").alias("node"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("timestamp"),
        (F.col("id") * 1.0).alias("price"),
        F.col("id").alias("seq"),
    )
    assert op.dedup(hot, "seq", "last").first()["price"] == 49_999.0
    assert op.dedup(hot, "seq", "first").first()["price"] == 0.0
    assert op.duplicate_count(hot).first()["duplicates"] == 49_999


def test_numbering_and_lags_of_one_dominant_node(spark):
    p = day_panel(spark, ("A",), days=40).unionByName(day_panel(spark, ("B",)))
    got = ordering.lagged(ordering.number_rows(p), [1, 3], size=500).toPandas()
    a = got[got.node == "A"].sort_values("timestamp").reset_index(drop=True)
    assert list(a.rn) == list(range(1, 3841)) and set(a.n) == {3840}
    assert np.allclose(a.lag_3[3:], a.price[:-3]) and a.lag_3[:3].isna().all()
    assert np.allclose(a.lag_1[1:], a.price[:-1])


def test_results_without_oracle_drop_out(spark):
    rows = [("n1", "oracle_LP", 200.0), ("n1", "online_mpc_ridge", 50.0), ("n1", "online_mpc_naive", -40.0),
            ("n2", "online_mpc_ridge", 9.0)]
    df = spark.createDataFrame(
        [(*r, 1.0) for r in rows], "node string, model string, revenue double, runtime_seconds double"
    )
    det = mt.mean_results(mt.normalise_models(df))
    vs = {(r["node"], r["model"]): r["pct_of_oracle"] for r in mt.vs_oracle(det).collect()}
    assert vs == {("n1", "oracle_lp"): 100.0, ("n1", "online_mpc_ridge"): 25.0, ("n1", "online_mpc_naive"): -20.0}
    cmp = mt.naive_comparison(det).collect()
    assert len(cmp) == 1 and cmp[0]["naive_vs_ridge"] == 225.0 and cmp[0]["better_forecaster"] == "ridge"
    rel = {r["node"]: r["ridge_vs_naive"] for r in mt.relative(det).collect()}
    assert rel["n1"] == -225.0 and rel["n2"] is None


def test_grid_starts_at_the_first_row_and_fills_whole_days(spark):
    t0 = dt.datetime(2024, 1, 1, 22, 7)
    rows = [("A", t0, 1.0), ("A", t0 + dt.timedelta(minutes=40), 9.0), ("A", t0 + dt.timedelta(days=2, minutes=30), 2.0)]
    df = spark.createDataFrame(rows, "node string, timestamp timestamp_ntz, price double")
    got = op.regular_grid(df, 15).orderBy("timestamp").collect()
    assert len(got) == 2 * 96 + 3
    assert [r["timestamp"] for r in got] == [t0 + dt.timedelta(minutes=15 * k) for k in range(len(got))]
    assert [r["price"] for r in got if r["price"] is not None] == [1.0, 2.0]


def test_sketches_of_days_merge(spark):
    """Many intervals, a day that comes twice, and late rows of a day."""
    rows = spark.range(40_000).selectExpr(
        "concat('N', id % 2) AS node", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(id * 7 AS DECIMAL(18, 6))) AS timestamp"
    )
    early = op.day_sketches(rows.filter("timestamp < timestamp_ntz'2024-01-03 12:00:00'"))
    late = op.day_sketches(rows.filter("timestamp >= timestamp_ntz'2024-01-02 00:00:00'"))
    both = early.unionByName(late)
    for r in op.merged_counts(both, "node").collect():
        assert abs(r["intervals"] - 20_000) <= 3 * 1.04 / 64 * 20_000
    assert abs(op.merged_counts(both).first()["intervals"] - 40_000) <= 3 * 1.04 / 64 * 40_000
    assert op.merged_counts(both.limit(0), "node").count() == 0


def test_previous_over_parts_of_a_second(spark):
    """One second with most ticks, gaps, nulls over many parts, several keys."""
    rng = np.random.default_rng(12)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(seconds=int(s)), float(i)) for i, s in enumerate(np.sort(rng.integers(0, 400, 3000)) // 390)]
    rows += [(f"n{i % 5}", start + dt.timedelta(seconds=7 * i), None if i % 3 or i < 60 else float(i)) for i in range(300)]
    rows += [(None, start + dt.timedelta(seconds=i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "node string, timestamp timestamp_ntz, price double").repartition(5)
    got = ordering.previous(df, F.col("price"), "before").toPandas()
    assert len(got) == len(rows)
    for node in [f"n{i}" for i in range(5)]:
        own = got[got.node == node].sort_values("timestamp")
        want = own.price.ffill().shift()
        assert (own.before.isna() == want.isna()).all() and (own.before.dropna() == want.dropna()).all()
    hot = got[got.node == "hot"]
    assert hot.before.isna().sum() == 1  # every tick but one has another one before it
    assert hot.before.dropna().nunique() == len(hot) - 1
    stamps = ordering.previous(df, F.col("timestamp"), "before").filter("node = 'hot'").toPandas()
    assert (stamps.before.dropna() <= stamps.timestamp[stamps.before.notna()]).all()
    assert got[got.node.isna()].before.isna().sum() == 1
    assert ordering.previous(df.limit(0), F.col("price"), "before").count() == 0
