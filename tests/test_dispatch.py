"""Ledgers by hand and by invariants; bounds and audits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricepanel.battery import Battery
from pricepanel.operators import dispatch, foresight

BATTERIES = [Battery(), Battery(eta_chg=0.87, p_max_mw=31.0, e_max_mwh=77.0, initial_soc_frac=0.3)]


def prices(spark, days=6, seed=5, decimals=0, nodes=("A", "B")):
    """Skewed random prices with gaps and some negative ones."""
    rng = np.random.default_rng(seed)
    slots = [dt.datetime(2024, 2, 26) + dt.timedelta(minutes=15 * i) for i in range(96 * days)]
    rows = [
        (node, t, float(p))
        for node in nodes
        for t, p, there in zip(slots, np.round(rng.gamma(2, 12, len(slots)) - 6, decimals), rng.random(len(slots)) < 0.9)
        if there
    ]
    return spark.createDataFrame(rows, "node string, timestamp timestamp_ntz, price double")


def day(spark, values, start="2024-01-01"):
    first = dt.datetime.fromisoformat(start)
    rows = [("A", first + dt.timedelta(minutes=15 * i), float(p)) for i, p in enumerate(values)]
    return spark.createDataFrame(rows, "node string, timestamp timestamp_ntz, price double")


def test_hand_computed_schedule(spark):
    """With a window of two rows the lower price charges and the higher discharges."""
    b = Battery(eta_chg=0.5, p_max_mw=40.0, e_max_mwh=20.0, initial_soc_frac=0.5)
    p = day(spark, [10, 5, 8, 2, 9, 9, 1, 7])
    led = dispatch.threshold_dispatch(p, pcts=(10,), batteries=[b], window=2, min_samples=2).toPandas().sort_values("timestamp")
    # 5 of 10 MWh taken are stored; a sale is 10, and 20 a day at most, so the last one is void.
    # The sixth price meets both thresholds of its window and charges.
    assert led.mwh.tolist() == [-10, -10, 10, -10, 10, -10, -10, 0]
    assert led.soc.tolist() == [15, 20, 10, 15, 5, 10, 15, 15]


def test_both_thresholds_meet(spark):
    """A constant price meets both thresholds: charge until full, then discharge and refill in turn."""
    led = dispatch.threshold_dispatch(day(spark, [5.0] * 96), pcts=(10,), min_samples=30).toPandas().sort_values("timestamp")
    assert set(led.signal) == {1, 2}
    b = Battery()
    full = led.soc_before >= b.e_max_mwh
    assert (led.mwh[full & (led.signal == 2)] == b.discharge_step).all()
    assert (led.mwh[~full] < 0).all()


def test_ledger_invariants(spark):
    led = dispatch.threshold_dispatch(prices(spark, decimals=-1), pcts=(45,), batteries=BATTERIES, window=96, min_samples=30).toPandas()
    for k, b in enumerate(BATTERIES, start=1):
        own = led[led.scenario == k]
        assert own.soc.between(-1e-9, b.e_max_mwh + 1e-9).all()
        assert (own.mwh <= b.discharge_step + 1e-9).all() and (own.mwh >= -b.charge_step / b.eta_chg - 1e-9).all()
        assert np.allclose(own.revenue, own.mwh * own.price)
        out, into = own.mwh.clip(lower=0), -own.mwh.clip(upper=0)
        assert np.allclose(own.soc - own.soc_before, b.eta_chg * into - out)
        assert (out.groupby([own.node, own.timestamp.dt.date]).sum() <= b.e_max_mwh + 1e-9).all()
        # Every row does as much of what its signal says as the limits let it.
        idle = own[(own.signal == 1) & (own.mwh == 0)]
        assert np.allclose(idle.soc_before, b.e_max_mwh)
        assert (own.mwh[own.signal == 0] == 0).all() and (own.mwh[own.signal == -1] >= 0).all()


def test_audit_finds_faults(spark):
    good = dispatch.threshold_dispatch(prices(spark)).filter("model = 'online_quartile_p25'")
    assert {tuple(r)[2:] for r in dispatch.audit(good).collect()} == {(0, 0, 0, 0, 0)}
    bad = good.withColumn("soc", F.when(F.hour("timestamp") == 5, F.lit(-1.0)).otherwise(F.col("soc")))
    row = dispatch.audit(bad).first()
    assert row["bad_soc"] > 0 and row["bad_balance"] > 0
    fast = dispatch.audit(good.withColumn("mwh", F.col("mwh") * 2)).first()
    assert fast["bad_power"] > 0 and fast["bad_revenue"] > 0


def test_bounds_hold_for_every_policy(spark):
    p = prices(spark)
    bound = {r["node"]: r for r in foresight.revenue_bracket(p).collect()}
    grid = dispatch.backtest_grid(p, models=("online_quartile", "oracle_lp"), window=96)
    for r in grid.collect():
        b = bound[r["node"]]
        assert b["lower"] <= b["upper"]
        assert r["revenue"] <= b["upper"]
        assert r["revenue"] != 0


def test_day_balance_matches_ledger(spark):
    p = prices(spark)
    sig = dispatch.threshold_signals(p, (10, 45), window=96)
    keys = ["node", "model", "scenario"]
    days = dispatch.day_balance(sig, ["a", "b"], BATTERIES).toPandas()
    days = days.sort_values([*keys, "day"]).reset_index(drop=True)
    led = dispatch.storage_ledger(sig, ["a", "b"], BATTERIES).toPandas()
    led["day"] = led.timestamp.dt.date
    last = led.sort_values("timestamp").groupby([*keys, "day"]).soc.last().reset_index()
    assert np.allclose(days.soc_out, last.soc)


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        dispatch.backtest_grid(prices(spark, days=1), models=("online_quartile", "other"))
