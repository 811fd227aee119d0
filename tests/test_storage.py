"""Charge maps against playing every start, and their composition against a sequence."""

import datetime as dt

import numpy as np
import pytest

from pricepanel.battery import Battery
from pricepanel.functions import storage as st
from pricepanel.operators import dispatch

BATTERIES = [(5.9375, 6.25, 200.0), (6.7, 7.75, 77.0), (11.25, 12.5, 20.0)]


def days(n, rng, kinds):
    out = rng.choice(kinds, (n, 96))
    out[rng.random((n, 96)) < 0.4] = 0
    out[: n // 4, int(rng.integers(1, 90)) :] = 0  # short days are padded
    return out


@pytest.mark.parametrize("kinds", [(0, 1, -1), (0, 1, -1, 2), (-1,), (1,), (0,), (2,)])
@pytest.mark.parametrize("battery", BATTERIES)
def test_maps_equal_playing(kinds, battery):
    rng = np.random.default_rng(len(kinds))
    n = 120
    chg, dis, e_max = (np.full(n, v) for v in battery)
    signals = days(n, rng, kinds)
    maps = st.day_maps(signals, chg, dis, e_max)
    for start in (np.zeros(n), e_max, *(rng.random(n) * e_max for _ in range(20))):
        want = st.play(signals, start, chg, dis, e_max)[0][:, -1]
        assert np.allclose(st.follow(maps, start, e_max), want, atol=1e-8)


@pytest.mark.parametrize("kinds", [(0, 1, -1), (0, 1, -1, 1, -1, 2)])
def test_composition_is_the_sequence_whatever_the_grouping(kinds):
    rng = np.random.default_rng(9)
    n, steps = 60, 9
    chg, dis, e_max = (np.full(n, v) for v in (1.3, 0.9, 40.0))
    signals = [days(n, rng, kinds) for _ in range(steps)]
    each = [st.day_maps(s, chg, dis, e_max) for s in signals]
    one = st.identity(n)
    for m in each:
        one = st.compose(one, m, e_max)
    two = st.compose(st.compose(each[0], each[1], e_max), st.compose(each[2], each[3], e_max), e_max)
    for start in (np.zeros(n), e_max, *(rng.random(n) * e_max for _ in range(10))):
        soc = start
        for t, s in enumerate(signals):
            soc = st.play(s, soc, chg, dis, e_max)[0][:, -1]
            if t == 3:
                assert np.allclose(st.follow(two, start, e_max), soc, atol=1e-8)
        assert np.allclose(st.follow(one, start, e_max), soc, atol=1e-8)


def test_ledger_over_years(spark):
    """Several years, unequal nodes, a missing price: the tree equals one long loop."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    batteries = [Battery(), Battery(eta_chg=0.8, p_max_mw=10.0, e_max_mwh=30.0)]
    for node, count in (("A", 900), ("B", 40), ("C", 1)):
        first = dt.datetime(2022, 12, 20)
        signals = rng.choice([0, 0, 1, -1], (count * 2, 2)).tolist()
        times = [first + dt.timedelta(hours=12 * i) for i in range(count * 2)]
        prices = [None if i % 50 == 7 else float(i % 13) for i in range(count * 2)]
        rows += list(zip([node] * len(times), times, prices, signals))
        for k in (0, 1):
            for i, b in enumerate(batteries, start=1):
                soc, used, today = b.start_soc, 0.0, None
                for t, s in zip(times, signals):
                    used = used if t.date() == today else 0.0
                    today = t.date()
                    flow = 0.0
                    if s[k] == 1 and soc < b.e_max_mwh:
                        flow = -min(b.charge_step, b.e_max_mwh - soc)
                    elif s[k] == -1:
                        flow = min(b.discharge_step, soc, b.e_max_mwh - used)
                    soc, used = soc - flow, used + max(flow, 0.0)
                    want[node, f"m{k}", i, t] = soc
    sets = spark.createDataFrame(rows, "node string, timestamp timestamp_ntz, price double, signals array<int>")
    got = dispatch.storage_ledger(sets, ["m0", "m1"], batteries).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.isclose(r["soc"], want[r["node"], r["model"], r["scenario"], r["timestamp"]])
        assert (r["revenue"] is None) == (r["price"] is None)
    assert dispatch.storage_ledger(sets.limit(0), ["m0"], batteries).count() == 0
