"""Fits and forecasts that SQL cannot solve, against direct numpy solutions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pricepanel.operators import forecast as fc


def series(spark, n=400, seed=7, keep=1.0):
    rng = np.random.default_rng(seed)
    rows = [
        ("A", dt.datetime(2024, 1, 30) + dt.timedelta(minutes=15 * i), float(np.round(rng.normal(30, 8), 2)))
        for i in range(n)
        if i in (0, n - 1) or rng.random() < keep
    ]
    return spark.createDataFrame(rows, "node string, timestamp timestamp_ntz, price double")


def design(index):
    cols = []
    for code, m in ((index.hour, 24), (index.minute // 15, 4), (index.dayofweek, 7), (index.month - 1, 12)):
        cols.append(np.eye(m)[code][:, 1:])
    return np.hstack(cols)


def ridge(x, y, alpha=1.0):
    m, c = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - c))
    return c - m @ w, w


# Rows that refit, worked out by hand from the rule: once the window has grown by
# more than a tenth, or ``every`` rows after the refit before.
REFITS = {
    (672, 96): [1, 69, 137, 205, 273, 341, 409, 477, 545, 613, 710, 807, 904],
    (100, 5): [1, 7, 13, 19, 25, 31, 37, 43, 49, 55, 61, 67, 73, 79, 85, 91, 97, 103, 109],
    (40, 96): [1, 6, 11, 16, 21, 26, 31, 36, 133, 230, 327],
    (2000, 96): [1, 98, 195, 292, 389, 486],
}


@pytest.mark.parametrize("window,every", REFITS)
def test_refit_rows(spark, window, every):
    from pyspark.sql import functions as F

    plan, want = fc.RefitPlan(window, every), REFITS[window, every]
    rn = spark.range(1, want[-1] + 1).withColumnRenamed("id", "rn")
    got = rn.select(plan.row(plan.index(F.col("rn"))).alias("r"), "rn").orderBy("rn").toPandas()
    assert sorted(set(got.r)) == want
    assert (got.r == got.rn.map(lambda x: max(w for w in want if w <= x))).all()


def test_ridge_paths(spark):
    p = series(spark)
    plan = fc.RefitPlan(200, 20)
    got = fc.ridge_paths(p, 5, plan).toPandas().sort_values("timestamp").reset_index(drop=True)
    s = p.toPandas().set_index("timestamp").price
    for i, refit in ((0, 1), (30, 22), (150, 148), (399, 400)):  # with these numbers a refit every 21 rows
        train = s.iloc[:refit].iloc[-200:]
        b0, w = ridge(design(train.index), train.to_numpy())
        future = pd.date_range(s.index[i], periods=5, freq="15min")
        assert np.allclose(got.path[i], b0 + design(future) @ w, atol=1e-8)


def test_whole_history(spark):
    p = series(spark, keep=0.8)
    grid = fc.gridded(p)
    fits = {r["k"]: r for r in fc.whole_history_fits(grid, 100, 50).collect()}
    s = grid.toPandas().sort_values("rn").set_index("timestamp").price
    for k in (0, 3, 5):
        train = s.iloc[: 100 + 50 * k].dropna()
        b0, w = ridge(design(train.index), train.to_numpy())
        fit = fits[k]["fit"]
        assert fits[k]["n_train"] == len(train)
        assert np.isclose(fit["intercept"], b0)
        assert np.allclose(fit["hr"][1:], w[:23])


def test_walk_forward_mae(spark):
    p = series(spark, keep=0.9)
    got = {r["model"]: r["mae"] for r in fc.mean_absolute_error(fc.walk_forward(p, ("ridge", "last_value"), 96, 32)).collect()}
    s = fc.gridded(p).toPandas().sort_values("rn").set_index("timestamp").price
    ridge_err, last_err = [], []
    for pos in range(96, len(s) - 32, 32):
        train, test = s.iloc[:pos].dropna(), s.iloc[pos : pos + 32]
        b0, w = ridge(design(train.index), train.to_numpy())
        ridge_err.append((test - (b0 + design(test.index) @ w)).abs())
        last_err.append((test - train.iloc[-1]).abs())
    assert np.isclose(got["ridge"], pd.concat(ridge_err).mean())
    assert np.isclose(got["last_value"], pd.concat(last_err).mean())


def test_lag_ridge_and_one_step(spark):
    p = series(spark)
    s = p.toPandas().set_index("timestamp").price
    x = pd.concat([s.shift(k) for k in range(1, 5)], axis=1)
    x["hr"], x["qtr"], x["dow"] = s.index.hour, s.index.minute // 15, s.index.dayofweek
    x = x.dropna()
    y = s.loc[x.index]
    n, test = len(x), len(x) // 6
    scores = []
    for a in fc.PENALTIES:
        r2 = []
        for k in range(5):
            z = n - (5 - k) * test
            b0, w = ridge(x.iloc[:z].to_numpy(), y.iloc[:z].to_numpy(), a)
            e = y.iloc[z : z + test] - (b0 + x.iloc[z : z + test].to_numpy() @ w)
            t = y.iloc[z : z + test]
            r2.append(1 - (e**2).sum() / ((t - t.mean()) ** 2).sum())
        scores.append(np.mean(r2))
    fit = fc.lag_ridge_fits(p).first()["fit"]
    assert np.allclose(fit["scores"], scores, atol=1e-8)
    assert np.isclose(fit["alpha"], fc.PENALTIES[int(np.argmax(scores))])
    b0, w = ridge(x.to_numpy(), y.to_numpy(), fit["alpha"])
    got = fc.one_step_forecast(p).toPandas().sort_values("timestamp").reset_index(drop=True)
    i = 200
    t = s.index[i] + pd.Timedelta("15min")
    feat = [s.iloc[i], s.iloc[i - 1], s.iloc[i - 2], s.iloc[i - 3], t.hour, t.minute // 15, t.dayofweek]
    assert np.isclose(got.yhat[i], b0 + np.dot(w, feat))
    assert np.isclose(got.yhat[1], s.iloc[:2].mean())


def gappy(spark, n=300, node="A"):
    """A grid on which whole days, the first rows and single slots lack a price."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        price = None if i < 2 or 96 <= i < 200 or i % 7 == 3 else float(np.round(rng.normal(30, 8), 2))
        price = float("nan") if i == 40 else price
        rows.append((node, dt.datetime(2024, 1, 30) + dt.timedelta(minutes=15 * i), price))
    return spark.createDataFrame(rows, "node string, timestamp timestamp_ntz, price double")


def test_last_known_skips_gaps(spark):
    from pricepanel.operators.ordering import last_known

    got = last_known(gappy(spark), 4).toPandas().sort_values("timestamp")
    seen, left = [], got.groupby(got.timestamp.dt.date).cumcount(ascending=False) + 1
    for r, n in zip(got.itertuples(), left):
        if not (r.price is None or np.isnan(r.price)):
            seen.insert(0, (r.price, r.timestamp))
        assert list(r[4]) == [x for x, _ in seen[:4]]
        assert (pd.isna(r[5]) and not seen) or r[5] == seen[0][1]
        assert r[6] == n


def test_gaps_are_no_prices(spark):
    """Fits and forecasts on a grid with gaps equal those on the known rows alone."""
    grid = gappy(spark)
    only = fc.known(grid)
    a, b = (fc.lag_ridge_fits(x).first()["fit"] for x in (grid, only))
    assert a["alpha"] == b["alpha"] and np.allclose(a["beta"], b["beta"])
    on_grid = {r["timestamp"]: r["yhat"] for r in fc.one_step_forecast(grid).collect()}
    for r in fc.one_step_forecast(only).collect():
        assert np.isclose(on_grid[r["timestamp"]], r["yhat"])
    assert not any(v is None or np.isnan(v) for v in on_grid.values())


def test_day_paths_feed_forecasts_back(spark):
    grid = gappy(spark)
    fit = fc.lag_ridge_fits(grid).first()["fit"]
    paths = {r["origin"]: r["path"] for r in fc.day_paths(grid).collect()}
    s = grid.toPandas().set_index("timestamp").price.sort_index()
    assert len(paths) == len(s)
    for i in (0, 1, 2, 4, 60, 95, 97, 150, 200, 299):
        origin, hist = s.index[i], s.iloc[: i + 1].dropna()
        path = paths[origin]
        assert len(path) == (s.iloc[i:].index.date == origin.date()).sum()
        for h, got in enumerate(path, 1):
            at = (hist.index[-1] if len(hist) else origin) + pd.Timedelta("15min")
            x = [*hist.iloc[::-1].iloc[:4], at.hour, at.minute // 15, at.dayofweek]
            want = fit["intercept"] + np.dot(fit["beta"], x) if len(hist) >= 4 else hist.mean() if len(hist) else 0.0
            assert np.isclose(got, want), (origin, h)
            hist = pd.concat([hist, pd.Series([want], index=[origin + pd.Timedelta(minutes=15 * h)])])
    short = grid.limit(5).unionByName(gappy(spark, 4, "B"))
    assert {len(r["path"]) > 0 for r in fc.day_paths(short).collect()} == {True}
    assert fc.day_paths(grid.limit(0)).count() == 0


def test_registered_function_sees_only_the_past(spark):
    seen = fc.FORECASTERS.copy()
    fc.register_function("last", lambda train, t0, h: np.full(h, train.dropna().iloc[-1]), history=50)
    try:
        f = fc.FORECASTERS["last"](fc.gridded(series(spark)), 96, 32).toPandas()
    finally:
        fc.FORECASTERS.clear()
        fc.FORECASTERS.update(seen)
    s = series(spark).toPandas().set_index("timestamp").price
    for origin, yhat in f.groupby("origin").yhat.first().items():
        assert yhat == s.loc[: origin - pd.Timedelta("15min")].iloc[-1]


def test_sql_function_over_stretches(spark, monkeypatch):
    """Stretches shorter than a node, with gaps: the same as calling it per origin."""
    monkeypatch.setattr(fc, "STRETCH", 70)
    last = lambda train, t0, h: np.full(h, (train.dropna().iloc[-1] if train.notna().any() else 0.0) + len(train))
    grid = fc.gridded(gappy(spark))
    fc.sql_function(spark, "last_plus", last, history=50, first=96, horizon=16)
    got = spark.sql(
        "SELECT * FROM last_plus(TABLE({t}) PARTITION BY (node, part) ORDER BY rn)", t=fc.slots(grid, 50)
    ).toPandas()
    s = grid.toPandas().sort_values("rn").set_index("timestamp").price
    places = range(96, 300 - 16, 16)
    assert len(got) == 16 * len(places)
    for i in places:
        train = s.iloc[i - 50 : i].dropna()
        if len(train):
            assert (got[got.origin == s.index[i]].yhat == train.iloc[-1] + 50).all()


def test_cells_hold_the_sum_of_every_pair(spark):
    """Pairs of different features too, against sums over each window's rows."""
    panel = series(spark, 900, keep=0.9)
    got = {(r["refit"], r["i"], r["j"]): (r["cnt"], r["total"]) for r in fc.window_cells(panel).collect()}
    rows = panel.orderBy("timestamp").collect()
    plan, wanted = fc.RefitPlan(), {}
    for refit, end in enumerate(plan.rows(0, 40).tolist()):
        for t, price in ((r["timestamp"], r["price"]) for r in rows[max(0, end - plan.window) : end] if end <= len(rows)):
            codes = [0, t.hour, t.minute // 15 and 23 + t.minute // 15, t.weekday() and 26 + t.weekday(), t.month > 1 and 31 + t.month]
            on = [c for f, c in enumerate(codes) if c or not f]
            for k, i in enumerate(on):
                for j in on[k:]:
                    cnt, total = wanted.get((refit, i, j), (0, 0.0))
                    wanted[refit, i, j] = cnt + 1, total + price
    assert got.keys() == wanted.keys()
    for key, (cnt, total) in wanted.items():
        assert got[key] == (cnt, pytest.approx(total, abs=1e-8)), key
