"""Numpy helpers against plain loops."""

import itertools

import numpy as np
from hypothesis import example, given, settings, strategies as st

from pricepanel.battery import Battery
from pricepanel.functions import kernels as kn


def run_day(signals, soc, chg, dis, e_max):
    left = e_max
    for s in signals:
        take = give = 0.0
        if s > 0 and soc < e_max:
            take = min(chg, e_max - soc)
        elif s < 0 or s == 2:
            give = min(dis, soc, left)
        soc, left = soc + take - give, left - give
    return soc


def follow(pieces, soc):
    x, y, k = [p for p in pieces if p[0] <= soc][-1]
    return y + k * (soc - x)


@example([1, 2, -1, 0, -1, -1, 1, 1, 1, 2, 2], (1.0, 1.5, 4.0))
@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from([1, 1, -1, -1, 0, 2]), max_size=60),
    st.sampled_from([(5.9375, 6.25, 200.0), (11.25, 12.5, 200.0), (3.0, 7.0, 20.0), (1.0, 1.5, 4.0)]),
)
def test_day_response_matches_every_start(signals, battery):
    pieces = kn.day_response(signals, *battery)
    e_max = battery[2]
    assert [p[0] for p in pieces] == sorted(p[0] for p in pieces)
    for soc in np.linspace(0, e_max, 129):
        assert abs(follow(pieces, soc) - run_day(signals, soc, *battery)) < 1e-9


def test_trailing_cuts_equals_percentile():
    rng = np.random.default_rng(1)
    x = np.round(rng.exponential(50, 1500), 1)
    for current in (True, False):
        got = kn.trailing_cuts(x, 672, [0.1, 0.55], current)
        for i in (0, 1, 5, 600, 671, 672, 673, 1499):
            end = i + 1 if current else i
            h = x[max(0, end - 672) : end]
            if len(h) == 0:
                assert np.isnan(got[i]).all()
            else:
                assert np.allclose(got[i], np.percentile(h, [10, 55]), rtol=0, atol=1e-10)


def test_calendar_ridge_equals_dense_solution():
    rng = np.random.default_rng(2)
    n = 300
    codes = {k: rng.integers(0, m, n) for k, m in kn.LEVELS.items()}
    y = rng.normal(40, 10, n)
    x = np.hstack([np.eye(m)[codes[k]][:, 1:] for k, m in kn.LEVELS.items()])
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    gram, right = kn.window_grams(np.column_stack(list(codes.values())), y, np.array([0]), np.array([n]))
    (b0,), (got,) = kn.solve_grams(gram, right, 1.0)
    assert np.allclose(got, beta)
    assert np.isclose(b0, y.mean() - x.mean(0) @ beta)


def test_window_grams_are_those_of_each_window():
    rng = np.random.default_rng(4)
    n = 250
    codes = np.column_stack([rng.integers(0, m, n) for m in kn.LEVELS.values()])
    y = rng.normal(40, 10, n)
    z = np.hstack([np.ones((n, 1)), *[np.eye(m)[codes[:, i]][:, 1:] for i, m in enumerate(kn.LEVELS.values())]])
    starts, ends = np.array([3, 3, 40, 100, 248]), np.array([4, 60, 130, 250, 250])
    for a, b, gram, right in zip(starts, ends, *kn.window_grams(codes, y, starts, ends)):
        assert np.allclose(gram, z[a:b].T @ z[a:b], atol=0) and np.allclose(right, z[a:b].T @ y[a:b])


def test_window_totals_are_those_of_each_window():
    rng = np.random.default_rng(6)
    n = 250
    codes = np.column_stack([rng.integers(0, m, n) for m in kn.LEVELS.values()])
    y = rng.normal(40, 10, n)
    y[[0, 20]] = np.inf, 1e18  # outside of some windows, whose sums they must not touch
    z = np.hstack([np.ones((n, 1)), *[np.eye(m)[codes[:, i]][:, 1:] for i, m in enumerate(kn.LEVELS.values())]])
    starts, ends = np.array([3, 3, 40, 100, 248]), np.array([4, 60, 130, 250, 250])
    for a, b, gram, total in zip(starts, ends, *kn.window_totals(codes, y, starts, ends), strict=True):
        assert (gram == np.triu(z[a:b].T @ z[a:b])).all()
        assert np.allclose(total, np.triu(z[a:b].T @ (z[a:b] * y[a:b, None])))


def test_lag_paths_equal_feeding_back():
    rng = np.random.default_rng(5)
    weights = np.array([0.6, -0.3, 0.2, 0.1])
    last = [list(rng.normal(30, 9, n)) for n in (4, 0, 2, 4, 3, 1)]
    inputs = rng.normal(1, 1, (6, 40))
    for values, u, path in zip(last, inputs, kn.lag_paths(last, inputs, weights)):
        seen = list(values)
        for x, got in zip(u, path):
            want = np.mean(seen) if 0 < len(seen) < 4 else 0.0 if not seen else x + np.dot(weights, seen[:4])
            assert np.isclose(got, want)
            seen.insert(0, want)
    assert kn.lag_paths([[1.0]], np.zeros((1, 2)), weights).tolist() == [[1.0, 1.0]]


def test_choose_alpha_equals_explicit_validation():
    rng = np.random.default_rng(3)
    n, splits = 305, 5
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=n)
    z = np.hstack([np.ones((n, 1)), x, y[:, None]])
    test = n // (splits + 1)
    edges = [0, *[n - (splits - k) * test for k in range(splits + 1)]]
    blocks = [z[a:b].T @ z[a:b] for a, b in zip(edges, edges[1:])]
    alphas = [0.01, 10.0, 1000.0]

    def ridge(a, b, alpha):
        m, c = a.mean(0), b.mean()
        w = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(3), (a - m).T @ (b - c))
        return c - m @ w, w

    scores = []
    for alpha in alphas:
        r2 = []
        for k in range(1, splits + 1):
            b0, w = ridge(x[: edges[k]], y[: edges[k]], alpha)
            xt, yt = x[edges[k] : edges[k + 1]], y[edges[k] : edges[k + 1]]
            r2.append(1 - ((yt - b0 - xt @ w) ** 2).sum() / ((yt - yt.mean()) ** 2).sum())
        scores.append(np.mean(r2))
    got = kn.choose_alpha(blocks, alphas)
    assert np.allclose(got["scores"], scores)
    assert got["alpha"] == alphas[int(np.argmax(scores))]


def brute_transfer(prices, levels, cap, unit, eta):
    best = np.full((levels, levels), -np.inf)
    for start in range(levels):
        for plan in itertools.product((0, 1, -1, 9), repeat=len(prices)):
            soc, used, value, ok = start, 0, 0.0, True
            for a, p in zip(plan, prices):
                if a == 1:
                    soc, value = soc + 1, value - p * unit / eta
                elif a == -1:
                    soc, used, value = soc - 1, used + 1, value + p * unit
                elif a == 9:
                    used, value = used + 1, value + p * unit * (1 - 1 / eta)
                ok &= 0 <= soc < levels and used <= cap
            if ok:
                best[start, soc] = max(best[start, soc], value)
    return best


def test_day_transfer_equals_enumeration():
    prices = np.array([3.0, -5.0, 8.0, 1.0, -2.0])
    got = kn.day_transfer(prices, 3, 2, 6.25, 0.9)
    want = brute_transfer(prices, 3, 2, 6.25, 0.9)
    assert np.allclose(np.nan_to_num(got, neginf=-1e9), np.nan_to_num(want, neginf=-1e9))


def test_compose_is_the_longer_day():
    prices = np.array([3.0, 9.0, 1.0, 7.0])
    a, b = (kn.day_transfer(p, 3, 9, 1.0, 1.0) for p in (prices[:2], prices[2:]))
    assert np.allclose(kn.compose([a, b]), kn.day_transfer(prices, 3, 9, 1.0, 1.0))


def test_trailing_cuts_skip_unknown_values():
    rng = np.random.default_rng(2)
    x = np.where(rng.random(300) < 0.4, np.nan, rng.normal(size=300))
    for current in (True, False):
        got = kn.trailing_cuts(x, 50, [0.1, 0.9], current)
        count = kn.trailing_known(x, 50, current)
        for i in range(300):
            end = i + current
            seen = x[max(0, end - 50) : end]
            seen = seen[~np.isnan(seen)]
            assert count[i] == len(seen)
            if len(seen):
                assert np.allclose(got[i], np.quantile(seen, [0.1, 0.9]))
            else:
                assert np.isnan(got[i]).all()
