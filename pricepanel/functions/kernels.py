"""Numpy helpers that run inside tasks, on arrays Spark has grouped.

Each function handles one bounded array: a chunk of a series, a day, or the
normal equations of one fit. None of them sees a whole node.
"""

from __future__ import annotations

import itertools

import numpy as np


class RankIndex:
    """Order statistics of any stretch of an array, in a step per bit of its length.

    Values are replaced by their ranks. From the highest bit of the ranks down, each
    level counts the zeros before every place and then moves places with a zero to the
    front, so the k-th smallest of a stretch is found by going down its bits: the
    zeros of the stretch tell which half holds it, and where the stretch lies in there.
    """

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.levels = []
        for bit in range(max(0, len(values) - 1).bit_length() - 1, -1, -1):
            zero = (ranks >> bit) & 1 == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)])))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def smallest(self, k: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, of each stretch ``start:end``."""
        found = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[start], zeros[end]
            high = k >= b - a
            k = np.where(high, k - (b - a), k)
            start = np.where(high, zeros[-1] + start - a, a)
            end = np.where(high, zeros[-1] + end - b, b)
            found |= high.astype(np.int64) << bit
        return self.sorted[found]


def trailing_cuts(
    prices: np.ndarray, window: int, shares: list[float], with_current: bool, first: int = 0
) -> np.ndarray:
    """Linear-interpolation quantiles of the known ones of the last ``window`` values,
    for the positions from ``first`` on.

    Rows without history are NaN, as unknown values are. A rank index answers every
    window, so the cost of a row grows with the logarithm of the window.
    """
    x = np.asarray(prices, dtype=float)
    count = trailing_known(x, window, with_current)[first:]
    index = RankIndex(np.where(np.isnan(x), np.inf, x))  # unknown ones rank behind every known value
    end = np.arange(first, len(x)) + int(with_current)
    start = np.maximum(end - window, 0)
    out = np.full((len(count), len(shares)), np.nan)
    ok = count > 0
    start, end, count = start[ok], end[ok], count[ok]
    for j, share in enumerate(shares):
        pos = (count - 1) * share
        low = np.floor(pos).astype(np.int64)
        high = np.ceil(pos).astype(np.int64)
        left = index.smallest(low, start, end)
        right = left.copy()
        between = high > low
        right[between] = index.smallest(high[between], start[between], end[between])
        out[ok, j] = left + (right - left) * (pos - low)
    return out


def trailing_known(prices: np.ndarray, window: int, with_current: bool) -> np.ndarray:
    """How many of the last ``window`` values per position are known."""
    seen = np.concatenate([[0], np.cumsum(~np.isnan(np.asarray(prices, dtype=float)))])
    end = np.arange(len(prices)) + int(with_current)
    return (seen[end] - seen[np.maximum(end - window, 0)]).astype(np.int32)


def day_response(
    signals, chg: float, dis: float, e_max: float
) -> list[tuple[float, float, float]]:
    """How the charge at the end of a day depends on the charge at its start.

    The daily discharge allowance restarts each day, so one number enters a day.
    Start levels ``[0, e_max]`` are followed as pieces ``(x, soc, dsoc, left,
    dleft)``: from ``x`` on, charge and remaining allowance are linear in the
    start level. A piece is split where a clamp begins to bind. The result lists
    ``(x, soc, slope)`` per piece, ascending in ``x``; exact for any battery.
    """
    pieces = [(0.0, 0.0, 1.0, e_max, 0.0)]

    def split(piece, until, value, slope):
        """Cut the piece where ``value + slope * (x - start)`` crosses zero."""
        x = piece[0]
        if slope == 0:
            return [piece]
        at = x - value / slope
        if x < at < until:
            d = at - x
            return [
                piece,
                (at, piece[1] + piece[2] * d, piece[2], piece[3] + piece[4] * d, piece[4]),
            ]
        return [piece]

    def bound(i, group, outer):
        return group[i + 1][0] if i + 1 < len(group) else outer

    def apply(pieces, action, times):
        out = []
        for i, p in enumerate(pieces):
            until = pieces[i + 1][0] if i + 1 < len(pieces) else e_max
            group = [p]
            if action > 0:
                amount = chg * times
                group = split(p, until, p[1] + amount - e_max, p[2])
                for j, q in enumerate(group):
                    # The middle of a piece tells which side of a clamp it is on.
                    half = (bound(j, group, until) - q[0]) / 2
                    full = q[1] + q[2] * half + amount >= e_max
                    out.append((q[0], e_max, 0.0, q[3], q[4]) if full
                               else (q[0], q[1] + amount, q[2], q[3], q[4]))
            elif action < 0:
                amount = dis * times
                for f in ("soc", "left", "both"):
                    cutted = []
                    for j, q in enumerate(group):
                        v, s = {
                            "soc": (q[1] - amount, q[2]),
                            "left": (q[3] - amount, q[4]),
                            "both": (q[1] - q[3], q[2] - q[4]),
                        }[f]
                        cutted += split(q, bound(j, group, until), v, s)
                    group = cutted
                for j, q in enumerate(group):
                    half = (bound(j, group, until) - q[0]) / 2
                    soc, left = q[1] + q[2] * half, q[3] + q[4] * half
                    if amount <= soc and amount <= left:
                        out.append((q[0], q[1] - amount, q[2], q[3] - amount, q[4]))
                    elif soc <= left:
                        out.append((q[0], 0.0, 0.0, q[3] - q[1], q[4] - q[2]))
                    else:
                        out.append((q[0], q[1] - q[3], q[2] - q[4], 0.0, 0.0))
        merged = out[:1]
        for q in out[1:]:
            p = merged[-1]
            d = q[0] - p[0]
            same = (
                p[2] == q[2] and p[4] == q[4]
                and p[1] + p[2] * d == q[1] and p[3] + p[4] * d == q[3]
            )
            if not same:
                merged.append(q)
        return merged

    def apply_either(pieces):
        """Charge, but a full battery discharges: full start levels differ."""
        whole = []
        for i, p in enumerate(pieces):
            last = i + 1 == len(pieces)
            until = e_max if last else pieces[i + 1][0]
            if p[2] == 0 and p[1] >= e_max:
                whole += [(p, True)]
            else:
                whole += [(p, False)]
                if last and p[1] + p[2] * (until - p[0]) >= e_max and until > p[0]:
                    d = until - p[0]
                    top = (until, p[1] + p[2] * d, 0.0, p[3] + p[4] * d, 0.0)
                    whole += [(top, True)]
        out = []
        for i, (p, full) in enumerate(whole):
            until = whole[i + 1][0][0] if i + 1 < len(whole) else e_max
            if full:
                x = min(dis, p[1], p[3]) if p[4] == 0 else None
                if x is not None:
                    out.append((p[0], p[1] - x, 0.0, p[3] - x, 0.0))
                else:
                    x = min(dis, p[1])
                    group = split(p, until, p[3] - x, p[4])
                    for j, q in enumerate(group):
                        half = (bound(j, group, until) - q[0]) / 2
                        if q[3] + q[4] * half >= x:
                            out.append((q[0], q[1] - x, 0.0, q[3] - x, q[4]))
                        else:
                            out.append((q[0], q[1] - q[3], -q[4], 0.0, 0.0))
            else:
                for j, q in enumerate(group := split(p, until, p[1] + chg - e_max, p[2])):
                    half = (bound(j, group, until) - q[0]) / 2
                    sat = q[1] + q[2] * half + chg >= e_max
                    out.append((q[0], e_max, 0.0, q[3], q[4]) if sat
                               else (q[0], q[1] + chg, q[2], q[3], q[4]))
        return out

    for action, run in itertools.groupby(int(s) for s in signals):
        times = sum(1 for _ in run)
        if action == 2:
            for _ in range(times):
                pieces = apply_either(pieces)
        elif action:
            pieces = apply(pieces, action, times)
    return [(p[0], p[1], p[2]) for p in pieces]


# --- ridge regression ----------------------------------------------------------

# One-hot calendar features with the first level dropped.
LEVELS = {"hr": 24, "qtr": 4, "dow": 7, "mon": 12}
OFFSETS = {"hr": 0, "qtr": 23, "dow": 26, "mon": 32}
N_CALENDAR = 43


def spread_coefficients(intercept: float, beta: np.ndarray) -> dict:
    """Coefficients per calendar level, 0 for the dropped first level."""
    out = {"intercept": float(intercept)}
    for name, count in LEVELS.items():
        a = OFFSETS[name]
        out[name] = [0.0, *(float(b) for b in beta[a : a + count - 1])]
    return out


def ridge_from_moments(
    n: float, sx: np.ndarray, sy: float, sxx: np.ndarray, sxy: np.ndarray, alpha: float
) -> tuple[float, np.ndarray]:
    """Ridge with an unpenalised intercept, from plain sums of products."""
    mx, my = sx / n, sy / n
    gram = sxx - n * np.outer(mx, mx) + alpha * np.eye(len(mx))
    beta = np.linalg.solve(gram, sxy - n * mx * my)
    return my - mx @ beta, beta


def window_grams(
    codes: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of many overlapping windows of one run of rows.

    ``codes`` has one column per calendar family, ``y`` the prices; window f covers
    rows ``starts[f]:ends[f]``. Rows are summed once, between the borders of windows;
    prefix sums over these stretches give each window as a difference of two.
    Returns ``(gram, right)``, index 0 being the intercept.
    """
    size = N_CALENDAR + 1
    rows, stretch, place, count = _stretches(starts, ends)
    active, on = _active(codes[rows])
    gram, right = np.zeros((count, size, size)), np.zeros((count, size))
    for i in range(active.shape[1]):
        np.add.at(right, (stretch[on[:, i]], active[on[:, i], i]), y[rows[on[:, i]]])
        for j in range(active.shape[1]):
            both = on[:, i] & on[:, j]
            np.add.at(gram, (stretch[both], active[both, i], active[both, j]), 1.0)
    gram, right = gram.cumsum(axis=0), right.cumsum(axis=0)
    first, last = place[: len(starts)], place[len(starts) :]
    return gram[last] - gram[first], right[last] - right[first]


def window_totals(
    codes: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows and sums of prices by pair of features ``(i, j)``, ``i <= j``, of
    the windows of ``window_grams``. Each row is summed once; a window adds up its own
    stretches, so that prices outside it do not touch its sums."""
    size = N_CALENDAR + 1
    rows, stretch, place, count = _stretches(starts, ends)
    active, on = _active(codes[rows])
    gram, total = np.zeros((count, size, size)), np.zeros((count, size, size))
    for i in range(active.shape[1]):
        for j in range(i, active.shape[1]):
            both = on[:, i] & on[:, j]
            at = stretch[both], active[both, i], active[both, j]
            np.add.at(gram, at, 1.0)
            np.add.at(total, at, y[rows[both]])
    own = [slice(a + 1, b + 1) for a, b in zip(place[: len(starts)].tolist(), place[len(starts) :].tolist())]
    return np.stack([gram[s].sum(0) for s in own]), np.stack([total[s].sum(0) for s in own])


def _stretches(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of some windows, the stretch between borders of windows that each is in,
    the place of each start, then end, among the borders, and their number. Stretch s
    lies before border s."""
    borders, place = np.unique(np.concatenate([starts, ends]), return_inverse=True)
    rows = np.arange(borders[0], borders[-1])
    return rows, np.searchsorted(borders, rows, side="right"), place, len(borders)


def _active(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each family that a row would switch on, and whether it does; the
    intercept comes first."""
    active = np.concatenate([np.zeros((len(codes), 1), int), codes + list(OFFSETS.values())], axis=1)
    return active, np.concatenate([np.ones((len(codes), 1), bool), codes > 0], axis=1)


def solve_grams(gram: np.ndarray, right: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and coefficients of a stack of normal equations; the intercept is
    not penalised."""
    n, sx, sy = gram[:, 0, 0], gram[:, 0, 1:], right[:, 0]
    mx, my = sx / n[:, None], sy / n
    centred = gram[:, 1:, 1:] - n[:, None, None] * mx[:, :, None] * mx[:, None, :] + alpha * np.eye(sx.shape[1])
    beta = np.linalg.solve(centred, (right[:, 1:] - n[:, None] * mx * my[:, None])[..., None])[..., 0]
    return my - (mx * beta).sum(1), beta


def gram_of_cells(cells) -> tuple[np.ndarray, np.ndarray]:
    """Dense normal equations from cells ``(i, j, count, sum of prices)``, ``i <= j``."""
    size = N_CALENDAR + 1
    gram, right = np.zeros((size, size)), np.zeros(size)
    for c in cells:
        gram[c["i"], c["j"]] = gram[c["j"], c["i"]] = c["cnt"]
        if c["i"] == c["j"]:
            right[c["i"]] = c["total"]
    return gram, right


def choose_alpha(blocks: list[np.ndarray], alphas: list[float]) -> dict:
    """Best penalty by expanding-window validation, from block moments.

    ``blocks[k]`` holds sums of products of ``(1, features, y)``; block 0 is the
    first training set, each later block is tested on what precedes it and then
    joins the training data. The score is the mean R² over the tested blocks.
    """

    def parts(m):
        return m[0, 0], m[0, 1:-1], m[0, -1], m[1:-1, 1:-1], m[1:-1, -1]

    scores = []
    for alpha in alphas:
        seen, folds = np.zeros_like(blocks[0]), []
        for k, block in enumerate(blocks):
            if k:
                b0, beta = ridge_from_moments(*parts(seen), alpha)
                w = np.concatenate([[-b0], -beta, [1.0]])
                sse = w @ block @ w
                sst = block[-1, -1] - block[0, -1] ** 2 / block[0, 0]
                folds.append(1 - sse / sst)
            seen = seen + block
        scores.append(float(np.mean(folds)))
    best = int(np.argmax(scores))
    b0, beta = ridge_from_moments(*parts(sum(blocks)), alphas[best])
    return {
        "alpha": float(alphas[best]),
        "scores": scores,
        "intercept": float(b0),
        "beta": [float(b) for b in beta],
    }


def lag_responses(weights: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence ``y_h = u_h + weights . (y_h-1, y_h-2, ...)`` solved for all steps.

    Returns ``(start, push)`` with ``y = start @ (y_0, y_-1, ...) + push @ u``: row h of
    ``start`` is the first row of the h-th power of the companion matrix, and ``push``
    holds the responses to a unit input, constant along diagonals.
    """
    k = len(weights)
    companion = np.eye(k, k=-1)
    companion[0] = weights
    powers = np.empty((steps + 1, k))
    powers[0] = np.eye(k)[0]
    for h in range(steps):
        powers[h + 1] = powers[h] @ companion
    back = np.arange(steps)[:, None] - np.arange(steps)
    return powers[1:], np.where(back >= 0, powers[np.maximum(back, 0), 0], 0.0)


def lag_paths(last: list[list[float]], inputs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Forecast paths of many origins: ``last`` has each one's known values, newest
    first, ``inputs`` what does not depend on prices, per step. Where values lack, the
    first forecasts are the mean of what there is (0 for nothing)."""
    k, steps = len(weights), inputs.shape[1]
    start, push = lag_responses(weights, steps)
    out = np.empty(inputs.shape)
    counts = np.array([len(x) for x in last])
    for n in np.unique(counts).tolist():
        at = np.flatnonzero(counts == n)
        known = np.array([last[i] for i in at.tolist()], dtype=float).reshape(len(at), n)
        mean = known.mean(axis=1, keepdims=True) if n else np.zeros((len(at), 1))
        lead = min(k - n, steps)
        state = np.concatenate([np.repeat(mean, k - n, axis=1), known], axis=1)
        out[at, :lead] = mean
        rest = steps - lead
        out[at, lead:] = state @ start[:rest].T + inputs[at, lead:] @ push[:rest, :rest].T
    return out


# --- storage value -------------------------------------------------------------


def day_transfer(
    prices: np.ndarray, levels: int, cap: int, unit: float, eta: float
) -> np.ndarray:
    """Best revenue of one day for every pair of opening and closing level.

    One unit per interval in either direction, at most ``cap`` units delivered.
    At a negative price charging and delivering at once pays, as in the linear
    program, and uses up allowance. Impossible pairs are ``-inf``.
    """
    cap = min(cap, len(prices))
    best = np.full((levels, levels, cap + 1), -np.inf)
    best[np.arange(levels), np.arange(levels), 0] = 0.0
    for p in prices:
        nxt = best.copy()
        np.maximum(nxt[:, 1:, :], best[:, :-1, :] - p * unit / eta, out=nxt[:, 1:, :])
        if cap:
            np.maximum(nxt[:, :-1, 1:], best[:, 1:, :-1] + p * unit, out=nxt[:, :-1, 1:])
            if p < 0:
                np.maximum(
                    nxt[:, :, 1:], best[:, :, :-1] + p * unit * (1 - 1 / eta), out=nxt[:, :, 1:]
                )
        best = nxt
    return best.max(axis=2)


def compose(tables: list[np.ndarray]) -> np.ndarray:
    """(max, +) product of transfer tables in sequence."""
    out = tables[0]
    for t in tables[1:]:
        out = (out[:, :, None] + t[None, :, :]).max(axis=1)
    return out
