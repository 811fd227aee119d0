"""Storage ledgers on arrays: rows played forward, and how a day, a year or any
stretch of days maps opening to closing charge.

A map is piecewise linear: from ``x`` on, the closing charge is ``soc`` plus
``slope`` times the distance from ``x``. Maps of many items are held side by side, as
three matrices with a row per item, pieces ascending and ``x`` infinite where an item
has fewer. Composition is associative, so stretches can be summarised in any order.
"""

from __future__ import annotations

import numpy as np

from pricepanel.functions.kernels import day_response

Maps = tuple[np.ndarray, np.ndarray, np.ndarray]
TINY = 1e-9


def play(signals: np.ndarray, soc: np.ndarray, chg: np.ndarray, dis: np.ndarray, e_max: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Charge before each step, and what leaves the battery (negative: enters it), for
    a matrix of signals with a day per row; and the charge after the last step in an
    added column. A signal of 0 does nothing, so days may be padded with it."""
    soc, used = np.array(soc, dtype=float), np.zeros(len(signals))
    before = np.empty((len(signals), signals.shape[1] + 1))
    flows = np.empty(signals.shape)
    for t in range(signals.shape[1]):
        now = signals[:, t]
        before[:, t] = soc
        charge = (now > 0) & (soc < e_max)
        give = ~charge & (now != 0) & (now != 1)
        flow = np.where(charge, -np.minimum(chg, e_max - soc), np.where(give, np.minimum(np.minimum(dis, soc), e_max - used), 0.0))
        soc = soc - flow
        used = used + np.maximum(flow, 0.0)
        flows[:, t] = flow
    before[:, -1] = soc
    return before, flows


def _padded(rows: list[list[tuple[float, float, float]]]) -> Maps:
    width = max(map(len, rows), default=1)
    out = np.zeros((3, len(rows), width))
    out[0] = np.inf
    for i, pieces in enumerate(rows):
        out[:, i, : len(pieces)] = np.array(pieces).T
    return tuple(out)


def ragged(flat: Maps, counts: np.ndarray) -> Maps:
    """Side by side from one after the other."""
    width = int(counts.max(initial=1))
    row = np.repeat(np.arange(len(counts)), counts)
    col = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((3, len(counts), width))
    out[0] = np.inf
    out[:, row, col] = flat
    return tuple(out)


def day_maps(signals: np.ndarray, chg: np.ndarray, dis: np.ndarray, e_max: np.ndarray) -> Maps:
    """The map of each day. Without signal 2 a map is continuous with slopes of 0 and
    1, so values at the ends of a stretch tell whether it is one piece; if not, the
    places where a single kink would lie, and the middle, are played as well. With
    signal 2, maps jump, and pieces are followed one by one."""
    odd = (signals == 2).any(axis=1)
    rows: list[list] = [[]] * len(signals)
    for i in np.flatnonzero(odd).tolist():
        s = signals[i]
        rows[i] = day_response(s[: np.flatnonzero(s).max() + 1].tolist(), float(chg[i]), float(dis[i]), float(e_max[i]))
    item = np.flatnonzero(~odd)

    def closing(i: np.ndarray, x: np.ndarray) -> np.ndarray:
        return play(signals[i], x, chg[i], dis[i], e_max[i])[0][:, -1]

    a, b = np.zeros(len(item)), e_max[item].astype(float)
    fa, fb = closing(item, a), closing(item, b)
    found: list[tuple] = []
    while len(item):
        rise, run = fb - fa, b - a
        flat, steep = rise <= TINY, rise >= run - TINY
        done = flat | steep | (run <= TINY)
        found.append((item[done], a[done], fa[done], (steep & ~flat)[done].astype(float)))
        item, a, b, fa, fb, rise = (v[~done] for v in (item, a, b, fa, fb, rise))
        cuts = np.sort(np.stack([a + rise, b - rise, (a + b) / 2]), axis=0)
        at = [closing(item, x) for x in cuts]
        xs, fs = [a, *cuts, b], [fa, *at, fb]
        item, a, b, fa, fb = (
            np.concatenate(v) for v in ([item] * 4, xs[:-1], xs[1:], fs[:-1], fs[1:])
        )
        wide = b > a
        item, a, b, fa, fb = (v[wide] for v in (item, a, b, fa, fb))
    if found:
        item, x, soc, slope = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((x, item))
        for i, *piece in zip(*(v[order].tolist() for v in (item, x, soc, slope))):
            if rows[i] and rows[i][-1][2] == piece[2]:
                continue  # the piece before goes on
            rows[i] = [*rows[i], tuple(piece)]
    return _padded([r or [(0.0, 0.0, 1.0)] for r in rows])


def follow(maps: Maps, soc: np.ndarray, e_max: np.ndarray) -> np.ndarray:
    """Closing charges for opening charges. What rounding leaves next to empty or full
    is empty or full, which a signal may ask for."""
    x, y, slope = maps
    at = (x <= soc[:, None]).sum(axis=1) - 1
    row = np.arange(len(soc))
    out = y[row, at] + slope[row, at] * (soc - x[row, at])
    out = np.where(out < TINY, 0.0, out)
    return np.where(out > e_max - TINY, e_max, out)


def compose(f: Maps, g: Maps, e_max: np.ndarray) -> Maps:
    """First ``f``, then ``g``: a piece of f is cut where its values reach the start of
    a piece of g."""
    (fx, fy, fs), (gx, gy, gs) = f, g
    n, k = fx.shape
    real = np.isfinite(fx)
    ends = np.append(fx[:, 1:], np.full((n, 1), np.inf), axis=1)
    last = real & ~np.isfinite(ends)
    ends = np.where(last, e_max[:, None], ends)
    at = (gx[:, None, :] <= fy[:, :, None]).sum(axis=2) - 1
    pick = lambda m: np.take_along_axis(m, at, axis=1)
    value, slope = pick(gy) + pick(gs) * (fy - pick(gx)), fs * pick(gs)
    with np.errstate(invalid="ignore", divide="ignore"):
        rise = fs * (ends - fx)
        up = gx[:, None, :] - fy[:, :, None]
        cut = real[:, :, None] & (fs[:, :, None] > 0) & (up > 0)
        cut &= np.where(last[:, :, None], up <= rise[:, :, None], up < rise[:, :, None])
        x = fx[:, :, None] + up / fs[:, :, None]
    wide = (n, k, 1 + gx.shape[1])
    out = np.empty((3, *wide))
    out[:, :, :, 0] = fx, value, slope
    out[0, :, :, 1:] = x
    out[1, :, :, 1:] = gy[:, None, :]
    out[2, :, :, 1:] = fs[:, :, None] * gs[:, None, :]
    keep = np.concatenate([real[:, :, None], cut], axis=2).reshape(n, -1)
    out = _closed_up(out.reshape(3, n, -1), keep)
    # A piece that continues the one before it is no piece of its own.
    with np.errstate(invalid="ignore"):
        going = out[1, :, :-1] + out[2, :, :-1] * (out[0, :, 1:] - out[0, :, :-1])
        same = (out[2, :, 1:] == out[2, :, :-1]) & (np.abs(out[1, :, 1:] - going) <= TINY)
    keep = np.isfinite(out[0])
    keep[:, 1:] &= ~same
    return tuple(_closed_up(out, keep))


def _closed_up(pieces: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Kept pieces moved to the front, in order."""
    order = np.argsort(~keep, axis=1, kind="stable")[:, : max(1, keep.sum(axis=1).max(initial=1))]
    keep = np.take_along_axis(keep, order, axis=1)
    out = np.take_along_axis(pieces, order[None], axis=2)
    out[0][~keep] = np.inf
    out[1:, ~keep] = 0.0
    return out


def merged(maps: Maps, rows: np.ndarray, some: Maps) -> Maps:
    """``maps`` with those of ``rows`` replaced."""
    width = max(maps[0].shape[1], some[0].shape[1])
    out = np.zeros((3, len(maps[0]), width))
    out[0] = np.inf
    out[:, :, : maps[0].shape[1]] = maps
    out[0, rows] = np.inf
    out[:, rows, : some[0].shape[1]] = some
    return tuple(out[:, :, : max(1, int(np.isfinite(out[0]).sum(axis=1).max(initial=1)))])


def identity(n: int) -> Maps:
    return np.zeros((n, 1)), np.zeros((n, 1)), np.ones((n, 1))
