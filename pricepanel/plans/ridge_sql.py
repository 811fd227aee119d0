"""SQL that fits ridge regressions, so that fits and forecasts have a full counterpart.

Normal equations are lists of lists; Gauss-Jordan elimination is a recursion over
the turn. The matrices are positive definite, so no turn has to be searched.
"""

from __future__ import annotations

from pricepanel.functions import kernels as kn
from pricepanel.operators import forecast as fc


def solved(source: str, keys: str, size: int, name: str = "sol") -> str:
    """CTE ``name`` (keys, x) from ``source`` (keys, m): m is size rows of size + 1."""
    return f"""{name}_step AS (
  SELECT {keys}, 1 AS turn, m FROM {source}
  UNION ALL
  SELECT {keys}, turn + 1, list_transform(range(1, {size + 1}), lambda i: CASE
           WHEN i = turn THEN list_transform(m[turn], lambda v: v / m[turn][turn])
           ELSE list_transform(range(1, {size + 2}), lambda j: m[i][j] - m[i][turn] / m[turn][turn] * m[turn][j]) END)
  FROM {name}_step WHERE turn <= {size}),
{name} AS (SELECT {keys}, list_transform(range(1, {size + 1}), lambda i: m[i][{size + 1}]) AS x FROM {name}_step WHERE turn = {size + 1})"""


# --- lags and calendar --------------------------------------------------------------

Z = ["1.0::DOUBLE", "l1", "l2", "l3", "l4", "hr", "qtr", "dow", "price"]
_N = len(Z) - 2  # features


def lag_rows(source: str) -> str:
    """CTE ``b``: rows of the known prices of ``source`` with lags, calendar and block."""
    return f"""x AS (
  SELECT *, lag(price, 1) OVER w AS l1, lag(price, 2) OVER w AS l2, lag(price, 3) OVER w AS l3,
         lag(price, 4) OVER w AS l4, hour(timestamp) AS hr, minute(timestamp) // 15 AS qtr,
         isodow(timestamp) - 1 AS dow, row_number() OVER w - 4 AS pos, count(*) OVER (PARTITION BY node) - 4 AS total
  FROM {source} WHERE price IS NOT NULL WINDOW w AS (PARTITION BY node ORDER BY timestamp)),
b AS (SELECT *, greatest(0, 5 - (total - pos) // (total // 6)) AS block FROM x WHERE pos > 0 AND total > 5)"""


def lag_fit(source: str) -> str:
    """CTE ``fit`` (node, alpha, score, intercept, beta): the penalty of best mean R2
    over five expanding folds, and the fit on all rows."""
    sums = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in Z) + "]" for a in Z)
    centred = lambda i, j: f"m[{i}][{j}] - m[1][{i}] * m[1][{j}] / m[1][1]"
    rows = ", ".join(
        "["
        + ", ".join(centred(i, j) + (" + alpha" if i == j else "") for j in range(2, _N + 2))
        + f", {centred(i, _N + 2)}]"
        for i in range(2, _N + 2)
    )
    own = " - ".join(["m[1][9]", *(f"m[1][{i + 1}] * x[{i}]" for i in range(1, _N + 1))])
    dot = " + ".join(f"s.x[{i}] * b.{c}" for i, c in enumerate(Z[1:-1], 1))
    return f"""{lag_rows(source)},
mom AS (SELECT node, fold, [{sums}] AS m FROM b JOIN range(1, 7) f(fold) ON block < fold GROUP BY node, fold),
sys AS (SELECT node, fold, alpha, [{rows}] AS m FROM mom CROSS JOIN (SELECT unnest({fc.PENALTIES!r}) AS alpha)),
{solved("sys", "node, fold, alpha", _N)},
full_sol AS (SELECT sol.*, ({own}) / m[1][1] AS b0 FROM sol JOIN mom USING (node, fold)),
r2 AS (SELECT b.node, s.alpha, s.fold, 1 - sum((b.price - s.b0 - ({dot})) ** 2)
              / (sum(b.price * b.price) - sum(b.price) * sum(b.price) / count(*)) AS r2
       FROM b JOIN full_sol s ON s.node = b.node AND s.fold = b.block GROUP BY 1, 2, 3),
best AS (SELECT node, alpha, avg(r2) AS score FROM r2 GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY node ORDER BY avg(r2) DESC, alpha) = 1),
fit AS (SELECT node, alpha, score, b0 AS intercept, x AS beta FROM best JOIN full_sol USING (node, alpha) WHERE fold = 6)"""


#: The newest known prices of each row of ``g``, as a list, newest first.
LAST = """lst AS (
  SELECT node, timestamp, price, [l1, l2, l3, l4][:len(list_filter([l1, l2, l3, l4], lambda v: v IS NOT NULL))] AS l, seen,
         count(*) OVER (PARTITION BY node, CAST(timestamp AS DATE) ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_
  FROM (SELECT g.node, g.timestamp, g.price, k.l1, k.l2, k.l3, k.l4, k.timestamp AS seen
        FROM g ASOF LEFT JOIN (
          SELECT node, timestamp, price AS l1, lag(price, 1) OVER w AS l2, lag(price, 2) OVER w AS l3, lag(price, 3) OVER w AS l4
          FROM g WHERE price IS NOT NULL WINDOW w AS (PARTITION BY node ORDER BY timestamp)) k
        ON g.node = k.node AND g.timestamp >= k.timestamp))"""


def one_step(latest: str, after: str) -> str:
    """The forecast from ``latest`` (a list, newest first) for the interval after ``after``."""
    nxt = f"({after} + INTERVAL 15 MINUTE)"
    model = " + ".join(
        ["intercept", *(f"beta[{i}] * {latest}[{i}]" for i in range(1, 5)),
         f"beta[5] * hour({nxt})", f"beta[6] * (minute({nxt}) // 15)", f"beta[7] * (isodow({nxt}) - 1)"]
    )
    return f"CASE WHEN len({latest}) >= 4 AND intercept IS NOT NULL THEN {model} ELSE coalesce(list_avg({latest}), 0) END"


#: Forecasts fed back step by step, as lists of the newest prices.
PATHS = f"""path AS (
  SELECT node, timestamp AS origin, 1::BIGINT AS h, left_, intercept, beta, l,
         {one_step("l", "coalesce(seen, timestamp)")} AS yhat
  FROM lst LEFT JOIN fit USING (node)
  UNION ALL
  SELECT node, origin, h + 1, left_, intercept, beta, list_prepend(yhat, l)[:4],
         {one_step("list_prepend(yhat, l)[:4]", "(origin + to_minutes(CAST(15 * h AS INTEGER)))")}
  FROM path WHERE h < left_)"""


# --- calendar ------------------------------------------------------------------------

CODES = """[0, hour(timestamp),
        CASE WHEN minute(timestamp) > 0 THEN 23 + minute(timestamp) // 15 ELSE 0 END,
        CASE WHEN isodow(timestamp) > 1 THEN 25 + isodow(timestamp) ELSE 0 END,
        CASE WHEN month(timestamp) > 1 THEN 31 + month(timestamp) ELSE 0 END]"""


def calendar_fit(source: str, keys: str) -> str:
    """CTE ``fit`` (keys, n_train, x, intercept): ridge of penalty 1 on the calendar of
    the rows of ``source`` (keys, timestamp, price), x in one-hot order."""
    n = kn.N_CALENDAR
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""act AS (
  SELECT * FROM (SELECT {keys}, timestamp, price, unnest({CODES}) AS i, unnest([0, 1, 2, 3, 4]) AS family FROM {source})
  WHERE family = 0 OR i > 0),
cells AS (SELECT {", ".join(f"a.{k}" for k in keys.split(", "))}, a.i, b.i AS j, count(*) AS c, sum(a.price) AS s
          FROM act a JOIN act b ON {same} AND a.timestamp = b.timestamp GROUP BY ALL),
lines AS (SELECT {keys}, i, list(coalesce(c, 0)::DOUBLE ORDER BY j) AS line, coalesce(max(CASE WHEN j = i THEN s END), 0) AS y
          FROM (SELECT DISTINCT {keys} FROM cells) CROSS JOIN range({n + 1}) r(i) CROSS JOIN range({n + 1}) q(j)
          LEFT JOIN cells USING ({keys}, i, j) GROUP BY {keys}, i),
mat AS (SELECT {keys}, list(line ORDER BY i) AS m, list(y ORDER BY i) AS y FROM lines GROUP BY {keys}),
sys AS (SELECT {keys}, list_transform(range(2, {n + 2}), lambda i: list_append(
          list_transform(range(2, {n + 2}), lambda j: m[i][j] - m[1][i] * m[1][j] / m[1][1] + CASE WHEN i = j THEN 1 ELSE 0 END),
          y[i] - m[1][i] * y[1] / m[1][1])) AS m FROM mat),
{solved("sys", keys, n)},
fit AS (SELECT {keys}, m[1][1]::BIGINT AS n_train, x,
               (y[1] - list_sum(list_transform(range(1, {n + 1}), lambda i: m[1][i + 1] * x[i]))) / m[1][1] AS intercept
        FROM sol JOIN mat USING ({keys}))"""


def calendar_value(ts: str) -> str:
    """The fitted value at a time."""
    codes = CODES.replace("timestamp", ts)
    return f"(intercept + list_sum(list_transform({codes}, lambda i: CASE WHEN i = 0 THEN 0 ELSE x[i] END)))"


def coefficients() -> str:
    """Select items: the intercept and each level's coefficient, rounded."""
    names = [f"{name}_{i}" for name, count in kn.LEVELS.items() for i in range(1, count)]
    return ", ".join(["round(intercept, 4) AS intercept", *(f"round(x[{i}], 4) AS {c}" for i, c in enumerate(names, 1))])
