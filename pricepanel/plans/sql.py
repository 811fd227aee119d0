"""SQL fragments shared by the query catalogue."""

from __future__ import annotations

P = """p AS (
  SELECT event_type AS node, time_bucket(INTERVAL '15 minutes', ts) AS timestamp,
         round(avg(value), 6) AS price
  FROM events GROUP BY 1, 2)"""

P_USER = P.replace("event_type AS node", "CAST(user_id AS VARCHAR) AS node")

TICKS = """ticks AS (
  SELECT event_type AS node, ts AS timestamp, value AS price, event_id AS seq FROM events)"""

DAILY = """daily AS (
  SELECT o_orderpriority AS node, o_orderdate AS timestamp, o_totalprice AS price,
         o_orderkey AS seq FROM orders)"""

SHIP = """ship AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS node, l_shipdate AS timestamp,
         l_extendedprice AS price, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq FROM lineitem)"""

RES = """res AS (
  SELECT o_orderstatus AS iso, c_mktsegment AS node, o_orderpriority AS model,
         o_totalprice AS revenue, (o_orderkey % 1000) / 8.0::DOUBLE AS runtime_seconds
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

RES_CUST = RES.replace("c_mktsegment AS node", "CAST(c_custkey AS VARCHAR) AS node")

GRID = """grid AS (
  SELECT node, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL '15 minutes')) AS timestamp
  FROM p GROUP BY node),
g AS (SELECT grid.node, grid.timestamp, p.price FROM grid LEFT JOIN p USING (node, timestamp))"""


def cut(items: str, share: float) -> str:
    """Linear-interpolation quantile of a sorted list."""
    pos = f"((len({items}) - 1) * {share}::DOUBLE)"
    lo = f"{items}[CAST(floor({pos}) AS BIGINT) + 1]"
    hi = f"{items}[CAST(ceil({pos}) AS BIGINT) + 1]"
    return f"({lo} + ({hi} - {lo}) * ({pos} - floor({pos})))"


def models(pcts=(10, 25, 45), window: int = 672, need: int = 67) -> str:
    """CTEs ``hist`` and ``thr``: trailing thresholds per percentile model."""
    parts = "\n  UNION ALL ".join(
        f"SELECT node, timestamp, price, 'online_quartile_p{p}' AS model,"
        f" CASE WHEN len(l) < {need} THEN 'infinity'::DOUBLE ELSE {cut('l', p / 100)} END AS low,"
        f" CASE WHEN len(l) < {need} THEN 'infinity'::DOUBLE ELSE {cut('l', (100 - p) / 100)} END AS high"
        " FROM hist"
        for p in pcts
    )
    return f"""hist AS (
  SELECT node, timestamp, price, list_sort(list(price) OVER (
    PARTITION BY node ORDER BY timestamp ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)) AS l
  FROM p),
thr AS (
  {parts}),
sig AS (
  SELECT *, CASE WHEN price <= low AND price >= high THEN 2 WHEN price <= low THEN 1
                 WHEN price >= high THEN -1 ELSE 0 END AS signal FROM thr)"""


SCEN = """scen AS (
  SELECT * FROM (VALUES (1, 0.95::DOUBLE, 5.9375::DOUBLE, 6.25::DOUBLE, 200::DOUBLE, 100::DOUBLE),
                        (2, 0.9::DOUBLE, 11.25::DOUBLE, 12.5::DOUBLE, 200::DOUBLE, 100::DOUBLE))
    AS s(scenario, eta, chg, dis, e_max, soc0))"""

# One battery step as SQL, from the state before the row (s) and the row (r).
_USED = "CASE WHEN CAST(s.timestamp AS DATE) = CAST(r.timestamp AS DATE) THEN s.used ELSE 0 END"
_TAKE = "CASE WHEN r.signal > 0 AND s.soc < r.e_max THEN least(r.chg, r.e_max - s.soc) ELSE 0 END"
_GIVE = (
    "CASE WHEN r.signal < 0 OR (r.signal = 2 AND s.soc >= r.e_max) "
    f"THEN least(r.dis, s.soc, r.e_max - {_USED}) ELSE 0 END"
)

LEDGER = f"""num AS (
  SELECT sig.*, scen.*, row_number() OVER (PARTITION BY node, model, scenario ORDER BY timestamp) AS rn
  FROM sig CROSS JOIN scen),
led AS (
  SELECT node, model, scenario, 0::BIGINT AS rn, TIMESTAMP '1900-01-01' AS timestamp, 0::DOUBLE AS price,
         0 AS signal, soc0 AS soc_before, 0::DOUBLE AS mwh, soc0 AS soc, 0::DOUBLE AS used
  FROM (SELECT DISTINCT node, model, scenario, soc0 FROM num)
  UNION ALL
  SELECT r.node, r.model, r.scenario, r.rn, r.timestamp, r.price, r.signal, s.soc,
         {_GIVE} - {_TAKE} / r.eta, s.soc + {_TAKE} - {_GIVE}, {_USED} + {_GIVE}
  FROM led s JOIN num r ON r.node = s.node AND r.model = s.model
       AND r.scenario = s.scenario AND r.rn = s.rn + 1),
ledger AS (SELECT *, mwh * price AS revenue FROM led WHERE rn > 0)"""
