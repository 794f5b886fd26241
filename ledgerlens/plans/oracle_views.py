"""The same views as ``views.py`` written as DuckDB SQL, used as CTEs by the
oracle queries. Definitions follow FIXTURES.md section 2."""

from __future__ import annotations

from .views import CAMPAIGN_PRIORITIES, CHANNEL_BY_PRIORITY, SPEND_BY_PART_TYPE

T_SQL = """
t_b AS (SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) amount,
               user_id % 10 dest, CAST(json_extract_string(props,'$.k') AS INT) k,
               CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 3600) AS INT) step
        FROM events),
t_w AS (SELECT *,
  coalesce(sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) pu,
  coalesce(sum(amount) OVER (PARTITION BY dest ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) pd FROM t_b),
t AS (SELECT event_id, step, event_type "type", CAST(amount AS DOUBLE) amount, user_id nameOrig, dest nameDest,
  CAST(CASE WHEN k = 0 THEN 1 ELSE 0 END AS INT) isFraud,
  CAST(greatest(0, 2500 - pu) AS DOUBLE) oldbalanceOrg,
  CAST(greatest(0, greatest(0, 2500 - pu) - amount) AS DOUBLE) newbalanceOrig,
  CAST(pd AS DOUBLE) oldbalanceDest,
  CAST(CASE WHEN k = 0 THEN 0 ELSE pd + amount END AS DOUBLE) newbalanceDest FROM t_w)
"""

P_SQL = """
p AS (SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) amount, event_type "type",
             CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 3600) AS INT) step,
             CAST(CASE WHEN CAST(json_extract_string(props,'$.k') AS INT) = 0 THEN 1 ELSE 0 END AS INT) y,
             CASE WHEN CAST(json_extract_string(props,'$.k') AS INT) = 0 THEN 99 - (99 - lvl) * (99 - lvl) // 100
                  ELSE lvl * lvl // 110 END / 100 proba
      FROM (SELECT *, CAST(floor(least(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE), 499.99) / 5) AS INT) lvl FROM events))
"""

V_SQL = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) features, CAST(label AS INT) cluster FROM embeddings)
"""


def _s_sql() -> str:
    spend = ",\n    ".join(
        f"sum(CASE WHEN p_type = '{t}' THEN price ELSE 0 END) {c}" for t, c in SPEND_BY_PART_TYPE)
    spend_c = ", ".join(f"sum({c}) {c}" for _, c in SPEND_BY_PART_TYPE)
    chans = ",\n    ".join(
        "CAST(count_if(o_orderpriority IN ({})) AS INT) {}".format(", ".join(f"'{p}'" for p in ps), c)
        for ps, c in CHANNEL_BY_PRIORITY)
    cmps = ",\n    ".join(
        f"CAST(max(CASE WHEN o_orderdate > (SELECT maxd FROM s_mx) - INTERVAL 365 DAY "
        f"AND o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS INT) AcceptedCmp{i}"
        for i, p in enumerate(CAMPAIGN_PRIORITIES, start=1))
    mnt = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) {c}" for _, c in SPEND_BY_PART_TYPE)
    num = ", ".join(f"CAST(coalesce({c}, 0) AS INT) {c}" for _, c in CHANNEL_BY_PRIORITY)
    acc = ", ".join(f"CAST(coalesce(AcceptedCmp{i}, 0) AS INT) AcceptedCmp{i}" for i in range(1, 6))
    return f"""
s_mx AS (SELECT max(o_orderdate) maxd FROM orders),
s_per_order AS (
  SELECT l_orderkey,
    {spend},
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) returned,
    count(*) lines
  FROM (SELECT l_orderkey, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) price, p_type
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY l_orderkey),
s_spend AS (
  SELECT o_custkey custkey, {spend_c}, max(returned) Complain,
         sum(CASE WHEN o_orderstatus = 'O' THEN lines ELSE 0 END) NumWebVisitsMonth
  FROM s_per_order JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
s_ord AS (
  SELECT o_custkey ocust,
    {chans},
    {cmps},
    CAST(max(CASE WHEN o_orderdate > (SELECT maxd FROM s_mx) - INTERVAL 90 DAY THEN 1 ELSE 0 END) AS INT) Response,
    max(o_orderdate) last_order, min(o_orderdate) first_order
  FROM orders GROUP BY o_custkey),
s AS (
  SELECT c_custkey ID, CAST(1940 + c_custkey % 60 AS INT) Year_Birth, c_mktsegment Education,
    r_name Marital_Status, CAST(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS DOUBLE) Income,
    CAST(c_custkey % 3 AS INT) Kidhome, CAST(c_custkey % 2 AS INT) Teenhome,
    strftime(first_order, '%d/%m/%Y') Dt_Customer,
    CAST(date_diff('day', CAST(last_order AS DATE), CAST((SELECT maxd FROM s_mx) AS DATE)) AS INT) Recency,
    {mnt}, {num},
    CAST(coalesce(NumWebVisitsMonth, 0) AS INT) NumWebVisitsMonth, {acc},
    CAST(coalesce(Response, 0) AS INT) Response, CAST(coalesce(Complain, 0) AS INT) Complain,
    CAST(3 AS INT) Z_CostContact, CAST(11 AS INT) Z_Revenue
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN s_spend ON c_custkey = custkey LEFT JOIN s_ord ON c_custkey = ocust)
"""


S_SQL = _s_sql()

VIEW_SQL = {"t": T_SQL, "p": P_SQL, "s": S_SQL, "v": V_SQL}


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the CTEs of the named views."""
    ctes = ",\n".join(VIEW_SQL[v].strip() for v in views)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
