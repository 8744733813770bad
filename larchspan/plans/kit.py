"""Registration of queries, and the SQL that mirrors `sources.domain` for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GRID = """w AS (SELECT CAST(ceil(sqrt(max(s_suppkey) + 1)) AS BIGINT) AS width FROM supplier),
grid AS (SELECT s_suppkey AS px, CAST(floor(s_suppkey / width) AS BIGINT) AS row, CAST(s_suppkey % width AS BIGINT) AS col, s_nationkey < 20 AS in_aoi,
  CAST(s_nationkey AS BIGINT) AS region, s_acctbal AS level, width FROM supplier, w)"""
OBS = """o0 AS (SELECT l_suppkey AS px, l_shipdate AS ts, max(l_tax) AS tax, max(l_discount) AS disc, min(l_discount) AS disc0,
  max(l_extendedprice / l_quantity) AS unit, max(l_linenumber) AS scl, max(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
obs AS (SELECT px, ts, CAST(year(ts) AS BIGINT) AS year, CAST(dayofyear(ts) AS BIGINT) AS doy, CAST(0.02 AS DOUBLE) + tax AS b02, CAST(0.03 AS DOUBLE) + disc AS b04,
  CAST(0.08 AS DOUBLE) + disc0 AS b05, CAST(0.1 AS DOUBLE) + least(unit, CAST(5000 AS DOUBLE)) / CAST(12503 AS DOUBLE) AS b08, CAST(0.11 AS DOUBLE) + least(unit, CAST(5000 AS DOUBLE)) / CAST(12503 AS DOUBLE) AS b8a,
  CAST(0.1 AS DOUBLE) + disc + qty / CAST(1000 AS DOUBLE) AS b11, CAST(0.06 AS DOUBLE) + tax + disc0 AS b12, scl, scl NOT IN (0,1,3,8,9,10,11) AS valid FROM o0)"""
IDX = """idx AS (SELECT px, ts, year, doy, valid, b02, scl,
  CASE WHEN b08 + b04 > 0 THEN (b08 - b04) / (b08 + b04) END AS ndvi, CASE WHEN b8a + b05 > 0 THEN (b8a - b05) / (b8a + b05) END AS ndre,
  CASE WHEN b8a + b11 > 0 THEN (b8a - b11) / (b8a + b11) END AS ndmi,
  CASE WHEN b8a + (b12 - b8a) * CAST(1.610 - 0.865 AS DOUBLE) / CAST(2.190 - 0.865 AS DOUBLE) > 0
    THEN b11 / (b8a + (b12 - b8a) * CAST(1.610 - 0.865 AS DOUBLE) / CAST(2.190 - 0.865 AS DOUBLE)) END AS crswir FROM obs)"""
OBJECTS = """objects AS (SELECT p_partkey AS id, CAST(p_partkey % 50 * 100 AS DOUBLE) AS x0, CAST(floor(p_partkey / 50) * 100 AS DOUBLE) AS y0,
  CAST(p_partkey % 50 * 100 + p_size * 3 AS DOUBLE) AS x1, CAST(floor(p_partkey / 50) * 100 AS DOUBLE) + CAST(p_size * 3 AS DOUBLE) / (p_partkey % 4 + 1) AS y1,
  CAST(p_size * 3 AS DOUBLE) * (CAST(p_size * 3 AS DOUBLE) / (p_partkey % 4 + 1)) / CAST(10000 AS DOUBLE) AS area_ha, CASE WHEN p_size % 3 = 0 THEN 'cut' ELSE 'stress' END AS type,
  ['new','persistent','recovered'][p_partkey % 3 + 1] AS status, CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) AS confidence,
  DATE '2001-05-01' + CAST(p_partkey * 7 % 140 AS INTEGER) AS first_detected FROM part)"""
REFS = """refs AS (SELECT o_orderkey AS rid, CAST(o_custkey % 50 * 100 + 10 AS DOUBLE) AS x0, CAST(floor(o_custkey / 50) * 100 + 10 AS DOUBLE) AS y0,
  CAST(o_custkey % 50 * 100 + 10 + o_orderkey % 40 + 5 AS DOUBLE) AS x1, CAST(floor(o_custkey / 50) * 100 + 10 + o_orderkey % 40 + 5 AS DOUBLE) AS y1,
  CAST(o_orderdate AS DATE) AS cut_date, CAST(year(o_orderdate) AS BIGINT) AS year,
  CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 620 WHEN o_orderpriority LIKE '2%' THEN 100 ELSE 900 END AS BIGINT) AS subtype,
  CAST((o_orderkey % 40 + 5) * (o_orderkey % 40 + 5) AS DOUBLE) / CAST(10000 AS DOUBLE) AS ha FROM orders)"""
UNITS = """units AS (SELECT user_id AS uid, event_type AS orbit, ts, max(value) AS lin FROM events WHERE value > 0 GROUP BY 1, 2, 3)"""
WEATHER = """wd AS (SELECT o_custkey % 4 AS node, CAST(o_orderdate AS DATE) AS date, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2),
wn AS (SELECT unnest([0, 1, 2, 3]) AS node), ws AS (SELECT unnest(generate_series(date_trunc('year', min(o_orderdate)), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders),
we AS (SELECT CAST(wn.node AS BIGINT) AS node, CAST(ws.d AS DATE) AS date, n, coalesce(top % 7, CAST(3 AS DOUBLE)) AS noise, coalesce(top % 3, CAST(0 AS DOUBLE)) AS rain, CAST(7 AS DOUBLE) + coalesce(top % 5, CAST(2 AS DOUBLE)) AS spread,
  cos(CAST(dayofyear(ws.d) - 200 AS DOUBLE) * CAST(0.0172142 AS DOUBLE)) AS season FROM wn CROSS JOIN ws LEFT JOIN wd ON wd.node = wn.node AND wd.date = CAST(ws.d AS DATE) WHERE wn.node < 3 OR wd.n IS NOT NULL),
wt AS (SELECT *, CAST(14 AS DOUBLE) + CAST(13 AS DOUBLE) * season + noise AS tmax FROM we),
weather AS (SELECT node, date, CAST(year(date) AS BIGINT) AS year, tmax, tmax - spread AS tmin, tmax - spread / 2 AS tmean, CAST(coalesce(n, 0) AS DOUBLE) + rain AS precip,
  CAST(1.5 AS DOUBLE) + CAST(1.2 AS DOUBLE) * season AS et0, CAST(43200 AS DOUBLE) + CAST(19000 AS DOUBLE) * season AS daylight_s FROM wt)"""


def query(sql: str | None = None, *ctes: str):  # noqa: ANN201
    """Registers the function under its name; `sql` gets the named common table expressions in front."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f.__name__)
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            head = ",\n".join(ctes)
            if head and body.upper().startswith("WITH RECURSIVE "):
                body = f"WITH RECURSIVE {head},\n{body[15:]}"
            elif head and body.upper().startswith("WITH "):
                body = f"WITH {head},\n{body[5:]}"
            elif head:
                body = f"WITH {head}\n{body}"
            ORACLE[f.__name__] = body if "RECURSIVE" in body else re.sub(r"(\b\w+) AS \((SELECT)", r"\1 AS MATERIALIZED (\2", body)
        return f

    return add
