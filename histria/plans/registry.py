"""Named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Interactions and histories in SQL, the same as histria.sources.driver.
INTER = """inter AS (SELECT o_custkey AS usr, l_partkey AS item, o_orderdate AS ts,
  (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey) - 1)::INT AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hist AS (SELECT usr, list(item ORDER BY pos) AS history FROM inter GROUP BY usr)"""
EVENTS = """ev AS (SELECT user_id AS usr, json_extract_string(props, '$.k')::INT AS item, event_type, ts,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos FROM events)"""


def plan(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
