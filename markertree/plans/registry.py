"""Registry of named queries and their ANSI-SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the inventory ids it exercises."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded value without negative zero, so both engines print the same number."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[
        r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns
    ])


# Shared SQL fragments: the canonical tables written for the oracle side.
LINE_SQL = """cells AS (
  SELECT l_returnflag AS batch,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS cell_id,
         l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax
  FROM lineitem)"""

LONG_SQL = LINE_SQL + """, long AS (
  SELECT batch, cell_id, 'qty' AS feature, qty AS value FROM cells UNION ALL
  SELECT batch, cell_id, 'price', price FROM cells UNION ALL
  SELECT batch, cell_id, 'disc', disc FROM cells UNION ALL
  SELECT batch, cell_id, 'tax', tax FROM cells)"""

EVENTS_SQL = """counts AS (
  SELECT CAST(user_id AS VARCHAR) AS cell_id, event_type AS feature, CAST(count(*) AS DOUBLE) AS value
  FROM events GROUP BY ALL)"""

TOKENS_SQL = """words AS (
  SELECT source AS batch, CAST(doc_id AS VARCHAR) AS cell_id,
         unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS feature FROM documents),
tokens AS MATERIALIZED (
  SELECT batch, cell_id, feature, CAST(count(*) AS DOUBLE) AS value
  FROM words WHERE feature <> '' GROUP BY ALL)"""
