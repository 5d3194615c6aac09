"""Where queries are named, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(df: DataFrame, row: str, **columns: Column | str) -> DataFrame:
    """The ``wide`` view: ``_row`` from an integer key, and text columns."""
    return df.select(F.col(row).cast("long").alias("_row"), *[(F.expr(c) if isinstance(c, str) else c).cast("string").alias(n) for n, c in columns.items()])


# === tables with planted defects, the same in both dialects ===

CUSTOMERS = """SELECT c_custkey AS r,
  CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS name,
  CASE WHEN c_custkey % 50 = 3 THEN 'N/A' WHEN c_custkey % 40 = 1 THEN '' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 4 = 0 THEN 'NULL' ELSE c_mktsegment END AS crowded,
  CASE c_custkey % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'n' WHEN 2 THEN 'true' WHEN 3 THEN ' False ' ELSE 'true' END AS active
FROM customer"""

#: price and shares are small integers, so that every value is exact in any type
LEDGER = """SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
  CAST(l_quantity AS INT) AS qty, CAST(2 + l_partkey % 11 AS INT) AS price,
  CAST(l_quantity AS INT) * CAST(2 + l_partkey % 11 AS INT) + CASE WHEN (l_orderkey * 7 + l_linenumber) % 20 = 0 THEN 7 ELSE 0 END AS subtotal,
  CAST(2 + l_suppkey % 3 AS INT) AS fee,
  CAST(l_quantity AS INT) * CAST(2 + l_partkey % 11 AS INT) + CAST(2 + l_suppkey % 3 AS INT) AS total
FROM lineitem"""

#: the ledger's rows by number; lines that are equal in all of these are equal
NUMBERED = "row_number() OVER (ORDER BY k1, k2, k3, k4, qty) - 1"

#: orders with their customer's nation, wrong in one of 37 rows and blank in one of 41
NATIONS = """SELECT o_orderkey AS r, CAST(o_custkey AS VARCHAR(20)) AS customer,
  CASE WHEN o_orderkey % 37 = 5 THEN 'NOWHERE' WHEN o_orderkey % 41 = 7 THEN '' ELSE n_name END AS nation
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

#: events with a duration in minutes and an end; one end of 29 is blank
SPANS = """SELECT event_id AS r, epoch(ts)::BIGINT AS s0, (event_id * 7) % 90 + 1 AS minutes FROM events"""
