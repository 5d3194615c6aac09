"""Queries of evidence, of tables side by side, and of gaps between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle, diagnostics, numeric, structural
from .discovery_queries import RELATIONS
from .diagnostic_queries import _EVENTS, _LEDGER, events
from .registry import query, table
from .rule_queries import ledger


@query("""SELECT l_orderkey AS _row, 'part' AS "column", CAST(l_suppkey AS VARCHAR) AS lineage, min(CAST(l_partkey AS VARCHAR)) AS source, min(CAST(l_quantity AS BIGINT)::VARCHAR) AS expected FROM lineitem GROUP BY 1, 3""")
def independent_witnesses(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("_row"), F.lit("part").alias("column"), F.col("l_suppkey").cast("string").alias("lineage"), F.col("l_partkey").cast("string").alias("source"), F.col("l_quantity").cast("long").cast("string").alias("expected"))
    return structural.distinct_witnesses(t)


@query("""WITH m(relation, family, "column") AS (VALUES (0, 'product', 'subtotal'), (0, 'product', 'qty'), (0, 'product', 'price'), (1, 'difference', 'subtotal'), (1, 'difference', 'total'), (1, 'difference', 'fee'),
 (2, 'sum', 'total'), (2, 'sum', 'subtotal'), (2, 'sum', 'fee'), (3, 'ratio', 'qty'), (3, 'ratio', 'subtotal'), (3, 'ratio', 'price'), (4, 'product_plus', 'total'), (4, 'product_plus', 'qty'), (4, 'product_plus', 'price'), (4, 'product_plus', 'fee'), (5, 'sum', 'fee'), (5, 'sum', 'qty'), (5, 'sum', 'price'))
SELECT "column", count(DISTINCT relation) AS relations, count(DISTINCT family) AS families, count(*) AS stable FROM m GROUP BY 1""")
def constraint_degrees(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, kind, [target, *sources], True) for i, (target, kind, sources) in enumerate(RELATIONS)]
    return structural.relation_degrees(spark.createDataFrame(rows, "relation int, family string, columns array<string>, stable boolean"))


@query(f"""WITH {_LEDGER} SELECT 'subtotal' AS "column", count(*) AS cells, count(*) FILTER (WHERE subtotal <> qty * price) AS supported, round(count(*) FILTER (WHERE subtotal <> qty * price) / count(*), 6) AS share FROM l
UNION ALL SELECT 'fee', count(*), 0, 0 FROM l UNION ALL SELECT 'total', count(*), 0, 0 FROM l UNION ALL SELECT 'qty', count(*), 0, 0 FROM l UNION ALL SELECT 'price', count(*), 0, 0 FROM l""")
def cell_support(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d, numbered=True).select("_row", "qty", "price", "subtotal", "fee", "total")
    return structural.cell_support(t, numeric.votes(t, [{"target": a, "kind": k, "sources": list(s)} for a, k, s in RELATIONS[:2]]))


@query("""WITH a AS (SELECT c_custkey AS "key", c_nationkey AS nation FROM customer), b AS (SELECT s_suppkey AS "key", s_nationkey AS nation FROM supplier)
SELECT 'key' AS "column", (SELECT count(*) FROM a) AS a_rows, (SELECT count(DISTINCT "key") FROM a WHERE "key" IN (SELECT "key" FROM b)) AS matched, true AS "unique" UNION ALL
SELECT 'nation', (SELECT count(*) FROM a), (SELECT count(DISTINCT nation) FROM a WHERE nation IN (SELECT nation FROM b)), false""")
def join_key_recovery(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return bundle.join_keys(a, b, ["key", "nation"])


@query("""SELECT 'orders' AS file, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS versions FROM orders UNION ALL SELECT 'part', 'v1' FROM region WHERE r_regionkey = 0""")
def schema_versions(spark: SparkSession, d: str) -> DataFrame:
    return bundle.schema_versions({"orders": table(spark, d, "orders").select(F.col("o_orderstatus").alias("version")), "part": table(spark, d, "part").select(F.lit("v1").alias("version")), "nation": table(spark, d, "nation")}, "version")


@query("""SELECT 'nation' AS file, 'n_name' AS "column", count(n_name) AS n, count(DISTINCT n_name) AS n_distinct, 0::BIGINT AS blanks FROM nation UNION ALL SELECT 'nation', 'n_nationkey', count(*), count(DISTINCT n_nationkey), 0 FROM nation
UNION ALL SELECT 'customer', 'c_mktsegment', count(*), count(DISTINCT c_mktsegment), 0 FROM customer""")
def sharded_scan(spark: SparkSession, d: str) -> DataFrame:
    return bundle.file_profile({"nation": table(spark, d, "nation").select("n_name", "n_nationkey"), "customer": table(spark, d, "customer").select("c_mktsegment")})


@query("""WITH p AS (SELECT 'orders' AS file, o_orderkey AS _row, 'c' AS "column", CAST(o_custkey % 7 AS VARCHAR) AS expected FROM orders UNION ALL SELECT 'orders', o_orderkey, 'c', CAST(o_custkey % 14 AS VARCHAR) FROM orders)
SELECT file, _row, "column", min(expected) AS expected FROM p GROUP BY 1, 2, 3 HAVING count(DISTINCT expected) = 1""")
def proposals_without_conflict(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    one = lambda m: o.select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("_row"), F.lit("c").alias("column"), (F.col("o_custkey") % m).cast("string").alias("expected"))
    return bundle.proposals_without_conflict(one(7).unionAll(one(14)))


@query(f"""WITH {_EVENTS}, m AS (SELECT max(r) AS m FROM e), g AS (SELECT r, CASE WHEN r % 50 = 7 THEN NULL ELSE (r * 3)::DOUBLE END AS x FROM e) SELECT r AS _row, (r * 3 - 3)::DOUBLE AS low, (r * 3 + 3)::DOUBLE AS high, (r * 3)::DOUBLE AS middle, r < m - 1 AS agrees FROM g, m WHERE x IS NULL AND r < m""")
def interpolation(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.interpolated(events(spark, d).withColumn("x", F.when(F.col("_row") % 50 != 7, (F.col("_row") * 3).cast("double"))), "x")


@query("""SELECT count(*) AS rows, count(DISTINCT (lower(p_type), p_size)) AS forms, round(1 - count(DISTINCT (lower(p_type), p_size)) / count(*), 6) AS hit_rate FROM part""")
def canonical_reuse(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.canonical_reuse(table(spark, d, "part").select(F.upper("p_type").alias("t"), "p_size"), ["t", "p_size"])


@query(f"""WITH {_LEDGER} SELECT 'qty' AS "column", count(*) AS n, round(avg(qty), 6) AS mean, min(qty)::DOUBLE AS low, max(qty)::DOUBLE AS high FROM l UNION ALL SELECT 'total', count(*), round(avg(total), 6), min(total), max(total) FROM l""")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.column_stats(ledger(spark, d), ["qty", "total"])


@query("""SELECT p_partkey AS _row, 'b' AS "column", '' AS value, CAST(p_size * 2 AS VARCHAR) AS expected, 2::BIGINT AS witnesses FROM part WHERE p_partkey % 17 = 4""")
def rank_one_fill(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("_row"), n.alias("a"), F.when(F.col("p_partkey") % 17 == 4, "").otherwise((n * 2).cast("string")).alias("b"), (n * 4).alias("c"))
    return diagnostics.proportional_fills(t, ["a", "b", "c"])


@query("""SELECT o_orderkey AS _row, 'price' AS "column", ((o_orderkey % 90 + 1) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.5') AS value, ((o_orderkey % 90 + 1) * 1000 + o_orderkey % 1000) || '.5' AS expected FROM orders""")
def locale_repair(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    us = F.concat((k % 90 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5"))
    return diagnostics.locale_repairs(table(spark, d, "orders").select(k.alias("_row"), us.alias("price"), "o_orderstatus"), ["price", "o_orderstatus"])
