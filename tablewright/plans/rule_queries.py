"""Queries of the local and the declared rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ordered import with_row
from ..operators import declared, local
from .registry import CUSTOMERS, LEDGER, NATIONS, NUMBERED, query, table

_STRIP = lambda v: f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("_row"),
        F.when(k % 7 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 50 == 3, "N/A").when(k % 40 == 1, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 4 == 0, "NULL").otherwise(F.col("c_mktsegment")).alias("crowded"),
        F.when(k % 5 == 0, "YES").when(k % 5 == 1, "n").when(k % 5 == 3, " False ").otherwise("true").alias("active"),
    )


def ledger(spark: SparkSession, d: str, numbered: bool = False, corrupt: bool = True) -> DataFrame:
    """Lines with keys ``k1`` to ``k4``, or ``_row`` by them; every twentieth subtotal is 7 too much."""
    t = table(spark, d, "lineitem")
    qty, price, fee = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 11 + 2).cast("int"), (F.col("l_suppkey") % 3 + 2).cast("int")
    wrong = F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 20 == 0, 7).otherwise(0) if corrupt else F.lit(0)
    keys = [F.col(c).alias(n) for c, n in (("l_orderkey", "k1"), ("l_linenumber", "k2"), ("l_partkey", "k3"), ("l_suppkey", "k4"))]
    out = t.select(*keys, qty.alias("qty"), price.alias("price"), (qty * price + wrong).alias("subtotal"), fee.alias("fee"), (qty * price + fee).alias("total"))
    return with_row(out, "k1", "k2", "k3", "k4", "qty") if numbered else out


def nations(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    return j.select(k.alias("_row"), F.col("o_custkey").cast("string").alias("customer"), F.when(k % 37 == 5, "NOWHERE").when(k % 41 == 7, "").otherwise(F.col("n_name")).alias("nation"))


@query(f"""WITH t AS ({CUSTOMERS}), l AS (SELECT r, 'name' AS "column", name AS value FROM t UNION ALL SELECT r, 'segment', segment FROM t UNION ALL SELECT r, 'active', active FROM t)
SELECT r AS _row, "column", value, {_STRIP('value')} AS expected FROM l WHERE value <> {_STRIP('value')}""")
def cell_outer_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return local.outer_whitespace(customers(spark, d), ["name", "segment", "active"])


@query(f"""WITH t AS ({CUSTOMERS}), l AS (SELECT r, 'segment' AS "column", segment AS value FROM t UNION ALL SELECT r, 'crowded', crowded FROM t),
m AS (SELECT *, lower(trim(value)) IN ('missing', 'nil', 'none', 'null', 'n/a', 'na') AS marker FROM l),
ok AS (SELECT "column", count(*) FILTER (WHERE trim(value) = '') >= 1 AND count(*) FILTER (WHERE NOT marker AND trim(value) <> '') >= 3
  AND count(*) FILTER (WHERE marker) <= greatest(2, floor(count(*) FILTER (WHERE NOT marker AND trim(value) <> '') / 5)) AS repairable FROM m GROUP BY 1)
SELECT r AS _row, "column", value, '' AS expected, repairable FROM m JOIN ok USING ("column") WHERE marker""")
def null_marker_contextual(spark: SparkSession, d: str) -> DataFrame:
    return local.null_markers(customers(spark, d), ["segment", "crowded"])


@query(f"""WITH t AS ({CUSTOMERS}), l AS (SELECT r AS _row, 'active' AS "column", active AS value,
  CASE WHEN lower(trim(active)) IN ('t', 'true', 'y', 'yes') THEN 'true' WHEN lower(trim(active)) IN ('f', 'false', 'n', 'no') THEN 'false' END AS expected FROM t)
SELECT * FROM l WHERE value <> expected""")
def boolean_spelling(spark: SparkSession, d: str) -> DataFrame:
    return local.boolean_spelling(customers(spark, d), ["name", "active"])


@query("""WITH t AS (SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 23 = 0 THEN 'oops' WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 31 = 0 THEN '2024-01-02' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS value FROM orders)
SELECT _row, 'price' AS "column", value, CASE WHEN value = 'oops' THEN 'string' ELSE 'date' END AS type, 'int' AS dominant FROM t WHERE value IN ('oops', '2024-01-02')""")
def dominant_type(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = F.when(k % 23 == 0, "oops").when(k % 29 == 0, "").when(k % 31 == 0, "2024-01-02").otherwise(F.floor("o_totalprice").cast("long").cast("string"))
    return local.dominant_type(table(spark, d, "orders").select(k.alias("_row"), price.alias("price"), F.col("o_orderstatus").alias("status")))


@query("""SELECT * FROM (SELECT doc_id AS _row, min(doc_id) OVER (PARTITION BY text, lang) AS first FROM documents) WHERE _row > first""")
def exact_duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return local.exact_duplicates(table(spark, d, "documents").select(F.col("doc_id").alias("_row"), "text", "lang"))


@query("""WITH t AS (SELECT p_partkey AS r, CASE WHEN p_partkey % 3 = 0 THEN ' ' || upper(p_type) ELSE p_type END AS a, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.0' ELSE p_size || '' END AS b, p_size AS n, p_type AS ty FROM part)
SELECT min(r) AS parent, count(*) AS members, count(DISTINCT (a, b)) AS forms FROM t GROUP BY lower(ty), n HAVING count(*) > 1""")
def canonical_duplicate_families(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(k.alias("_row"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("p_type"))).otherwise(F.col("p_type")).alias("a"), F.concat(F.col("p_size").cast("string"), F.when(k % 2 == 0, ".0").otherwise("")).alias("b"))
    return local.duplicate_families(t, ["a", "b"])


@query(f"""WITH t AS (SELECT {NUMBERED} AS _row, k1, k2 FROM ({LEDGER}) l)
SELECT * FROM (SELECT _row, k1, k2, min(_row) OVER (PARTITION BY k1, k2) AS first FROM t) WHERE _row > first""")
def unique_key_violation(spark: SparkSession, d: str) -> DataFrame:
    return declared.unique_key(ledger(spark, d, numbered=True).select("_row", "k1", "k2"), ["k1", "k2"])


_FD_SQL = f"""WITH t AS ({NATIONS}), c AS (SELECT customer, nation, count(*) AS n, min(r) AS first FROM t WHERE nation <> '' GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY n DESC, first) AS i, sum(n) OVER (PARTITION BY customer) AS support FROM c),
b AS (SELECT customer, max(nation) FILTER (WHERE i = 1) AS expected, max(n) FILTER (WHERE i = 1) AS most, coalesce(max(n) FILTER (WHERE i = 2), 0) AS second, max(support) AS support FROM o GROUP BY 1)
SELECT r AS _row, 'nation' AS "column", nation AS value, expected, support::BIGINT AS support FROM t JOIN b USING (customer)
WHERE nation <> '' AND nation <> expected AND support >= 3 AND most > second AND most >= support * 0.66::DOUBLE"""


@query(_FD_SQL)
def declared_fd_majority(spark: SparkSession, d: str) -> DataFrame:
    return declared.dependency(nations(spark, d), ["customer"], "nation")


@query(f"""SELECT k1, k2, k3, k4, subtotal AS value, qty * price AS expected FROM ({LEDGER}) WHERE subtotal <> qty * price""")
def row_formula_violation(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d)
    bad = X.evaluate("product", [F.col("qty"), F.col("price")])
    return t.where(F.col("subtotal") != bad).select("k1", "k2", "k3", "k4", F.col("subtotal").alias("value"), bad.alias("expected"))


@query(f"""SELECT _row, 'subtotal' AS "column", CAST(subtotal AS VARCHAR) AS value, CAST(qty * price AS VARCHAR) AS expected FROM (SELECT {NUMBERED} AS _row, * FROM ({LEDGER})) WHERE abs(subtotal - qty * price) > 0.01""")
def row_formula_repair(spark: SparkSession, d: str) -> DataFrame:
    return declared.formula(ledger(spark, d, numbered=True), "subtotal", "product", ["qty", "price"])


@query("""WITH t AS (SELECT p_partkey AS _row, CASE p_partkey % 4 WHEN 0 THEN p_size || ' cm' WHEN 1 THEN p_size || 'mm' WHEN 2 THEN p_size || ' cubit' ELSE p_size || ' m' END AS value, p_size * 1 AS n FROM part)
SELECT _row, 'length' AS "column", value, CASE WHEN _row % 4 = 2 THEN 'unknown_unit' ELSE 'noncanonical_unit' END AS code,
 CASE _row % 4 WHEN 0 THEN regexp_replace(printf('%.3f', n / 100), '\\.?0+$', '') || ' m' WHEN 1 THEN regexp_replace(printf('%.3f', n / 1000), '\\.?0+$', '') || ' m' END AS expected FROM t WHERE _row % 4 <> 3""")
def unit_normalize(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    v = F.when(k % 4 == 0, F.concat(n, F.lit(" cm"))).when(k % 4 == 1, F.concat(n, F.lit("mm"))).when(k % 4 == 2, F.concat(n, F.lit(" cubit"))).otherwise(F.concat(n, F.lit(" m")))
    return declared.units(table(spark, d, "part").select(k.alias("_row"), v.alias("length")), "length", "m", {"m": 1, "mm": 0.001, "cm": 0.01})


@query("""WITH t AS (SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 19 = 4 THEN o_custkey + 100000000 ELSE o_custkey END AS c FROM orders)
SELECT _row, 'customer' AS "column", CAST(c AS VARCHAR) AS value FROM t WHERE c NOT IN (SELECT c_custkey FROM customer)""")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    child = table(spark, d, "orders").select(k.alias("_row"), F.when(k % 19 == 4, F.col("o_custkey") + 100000000).otherwise(F.col("o_custkey")).alias("customer"))
    return declared.orphans(child, "customer", table(spark, d, "customer"), "c_custkey")


@query("""SELECT o_orderkey AS _row, 'status' AS "column", o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def allowed_values(spark: SparkSession, d: str) -> DataFrame:
    return declared.allowed(table(spark, d, "orders").select(F.col("o_orderkey").alias("_row"), F.col("o_orderstatus").alias("status")), "status", ["O", "F"])


@query("""SELECT p_partkey AS _row, 'size' AS "column", CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size < 5 OR p_size > 40""")
def range_violation(spark: SparkSession, d: str) -> DataFrame:
    return declared.in_range(table(spark, d, "part").select(F.col("p_partkey").alias("_row"), F.col("p_size").alias("size")), "size", 5, 40)


@query("""WITH l AS (SELECT 'status' AS "column", o_orderstatus AS v, NULL::DOUBLE AS x FROM orders UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), p_size FROM part)
SELECT "column", count(*) AS n, 0::BIGINT AS n_empty, count(*) FILTER (WHERE v IN ('F', 'T', 'Y', 'N')) AS n_bool, count(x) AS n_int, 0::BIGINT AS n_float, 0::BIGINT AS n_date,
 count(*) FILTER (WHERE x IS NULL AND v NOT IN ('F', 'T', 'Y', 'N')) AS n_string, count(DISTINCT v) AS n_distinct, min(x) AS low, max(x) AS high FROM l GROUP BY 1""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("_row"), F.col("o_orderstatus").alias("status"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("_row"), F.col("p_size").cast("string").alias("size"))
    return local.column_profile(a).unionByName(local.column_profile(b))


@query("""WITH l AS (SELECT 'brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part),
c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 16""")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return local.top_values(table(spark, d, "part").select(F.col("p_partkey").alias("_row"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size")))


_STATES = """WITH t AS (SELECT event_id AS _row, CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN '<' || (event_id % 13) WHEN 3 THEN '>= ' || (event_id % 17) WHEN 4 THEN 'not applicable' WHEN 5 THEN 'absent' ELSE CAST(event_id % 100 AS VARCHAR) END AS value FROM events)"""


def states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    v = F.when(k % 11 == 0, "").when(k % 11 == 1, "NA").when(k % 11 == 2, F.concat(F.lit("<"), (k % 13).cast("string"))).when(k % 11 == 3, F.concat(F.lit(">= "), (k % 17).cast("string"))).when(k % 11 == 4, "not applicable").when(k % 11 == 5, "absent").otherwise((k % 100).cast("string"))
    return table(spark, d, "events").select(k.alias("_row"), v.alias("value"))


@query(_STATES + """ SELECT _row, value, CASE _row % 11 WHEN 0 THEN 'MISSING_KNOWN' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'CENSORED' WHEN 3 THEN 'CENSORED' WHEN 4 THEN 'STRUCTURALLY_NOT_APPLICABLE' WHEN 5 THEN 'ABSENT_CERTIFIED' ELSE 'OBSERVED' END AS state FROM t""")
def missingness_states(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d).select("_row", "value", local.missing_state(F.col("value")).alias("state"))


@query(_STATES + """ SELECT _row, 'value' AS "column", value, CASE WHEN _row % 11 = 3 THEN (_row % 17)::DOUBLE END AS lower, CASE WHEN _row % 11 = 2 THEN (_row % 13)::DOUBLE END AS upper, _row % 11 = 3 AS closed FROM t WHERE _row % 11 IN (2, 3)""")
def censor_bounds(spark: SparkSession, d: str) -> DataFrame:
    return local.censor_bounds(states(spark, d))


@query("""SELECT p_partkey AS _row, 'price' AS "column", CASE WHEN p_partkey % 3 = 0 THEN '1.5' WHEN p_partkey % 3 = 1 THEN '22' ELSE '3.250' END AS value, CASE WHEN p_partkey % 3 = 0 THEN 0.05 WHEN p_partkey % 3 = 1 THEN 0.5 ELSE 0.0005 END::DOUBLE AS half_step FROM part""")
def quantization(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return local.quantum(table(spark, d, "part").select(k.alias("_row"), F.when(k % 3 == 0, "1.5").when(k % 3 == 1, "22").otherwise("3.250").alias("price")))


@query("""SELECT p_partkey AS _row, 'weight' AS "column", CASE p_partkey % 4 WHEN 0 THEN p_size || ' kg' WHEN 1 THEN p_size || 'cm' WHEN 2 THEN p_size || ' min' END AS value,
 CASE p_partkey % 4 WHEN 0 THEN 'mass' WHEN 1 THEN 'length' ELSE 'time' END AS family, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.01 ELSE 60.0 END, 9)::DOUBLE AS base FROM part WHERE p_partkey % 4 < 3""")
def unit_graph(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    v = F.when(k % 4 == 0, F.concat(n, F.lit(" kg"))).when(k % 4 == 1, F.concat(n, F.lit("cm"))).when(k % 4 == 2, F.concat(n, F.lit(" min"))).otherwise(F.concat(n, F.lit(" ells")))
    return local.base_units(table(spark, d, "part").select(k.alias("_row"), v.alias("weight")))


@query(f"""WITH t AS ({CUSTOMERS}), x AS (SELECT r, {_STRIP('name')} AS name, CASE WHEN lower(trim(segment)) = 'n/a' THEN '' ELSE trim(segment) END AS segment,
 CASE WHEN lower(trim(active)) IN ('t', 'true', 'y', 'yes') THEN 'true' WHEN lower(trim(active)) IN ('f', 'false', 'n', 'no') THEN 'false' ELSE trim(active) END AS active FROM t)
SELECT r AS _row, name, segment, active FROM x""")
def stream_local_repair(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select("_row", *[local.canonical_cell(F.col(c), c == "active").alias(c) for c in ("name", "segment", "active")])
