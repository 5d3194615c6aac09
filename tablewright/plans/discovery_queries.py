"""Queries of relations that are learnt from the data, and of repairs by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import cut
from ..operators import mapping, numeric, overlay, scoped, sequential, temporal
from . import fixpoint
from .registry import LEDGER, NATIONS, NUMBERED, query, table
from .rule_queries import ledger, nations

_SCOPED = lambda n: f"unnest(['all', CASE WHEN r % 2 = 0 THEN 'even' ELSE 'odd' END, CASE WHEN r < {n} // 2 THEN 'first' ELSE 'second' END])"
_STATS = f"""t AS ({NATIONS}), s AS (SELECT {_SCOPED('(SELECT count(*) FROM orders)')} AS scope, customer, nation FROM t),
c AS (SELECT scope, customer, nation, count(*) AS n FROM s GROUP BY 1, 2, 3),
g AS (SELECT scope, customer, sum(n) AS eligible, coalesce(sum(n) FILTER (WHERE nation = ''), 0) AS nulls, coalesce(sum(n) FILTER (WHERE nation <> ''), 0) AS observed, coalesce(max(n) FILTER (WHERE nation <> ''), 0) AS most FROM c GROUP BY 1, 2),
u AS (SELECT scope, sum(eligible)::BIGINT AS eligible, coalesce(sum(observed) FILTER (WHERE observed >= 2), 0)::BIGINT AS considered, count(*) FILTER (WHERE observed >= 2) AS repeated_groups,
 coalesce(sum(most) FILTER (WHERE observed >= 2), 0) AS matched, sum(nulls) AS nulls FROM g GROUP BY 1),
x AS (SELECT scope, eligible, considered, repeated_groups, coalesce(matched::DOUBLE / nullif(considered, 0), 0) AS confidence, considered::DOUBLE / eligible AS coverage, nulls::DOUBLE / eligible AS null_rate FROM u)"""


@query(f"WITH {_STATS} SELECT * FROM x")
def mapping_relation_stats(spark: SparkSession, d: str) -> DataFrame:
    return mapping.relation_stats(nations(spark, d), ["customer"], "nation", table(spark, d, "orders").count())


@query(f"""WITH {_STATS}, p AS (SELECT count(*) AS applicable, min(confidence) AS worst FROM x WHERE scope <> 'all' AND considered >= 4 AND repeated_groups >= 1),
a AS (SELECT * FROM x WHERE scope = 'all')
SELECT 'customer' AS determinants, 'nation' AS dependent, concat_ws(',',
 CASE WHEN NOT (considered >= 12 AND repeated_groups >= 2 AND confidence >= 0.95::DOUBLE AND coverage >= 0.5) THEN 'base_relation_not_strong_enough' END,
 CASE WHEN applicable < 2 THEN 'insufficient_partition_evidence' WHEN worst < 0.95::DOUBLE - 0.05::DOUBLE THEN 'row_scope_sensitive' END,
 CASE WHEN confidence < 0.95::DOUBLE + 0.02::DOUBLE THEN 'confidence_threshold_sensitive' END,
 CASE WHEN null_rate > 0.25 THEN 'missing_value_scope_sensitive' END) AS reasons FROM a, p""")
def mapping_stability(spark: SparkSession, d: str) -> DataFrame:
    _, reasons = mapping.stability(nations(spark, d), ["customer"], "nation", table(spark, d, "orders").count())
    return spark.createDataFrame([("customer", "nation", ",".join(reasons))], "determinants string, dependent string, reasons string")


_GROUPS = f"""t AS ({NATIONS}), c AS (SELECT customer, nation, count(*) AS n, min(r) AS first FROM t WHERE nation <> '' GROUP BY 1, 2),
w AS (SELECT customer, arg_max(nation, (n, -first)) AS expected, sum(n)::BIGINT AS support, max(n)::DOUBLE / sum(n) AS sure FROM c GROUP BY 1)"""


@query(f"WITH {_GROUPS} SELECT r AS _row, 'nation' AS \"column\", nation AS value, expected, support FROM t JOIN w USING (customer) WHERE nation = '' AND support >= 3 AND sure >= 0.98::DOUBLE")
def mapping_missing_projection(spark: SparkSession, d: str) -> DataFrame:
    return mapping.projections(nations(spark, d), ["customer"], "nation")


@query(f"WITH {_GROUPS} SELECT r AS _row, 'nation' AS \"column\", nation AS value, expected, support FROM t JOIN w USING (customer) WHERE nation <> '' AND nation <> expected AND support >= 3 AND sure >= 0.9::DOUBLE")
def mapping_violations(spark: SparkSession, d: str) -> DataFrame:
    return mapping.violations(nations(spark, d), ["customer"], "nation", confidence=0.9)


@query("""SELECT 'o_orderkey' AS columns, count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_rows, count(*) = count(DISTINCT o_orderkey) AS is_key FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'o_orderkey,o_custkey', count(*), count(DISTINCT (o_orderkey, o_custkey)), count(*) = count(DISTINCT (o_orderkey, o_custkey)) FROM orders""")
def unique_key_candidates(spark: SparkSession, d: str) -> DataFrame:
    return mapping.unique_keys(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], 2)


RELATIONS = [("subtotal", "product", ("qty", "price")), ("subtotal", "difference", ("total", "fee")), ("total", "sum", ("subtotal", "fee")), ("qty", "ratio", ("subtotal", "price")), ("total", "product_plus", ("qty", "price", "fee")), ("fee", "sum", ("qty", "price"))]
_WANT = {"subtotal:product": "qty * price", "subtotal:difference": "total - fee", "total:sum": "subtotal + fee", "qty:ratio": "subtotal / price", "total:product_plus": "qty * price + fee", "fee:sum": "qty + price"}
_REL_SQL = " UNION ALL ".join(f"SELECT {i} AS relation, scope, count(*) AS eligible, count(*) FILTER (WHERE abs({k.split(':')[0]} - ({v})) <= 1e-6 + 1e-6 * greatest(abs({v}), 1)) AS matched FROM s GROUP BY scope" for i, (k, v) in enumerate(_WANT.items()))
_LEDGER = f"l AS (SELECT {NUMBERED} AS r, * FROM ({LEDGER}))"


@query(f"WITH {_LEDGER}, s AS (SELECT {_SCOPED('(SELECT count(*) FROM l)')} AS scope, * FROM l) SELECT relation::BIGINT AS relation, scope, eligible, matched FROM ({_REL_SQL})")
def numeric_relation_stats(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d, numbered=True)
    return numeric.relation_stats(t, RELATIONS, table(spark, d, "lineitem").count()).drop("tight")


@query(f"WITH {_LEDGER}, s AS (SELECT {_SCOPED('(SELECT count(*) FROM l)')} AS scope, * FROM l) SELECT relation::BIGINT AS relation, scope, eligible, matched FROM ({_REL_SQL})")
def numeric_relation_stats_batched(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d, numbered=True)
    return numeric.relation_stats(t, RELATIONS, table(spark, d, "lineitem").count(), batches=True).drop("tight")


@query(f"WITH {_LEDGER} SELECT r AS _row, 'subtotal' AS \"column\", CAST(subtotal AS VARCHAR) AS value, CAST(qty * price AS VARCHAR) AS expected, 2::BIGINT AS witnesses FROM l WHERE subtotal <> qty * price")
def numeric_consensus_repair(spark: SparkSession, d: str) -> DataFrame:
    """Learn the equations, let them vote, and report the cells that two agree on."""
    t = ledger(spark, d, numbered=True)
    learnt = numeric.discover(t, ["qty", "price", "subtotal", "fee", "total"], table(spark, d, "lineitem").count())
    return numeric.consensus(t, [r for r in learnt if r["stable"]])


def gaps(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d, numbered=True, corrupt=False)
    return t.withColumn("fee", F.when((F.col("k1") * 3 + F.col("k2")) % 25 == 0, "").otherwise(F.col("fee").cast("string")))


@query(f"WITH {_LEDGER} SELECT r AS _row, 'fee' AS \"column\", '' AS value, CAST(fee AS VARCHAR) AS expected, 1::BIGINT AS witnesses FROM l WHERE (k1 * 3 + k2) % 25 = 0")
def numeric_missing_projection(spark: SparkSession, d: str) -> DataFrame:
    t = gaps(spark, d)
    learnt = numeric.discover(t, ["qty", "price", "subtotal", "fee", "total"], table(spark, d, "lineitem").count())
    return numeric.projections(t, [r for r in learnt if r["stable"]])


@query(f"WITH {_LEDGER} SELECT 'qty' AS \"column\", min(qty)::DOUBLE AS low, max(qty)::DOUBLE AS high FROM l UNION ALL SELECT 'total', min(total), max(total) FROM l")
def relation_ranges(spark: SparkSession, d: str) -> DataFrame:
    return numeric.ranges(ledger(spark, d), ["qty", "total"])


def spans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    at = lambda m: F.concat(F.lit("2024-01-"), two(k % 28 + 1), F.lit("T"), two(k % 24), F.lit(":"), two(m), F.lit(":00"))
    took = (k * 7) % 29 + 1
    return table(spark, d, "events").select(k.alias("_row"), at(k % 30).alias("start"), took.cast("string").alias("took"), F.when(k % 29 == 3, "").otherwise(at(k % 30 + took)).alias("end"))


_SPANS = """t AS (SELECT event_id AS r, event_id % 29 = 3 AS gap, (event_id * 7) % 29 + 1 AS took,
 '2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 30 + (event_id * 7) % 29 + 1 AS VARCHAR), 2, '0') || ':00' AS finish FROM events)"""


@query(f"""WITH {_SPANS}, s AS (SELECT {_SCOPED('(SELECT count(*) FROM t)')} AS scope, * FROM t), u(unit, k) AS (VALUES ('seconds', 1), ('minutes', 60), ('hours', 3600), ('days', 86400))
SELECT unit, scope, count(*) FILTER (WHERE NOT gap) AS eligible, count(*) FILTER (WHERE NOT gap AND took * 60 = took * k) AS matched FROM s, u GROUP BY 1, 2""")
def temporal_relation_stats(spark: SparkSession, d: str) -> DataFrame:
    return temporal.relation_stats(spans(spark, d), "start", "end", "took", table(spark, d, "events").count())


@query(f"WITH {_SPANS} SELECT r AS _row, 'end' AS \"column\", '' AS value, finish AS expected FROM t WHERE gap")
def temporal_projection(spark: SparkSession, d: str) -> DataFrame:
    t = spans(spark, d)
    learnt = temporal.discover(t, ["start", "end"], ["took"], table(spark, d, "events").count())
    one = next(r for r in learnt if r["start"] == "start" and r["stable"])
    return temporal.projections(t, one)


def balances(spark: SparkSession, d: str, every: int = 97) -> DataFrame:
    """Inflow and outflow by event, their balance, and 9 too much in one row of ``every``."""
    k = F.col("event_id")

    def upto(m: int) -> Column:
        q, r = F.floor((k + 1) / m), (k + 1) % m
        return q * (m * (m - 1) // 2) + F.floor(r * (r - 1) / 2)

    return table(spark, d, "events").select(k.alias("_row"), (k % 17).alias("inflow"), (k % 5).alias("outflow"), (upto(17) - upto(5) + F.when(k % every == 13, 9).otherwise(0)).cast("long").alias("balance"))


_BALANCE = """t AS (SELECT event_id AS r, event_id % 17 AS inflow, event_id % 5 AS outflow, sum(event_id % 17 - event_id % 5) OVER (ORDER BY event_id) AS good, event_id % 97 = 13 AS bad FROM events),
b AS (SELECT *, good + CASE WHEN bad THEN 9 ELSE 0 END AS balance FROM t)"""


@query(f"""WITH {_BALANCE}, n AS (SELECT *, lag(balance) OVER (ORDER BY r) AS p FROM b), s AS (SELECT {_SCOPED('(SELECT count(*) FROM b)')} AS scope, * FROM n)
SELECT 0 AS relation, scope, count(p) AS eligible, count(*) FILTER (WHERE balance = p + inflow - outflow) AS matched FROM s GROUP BY scope""")
def running_balance_stats(spark: SparkSession, d: str) -> DataFrame:
    return sequential.relation_stats(balances(spark, d), [("balance", "inflow", "outflow")], table(spark, d, "events").count())


@query(f"WITH {_BALANCE}, m AS (SELECT max(r) AS m FROM b) SELECT r AS _row, 'balance' AS \"column\", CAST(balance::BIGINT AS VARCHAR) AS value, CAST(good::BIGINT AS VARCHAR) AS expected FROM b, m WHERE bad AND r > 0 AND r < m")
def running_balance_two_sided(spark: SparkSession, d: str) -> DataFrame:
    t = balances(spark, d)
    learnt = sequential.discover(t, ["balance", "inflow", "outflow"], table(spark, d, "events").count())
    one = next(r for r in learnt if r["balance"] == "balance" and r["inflow"] == "inflow" and r["outflow"] == "outflow")
    return sequential.two_sided(t, one)


@query("SELECT event_id AS _row, 'inflow' AS \"column\", '' AS value, CAST(event_id % 17 AS VARCHAR) AS expected FROM events WHERE event_id % 31 = 7")
def running_balance_projection(spark: SparkSession, d: str) -> DataFrame:
    t = balances(spark, d, 1 << 40).withColumn("inflow", F.when(F.col("_row") % 31 == 7, "").otherwise(F.col("inflow").cast("string")))
    return sequential.projections(t, {"balance": "balance", "inflow": "inflow", "outflow": "outflow"})


def flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    slope = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 3).otherwise(5)
    x = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("_row"), F.col("l_returnflag").alias("flag"), x.cast("string").alias("x"), F.when((k * 7 + F.col("l_linenumber")) % 33 == 0, "").otherwise((x * slope + 4).cast("string")).alias("y"))


_FLAGS = "t AS (SELECT l_orderkey * 10 + l_linenumber AS r, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS x, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 5 END AS slope, (l_orderkey * 7 + l_linenumber) % 33 = 0 AS gap FROM lineitem)"


@query(f"""WITH {_FLAGS} SELECT flag AS scope, slope::DOUBLE AS slope, 4::DOUBLE AS intercept, count(*) AS support, 1::DOUBLE AS confidence, true AS exact, true AS stable, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM t WHERE NOT gap GROUP BY flag, slope""")
def scoped_affine(spark: SparkSession, d: str) -> DataFrame:
    return scoped.fits(flags(spark, d), "flag", "x", "y")


@query(f"WITH {_FLAGS} SELECT r AS _row, 'y' AS \"column\", '' AS value, CAST(x * slope + 4 AS VARCHAR) AS expected FROM t WHERE gap")
def scoped_projection(spark: SparkSession, d: str) -> DataFrame:
    t = flags(spark, d)
    return scoped.projections(t, scoped.discover(t, ["flag"], ["x", "y"])[0])


@query(f"WITH {_LEDGER} SELECT r AS _row, CAST(qty AS VARCHAR) AS qty, CAST(price AS VARCHAR) AS price, CAST(qty * price AS VARCHAR) AS subtotal, CAST(fee AS VARCHAR) AS fee, CAST(total AS VARCHAR) AS total FROM l")
def repair_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after the repair loop, which learns its equations by itself."""
    t = ledger(spark, d, numbered=True).select("_row", "qty", "price", "subtotal", "fee", "total")
    return fixpoint.repair(t, fixpoint.Config(numeric=True)).table


@query(f"WITH {_LEDGER}, n AS (SELECT count(*) FILTER (WHERE subtotal <> qty * price) AS bad FROM l) SELECT bad AS wrong_before, bad AS touched, bad AS repaired, 0::BIGINT AS false_mutations, 0::BIGINT AS wrong_after, 1::DOUBLE AS precision, 1::DOUBLE AS recall, true AS exact FROM n")
def truth_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A repair by two witnesses, held against the clean ledger."""
    columns = ["_row", "qty", "price", "subtotal", "fee", "total"]
    dirty = ledger(spark, d, numbered=True).select(columns)
    clean = dirty.withColumn("subtotal", F.col("qty") * F.col("price"))
    found = numeric.consensus(dirty, [{"target": t, "kind": k, "sources": list(s)} for t, k, s in RELATIONS[:2]])
    edits = cut(found.select(F.lit("set_cell").alias("kind"), "_row", "column", F.col("value").alias("old"), F.col("expected").alias("new")))
    return overlay.truth(dirty, overlay.apply(dirty, edits, written=True, deletes=False), clean)


@query(f"WITH {_LEDGER} SELECT r AS _row, qty, price, CAST(subtotal AS VARCHAR) AS subtotal FROM l")
def overlay_undo(spark: SparkSession, d: str) -> DataFrame:
    """Edits laid over the ledger and taken back: what was there before."""
    dirty = ledger(spark, d, numbered=True).select("_row", "qty", "price", "subtotal")
    edits = dirty.where(F.col("subtotal") != F.col("qty") * F.col("price")).select(F.lit("set_cell").alias("kind"), "_row", F.lit("subtotal").alias("column"), F.col("subtotal").cast("string").alias("old"), (F.col("qty") * F.col("price")).cast("string").alias("new"))
    back = overlay.restore(overlay.apply(dirty, edits), edits)
    return back.select("_row", F.col("qty").cast("int").alias("qty"), F.col("price").cast("int").alias("price"), "subtotal")
