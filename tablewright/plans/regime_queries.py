"""Queries of regimes, held-out error and row alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, regimes
from .diagnostic_queries import _EVENTS, _LEDGER, events
from .registry import query, table
from .rule_queries import ledger

_N = "n AS (SELECT count(*) AS n FROM e)"


def level(n: int):  # noqa: ANN201
    """Alternating levels by quarter, with a small ripple."""
    q = F.least(F.floor(F.col("_row") / (n // 4)), F.lit(3))
    return (F.when(q % 2 == 0, 10).otherwise(50) + F.col("_row") % 5).cast("double")


_LEVEL = "l AS (SELECT r, (CASE WHEN least(r // (n // 4), 3) % 2 = 0 THEN 10 ELSE 50 END + r % 5)::DOUBLE AS x, n, least(r // (n // 4), 3) AS q FROM e, n)"


@query(f"""WITH {_EVENTS}, {_N}, {_LEVEL}, g AS (SELECT avg(x) FILTER (WHERE q = 0) AS q1, avg(x) FILTER (WHERE q = 1) AS q2, avg(x) FILTER (WHERE q = 2) AS q3, avg(x) FILTER (WHERE q = 3) AS q4, stddev_samp(x) AS sd FROM l)
SELECT round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(q4, 6) AS q4, round(abs((q1 + q3) / 2 - (q2 + q4) / 2) / sd, 6) AS separation, abs(q1 - q3) <= 0.6 * sd AND abs(q2 - q4) <= 0.6 * sd AND abs((q1 + q3) / 2 - (q2 + q4) / 2) / sd >= 1.5 AS recurring FROM g""")
def recurring_regime(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").count()
    return regimes.quarters(events(spark, d).withColumn("x", level(n)), "x", n)


@query(f"""WITH {_EVENTS}, {_N}, {_LEVEL} SELECT round(sum(pow(1 - 2.0::DOUBLE / (greatest(6, n // 5) + 1), n - 1 - r) * (CASE WHEN r = 0 THEN 1 ELSE 2.0::DOUBLE / (greatest(6, n // 5) + 1) END) * x), 6) AS ema FROM l""")
def exponential_mean(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").count()
    return regimes.ema(events(spark, d).withColumn("x", level(n)), "x", n)


@query(f"""WITH {_LEDGER}, n AS (SELECT count(*) AS n FROM l), m AS (SELECT median(subtotal - qty * price) FILTER (WHERE r < n // 2) AS a, median(subtotal - qty * price) FILTER (WHERE r >= n // 2) AS b FROM l, n)
SELECT round(a, 6)::DOUBLE AS first, round(b, 6)::DOUBLE AS second, round(b - a, 6)::DOUBLE AS shift FROM m""")
def calibration_shift(spark: SparkSession, d: str) -> DataFrame:
    return regimes.half_shift(ledger(spark, d, numbered=True), F.col("subtotal") - F.col("qty") * F.col("price"), table(spark, d, "lineitem").count())


@query(f"""WITH {_EVENTS}, m AS (SELECT count(*) AS rows, avg(wave) AS m, var_pop(wave) AS v FROM e), p AS (SELECT wave, lag(wave) OVER (ORDER BY r) AS p FROM e), s AS (SELECT sum((wave - m) * (p - m)) AS s FROM p, m)
SELECT rows, round(s / (v * rows), 6) AS acf1, abs(s / (v * rows)) <= 2 / sqrt(rows) AS white FROM m, s""")
def residual_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return regimes.autocorrelation(events(spark, d), "wave")


_LOOP = "h AS (SELECT r, x, 2 * x + CASE WHEN down THEN 30 ELSE 0 END + r % 3 AS y, down FROM (SELECT r, abs(r % 40 - 20)::DOUBLE AS x, r > 0 AND abs(r % 40 - 20) < abs((r - 1) % 40 - 20) AS down FROM e))"


def loop(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("_row")
    x, p = F.abs(k % 40 - 20), F.abs((k - 1) % 40 - 20)
    return events(spark, d).select("_row", x.cast("double").alias("x"), (2 * x + F.when((k > 0) & (x < p), 30).otherwise(0) + k % 3).cast("double").alias("y"))


@query(f"""WITH {_EVENTS}, {_LOOP}, g AS (SELECT least(floor((x - 0) / 20 * 10), 9)::BIGINT AS bin, avg(y) FILTER (WHERE NOT down) AS up, avg(y) FILTER (WHERE down) AS dn, var_samp(y) FILTER (WHERE NOT down) AS vu, var_samp(y) FILTER (WHERE down) AS vd, count(*) FILTER (WHERE NOT down) AS nu, count(*) FILTER (WHERE down) AS nd FROM h GROUP BY 1)
SELECT bin, round(up, 6) AS up, round(dn, 6) AS down, round(abs(up - dn) / sqrt(greatest((vu + vd) / 2, 1e-30)), 6) AS separation FROM g WHERE nu >= 3 AND nd >= 3""")
def hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return regimes.hysteresis(loop(spark, d), "x", "y")


@query(f"""WITH {_EVENTS}, {_LOOP}, b AS (SELECT *, least(floor(x / 20 * 10), 9)::BIGINT AS bin FROM h), m AS (SELECT bin, median(y) AS mid, stddev_samp(y) AS sd, count(*) AS count FROM b GROUP BY 1 HAVING count(*) >= 6),
g AS (SELECT bin, max(count) AS count, max(sd) AS sd, avg(y) FILTER (WHERE y <= mid) AS lo, avg(y) FILTER (WHERE y > mid) AS hi, count(*) FILTER (WHERE y <= mid) AS n, count(*) FILTER (WHERE y > mid) AS k FROM b JOIN m USING (bin) GROUP BY 1)
SELECT bin, count, round((hi - lo) / greatest(sd, 1e-15), 6) AS separation FROM g WHERE n >= 2 AND k >= 2 AND round((hi - lo) / greatest(sd, 1e-15), 6) >= 1.5""")
def multistability(spark: SparkSession, d: str) -> DataFrame:
    return regimes.multistable(loop(spark, d), "x", "y")


@query(f"""WITH {_LEDGER}, n AS (SELECT count(*) AS n FROM l), c AS (SELECT s, n * s // 100 AS k FROM n, (VALUES (25), (50), (75), (100)) v(s)) SELECT s::BIGINT AS share, count(*) AS rows, round(avg((subtotal = qty * price)::INT), 6) AS rate FROM c JOIN l ON r < k GROUP BY s""")
def prefix_evidence(spark: SparkSession, d: str) -> DataFrame:
    return regimes.prefixes(ledger(spark, d, numbered=True), F.col("subtotal") == F.col("qty") * F.col("price"), table(spark, d, "lineitem").count())


@query(f"""WITH {_LEDGER}, n AS (SELECT count(*) AS n FROM l), x AS (SELECT unnest([CASE WHEN r < greatest(1, n * 6 // 10) THEN 'train' WHEN r < greatest(1, n * 8 // 10) THEN 'validation' ELSE 'test' END, 'quarter' || (least(r * 4 // n, 3) + 1)]) AS part, abs(subtotal - qty * price) AS e FROM l, n)
SELECT part, count(*) AS rows, round(avg(e), 6) AS mean_error, max(e)::DOUBLE AS worst FROM x GROUP BY 1""")
def held_out_error(spark: SparkSession, d: str) -> DataFrame:
    return regimes.held_out(ledger(spark, d, numbered=True), (F.col("subtotal") - F.col("qty") * F.col("price")).cast("double"), table(spark, d, "lineitem").count())


@query(f"""WITH {_LEDGER} SELECT r % 5 AS fold, count(*) AS rows, round(avg(abs(subtotal - qty * price)), 6) AS mean_error FROM l GROUP BY 1""")
def k_fold_error(spark: SparkSession, d: str) -> DataFrame:
    return regimes.folds(ledger(spark, d, numbered=True), F.col("subtotal") - F.col("qty") * F.col("price"))


@query(f"""WITH {_LEDGER}, e AS (SELECT (subtotal - qty * price)::DOUBLE AS a, (total - subtotal)::DOUBLE AS b FROM l), s AS (SELECT 'product' AS model, 2 AS k, count(*) AS rows, sum(a * a) AS rss FROM e UNION ALL SELECT 'difference', 3, count(*), sum(b * b) FROM e)
SELECT model, rows, round(rss, 6) AS rss, round(rows * ln(greatest(rss / rows, 1e-30)) + 2 * k, 6) AS aic, round(rows * ln(greatest(rss / rows, 1e-30)) + k * ln(rows), 6) AS bic FROM s""")
def complexity_ranking(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d)
    return regimes.complexity(t, {"product": ((F.col("subtotal") - F.col("qty") * F.col("price")).cast("double"), 2), "difference": ((F.col("total") - F.col("subtotal")).cast("double"), 3)})


@query(f"""WITH {_LEDGER}, n AS (SELECT count(*) AS n FROM l), s AS (SELECT count(*) FILTER (WHERE subtotal <> qty * price AND r < n // 2) AS before, count(*) FILTER (WHERE subtotal <> qty * price AND r >= n // 2) AS after FROM l, n) SELECT *, greatest(before, after) >= (before + after) * 0.8 AS one_sided FROM s""")
def epoch_revalidation(spark: SparkSession, d: str) -> DataFrame:
    return regimes.epochs(ledger(spark, d, numbered=True), F.col("subtotal") != F.col("qty") * F.col("price"), table(spark, d, "lineitem").count() // 2)


@query()
def bootstrap_confidence(spark: SparkSession, d: str) -> DataFrame:
    return regimes.bootstrap(ledger(spark, d, numbered=True), F.col("subtotal") == F.col("qty") * F.col("price"))


@query("""SELECT c_custkey AS _row, CASE WHEN c_custkey % 10 = 3 THEN 'insert_blank' ELSE 'remove_blank' END AS operation, CASE WHEN c_custkey % 10 = 3 THEN 2 ELSE 1 END::BIGINT AS position, 0::BIGINT AS mismatches,
 CASE WHEN c_custkey % 10 = 3 THEN c_custkey || '|' || c_name || '||' || c_mktsegment ELSE c_custkey || '|' || c_name || '|' || c_nationkey || '|' || c_mktsegment END AS cells FROM customer WHERE c_custkey % 10 IN (3, 7)""")
def row_realignment(spark: SparkSession, d: str) -> DataFrame:
    """Customers of which some lost their nation and some got a blank too many."""
    k = F.col("c_custkey")
    key, nation = k.cast("string"), F.col("c_nationkey").cast("string")
    cells = F.when(k % 10 == 3, F.array(key, F.col("c_name"), F.col("c_mktsegment"))).when(k % 10 == 7, F.array(key, F.lit(""), F.col("c_name"), nation, F.col("c_mktsegment"))).otherwise(F.array(key, F.col("c_name"), nation, F.col("c_mktsegment")))
    out = alignment.realigned(table(spark, d, "customer").select(k.alias("_row"), cells.alias("_cells")), 4)
    return out.select("_row", "operation", "position", "mismatches", F.array_join("new_cells", "|").alias("cells"))
