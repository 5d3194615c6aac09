"""Queries of the diagnostics, of several tables together, and of issues as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle, diagnostics, structural
from .registry import LEDGER, NUMBERED, query, table
from .rule_queries import ledger

_LEDGER = f"l AS (SELECT {NUMBERED} AS r, * FROM ({LEDGER}))"


def events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    wave = (k * 37) % 12 + F.when(k % 12 < 6, 40).otherwise(0)
    return table(spark, d, "events").select(k.alias("_row"), "event_type", "value", "user_id", (k * 3 + k % 7).alias("clock"), F.floor(k / 4).cast("long").alias("step"), wave.cast("double").alias("wave"), F.when(k % 10 == 9, (k * 7) % 100).otherwise(F.floor(k / 10)).cast("long").alias("mostly"))


_EVENTS = """e AS (SELECT event_id AS r, event_type, value, user_id, event_id * 3 + event_id % 7 AS clock, event_id // 4 AS step, ((event_id * 37) % 12 + CASE WHEN event_id % 12 < 6 THEN 40 ELSE 0 END)::DOUBLE AS wave,
 CASE WHEN event_id % 10 = 9 THEN (event_id * 7) % 100 ELSE event_id // 10 END AS mostly FROM events)"""


@query(f"""WITH {_EVENTS}, x AS (SELECT 'step' AS "column", r, step::DOUBLE AS x FROM e UNION ALL SELECT 'clock', r, clock FROM e UNION ALL SELECT 'mostly', r, mostly FROM e),
p AS (SELECT *, lag(x) OVER (PARTITION BY "column" ORDER BY r) AS p FROM x), g AS (SELECT "column", count(p) AS pairs, round(avg((x >= p)::INT), 6) AS rising FROM p WHERE p IS NOT NULL GROUP BY 1)
SELECT *, pairs >= 7 AND rising >= 0.98 AS monotonic FROM g""")
def monotonic_order(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.monotonic(events(spark, d), ["step", "clock", "mostly"])


@query(f"""WITH {_LEDGER}, g AS (SELECT 'qty' AS low, 'total' AS high, count(*) AS rows, round(avg((qty <= total)::INT), 6) AS share FROM l UNION ALL SELECT 'total', 'qty', count(*), round(avg((total <= qty)::INT), 6) FROM l
 UNION ALL SELECT 'qty', 'fee', count(*), round(avg((qty <= fee)::INT), 6) FROM l UNION ALL SELECT 'fee', 'qty', count(*), round(avg((fee <= qty)::INT), 6) FROM l
 UNION ALL SELECT 'total', 'fee', count(*), round(avg((total <= fee)::INT), 6) FROM l UNION ALL SELECT 'fee', 'total', count(*), round(avg((fee <= total)::INT), 6) FROM l)
SELECT *, rows >= 8 AND share >= 0.98 AS holds FROM g""")
def pair_order(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.pair_order(ledger(spark, d), ["qty", "total", "fee"])


@query(f"""WITH {_EVENTS}, p AS (SELECT wave, k, lag(wave, k::INT) OVER (PARTITION BY k ORDER BY r) AS w FROM e, range(2, 13) t(k)),
g AS (SELECT k AS lag, count(w) AS pairs, round(corr(w, wave), 6) AS correlation FROM p WHERE w IS NOT NULL GROUP BY 1) SELECT *, pairs >= 12 AND abs(correlation) >= 0.85 AS related FROM g""")
def seasonal(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.lag_correlation(events(spark, d), "wave", "wave", range(2, 13), 0.85)


@query(f"""WITH {_EVENTS}, p AS (SELECT mostly::DOUBLE AS y, k, lag(wave, k::INT) OVER (PARTITION BY k ORDER BY r) AS w FROM e, range(1, 6) t(k)),
g AS (SELECT k AS lag, count(w) AS pairs, round(corr(w, y), 6) AS correlation FROM p WHERE w IS NOT NULL GROUP BY 1) SELECT *, pairs >= 12 AND abs(correlation) >= 0.8 AS related FROM g""")
def lag_correlation(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.lag_correlation(events(spark, d), "wave", "mostly")


@query(f"""WITH {_EVENTS}, g AS (SELECT clock - lag(clock) OVER (ORDER BY r) AS gap FROM e)
SELECT count(*) AS gaps, round(median(gap), 6)::DOUBLE AS median, round(stddev_pop(gap) / avg(gap), 6) AS cv, round(stddev_pop(gap) / avg(gap), 6) > 0.1 AS irregular FROM g WHERE gap IS NOT NULL""")
def sampling_gaps(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.sampling_gaps(events(spark, d), "clock")


@query(f"""WITH {_EVENTS}, g AS (SELECT event_type, clock - lag(clock) OVER (PARTITION BY event_type ORDER BY clock, r) AS gap FROM e)
SELECT event_type, count(*) AS gaps, round(median(gap), 6)::DOUBLE AS median, round(stddev_pop(gap) / avg(gap), 6) AS cv, round(stddev_pop(gap) / avg(gap), 6) > 0.1 AS irregular FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def multirate(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.sampling_gaps(events(spark, d), "clock", "event_type")


@query(f"""WITH {_EVENTS}, m AS (SELECT r, step, CASE WHEN step IS NOT DISTINCT FROM lag(step) OVER (ORDER BY r) AND r > 0 THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (ORDER BY r) AS run FROM m) SELECT min(r) AS start, count(*) AS length, min(step) AS value FROM i GROUP BY run HAVING count(*) > 1""")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.stale_runs(events(spark, d), "step")


@query(f"""WITH {_EVENTS}, m AS (SELECT count(*) AS rows, avg(mostly) AS mean, stddev_pop(mostly) AS sd FROM e), s AS (SELECT r, sum(mostly - mean) OVER (ORDER BY r) AS s FROM e, m)
SELECT rows, round(mean, 6) AS mean, (SELECT arg_max(r, (round(abs(s), 6), -r)) FROM s) AS at, round((SELECT max(abs(s)) FROM s) / (sd * sqrt(rows)), 6) AS score FROM m""")
def change_point_cusum(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.cusum(events(spark, d), "mostly")


@query(f"""WITH {_EVENTS}, n AS (SELECT count(*) AS n, greatest(6, count(*) // 5) AS w FROM e), g AS (SELECT avg(mostly) FILTER (WHERE r < w) AS early, avg(mostly) FILTER (WHERE r >= n - w) AS recent, var_samp(mostly) FILTER (WHERE r < w) AS va, var_samp(mostly) FILTER (WHERE r >= n - w) AS vb FROM e, n)
SELECT round(early, 6) AS early, round(recent, 6) AS recent, round(abs(recent - early) / sqrt((va + vb) / 2), 6) AS effect, abs(recent - early) / sqrt((va + vb) / 2) >= 2.5 AS drifts FROM g""")
def sliding_drift(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.drift(events(spark, d), "mostly", table(spark, d, "events").count())


@query("""WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS priority FROM orders), c AS (SELECT 'status' AS "column", status AS v FROM o UNION ALL SELECT 'priority', priority FROM o), n AS (SELECT "column", v, count(*) AS n FROM c GROUP BY 1, 2)
SELECT "column", round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM n GROUP BY 1""")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.entropy(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), ["status", "priority"])


@query("""WITH o AS (SELECT p_brand AS brand, p_type AS type, CAST(p_partkey % 5 AS VARCHAR) AS five, CAST(p_partkey % 10 AS VARCHAR) AS ten FROM part),
j AS (SELECT 'brand' AS a, 'type' AS b, brand AS x, type AS y FROM o UNION ALL SELECT 'brand', 'five', brand, five FROM o UNION ALL SELECT 'brand', 'ten', brand, ten FROM o UNION ALL SELECT 'type', 'five', type, five FROM o UNION ALL SELECT 'type', 'ten', type, ten FROM o UNION ALL SELECT 'five', 'ten', five, ten FROM o),
n AS (SELECT a, b, x, y, count(*) AS n FROM j GROUP BY ALL), h AS (SELECT a, b, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM n GROUP BY 1, 2),
nx AS (SELECT a, b, x, sum(n) AS n FROM n GROUP BY ALL), hx AS (SELECT a, b, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hx FROM nx GROUP BY 1, 2),
ny AS (SELECT a, b, y, sum(n) AS n FROM n GROUP BY ALL), hy AS (SELECT a, b, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hy FROM ny GROUP BY 1, 2)
SELECT a, b, round(hx + hy - h, 6) AS bits, round((hx + hy - h) / greatest(hx, hy), 6) AS share, round((hx + hy - h) / greatest(hx, hy), 6) >= 0.5 AS related FROM h JOIN hx USING (a, b) JOIN hy USING (a, b)""")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), (k % 5).cast("string").alias("five"), (k % 10).cast("string").alias("ten"))
    return diagnostics.mutual_information(t, ["brand", "type", "five", "ten"])


@query("""WITH t AS (SELECT p_partkey % 10 AS a, p_partkey % 5 AS b, p_partkey % 3 AS c FROM part), s(determinants, dependent, x, y) AS (
 SELECT 'a', 'b', count(DISTINCT a), count(DISTINCT (a, b)) FROM t UNION ALL SELECT 'a', 'c', count(DISTINCT a), count(DISTINCT (a, c)) FROM t UNION ALL SELECT 'b', 'a', count(DISTINCT b), count(DISTINCT (a, b)) FROM t
 UNION ALL SELECT 'b', 'c', count(DISTINCT b), count(DISTINCT (b, c)) FROM t UNION ALL SELECT 'c', 'a', count(DISTINCT c), count(DISTINCT (a, c)) FROM t UNION ALL SELECT 'c', 'b', count(DISTINCT c), count(DISTINCT (b, c)) FROM t
 UNION ALL SELECT 'a,b', 'c', count(DISTINCT (a, b)), count(DISTINCT (a, b, c)) FROM t UNION ALL SELECT 'a,c', 'b', count(DISTINCT (a, c)), count(DISTINCT (a, b, c)) FROM t UNION ALL SELECT 'b,c', 'a', count(DISTINCT (b, c)), count(DISTINCT (a, b, c)) FROM t)
SELECT determinants, dependent, x = y AS holds FROM s""")
def exact_dependencies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return diagnostics.exact_dependencies(table(spark, d, "part").select((k % 10).alias("a"), (k % 5).alias("b"), (k % 3).alias("c")), ["a", "b", "c"])


@query("""WITH t AS (SELECT CAST(p_partkey % 4 AS VARCHAR) AS g, p_size::DOUBLE AS x, p_size::DOUBLE * CASE WHEN p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 4 = 1 THEN 3 ELSE 1 + p_partkey % 7 END AS y FROM part WHERE p_size <> 0)
SELECT g AS "group", count(*) AS rows, round(avg(y / x), 6) AS ratio, count(*) >= 8 AND stddev_pop(y / x) <= 1e-10 * abs(avg(y / x)) + 1e-12 AS "constant" FROM t GROUP BY g""")
def conditional_ratio(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.col("p_partkey"), F.col("p_size").cast("double")
    t = table(spark, d, "part").select((k % 4).alias("g"), x.alias("x"), (x * F.when(k % 4 == 0, 2).when(k % 4 == 1, 3).otherwise(k % 7 + 1)).alias("y"))
    return diagnostics.group_ratio(t, "g", "x", "y")


@query(f"""WITH s AS (SELECT k1, sum(total) AS s FROM ({LEDGER}) GROUP BY 1) SELECT k1 AS "group", s::BIGINT AS sum, (s + CASE WHEN k1 % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS reported, k1 % 9 <> 0 AS agrees FROM s""")
def group_totals(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d).select("k1", F.col("total").cast("long").alias("total"))
    told = t.groupBy("k1").agg((F.sum("total") + F.when(F.first("k1") % 9 == 0, 1).otherwise(0)).alias("reported"))
    return diagnostics.group_totals(t.join(told, "k1"), "k1", "total", "reported")


@query("""WITH t AS (SELECT c_mktsegment AS segment, CAST(c_nationkey % 3 AS VARCHAR) AS third, CASE WHEN (c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0) OR c_custkey % 20 = 0 THEN 1 ELSE 0 END AS m FROM customer),
g AS (SELECT 'segment' AS group_column, segment AS g, avg(m) AS r, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'third', third, avg(m), count(*) FROM t GROUP BY 2)
SELECT group_column, round(max(r) - min(r), 6) AS span, round(max(r) - min(r), 6) >= 0.35 AS depends FROM g WHERE n >= 3 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12""")
def missing_mechanism(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).alias("third"), F.when(((F.col("c_mktsegment") == "BUILDING") & (k % 2 == 0)) | (k % 20 == 0), "").otherwise("x").alias("note"))
    return diagnostics.missing_mechanism(t, "note", ["segment", "third"])


@query(f"""WITH {_LEDGER}, x AS (SELECT r, qty::DOUBLE AS a, (total + CASE WHEN r % 501 = 0 THEN 5000 ELSE 0 END)::DOUBLE AS b FROM l), m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM x)
SELECT * FROM (SELECT r AS _row, round(sqrt((((a - ma) / sa) ** 2 + ((b - mb) / sb) ** 2) / 2), 6) AS rms_z FROM x, m) WHERE rms_z >= 4""")
def ood_rms_z(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d, numbered=True).select("_row", F.col("qty").cast("double").alias("a"), (F.col("total") + F.when(F.col("_row") % 501 == 0, 5000).otherwise(0)).cast("double").alias("b"))
    return diagnostics.ood(t, ["a", "b"])


@query("""WITH x AS (SELECT 'size' AS "column", least(p_size, 40)::DOUBLE AS x FROM part UNION ALL SELECT 'key', p_partkey FROM part), e AS (SELECT "column", min(x) AS a, max(x) AS b, count(DISTINCT x) AS d FROM x GROUP BY 1)
SELECT "column", round(avg((x = a)::INT), 6) AS low_share, round(avg((x = b)::INT), 6) AS high_share, max(d) >= 4 AND greatest(round(avg((x = a)::INT), 6), round(avg((x = b)::INT), 6)) >= 0.08 AS saturated FROM x JOIN e USING ("column") GROUP BY 1""")
def saturation(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.saturation(table(spark, d, "part").select(F.least("p_size", F.lit(40)).alias("size"), F.col("p_partkey").alias("key")), ["size", "key"])


@query("""WITH n AS (SELECT count(*) AS n FROM orders), m AS (SELECT count(*) AS m FROM orders WHERE o_orderkey % 30 = 0)
SELECT 'american' AS "column", 0::BIGINT AS plain, n AS us, 0::BIGINT AS eu, n AS observed, 'us' AS decisive FROM n UNION ALL SELECT 'european', 0, 0, n, n, 'eu' FROM n UNION ALL SELECT 'mixed', m, n - m, 0, n, 'us' FROM n, m""")
def locale_number_profile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    us = F.concat((k % 90 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5"))
    eu = F.concat((k % 90 + 1).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(",25"))
    return diagnostics.locale_profile(table(spark, d, "orders").select(us.alias("american"), eu.alias("european"), F.when(k % 30 == 0, "12.5").otherwise(us).alias("mixed")), ["american", "european", "mixed"])


@query("""SELECT o_orderkey AS _row, ((o_orderkey % 90 + 1) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.5') AS value, ((o_orderkey % 90 + 1) * 1000 + o_orderkey % 1000 + 0.5)::DOUBLE AS number FROM orders""")
def locale_number_normalize(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import exprs as X

    k = F.col("o_orderkey")
    us = F.concat((k % 90 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".5"))
    return table(spark, d, "orders").select(k.alias("_row"), us.alias("value")).withColumn("number", X.locale_number(F.col("value"), "us"))


@query("""SELECT 'day' AS "column", count(*) AS observed, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS iso, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS dmy, count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 28 + 1 <= 12) AS mdy,
 count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 28 + 1 <= 12 AND o_orderkey % 28 + 1 <> o_orderkey % 12 + 1) AS ambiguous FROM orders""")
def datetime_profile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.when(k % 3 == 0, F.concat(F.lit("2024-"), two(k % 12 + 1), F.lit("-"), two(k % 28 + 1))).otherwise(F.concat(two(k % 28 + 1), F.lit("/"), two(k % 12 + 1), F.lit("/2024")))
    return diagnostics.datetime_profile(table(spark, d, "orders").select(day.alias("day")), ["day"])


@query("""WITH t AS (SELECT s_suppkey AS r, CAST(s_suppkey // 2 AS VARCHAR) AS a, CAST(s_nationkey AS VARCHAR) AS b, CAST(s_suppkey % 2 AS VARCHAR) AS c, CAST(s_suppkey // 2 AS VARCHAR) AS e, CAST(s_suppkey // 2 + 1 AS VARCHAR) AS f FROM supplier)
SELECT x.r AS a, y.r AS b, (x.a = y.a)::BIGINT + (x.b = y.b)::BIGINT + (x.c = y.c)::BIGINT + (x.e = y.e)::BIGINT + (x.f = y.f)::BIGINT AS same FROM t x, t y WHERE x.r < y.r AND (x.a = y.a)::INT + (x.b = y.b)::INT + (x.c = y.c)::INT + (x.e = y.e)::INT + (x.f = y.f)::INT = 4""")
def near_duplicate_residue(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    h = F.floor(k / 2).cast("long")
    return diagnostics.near_residue(table(spark, d, "supplier").select(k.alias("_row"), h.alias("a"), F.col("s_nationkey").alias("b"), (k % 2).alias("c"), h.alias("e"), (h + 1).alias("f")), ["a", "b", "c", "e", "f"])


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 211 = 0 THEN p_brand || 'x' ELSE p_brand END AS v FROM part), c AS (SELECT v, count(*) AS n, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS t FROM t GROUP BY 1),
p AS (SELECT a.v AS value, a.n, b.v AS dominant, b.n AS dominant_n FROM c a JOIN c b ON a.v <> b.v AND b.n >= 5 AND a.n <= greatest(2, b.n / 5) AND levenshtein(a.t, b.t) <= 1)
SELECT value, n, arg_max(dominant, (dominant_n, dominant)) AS dominant, max(dominant_n) AS dominant_n FROM p GROUP BY 1, 2""")
def category_typos(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.typos(table(spark, d, "part").select(F.when(F.col("p_partkey") % 211 == 0, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")).alias("brand")), "brand")


@query("""WITH c AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN replace(p_type, ' ', '-') ELSE p_type END AS v, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS token FROM c)
SELECT token, count(*) AS forms, sum(n)::BIGINT AS n, arg_max(v, (n, v)) AS dominant FROM t GROUP BY 1 HAVING count(*) > 1""")
def category_synonyms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return diagnostics.synonyms(table(spark, d, "part").select(F.when(k % 3 == 0, F.upper("p_type")).when(k % 3 == 1, F.replace("p_type", F.lit(" "), F.lit("-"))).otherwise(F.col("p_type")).alias("type")), "type")


@query("""WITH t AS (SELECT DISTINCT 'priority' AS "column", regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS token FROM orders UNION SELECT 'status', regexp_replace(lower(o_orderstatus), '[^a-z0-9]', '', 'g') FROM orders UNION SELECT 'first', lower(substr(o_orderstatus, 1, 1)) FROM orders)
SELECT token, string_agg("column", ',' ORDER BY "column") AS columns FROM t WHERE token <> '' GROUP BY 1 HAVING count(*) > 1""")
def polysemy(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.substring("o_orderstatus", 1, 1).alias("first"))
    return diagnostics.polysemy(t, ["priority", "status", "first"])


@query("""SELECT l_partkey AS entity, count(DISTINCT l_suppkey) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def entity_versions(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.versions(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


_RANK = "c AS (SELECT n_nationkey AS i, k, CASE WHEN (n_nationkey + k) % 9 = 0 THEN NULL ELSE ((n_nationkey + 2) * (k + 1))::DOUBLE END AS x FROM nation, range(6) t(k))"


@query(f"""WITH {_RANK} SELECT g.i, g.k, round(avg(a.x * b.x / c.x), 6) AS expected, count(*) AS witnesses FROM c g JOIN c a ON a.i = g.i AND a.x IS NOT NULL JOIN c b ON b.k = g.k AND b.x IS NOT NULL
JOIN c ON c.i = b.i AND c.k = a.k AND c.x <> 0 WHERE g.x IS NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def rank1_completion(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.explode(F.expr("sequence(0L, 5L)")).alias("k"))
    return diagnostics.rank_one(t.withColumn("x", F.when((F.col("i") + F.col("k")) % 9 != 0, ((F.col("i") + 2) * (F.col("k") + 1)).cast("double"))))


@query(f"WITH {_LEDGER} SELECT 'total' AS target, 'subtotal,fee' AS sources, '1,1' AS weights, true AS conservation UNION ALL SELECT 'subtotal', 'fee,total', '-1,1', true UNION ALL SELECT 'fee', 'subtotal,total', '-1,1', true")
def linear_laws(spark: SparkSession, d: str) -> DataFrame:
    t = ledger(spark, d, corrupt=False).select("price", "subtotal", "fee", "total")
    laws = diagnostics.linear_laws(t, ["price", "subtotal", "fee", "total"], 2)
    return spark.createDataFrame([(x["target"], ",".join(x["sources"]), ",".join(map(str, x["weights"])), x["conservation"]) for x in laws], "target string, sources string, weights string, conservation boolean")


@query(f"""WITH {_LEDGER}, s AS (SELECT r, avg((subtotal = qty * price)::INT) OVER (ORDER BY r) AS rate FROM l), h AS (SELECT r, rate, CASE WHEN rate >= 0.995 THEN 'accept' ELSE 'reject' END AS verdict FROM s WHERE r + 1 >= 16 AND (rate >= 0.995 OR rate < 0.8))
SELECT r AS at, round(rate, 6) AS rate, verdict FROM h ORDER BY r LIMIT 1""")
def support_probe(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.support_probe(ledger(spark, d, numbered=True), F.col("subtotal") == F.col("qty") * F.col("price"))


@query("""SELECT * FROM (VALUES ('orders', 'o_custkey', 'customer', 'c_custkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey')) v(child, child_column, parent, parent_column), (SELECT 1.0::DOUBLE AS coverage)""")
def inclusion_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys among three tables whose key ranges are told apart by a prefix."""
    tag = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    tables = {
        "orders": table(spark, d, "orders").select(tag("o_orderkey", "O").alias("o_orderkey"), tag("o_custkey", "C").alias("o_custkey")),
        "customer": table(spark, d, "customer").select(tag("c_custkey", "C").alias("c_custkey"), tag("c_nationkey", "N").alias("c_nationkey")),
        "nation": table(spark, d, "nation").select(tag("n_nationkey", "N").alias("n_nationkey"), "n_name"),
    }
    return bundle.inclusions(tables)


@query("""WITH a AS (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS v FROM nation), b AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS v FROM supplier), c AS (SELECT count(*) AS n FROM a JOIN b USING (v))
SELECT 'nation' AS a, 'n_nationkey' AS a_column, 'supplier' AS b, 's_nationkey' AS b_column, round(n / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6) AS shared FROM c""")
def value_overlap(spark: SparkSession, d: str) -> DataFrame:
    return bundle.overlaps({"nation": table(spark, d, "nation").select("n_nationkey", "n_name"), "supplier": table(spark, d, "supplier").select("s_nationkey", "s_name")})


@query("""WITH o AS (SELECT o_orderkey AS r, o_custkey AS k, CASE WHEN o_orderkey % 43 = 1 THEN 'XX' ELSE ' ' || lower(c_mktsegment) END AS value, c_mktsegment AS expected FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT r AS _row, 'segment' AS "column", value, expected FROM o WHERE value = 'XX'""")
def lookup_attribute_repair(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    child = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("_row"), "o_custkey", F.when(F.col("o_orderkey") % 43 == 1, "XX").otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("segment"))
    return bundle.lookup_repairs(child, "o_custkey", c, "c_custkey", "segment", "c_mktsegment")


@query("""SELECT c_custkey AS key, 'name' AS "column", c_name AS expected FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_custkey % 13 = 0""")
def cross_table_blank_fill(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    holes = c.withColumn("name", F.when(F.col("key") % 11 == 0, "").otherwise(F.col("name"))).withColumn("segment", F.when(F.col("key") % 13 == 0, "").otherwise(F.col("segment")))
    return bundle.blank_fills(holes, c, "key", ["name", "segment"])


@query("""SELECT upper(p_type) || '!' AS value, min(p_type) AS suggestion FROM (SELECT DISTINCT p_type FROM part) GROUP BY 1""")
def fuzzy_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "part").select("p_type").distinct()
    return bundle.fuzzy_parents(types.select(F.concat(F.upper("p_type"), F.lit("!")).alias("value")), types, "p_type")


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Two witnesses for each wrong subtotal, and a range issue for some totals."""
    t = ledger(spark, d, numbered=True)
    base = t.where("subtotal <> qty * price")
    one = lambda analyzer, evidence, severity, want: base.select(F.lit(analyzer).alias("analyzer"), F.lit(evidence).alias("evidence"), F.lit(severity).alias("severity"), "_row", F.lit("subtotal").alias("column"), F.col("subtotal").cast("string").alias("value"), want.cast("string").alias("expected"), F.lit(True).alias("repairable"))
    far = t.where("total > 400").select(F.lit("range").alias("analyzer"), F.lit("r").alias("evidence"), F.lit("info").alias("severity"), "_row", F.lit("total").alias("column"), F.col("total").cast("string").alias("value"), F.lit(None).cast("string").alias("expected"), F.lit(False).alias("repairable"))
    return one("numeric", "product", "error", F.col("qty") * F.col("price")).unionByName(one("rules", "difference", "warning", F.concat((F.col("total") - F.col("fee")).cast("string"), F.lit(".0")))).unionByName(far)


@query(f"WITH {_LEDGER}, b AS (SELECT count(*) AS n FROM l WHERE subtotal <> qty * price), f AS (SELECT count(*) AS n FROM l WHERE total > 400) SELECT b.n * 13 AS repairable, b.n * 13 + f.n AS total FROM b, f")
def consistency_score(spark: SparkSession, d: str) -> DataFrame:
    return structural.score(issues(spark, d))


@query(f"WITH {_LEDGER} SELECT r AS _row, 'subtotal' AS \"column\", CAST(qty * price AS VARCHAR) AS expected, 2::BIGINT AS families, false AS conflict FROM l WHERE subtotal <> qty * price")
def consensus_issues(spark: SparkSession, d: str) -> DataFrame:
    return structural.consensus(issues(spark, d))


@query(f"""WITH {_LEDGER} SELECT r AS _row, 'subtotal' AS "column", 2::BIGINT AS violations, 13::BIGINT AS weight, 2::BIGINT AS families, 'UNIQUE_MULTI_WITNESS' AS class, 0.5::DOUBLE AS reliability FROM l WHERE subtotal <> qty * price
UNION ALL SELECT r, 'total', 1, 1, 1, 'LOCALIZED_NO_RECONSTRUCTION', 0.0 FROM l WHERE total > 400""")
def cell_syndromes(spark: SparkSession, d: str) -> DataFrame:
    return structural.syndrome(issues(spark, d))


@query(f"""WITH {_LEDGER}, c AS (SELECT 'subtotal' AS "column", r FROM l WHERE subtotal <> qty * price UNION ALL SELECT 'total', r FROM l WHERE total > 400)
SELECT "column", count(*) AS faulty, round(1 - count(*) / (SELECT count(*) FROM l), 6) AS reliability FROM c GROUP BY 1""")
def column_reliability(spark: SparkSession, d: str) -> DataFrame:
    return structural.column_reliability(issues(spark, d), table(spark, d, "lineitem").count())


@query(f"""WITH {_LEDGER}, c AS (SELECT 'subtotal' AS "column", r FROM l WHERE subtotal <> qty * price UNION ALL SELECT 'total', r FROM l WHERE total > 400), i AS (SELECT *, r - row_number() OVER (PARTITION BY "column" ORDER BY r) AS i FROM c)
SELECT "column", min(r) AS start, count(*) AS length FROM i GROUP BY "column", i HAVING count(*) >= 3""")
def common_cause_runs(spark: SparkSession, d: str) -> DataFrame:
    return structural.common_runs(issues(spark, d))


@query("""WITH a AS (SELECT DISTINCT 'r' || p_partkey AS relation FROM part), b AS (SELECT DISTINCT 'r' || (s_suppkey * 3) AS relation FROM supplier)
SELECT 'removed' AS change, relation FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'added', relation FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'stable', relation FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def relation_drift(spark: SparkSession, d: str) -> DataFrame:
    name = lambda x: F.concat(F.lit("r"), x.cast("string")).alias("relation")
    return structural.drift(table(spark, d, "part").select(name(F.col("p_partkey"))), table(spark, d, "supplier").select(name(F.col("s_suppkey") * 3)))


@query("""SELECT s_suppkey AS _row, s_name AS name FROM supplier ORDER BY sha256('seed:' || s_suppkey) LIMIT 20""")
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    return structural.sample(table(spark, d, "supplier").select(F.col("s_suppkey").alias("_row"), F.col("s_name").alias("name")), 20, "seed")
