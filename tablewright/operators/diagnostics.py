"""Diagnostics: what a table's columns have to do with each other, without edits.

Typed columns go in.  Ordered ones use bucketed windows, so no task sorts the table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ordered import neighbours, running_sum


def monotonic(df: DataFrame, columns: list[str], least: float = 0.98) -> DataFrame:
    """``column, pairs, rising, monotonic``: share of rows not below the one before."""
    t = neighbours(df.select("_row", *columns), {f"p_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in columns})
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.col(f"p_{c}").cast("double").alias("p")) for c in columns])
    both = t.select(F.inline(cells)).where("x is not null and p is not null")
    out = both.groupBy("column").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("x") >= F.col("p")).cast("int")), 6).alias("rising"))
    return out.select("*", ((F.col("pairs") >= 7) & (F.col("rising") >= least)).alias("monotonic"))


def pair_order(df: DataFrame, columns: list[str], least: float = 0.98) -> DataFrame:
    """``low, high, rows, share, holds`` of ``low <= high`` for every ordered pair, in one pass."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    aggs = [x for i, (a, b) in enumerate(pairs) for x in (F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}"), F.avg((F.col(a) <= F.col(b)).cast("int")).alias(f"s{i}"))]
    cells = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"n{i}").alias("rows"), F.round(f"s{i}", 6).alias("share")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.inline(cells)).select("*", ((F.col("rows") >= 8) & (F.col("share") >= least)).alias("holds"))


def lag_correlation(df: DataFrame, x: str, y: str, lags: range = range(1, 6), least: float = 0.8) -> DataFrame:
    """``lag, pairs, correlation, related`` of ``y`` with earlier ``x``; y = x gives seasons."""
    make = {f"l{k}": (lambda w, k=k: F.lag(x, k).over(w)) for k in lags}
    t = neighbours(df.select("_row", *{x, y}), make, back=max(lags))
    aggs = [a for k in lags for a in (F.count_if(F.col(f"l{k}").isNotNull() & F.col(y).isNotNull()).alias(f"n{k}"), F.corr(f"l{k}", y).alias(f"c{k}"))]
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"n{k}").alias("pairs"), F.round(f"c{k}", 6).alias("correlation")) for k in lags])
    return t.agg(*aggs).select(F.inline(cells)).select("*", F.coalesce((F.col("pairs") >= 12) & (F.abs("correlation") >= least), F.lit(False)).alias("related"))


def sampling_gaps(df: DataFrame, seconds: str, channel: str | None = None) -> DataFrame:
    """``channel, gaps, median, cv, irregular`` of the times between rows."""
    by = [channel] if channel else []
    w = Window.partitionBy(*by).orderBy(seconds, "_row") if channel else None
    t = df.withColumn("gap", F.col(seconds) - F.lag(seconds).over(w)) if channel else neighbours(df, {"gap": lambda v: F.col(seconds) - F.lag(seconds).over(v)})
    out = t.where("gap is not null").groupBy(*by).agg(F.count("*").alias("gaps"), F.round(F.median("gap"), 6).alias("median"), F.round(F.stddev_pop("gap") / F.avg("gap"), 6).alias("cv"))
    return out.withColumn("irregular", F.col("cv") > 0.1)


def stale_runs(df: DataFrame, column: str) -> DataFrame:
    """``start, length, value`` of the runs of equal neighbours of two rows or more."""
    t = neighbours(df.select("_row", column), {"_new": lambda w: F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & F.lag("_row").over(w).isNotNull(), 0).otherwise(1)})
    runs = running_sum(t, F.col("_new"), "_run").groupBy("_run").agg(F.min("_row").alias("start"), F.count("*").alias("length"), F.first(column).alias("value"))
    return runs.where("length > 1").drop("_run")


def cusum(df: DataFrame, column: str) -> DataFrame:
    """``rows, mean, at, score``: where the sum of deviations is farthest from zero, over
    the deviation times the root of the count."""
    m = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("rows"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"))
    t = running_sum(df.select("_row", column).where(F.col(column).isNotNull()).crossJoin(F.broadcast(m)), F.col(column) - F.col("mean"), "s")
    out = t.groupBy("rows", "mean", "sd").agg(F.max_by("_row", F.struct(F.round(F.abs("s"), 6), -F.col("_row"))).alias("at"), F.max(F.abs("s")).alias("most"))
    return out.select("rows", F.round("mean", 6).alias("mean"), "at", F.round(F.try_divide(F.col("most"), F.col("sd") * F.sqrt("rows")), 6).alias("score"))


def drift(df: DataFrame, column: str, rows: int) -> DataFrame:
    """``early, recent, effect, drifts``: the first against the last fifth of the rows."""
    w = max(6, rows // 5)
    a, b = F.col("_row") < w, F.col("_row") >= rows - w
    x = lambda m: F.when(m, F.col(column))
    r = df.agg(F.avg(x(a)).alias("early"), F.avg(x(b)).alias("recent"), F.var_samp(x(a)).alias("va"), F.var_samp(x(b)).alias("vb"))
    effect = F.abs(F.col("recent") - F.col("early")) / F.sqrt((F.col("va") + F.col("vb")) / 2)
    return r.select(F.round("early", 6).alias("early"), F.round("recent", 6).alias("recent"), F.round(effect, 6).alias("effect"), (effect >= 2.5).alias("drifts"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, entropy`` in bits."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    n = df.select(F.inline(cells)).where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    sums = n.groupBy("column").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("l"))
    return sums.select("column", F.round(F.log2("t") - F.col("l") / F.col("t"), 6).alias("entropy"))


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, bits, share, related``; share is of the larger entropy."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(columns, 2)])
    joint = df.select(F.inline(pairs)).groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    ab = joint.groupBy("a", "b").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("l")).select("a", "b", (F.log2("t") - F.col("l") / F.col("t")).alias("h"))
    one = {c: F.col("entropy") for c in columns}
    h = entropy_exact(df, list(one))
    out = ab.join(F.broadcast(h.select(F.col("column").alias("a"), F.col("e").alias("ha"))), "a").join(F.broadcast(h.select(F.col("column").alias("b"), F.col("e").alias("hb"))), "b")
    bits = F.col("ha") + F.col("hb") - F.col("h")
    share = F.coalesce(F.try_divide(bits, F.greatest("ha", "hb")), F.lit(0.0))
    return out.select("a", "b", F.round(bits, 6).alias("bits"), F.round(share, 6).alias("share"), (F.round(share, 6) >= 0.5).alias("related"))


def entropy_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    n = df.select(F.inline(cells)).where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    return n.groupBy("column").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("e"))


def exact_dependencies(df: DataFrame, columns: list[str], arity: int = 2) -> DataFrame:
    """``determinants, dependent, holds`` of every set of up to ``arity`` columns.

    A dependency holds when adding the dependent makes no more groups: one pass of
    distinct counts over all sets."""
    sets = [s for n in range(1, arity + 2) for s in combinations(columns, n)]
    key = lambda s: F.to_json(F.array(*[F.col(c).cast("string") for c in s]))
    spread = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(key(s)).alias("k")) for i, s in enumerate(sets)])).alias("x")).select("x.*").distinct()
    n = F.map_from_entries(F.collect_list(F.struct("i", "n")))
    counts = spread.groupBy("i").agg(F.count("*").alias("n")).agg(n.alias("n"))
    at = {s: i for i, s in enumerate(sets)}
    rows = [F.struct(F.lit(",".join(s)).alias("determinants"), F.lit(c).alias("dependent"), (F.col("n")[at[s]] == F.col("n")[at[tuple(x for x in columns if x in s or x == c)]]).alias("holds")) for s in sets if len(s) <= arity for c in columns if c not in s]
    return counts.select(F.inline(F.array(*rows)))


def group_ratio(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``group, rows, ratio, constant`` of y / x; constant if it hardly varies in 8 rows or more."""
    r = df.where((F.col(x) != 0) & F.col(y).isNotNull()).select(F.col(group).cast("string").alias("group"), (F.col(y) / F.col(x)).alias("r"))
    out = r.groupBy("group").agg(F.count("*").alias("rows"), F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"))
    return out.select("group", "rows", F.round("m", 6).alias("ratio"), ((F.col("rows") >= 8) & (F.col("sd") <= 1e-10 * F.abs("m") + 1e-12)).alias("constant"))


def group_totals(detail: DataFrame, group: str, amount: str, total: str, tolerance: float = 1e-6) -> DataFrame:
    """``group, sum, reported, agrees`` of each group with one reported total."""
    out = detail.groupBy(F.col(group).alias("group")).agg(F.sum(amount).alias("sum"), F.min(total).alias("low"), F.max(total).alias("reported")).where("low = reported")
    return out.select("group", "sum", "reported", (F.abs(F.col("sum") - F.col("reported")) <= tolerance).alias("agrees"))


def missing_mechanism(df: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """``group_column, span, depends``: by how much the share of blanks differs by group."""
    cells = F.array(*[F.struct(F.lit(g).alias("group_column"), F.col(g).cast("string").alias("g"), (F.col(column).cast("string") == "").cast("int").alias("m")) for g in groups])
    rates = df.select(F.inline(cells)).groupBy("group_column", "g").agg(F.count("*").alias("n"), F.avg("m").alias("r")).where("n >= 3")
    out = rates.groupBy("group_column").agg(F.count("*").alias("k"), F.round(F.max("r") - F.min("r"), 6).alias("span")).where("k between 2 and 12")
    return out.select("group_column", "span", (F.col("span") >= 0.35).alias("depends"))


def ood(df: DataFrame, columns: list[str], limit: float = 4.0) -> DataFrame:
    """``_row, rms_z`` of rows whose root mean square of z-scores is at least ``limit``."""
    m = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    z = [F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")) for c in columns]
    total = sum((F.coalesce(x * x, F.lit(0.0)) for x in z), F.lit(0.0))
    out = df.crossJoin(F.broadcast(m)).select("_row", F.round(F.sqrt(total / len(columns)), 6).alias("rms_z"))
    return out.where(F.col("rms_z") >= limit)


def saturation(df: DataFrame, columns: list[str], least: float = 0.08) -> DataFrame:
    """``column, low_share, high_share, saturated``: how many rows sit on the extremes."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    t = df.select(F.inline(cells)).where("x is not null")
    ends = t.groupBy("column").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.countDistinct("x").alias("d"))
    out = t.join(F.broadcast(ends), "column").groupBy("column", "d").agg(F.round(F.avg((F.col("x") == F.col("a")).cast("int")), 6).alias("low_share"), F.round(F.avg((F.col("x") == F.col("b")).cast("int")), 6).alias("high_share"))
    return out.select("column", "low_share", "high_share", ((F.col("d") >= 4) & (F.greatest("low_share", "high_share") >= least)).alias("saturated"))


def locale_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, plain, us, eu, observed, decisive``: cells of each way to write numbers."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    styles = ("plain", "us", "eu")
    t = df.select(F.inline(cells)).where("v <> ''")
    out = t.groupBy("column").agg(*[F.count(X.locale_number(F.col("v"), s)).alias(s) for s in styles], F.count("*").alias("observed"))
    best = F.greatest("plain", "us", "eu")
    once = sum(((F.col(s) == best).cast("int") for s in styles), F.lit(0)) == 1
    name = F.when(F.col("us") == best, "us").when(F.col("eu") == best, "eu").otherwise("plain")
    return out.select("*", F.when(once & (best >= F.greatest(F.lit(3.0), F.col("observed") * 0.9)), name).alias("decisive"))


def datetime_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, observed, iso, dmy, mdy, ambiguous``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    t = df.select(F.inline(cells)).where("v <> ''")
    shaped = F.col("v").rlike(r"^\d{2}/\d{2}/\d{4}$")
    dmy = F.when(shaped, F.try_to_timestamp("v", F.lit("dd/MM/yyyy")))
    mdy = F.when(shaped, F.try_to_timestamp("v", F.lit("MM/dd/yyyy")))
    return t.groupBy("column").agg(F.count("*").alias("observed"), F.count(X.to_ts(F.col("v"))).alias("iso"), F.count(dmy).alias("dmy"), F.count(mdy).alias("mdy"), F.count_if(dmy != mdy).alias("ambiguous"))


def near_residue(df: DataFrame, columns: list[str], share: float = 0.8) -> DataFrame:
    """``a, b, same``: pairs of rows of which most canonical cells agree, but not all.

    Rows meet by the cells of each column that they share; a pair that agrees in four
    fifths of the columns agrees in one of any ``k`` that leave fewer, so only the first
    ``k`` columns are used to meet.  Nothing is capped."""
    n = len(columns)
    need = -int(-share * n // 1)
    block = n - need + 1
    key = [X.canonical(F.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)]
    t = df.select("_row", F.array(*key).alias("c"))
    # the rarest columns make the smallest blocks
    meet = t.select("_row", "c", F.posexplode("c").alias("i", "v"))
    kinds = meet.groupBy("i").agg(F.countDistinct("v").alias("d")).orderBy(F.desc("d"), "i").limit(block).select("i")
    used = meet.join(F.broadcast(kinds), "i").select("_row", "c", "i", "v")
    a, b = used.alias("a"), used.alias("b")
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.v") == F.col("b.v")) & (F.col("a._row") < F.col("b._row")))
    same = F.size(F.filter(F.zip_with("a.c", "b.c", lambda x, y: x == y), lambda x: x))
    return pairs.select(F.col("a._row").alias("a"), F.col("b._row").alias("b"), same.cast("long").alias("same")).where((F.col("same") >= need) & (F.col("same") < n)).distinct()


def typos(df: DataFrame, column: str) -> DataFrame:
    """``value, n, dominant, dominant_n``: rare values one edit from a frequent one."""
    counts = df.select(F.col(column).cast("string").alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n")).withColumn("token", X.canon_token(F.col("value")))
    big = counts.where("n >= 5").select(F.col("value").alias("dominant"), F.col("n").alias("dominant_n"), F.col("token").alias("t2"))
    pairs = counts.join(big, (F.col("value") != F.col("dominant")) & (F.abs(F.length("token") - F.length("t2")) <= 1) & (F.col("n") <= F.greatest(F.lit(2.0), F.col("dominant_n") / 5)) & (F.levenshtein("token", "t2", 1) >= 0))
    return pairs.groupBy("value", "n").agg(F.max_by("dominant", F.struct("dominant_n", "dominant")).alias("dominant"), F.max("dominant_n").alias("dominant_n"))


def synonyms(df: DataFrame, column: str) -> DataFrame:
    """``token, forms, n, dominant`` of values that differ only in how they are written."""
    counts = df.select(F.col(column).cast("string").alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n")).withColumn("token", X.canon_token(F.col("value")))
    return counts.groupBy("token").agg(F.count("*").alias("forms"), F.sum("n").alias("n"), F.max_by("value", F.struct("n", "value")).alias("dominant")).where("forms > 1")


def polysemy(df: DataFrame, columns: list[str]) -> DataFrame:
    """``token, columns`` of tokens in two columns or more."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), X.canon_token(F.col(c).cast("string")).alias("token")) for c in columns])
    return df.select(F.inline(cells)).where("token <> ''").groupBy("token").agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"), F.countDistinct("column").alias("n")).where("n > 1").drop("n")


def versions(df: DataFrame, entity: str, version: str) -> DataFrame:
    """``entity, versions`` of entities with more than one version."""
    return df.groupBy(F.col(entity).alias("entity")).agg(F.countDistinct(version).alias("versions")).where("versions > 1")


def linear_laws(df: DataFrame, columns: list[str], terms: int = 4, most: int | None = None) -> list[dict]:
    """Targets that are small-integer sums of 2 to ``terms`` others, from one Gram matrix.

    ``most``: only the first columns; by default all."""
    columns = columns[:most]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    n = len(x)
    whole = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    r = whole.agg(*[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    out = []
    for t in range(1, n):
        for k in range(2, min(terms, 4) + 1):
            for s in combinations([i for i in range(1, n) if i != t], k):
                use = [0, *s]
                a = g[np.ix_(use, use)]
                if np.linalg.cond(a) > 1e12:
                    continue
                w = np.linalg.solve(a, g[use, t])
                near = np.round(w[1:])
                if not near.all() or np.abs(near).max() > 4 or np.abs(w[1:] - near).max() > 1e-6:
                    continue
                error = g[t, t] - 2 * w @ g[use, t] + w @ a @ w
                if error <= 1e-9 * max(g[t, t], 1):
                    out.append({"target": columns[t - 1], "sources": [columns[i - 1] for i in s], "weights": near.astype(int).tolist(), "intercept": float(np.round(w[0], 6)), "conservation": bool(abs(w[0]) < 1e-6)})
    return out


def rank_one(cells: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``i, k, expected, witnesses``: missing cells of a matrix ``i, k, x`` of rank one.

    ``x[i,k] = x[i,l] * x[j,k] / x[j,l]``; all witnesses, two at least, must agree."""
    known = cells.where("x is not null")
    gaps = cells.where("x is null").select("i", "k")
    il = known.select("i", F.col("k").alias("l"), F.col("x").alias("a"))
    jk = known.select(F.col("i").alias("j"), "k", F.col("x").alias("b"))
    jl = known.select(F.col("i").alias("j"), F.col("k").alias("l"), F.col("x").alias("c")).where("c <> 0")
    w = gaps.join(il, "i").join(jk, "k").join(jl, ["j", "l"]).select("i", "k", (F.col("a") * F.col("b") / F.col("c")).alias("v"))
    out = w.groupBy("i", "k").agg(F.avg("v").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("witnesses"))
    return out.where((F.col("witnesses") >= 2) & (F.col("high") - F.col("low") <= tolerance * F.greatest(F.abs("m"), F.lit(1.0)))).select("i", "k", F.round("m", 6).alias("expected"), "witnesses")


def support_probe(df: DataFrame, success: Column, least: int = 16, reject: float = 0.8, accept: float = 0.995) -> DataFrame:
    """``at, rate, verdict``: the first row, from ``least`` on, at which a share decides."""
    t = running_sum(df.withColumn("_s", success.cast("int")), F.col("_s"), "_sum")
    rate = F.col("_sum") / (F.col("_row") + 1)
    verdict = F.when(rate >= accept, "accept").when(rate < reject, "reject")
    hit = t.select(F.col("_row"), rate.alias("rate"), verdict.alias("verdict")).where((F.col("_row") + 1 >= least) & F.col("verdict").isNotNull())
    return hit.agg(F.min_by(F.struct("_row", "rate", "verdict"), "_row").alias("x")).where("x is not null").select(F.col("x._row").alias("at"), F.round("x.rate", 6).alias("rate"), "x.verdict")


def interpolated(df: DataFrame, column: str) -> DataFrame:
    """``_row, low, high, middle, agrees`` of single gaps: the neighbours as bounds, their mean,
    and whether the steps before and after it say the same."""
    make = {f"p{k}": (lambda w, k=k: F.lag(column, k).over(w)) for k in (1, 2)} | {f"n{k}": (lambda w, k=k: F.lead(column, k).over(w)) for k in (1, 2)}
    t = neighbours(df.select("_row", column), make, back=2, ahead=2).where(F.col(column).isNull() & F.col("p1").isNotNull() & F.col("n1").isNotNull())
    forward, backward = 2 * F.col("p1") - F.col("p2"), 2 * F.col("n1") - F.col("n2")
    same = F.coalesce(X.is_close(forward, backward), F.lit(False))
    return t.select("_row", F.least("p1", "n1").alias("low"), F.greatest("p1", "n1").alias("high"), ((F.col("p1") + F.col("n1")) / 2).alias("middle"), same.alias("agrees"))


def canonical_reuse(df: DataFrame, columns: list[str]) -> DataFrame:
    """``rows, forms, hit_rate``: rows whose canonical form another row has had."""
    key = F.xxhash64(F.to_json(F.array(*[X.canonical(F.col(f"`{c}`").cast("string")) for c in columns])))
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("forms")).select("rows", "forms", F.round(1 - F.col("forms") / F.col("rows"), 6).alias("hit_rate"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, mean, low, high`` of the numbers of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    return df.select(F.inline(cells)).where("x is not null").groupBy("column").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))


def locale_repairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``_row, column, value, expected``: numbers of a column's decisive locale, written plainly."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    style = locale_profile(df, columns).select("column", "decisive").where("decisive in ('us', 'eu')")
    t = df.select("_row", F.inline(cells)).join(F.broadcast(style), "column")
    number = F.when(F.col("decisive") == "us", X.locale_number(F.col("value"), "us")).otherwise(X.locale_number(F.col("value"), "eu"))
    return t.select("_row", "column", "value", X.fmt_num(number.cast("decimal(38,6)")).alias("expected")).where("expected is not null and expected <> value")


def proportional_fills(df: DataFrame, columns: list[str], rows_least: int = 8) -> DataFrame:
    """``_row, column, value, expected, witnesses``: blanks of a table of rank one.

    Two columns are proportional when their ratio is the same in all rows, which one
    aggregation tells of all pairs.  Two witnesses must give a blank the same value."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    x = lambda c: X.to_num(F.col(f"`{c}`").cast("string"))
    ratio = [F.when(x(b) != 0, x(a) / x(b)) for a, b in pairs]
    r = df.agg(*[z for i, q in enumerate(ratio) for z in (F.min(q).alias(f"l{i}"), F.max(q).alias(f"h{i}"), F.count(q).alias(f"n{i}"))]).first()
    steady = [(a, b, (r[f"l{i}"] + r[f"h{i}"]) / 2) for i, (a, b) in enumerate(pairs) if r[f"n{i}"] >= rows_least and r[f"l{i}"] and r[f"h{i}"] - r[f"l{i}"] <= 1e-9 * abs(r[f"h{i}"])]
    cells = [F.struct(F.lit(a).alias("column"), F.round(F.lit(q) * x(b), 6).alias("v")) for a, b, q in steady]
    if not cells:
        return df.select("_row", F.lit("").alias("column"), F.lit("").alias("value"), F.lit("").alias("expected"), F.lit(0).alias("witnesses")).where("false")
    blank = {a: F.col(f"`{a}`").cast("string") == "" for a, _, _ in steady}
    said = df.select("_row", F.explode(F.filter(F.array(*[F.when(blank[a], c) for (a, _, _), c in zip(steady, cells)]), lambda z: z.isNotNull() & z["v"].isNotNull())).alias("z")).select("_row", "z.column", "z.v")
    out = said.groupBy("_row", "column").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("witnesses")).where("witnesses >= 2 and high - low <= 1e-6 * greatest(abs(high), 1)")
    return out.select("_row", "column", F.lit("").alias("value"), X.fmt_num(F.col("low").cast("decimal(38,6)")).alias("expected"), "witnesses")
