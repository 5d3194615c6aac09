"""How a series or a relation changes over the rows: levels, hysteresis, held-out error."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import neighbours


def quarters(df: DataFrame, column: str, rows: int) -> DataFrame:
    """``q1, q2, q3, q4, separation, recurring``: whether levels come back every other quarter."""
    q = rows // 4
    part = F.least(F.floor(F.col("_row") / q), F.lit(3))
    means = [F.avg(F.when(part == i, F.col(column))).alias(f"q{i + 1}") for i in range(4)]
    r = df.agg(*means, F.stddev_samp(column).alias("sd"))
    apart = F.abs((F.col("q1") + F.col("q3")) / 2 - (F.col("q2") + F.col("q4")) / 2) / F.col("sd")
    back = (F.abs(F.col("q1") - F.col("q3")) <= 0.6 * F.col("sd")) & (F.abs(F.col("q2") - F.col("q4")) <= 0.6 * F.col("sd"))
    return r.select(*[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(1, 5)], F.round(apart, 6).alias("separation"), (back & (apart >= 1.5)).alias("recurring"))


def ema(df: DataFrame, column: str, rows: int) -> DataFrame:
    """``ema``: the exponential mean at the last row, as one weighted sum.

    With a = 2 / (w + 1) the value at row i counts a * (1 - a)^(n-1-i), the first without a."""
    a = 2.0 / (max(6, rows // 5) + 1.0)
    weight = F.pow(F.lit(1 - a), F.lit(rows - 1) - F.col("_row")) * F.when(F.col("_row") == 0, 1.0).otherwise(a)
    return df.agg(F.round(F.sum(weight * F.col(column)), 6).alias("ema"))


def half_shift(df: DataFrame, residual: Column, rows: int) -> DataFrame:
    """``first, second, shift``: median residual of either half."""
    m = lambda c: F.median(F.when(c, residual))
    return df.agg(m(F.col("_row") < rows // 2).alias("a"), m(F.col("_row") >= rows // 2).alias("b")).select(F.round("a", 6).alias("first"), F.round("b", 6).alias("second"), F.round(F.col("b") - F.col("a"), 6).alias("shift"))


def autocorrelation(df: DataFrame, column: str) -> DataFrame:
    """``rows, acf1, white``: lag-one autocorrelation, and whether it's within 2 / sqrt(n)."""
    m = df.agg(F.count(column).alias("rows"), F.avg(column).alias("m"), F.var_pop(column).alias("v"))
    t = neighbours(df.select("_row", column), {"p": lambda w: F.lag(column).over(w)}).crossJoin(F.broadcast(m))
    out = t.groupBy("rows", "v").agg(F.sum((F.col(column) - F.col("m")) * (F.col("p") - F.col("m"))).alias("s"))
    r = F.coalesce(F.try_divide(F.col("s"), F.col("v") * F.col("rows")), F.lit(0.0))
    return out.select("rows", F.round(r, 6).alias("acf1"), (F.abs(r) <= 2 / F.sqrt("rows")).alias("white"))


def hysteresis(df: DataFrame, x: str, y: str) -> DataFrame:
    """``bin, up, down, separation``: mean of y by tenth of x, as x rises and as it falls."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("hi > lo")
    t = neighbours(df.select("_row", x, y), {"p": lambda w: F.lag(x).over(w)}).crossJoin(F.broadcast(ends))
    part = F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9)).cast("long")
    down = F.coalesce(F.col(x) < F.col("p"), F.lit(False))
    g = t.groupBy(part.alias("bin")).agg(F.avg(F.when(~down, F.col(y))).alias("up"), F.avg(F.when(down, F.col(y))).alias("down"), F.var_samp(F.when(~down, F.col(y))).alias("vu"), F.var_samp(F.when(down, F.col(y))).alias("vd"), F.count_if(~down).alias("nu"), F.count_if(down).alias("nd"))
    sep = F.abs(F.col("up") - F.col("down")) / F.sqrt(F.greatest((F.col("vu") + F.col("vd")) / 2, F.lit(1e-30)))
    return g.where("nu >= 3 and nd >= 3").select("bin", F.round("up", 6).alias("up"), F.round("down", 6).alias("down"), F.round(sep, 6).alias("separation"))


def multistable(df: DataFrame, x: str, y: str) -> DataFrame:
    """``bin, count, separation`` of tenths of x in which y falls in two far apart levels."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("hi > lo")
    t = df.select(x, y).crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9)).cast("long"))
    mid = t.groupBy("bin").agg(F.median(y).alias("mid"), F.stddev_samp(y).alias("sd"), F.count("*").alias("count")).where("count >= 6")
    low = F.col(y) <= F.col("mid")
    g = t.join(F.broadcast(mid), "bin").groupBy("bin", "count", "sd").agg(F.avg(F.when(low, F.col(y))).alias("a"), F.avg(F.when(~low, F.col(y))).alias("b"), F.count_if(low).alias("n"), F.count_if(~low).alias("m")).where("n >= 2 and m >= 2")
    sep = (F.col("b") - F.col("a")) / F.greatest("sd", F.lit(1e-15))
    return g.select("bin", "count", F.round(sep, 6).alias("separation")).where(F.col("separation") >= 1.5)


def prefixes(df: DataFrame, success: Column, rows: int) -> DataFrame:
    """``share, rows, rate`` over the first quarter, half, three quarters and all rows."""
    cuts = [(s, rows * s // 100) for s in (25, 50, 75, 100)]
    aggs = [x for s, n in cuts for x in (F.count_if(F.col("_row") < n).alias(f"n{s}"), F.avg(F.when(F.col("_row") < n, success.cast("int"))).alias(f"r{s}"))]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(s).cast("long").alias("share"), F.col(f"n{s}").alias("rows"), F.round(f"r{s}", 6).alias("rate")) for s, _ in cuts])))


def epochs(df: DataFrame, violated: Column, at: int, share: float = 0.8) -> DataFrame:
    """``before, after, one_sided``: violations on either side of a change point."""
    r = df.agg(F.count_if(violated & (F.col("_row") < at)).alias("before"), F.count_if(violated & (F.col("_row") >= at)).alias("after"))
    return r.select("*", (F.greatest("before", "after") >= (F.col("before") + F.col("after")) * share).alias("one_sided"))


def held_out(df: DataFrame, error: Column, rows: int) -> DataFrame:
    """``part, rows, mean_error, worst`` of the first 60, next 20 and last 20 per cent, and quarters."""
    a, b = max(1, rows * 6 // 10), max(1, rows * 8 // 10)
    r = F.col("_row")
    split = F.when(r < a, "train").when(r < b, "validation").otherwise("test")
    quarter = F.concat(F.lit("quarter"), (F.least(F.floor(r * 4 / rows), F.lit(3)) + 1).cast("string"))
    spread = df.select(F.explode(F.array(split, quarter)).alias("part"), F.abs(error).alias("e")).where("e is not null")
    return spread.groupBy("part").agg(F.count("*").alias("rows"), F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.max("e"), 6).alias("worst"))


def folds(df: DataFrame, error: Column, k: int = 5) -> DataFrame:
    """``fold, rows, mean_error`` by row number modulo ``k``."""
    return df.select((F.col("_row") % k).alias("fold"), F.abs(error).alias("e")).where("e is not null").groupBy("fold").agg(F.count("*").alias("rows"), F.round(F.avg("e"), 6).alias("mean_error"))


def complexity(df: DataFrame, errors: dict[str, tuple[Column, int]]) -> DataFrame:
    """``model, rows, rss, aic, bic`` of each model, ``(error, parameters)``, least BIC first."""
    aggs = [x for i, (e, _) in enumerate(errors.values()) for x in (F.count(e).alias(f"n{i}"), F.sum(e * e).alias(f"s{i}"))]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"), F.col(f"n{i}").alias("rows"), F.col(f"s{i}").alias("rss")) for i, (m, (_, k)) in enumerate(errors.items())])
    fit = F.col("rows") * F.log(F.greatest(F.col("rss") / F.col("rows"), F.lit(1e-30)))
    return df.agg(*aggs).select(F.inline(rows)).select("model", "rows", F.round("rss", 6).alias("rss"), F.round(fit + 2 * F.col("k"), 6).alias("aic"), F.round(fit + F.col("k") * F.log("rows"), 6).alias("bic")).orderBy("bic", "aic", "model")


#: P(weight < k) of a Poisson weight of mean one, in 32 bits; beyond the last it's under 2^-32
_BELOW = np.array([round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(rows: np.ndarray, replicates: int, seed: int) -> Iterator[np.ndarray]:
    """The weights of ``rows``, by number, in each replicate; two are drawn from one hash."""
    with np.errstate(over="ignore"):
        base = _mixed(rows.astype(np.int64).view(np.uint64) + _mixed(np.array([seed], np.uint64)))
        for k in range(0, replicates, 2):
            bits = _mixed(base + np.uint64((k // 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
            for half in (bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))[: replicates - k]:
                yield np.searchsorted(_BELOW, half, side="right").astype(float)


def bootstrap(df: DataFrame, success: Column, replicates: int = 40, seed: int = 731) -> DataFrame:
    """``rate, low, high``: a share with the range of resampled ones.

    A row's weight in a replicate is Poisson with mean one, drawn from its number, so that
    replicates are sums over partitions and no row travels.  Draws are made for whole arrays:
    32 bits of a hash of row, seed and replicate, held against the distribution."""

    def weigh(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((replicates + 1, 2))
        for pdf in parts:
            ok = pdf["ok"].to_numpy(float)
            for k, w in enumerate(poisson_weights(pdf["_row"].to_numpy(), replicates, seed), 1):
                out[k] += w.sum(), w @ ok
            out[0] += len(ok), ok.sum()
        yield pd.DataFrame({"replicate": range(replicates + 1), "n": out[:, 0], "s": out[:, 1]})

    sums = df.select("_row", success.cast("int").alias("ok")).where("ok is not null").mapInPandas(weigh, "replicate int, n double, s double").groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("r"))
    return sums.agg(F.round(F.max(F.when(F.col("replicate") == 0, F.col("r"))), 6).alias("rate"), F.round(F.min("r"), 6).alias("low"), F.round(F.max("r"), 6).alias("high"))


def shuffled_control(errors: list[float], seed: int = 731) -> float:
    """Mean absolute difference of a list and itself in random order."""
    other = list(errors)
    random.Random(seed).shuffle(other)
    return float(np.mean(np.abs(np.array(errors) - np.array(other)))) if errors else 0.0
