"""Affine laws ``y = slope * x + intercept`` that hold within a group of rows.

The fit is Theil-Sen: the median of slopes between up to 40 points, then the median
intercept.  Laws are fitted on about ``SAMPLE`` rows of each group, picked by a hash of the
row number, in a grouped map; they are then measured over all rows in one aggregation.
A small group is fitted on all of its rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ordered import beside, cut

ABS, REL, POINTS, SAMPLE, MIN_ROWS, CONFIDENCE = 1e-6, 1e-6, 40, 400, 12, 0.98


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """Slope and intercept; None for fewer than four points or three values of x."""
    if len(x) < 4 or len(np.unique(x)) < 3:
        return None
    take = np.unique(np.linspace(0, len(x) - 1, min(POINTS, len(x))).astype(int))
    a, b = np.triu_indices(len(take), 1)
    dx, dy = x[take][b] - x[take][a], y[take][b] - y[take][a]
    if not (dx != 0).any():
        return None
    slope = float(np.median(dy[dx != 0] / dx[dx != 0]))
    return slope, float(np.median(y - slope * x))


def steady(x: np.ndarray, y: np.ndarray, law: tuple[float, float]) -> bool:
    """Whether halves and alternate rows have the same law."""
    slope, intercept = law
    half = len(x) // 2
    parts = [s for s in (slice(0, None, 2), slice(1, None, 2), slice(0, half), slice(half, None)) if len(x[s]) >= 4]
    others = [f for f in (fit(x[s], y[s]) for s in parts) if f]
    near = lambda a, b: abs(a - b) <= 10 * (ABS + REL * max(abs(b), 1))
    return len(others) >= 2 and all(near(a, slope) and near(b, intercept) for a, b in others)


def fits(wide: DataFrame, scope: str, source: str, target: str, confidence: float = CONFIDENCE) -> DataFrame:
    """``scope`` and the law of each group."""
    t = wide.select("_row", F.col(f"`{scope}`").cast("string").alias("scope"), X.to_num(F.col(f"`{source}`").cast("string")).alias("x"), X.to_num(F.col(f"`{target}`").cast("string")).alias("y")).where("scope <> '' and x is not null and y is not null")
    sizes = cut(t.groupBy("scope").agg(F.count("*").alias("n")))
    width = F.octet_length("scope") + 80
    picked = beside(t, sizes, "scope", "inner", width).where(F.pmod(F.xxhash64("_row"), F.floor(F.col("n") / SAMPLE) + 1) == 0).select("scope", "_row", "x", "y")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        law = fit(x, y)
        return pd.DataFrame([(pdf["scope"].iloc[0], *law, steady(x, y, law))] if law else [], columns=["scope", "slope", "intercept", "steady"])

    laws = cut(picked.groupBy("scope").applyInPandas(one, "scope string, slope double, intercept double, steady boolean"))
    want = F.col("slope") * F.col("x") + F.col("intercept")
    hit = lambda k: F.count_if(X.is_close(F.col("y"), want, k * ABS, k * REL))
    out = beside(t, laws, "scope", "inner", width).groupBy("scope", "slope", "intercept", "steady").agg(F.count("*").alias("support"), hit(1).alias("m"), hit(0.5).alias("tight"), F.min("x").alias("low"), F.max("x").alias("high"))
    share = F.col("m") / F.col("support")
    return out.select("scope", "slope", "intercept", "support", share.alias("confidence"), (F.col("m") == F.col("support")).alias("exact"), (F.col("steady") & (share >= confidence) & (F.col("tight") >= F.col("support") * confidence)).alias("stable"), "low", "high")


def scope_columns(wide: DataFrame, columns: list[str], rows: int, most: int | None = None) -> list[str]:
    """Text columns of two groups or more, which are a quarter of the rows at most."""
    if not columns:
        return []
    r = wide.agg(*[F.countDistinct(F.col(f"`{c}`").cast("string")).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if 2 <= r[f"d{i}"] <= min(most or rows, max(2, rows // 4))]


def pair_fits(wide: DataFrame, scope: Column, pairs: list[tuple[str, str]], confidence: float) -> dict[int, list[dict]]:
    """The stable laws of all pairs of columns by index and group of ``scope``, in one job."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    each = F.array(*[F.struct(F.lit(i).alias("i"), text(a).alias("x"), text(b).alias("y")) for i, (a, b) in enumerate(pairs)])
    spread = wide.select("_row", scope.alias("s"), F.explode(each).alias("p")).where("s <> ''").select("_row", F.concat(F.col("p.i").cast("string"), F.lit(":"), "s").alias("_scope"), F.col("p.x").alias("_x"), F.col("p.y").alias("_y"))
    by: dict[int, list[dict]] = {}
    for r in fits(spread, "_scope", "_x", "_y", confidence).where("stable").orderBy("scope").collect():
        i, _, group = r["scope"].partition(":")
        by.setdefault(int(i), []).append(r.asDict() | {"scope": group})
    return by


def differ(laws: list[dict]) -> bool:
    return len({(round(x["slope"], 6), round(x["intercept"], 6)) for x in laws}) >= 2


def discover(wide: DataFrame, scopes: list[str], numbers: list[str], confidence: float = CONFIDENCE, about: set[str] | None = None) -> list[dict]:
    """Laws with two stable groups or more that differ; all pairs of columns in one job.

    ``about``: only relations with one of these columns."""
    out = []
    for scope in scopes:
        pairs = [p for p in permutations(numbers, 2) if scope not in p and (about is None or about & {scope, *p})]
        if not pairs:
            continue
        for i, laws in sorted(pair_fits(wide, F.col(f"`{scope}`").cast("string"), pairs, confidence).items()):
            if len(laws) >= 2 and differ(laws):
                out.append({"scope": scope, "source": pairs[i][0], "target": pairs[i][1], "laws": laws})
    return out


def side(split: int) -> Column:
    return F.when(F.col("_row") < split, "before").otherwise("after")


def discover_segments(wide: DataFrame, numbers: list[str], rows: int, confidence: float = CONFIDENCE, about: set[str] | None = None) -> list[dict]:
    """Laws that change at a third, a half or two thirds of the rows: of each pair of columns
    the first of these at which both sides have a stable law, and another."""
    pairs = [p for p in permutations(numbers, 2) if about is None or about & set(p)]
    out: dict[int, dict] = {}
    for split in dict.fromkeys((rows // 3, rows // 2, 2 * rows // 3)) if pairs else ():
        for i, laws in pair_fits(wide, side(split), pairs, confidence).items():
            if i not in out and len(laws) == 2 and differ(laws):
                out[i] = {"split": split, "source": pairs[i][0], "target": pairs[i][1], "laws": laws}
    return [r for _, r in sorted(out.items())]


def segments(wide: DataFrame, source: str, target: str, rows: int, confidence: float = CONFIDENCE) -> DataFrame:
    """The laws before and after a third, a half and two thirds of the rows: ``split, side, ...``."""
    cuts = F.array(*[F.struct(F.lit(c).alias("split"), F.when(F.col("_row") < c, "before").otherwise("after").alias("side")) for c in (rows // 3, rows // 2, 2 * rows // 3)])
    spread = wide.select("*", F.explode(cuts).alias("_c")).select("*", F.concat_ws(":", F.col("_c.split").cast("string"), "_c.side").alias("_scope"))
    out = fits(spread, "_scope", source, target, confidence)
    return out.select(F.split_part("scope", F.lit(":"), F.lit(1)).cast("long").alias("split"), F.split_part("scope", F.lit(":"), F.lit(2)).alias("side"), *[c for c in out.columns if c != "scope"])


def told(wide: DataFrame, relation: dict) -> DataFrame:
    """``_row, value, y, want`` of the targets that a law speaks of: source in its range."""
    laws = wide.sparkSession.createDataFrame([(x["scope"], x["slope"], x["intercept"], x["low"], x["high"]) for x in relation["laws"]], "scope string, slope double, intercept double, low double, high double")
    scope = side(relation["split"]) if "split" in relation else F.col(f"`{relation['scope']}`").cast("string")
    target = F.col(f"`{relation['target']}`").cast("string")
    t = wide.select("_row", scope.alias("scope"), X.to_num(F.col(f"`{relation['source']}`").cast("string")).alias("x"), target.alias("value"), X.to_num(target).alias("y")).where("x is not null")
    hit = beside(t, laws, "scope", "inner", F.octet_length("scope") + 80).where("x between low and high")
    return hit.select("_row", "value", "y", (F.col("slope") * F.col("x") + F.col("intercept")).alias("want"))


def projections(wide: DataFrame, relation: dict) -> DataFrame:
    """Blank targets by their group's law, only for sources within its range."""
    return told(wide, relation).where("value = ''").select("_row", F.lit(relation["target"]).alias("column"), "value", X.fmt_num(F.col("want").cast("decimal(28,9)")).alias("expected"))


def disagreements(wide: DataFrame, relation: dict) -> DataFrame:
    """Targets that differ from their group's law, in range: a witness, not yet a repair."""
    hit = told(wide, relation).where(F.col("y").isNotNull() & ~X.is_close(F.col("y"), F.col("want")))
    return hit.select("_row", F.lit(relation["target"]).alias("column"), "value", X.fmt_num(F.col("want").cast("decimal(28,9)")).alias("expected"))


def consensus(wide: DataFrame, relations: list[dict], independent: int = 2) -> DataFrame:
    """Targets on whose other value laws from different sources agree, and no others."""
    parts = [disagreements(wide, r).withColumn("source", F.lit(r["source"])) for r in relations]
    if not parts:
        return wide.select("_row", F.lit("").alias("column"), F.lit("").alias("value"), F.lit("").alias("expected")).where("false")
    by = reduce(DataFrame.unionByName, parts).groupBy("_row", "column", "value", "expected").agg(F.countDistinct("source").alias("n")).where(F.col("n") >= independent)
    return by.groupBy("_row", "column", "value").agg(F.min("expected").alias("expected"), F.count("*").alias("answers")).where("answers = 1").drop("answers")
