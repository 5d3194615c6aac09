"""Numeric equations between columns of a row.

Every candidate is measured over all rows and in four partitions, in one pass: NumPy counts
each Arrow batch, and a task hands over one sum for each candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .mapping import SCOPES

ABS, REL, MIN_ROWS, CONFIDENCE, TOLERANCE = 1e-6, 1e-6, 12, 0.95, 0.05
CHUNK = 1 << 13
Relation = tuple[str, str, tuple[str, ...]]  # target, kind, sources

_NUMPY = {
    "sum": lambda a, b: a + b, "difference": lambda a, b: a - b, "product": lambda a, b: a * b, "ratio": lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0),
    "sum3": lambda a, b, c: a + b + c, "sum_minus": lambda a, b, c: a + b - c, "product_plus": lambda a, b, c: a * b + c, "product_minus": lambda a, b, c: a * b - c,
}


def candidates(columns: list[str], terms: int = 2) -> list[Relation]:
    """Every equation of two sources (and three), once up to order."""
    out: list[Relation] = []
    for target in columns:
        rest = [c for c in columns if c != target]
        for a, b in combinations(rest, 2):
            out += [(target, k, s) for k, s in (("sum", (a, b)), ("product", (a, b)), ("difference", (a, b)), ("difference", (b, a)), ("ratio", (a, b)), ("ratio", (b, a)))]
        if terms >= 3:
            for a, b, c in combinations(rest, 3):
                out.append((target, "sum3", (a, b, c)))
                for last in (a, b, c):  # each may be the one that is added or taken off
                    first = tuple(x for x in (a, b, c) if x != last)
                    out += [(target, k, (*first, last)) for k in ("product_minus", "product_plus", "sum_minus")]
    return out


def numeric_columns(wide: DataFrame, columns: list[str], most: int | None = None) -> list[str]:
    """Columns of which nine tenths of the observed cells, and four of them, are numbers."""
    if not columns:
        return []
    seen = [F.count_if(F.col(f"`{c}`").cast("string") != "") for c in columns]
    good = [F.count(X.number_of(wide, c)) for c in columns]
    row = wide.agg(*[x.alias(f"n{i}") for i, x in enumerate(seen)], *[x.alias(f"g{i}") for i, x in enumerate(good)]).first()
    return [c for i, c in enumerate(columns) if row[f"g{i}"] >= 4 and row[f"g{i}"] >= 0.9 * row[f"n{i}"]][:most]


def _count(values: dict[tuple[str, tuple[str, ...]], list[tuple[int, str]]], x: dict[str, np.ndarray], sums: np.ndarray) -> None:
    """Add, for each relation, the rows that have all members; those where the equation holds;
    those where it holds within half the tolerance.

    ``values`` has, for each kind and sources, the relations by index and target."""
    with np.errstate(all="ignore"):
        has = {c: np.isfinite(v) for c, v in x.items()}
        for (kind, sources), uses in values.items():
            value = _NUMPY[kind](*[x[s] for s in sources])
            finite, room = np.isfinite(value), ABS + REL * np.maximum(np.abs(value), 1)
            for i, target in uses:
                there = finite & has[target]
                off = np.abs(x[target] - value)
                good = (off <= room) & there
                n = np.count_nonzero(good)
                sums[i] += np.count_nonzero(there), n, n and np.count_nonzero(good & (off <= 0.5 * room))


def typed(wide: DataFrame, columns: list[str]) -> DataFrame:
    return wide.select("_row", *[X.number_of(wide, c).alias(c) for c in columns])


def relation_stats(wide: DataFrame, relations: list[Relation], rows: int, batches: bool = True) -> DataFrame:
    """``relation, scope, eligible, matched, tight`` (within half the tolerance), by index.

    ``batches=False`` counts in expressions instead of NumPy: the same, for comparison."""
    columns = sorted({c for t, _, s in relations for c in (t, *s)})
    nums = typed(wide, columns)
    masks = {"all": F.lit(True), "even": F.col("_row") % 2 == 0, "odd": F.col("_row") % 2 == 1, "first": F.col("_row") < rows // 2, "second": F.col("_row") >= rows // 2}
    if not batches:
        out = None
        for at in range(0, len(relations), 3):
            aggs, cells = [], []
            for i in range(at, min(at + 3, len(relations))):
                target, kind, sources = relations[i]
                value = X.evaluate(kind, [F.col(f"`{s}`") for s in sources])
                both = value.isNotNull() & F.col(f"`{target}`").isNotNull()
                good = X.is_close(F.col(f"`{target}`"), value, ABS, REL)
                tight = X.is_close(F.col(f"`{target}`"), value, ABS / 2, REL / 2)
                for s in SCOPES:
                    aggs += [F.count_if(masks[s] & both).alias(f"e{i}{s}"), F.count_if(masks[s] & good).alias(f"m{i}{s}"), F.count_if(masks[s] & tight).alias(f"t{i}{s}")]
                    cells.append(F.struct(F.lit(i).cast("long").alias("relation"), F.lit(s).alias("scope"), F.col(f"e{i}{s}").alias("eligible"), F.col(f"m{i}{s}").alias("matched"), F.col(f"t{i}{s}").alias("tight")))
            one = nums.agg(*aggs).select(F.inline(F.array(*cells)))
            out = one if out is None else out.unionAll(one)
        return out

    values: dict[tuple[str, tuple[str, ...]], list[tuple[int, str]]] = {}
    for i, (target, kind, sources) in enumerate(relations):
        values.setdefault((kind, tuple(sources)), []).append((i, target))

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(relations), 4, 3), int)  # by half and parity
        for pdf in parts:
            r = pdf["_row"].to_numpy()
            kind = (r >= rows // 2) * 2 + r % 2
            order = np.argsort(kind, kind="stable")
            held, starts = np.unique(kind[order], return_index=True)
            whole = {c: pdf[c].to_numpy(float)[order] for c in columns}
            for at, (k, start) in enumerate(zip(held, starts)):
                end = starts[at + 1] if at + 1 < len(starts) else len(r)
                for lo in range(start, end, CHUNK):  # what fits in the cache
                    _count(values, {c: v[lo : min(lo + CHUNK, end)] for c, v in whole.items()}, sums[:, k])
        scopes = {"all": (0, 1, 2, 3), "even": (0, 2), "odd": (1, 3), "first": (0, 1), "second": (2, 3)}
        yield pd.DataFrame([(i, s, *sums[i, list(scopes[s])].sum(0).tolist()) for i in range(len(relations)) for s in SCOPES], columns=["relation", "scope", "eligible", "matched", "tight"])

    parts = nums.mapInPandas(partial, "relation long, scope string, eligible long, matched long, tight long")
    return parts.groupBy("relation", "scope").agg(*[F.sum(c).alias(c) for c in ("eligible", "matched", "tight")])


def discover(wide: DataFrame, columns: list[str], rows: int, terms: int = 2, min_rows: int = MIN_ROWS, confidence: float = CONFIDENCE, tolerance: float = TOLERANCE, about: set[str] | None = None, known: bool = False) -> list[dict]:
    """Relations that hold in most rows, each with ``confidence, exact`` and ``stable``.

    ``about``: only those with one of these columns.  ``known``: the columns are numeric."""
    columns = columns if known else numeric_columns(wide, columns)
    floor = max(0.70, confidence - max(tolerance, 0.25))
    loose = max(0.60, floor - 0.10)
    left = [r for r in candidates(columns, terms) if about is None or about & {r[0], *r[2]}]
    if not left:
        return []
    stats: dict[int, dict[str, tuple[int, int, int]]] = {}
    for r in relation_stats(wide, left, rows).collect():
        stats.setdefault(r["relation"], {})[r["scope"]] = (r["eligible"], r["matched"], r["tight"])
    out = []
    for i, (target, kind, sources) in enumerate(left):
        eligible, matched, tight = stats[i]["all"]
        if eligible < min_rows or matched < loose * eligible:
            continue
        parts = [m / e for e, m, _ in (stats[i][s] for s in SCOPES[1:]) if e >= max(4, min_rows // 3)]
        stable = matched >= floor * eligible and tight >= floor * eligible and len(parts) >= 2 and sum(p >= loose for p in parts) >= max(2, len(parts) - 1) and eligible - matched <= max(1, int(0.3 * eligible))
        out.append({"target": target, "kind": kind, "sources": list(sources), "eligible": eligible, "confidence": matched / eligible, "exact": matched == eligible, "stable": stable})
    return out


def ranges(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``column, low, high`` of the numbers of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), X.to_num(F.col(f"`{c}`").cast("string")).alias("x")) for c in columns])
    return wide.select(F.inline(cells)).where("x is not null").groupBy("column").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def _surely(relation: dict) -> Column:
    """Whether a relation of small whole numbers holds to the digit; False of any others."""
    n = lambda c: F.col(f"`{c}`").cast("string").try_cast("int").cast("bigint")
    t, x, kind = n(relation["target"]), [n(c) for c in relation["sources"]], relation["kind"]
    return F.coalesce((t * x[1] == x[0]) & (x[1] != 0) if kind == "ratio" else X.evaluate(kind, x) == t, F.lit(False))


def votes(wide: DataFrame, relations: list[dict]) -> DataFrame:
    """``_row, column, value, expected, relation``: cells that an equation contradicts or,
    where they are blank, gives.  Exact decimals; each relation by its index."""
    if not relations:
        return wide.sparkSession.createDataFrame([], "_row long, column string, value string, expected string, relation int")
    # rows of which nothing is said are told in compiled code, most by whole numbers alone
    wide = wide.where(~reduce(and_, [_surely(r) for r in relations]))
    names = sorted({c for r in relations for c in (r["target"], *r["sources"])})
    cells = {c: F.col(f"`{c}`").cast("string") for c in names}
    numbers = {c: X.decimal_of(wide, c) for c in names}
    t = wide.select("_row", *[cells[c].alias(f"v{i}") for i, c in enumerate(names)], *[numbers[c].alias(f"x{i}") for i, c in enumerate(names)])
    at = {c: i for i, c in enumerate(names)}
    wants = [X.evaluate(r["kind"], [F.col(f"x{at[s]}") for s in r["sources"]]) for r in relations]
    speaks = [F.coalesce((F.col(f"v{at[r['target']]}") == "") | ~X.is_close(F.col(f"x{at[r['target']]}"), want, ABS, REL), F.lit(False)) & want.isNotNull() for r, want in zip(relations, wants)]
    each = [F.when(use, F.struct(F.lit(r["target"]).alias("column"), F.col(f"v{at[r['target']]}").alias("value"), X.fmt_num(want).alias("expected"), F.lit(i).alias("relation"))) for i, (r, want, use) in enumerate(zip(relations, wants, speaks))]
    return t.where(reduce(or_, speaks)).select("_row", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull() & x["expected"].isNotNull())).alias("v")).select("_row", "v.*")


def answers(wide: DataFrame, relations: list[dict], independent: int = 2) -> DataFrame:
    """``_row, column, value, expected, witnesses``: cells with one value that relations agree
    on: two or more for a cell that has another, an exact one or two for a blank."""
    exact = [i for i, r in enumerate(relations) if r.get("exact")]
    sure = F.col("relation").isin(exact) if exact else F.lit(False)
    # a relation speaks of a cell once, so its voices need no distinct count; rows meet once for both counts
    by = votes(wide, relations).repartition("_row").groupBy("_row", "column", "value", "expected").agg(F.count("*").alias("witnesses"), F.max(sure).alias("sure"))
    enough = F.when(F.col("value") == "", F.col("sure") | (F.col("witnesses") >= 2)).otherwise(F.col("witnesses") >= independent)
    best = by.where(enough).groupBy("_row", "column", "value").agg(F.max_by("expected", "witnesses").alias("expected"), F.max("witnesses").alias("witnesses"), F.count("*").alias("answers"))
    return best.where("answers = 1").drop("answers")


def consensus(wide: DataFrame, relations: list[dict], independent: int = 2) -> DataFrame:
    """Non-blank cells on whose other value two or more relations agree, and no others do."""
    return answers(wide, relations, independent).where("value <> ''")


def projections(wide: DataFrame, relations: list[dict]) -> DataFrame:
    """Blank cells with the one value that exact relations give (or two others agree on)."""
    return answers(wide, relations).where("value = ''")
