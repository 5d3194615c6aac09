"""Running balances: ``balance = balance before + inflow - outflow``.

Neighbours come from bucketed windows (``functions.ordered``); each numeric column is
lagged once.  Many candidates are first counted as NumPy partial counts of Arrow batches,
with a wider tolerance, so that none is lost; what is left is counted exactly.

Numbers are exact decimals of six places, so a balance may be off by one in the last of them,
but by no share of its own size: it grows with the rows, and such a share would outgrow what
the rows differ by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ordered import neighbours
from .mapping import SCOPES

ABS, CONFIDENCE, MIN_ROWS = 1e-6, 0.99, 16


def near(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Exact numbers of each column, of the row before (``p_``) and after (``n_``)."""
    t = wide.select("_row", *[X.decimal_of(wide, c).alias(c) for c in columns], *[F.col(f"`{c}`").cast("string").alias(f"v_{c}") for c in columns])
    make = {f"p_{c}": (lambda w, c=c: F.lag(f"`{c}`").over(w)) for c in columns} | {f"n_{c}": (lambda w, c=c: F.lead(f"`{c}`").over(w)) for c in columns}
    return neighbours(t, make, back=1, ahead=1)


def flow(prefix: str, inflow: str, outflow: str | None) -> Column:
    return F.col(f"`{prefix}{inflow}`") - (F.col(f"`{prefix}{outflow}`") if outflow else F.lit(0))


def equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= ABS


def relation_stats(wide: DataFrame, triples: list[tuple[str, str, str | None]], rows: int) -> DataFrame:
    """``relation, scope, eligible, matched``, by index."""
    columns = sorted({c for t in triples for c in t if c})
    t = near(wide, columns)
    masks = {"all": F.lit(True), "even": F.col("_row") % 2 == 0, "odd": F.col("_row") % 2 == 1, "first": F.col("_row") < rows // 2, "second": F.col("_row") >= rows // 2}
    out = None
    for at in range(0, len(triples), 5):
        aggs, cells = [], []
        for i in range(at, min(at + 5, len(triples))):
            b, x, y = triples[i]
            want = F.col(f"`p_{b}`") + flow("", x, y)
            good = equal(F.col(f"`{b}`"), want)
            for s in SCOPES:
                aggs += [F.count_if(masks[s] & want.isNotNull() & F.col(f"`{b}`").isNotNull()).alias(f"e{i}{s}"), F.count_if(masks[s] & good).alias(f"m{i}{s}")]
                cells.append(F.struct(F.lit(i).alias("relation"), F.lit(s).alias("scope"), F.col(f"e{i}{s}").alias("eligible"), F.col(f"m{i}{s}").alias("matched")))
        one = t.agg(*aggs).select(F.inline(F.array(*cells)))
        out = one if out is None else out.unionAll(one)
    return out


def screened(wide: DataFrame, triples: list[tuple[str, str, str | None]], confidence: float, min_rows: int) -> list[tuple[str, str, str | None]]:
    """The candidates that can still pass over all rows."""
    columns = sorted({c for t in triples for c in t if c})
    at = {c: i for i, c in enumerate(columns)}
    t = near(wide, columns).select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for c, i in at.items()], *[F.col(f"`p_{c}`").cast("double").alias(f"p{i}") for c, i in at.items()])

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            now, had = ({c: pdf[f"{k}{i}"].to_numpy(float) for c, i in at.items()} for k in "cp")
            found = []
            for i, (b, x, y) in enumerate(triples):
                out = now[y] if y else 0.0
                want = had[b] + now[x] - out
                there = np.isfinite(want) & np.isfinite(now[b])
                room = 2 * ABS + 1e-12 * (np.abs(had[b]) + np.abs(now[x]) + np.abs(out))
                good = there & (np.abs(now[b] - want) <= room)
                found.append((i, int(there.sum()), int(good.sum())))
            yield pd.DataFrame(found, columns=["relation", "eligible", "matched"])

    sums = t.mapInPandas(partial, "relation long, eligible long, matched long").groupBy("relation").agg(F.sum("eligible").alias("e"), F.sum("matched").alias("m")).collect()
    return [triples[i] for i in sorted(r["relation"] for r in sums if r["e"] >= min_rows and passes(r["e"], r["m"], confidence))]


def passes(eligible: int, matched: int, confidence: float) -> bool:
    return matched >= confidence * eligible or eligible - matched <= max(2, int(0.05 * eligible))


def discover(wide: DataFrame, columns: list[str], rows: int, confidence: float = CONFIDENCE, min_rows: int = MIN_ROWS) -> list[dict]:
    """Stable balances; one of two columns is dropped where one of three covers it."""
    triples = [(b, x, None) for b, x in permutations(columns, 2)] + list(permutations(columns, 3))
    if len(triples) > 10:
        triples = screened(wide, triples, confidence, min_rows)
    if not triples:
        return []
    stats: dict[int, dict[str, tuple[int, int]]] = {}
    for r in relation_stats(wide, triples, rows).collect():
        stats.setdefault(r["relation"], {})[r["scope"]] = (r["eligible"], r["matched"])
    out = []
    for i, (b, x, y) in enumerate(triples):
        eligible, matched = stats[i]["all"]
        parts = [p for p in (stats[i][s] for s in SCOPES[1:]) if p[0] >= max(4, min_rows // 4)]
        if eligible >= min_rows and passes(eligible, matched, confidence) and len(parts) >= 2 and all(passes(*p, confidence) for p in parts):
            out.append({"balance": b, "inflow": x, "outflow": y, "eligible": eligible, "confidence": matched / eligible, "exact": matched == eligible, "stable": True})
    three = {(r["balance"], r["inflow"]) for r in out if r["outflow"]}
    return [r for r in out if r["outflow"] or (r["balance"], r["inflow"]) not in three]


def two_sided(wide: DataFrame, relation: dict) -> DataFrame:
    """Balances that differ from both the row before and the row after, which agree."""
    b, x, y = relation["balance"], relation["inflow"], relation["outflow"]
    t = near(wide, [c for c in (b, x, y) if c])
    forward = F.col(f"`p_{b}`") + flow("", x, y)
    backward = F.col(f"`n_{b}`") - flow("n_", x, y)
    said = t.select("_row", F.lit(b).alias("column"), F.col(f"`v_{b}`").alias("value"), F.col(f"`{b}`").alias("b"), forward.alias("f"), backward.alias("g"))
    agree = said.where(equal(F.col("f"), F.col("g")))
    return agree.where((F.col("value") == "") | ~equal(F.col("b"), F.col("f"))).select("_row", "column", "value", X.fmt_num(F.col("f")).alias("expected"))


def projections(wide: DataFrame, relation: dict) -> DataFrame:
    """The single blank of balance, inflow and outflow, going forward."""
    b, x, y = relation["balance"], relation["inflow"], relation["outflow"]
    t = near(wide, [c for c in (b, x, y) if c])
    had, now = F.col(f"`p_{b}`"), F.col(f"`{b}`")
    each = [(b, had + flow("", x, y)), (x, now - had + (F.col(f"`{y}`") if y else F.lit(0)))]
    if y:
        each.append((y, had + F.col(f"`{x}`") - now))
    cells = [F.when((F.col(f"`v_{c}`") == "") & want.isNotNull(), F.struct(F.lit(c).alias("column"), X.fmt_num(want).alias("expected"))) for c, want in each]
    return t.select("_row", F.explode(F.filter(F.array(*cells), lambda z: z.isNotNull())).alias("v")).select("_row", "v.column", F.lit("").alias("value"), "v.expected")
