"""Elapsed time: ``end = start + duration`` in a learnt unit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .mapping import SCOPES

UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
CONFIDENCE, MIN_ROWS = 0.95, 12


def typed(wide: DataFrame, times: list[str], numbers: list[str]) -> DataFrame:
    """Times as microseconds and numbers as doubles."""
    return wide.select("_row", *[F.unix_micros(X.to_ts(F.col(f"`{c}`").cast("string"))).alias(c) for c in times], *[X.to_num(F.col(f"`{c}`").cast("string")).alias(c) for c in numbers])


def relation_stats(wide: DataFrame, start: str, end: str, duration: str, rows: int) -> DataFrame:
    """``unit, scope, eligible, matched`` for each unit, in one aggregation."""
    t = typed(wide, [start, end], [duration])
    took, n = (F.col(f"`{end}`") - F.col(f"`{start}`")) / 1e6, F.col(f"`{duration}`")
    masks = {"all": F.lit(True), "even": F.col("_row") % 2 == 0, "odd": F.col("_row") % 2 == 1, "first": F.col("_row") < rows // 2, "second": F.col("_row") >= rows // 2}
    both = took.isNotNull() & n.isNotNull()
    aggs, cells = [], []
    for u, k in UNITS.items():
        for s in SCOPES:
            aggs += [F.count_if(masks[s] & both).alias(f"e_{u}_{s}"), F.count_if(masks[s] & (F.abs(took - n * k) <= 1e-6 * k)).alias(f"m_{u}_{s}")]
            cells.append(F.struct(F.lit(u).alias("unit"), F.lit(s).alias("scope"), F.col(f"e_{u}_{s}").alias("eligible"), F.col(f"m_{u}_{s}").alias("matched")))
    return t.agg(*aggs).select(F.inline(F.array(*cells)))


def counted(wide: DataFrame, triples: list[tuple[str, str, str]], rows: int) -> dict[tuple[int, str], dict[str, tuple[int, int]]]:
    """Eligible and matched rows by triple, unit and scope: NumPy counts of each batch."""
    times, numbers = sorted({c for s, e, _ in triples for c in (s, e)}), sorted({d for _, _, d in triples})

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            t, n = {c: pdf[c].to_numpy(float) for c in times}, {c: pdf[c].to_numpy(float) for c in numbers}
            r = pdf["_row"].to_numpy()
            masks = np.array([np.ones(len(r), bool), r % 2 == 0, r % 2 == 1, r < rows // 2, r >= rows // 2], float)
            found = []
            for i, (start, end, duration) in enumerate(triples):
                took = (t[end] - t[start]) / 1e6
                there = np.isfinite(took) & np.isfinite(n[duration])
                for unit, k in UNITS.items():
                    with np.errstate(invalid="ignore"):
                        good = there & (np.abs(took - n[duration] * k) <= 1e-6 * k)
                    found += [(i, unit, s, *x) for s, x in zip(SCOPES, (masks @ np.array([there, good], float).T).astype(int).tolist())]
            yield pd.DataFrame(found, columns=["i", "unit", "scope", "eligible", "matched"])

    sums = typed(wide, times, numbers).mapInPandas(partial, "i long, unit string, scope string, eligible long, matched long").groupBy("i", "unit", "scope").agg(F.sum("eligible").alias("e"), F.sum("matched").alias("m"))
    out: dict[tuple[int, str], dict[str, tuple[int, int]]] = {}
    for r in sums.collect():
        out.setdefault((r["i"], r["unit"]), {})[r["scope"]] = (r["e"], r["m"])
    return out


def discover(wide: DataFrame, times: list[str], numbers: list[str], rows: int, confidence: float = CONFIDENCE, min_rows: int = MIN_ROWS, about: set[str] | None = None) -> list[dict]:
    """Relations of all triples in one job; ``about``: only those with one of these columns."""
    triples = [(s, e, d) for s, e in permutations(times, 2) for d in numbers if about is None or about & {s, e, d}]
    if not triples:
        return []
    out = []
    for (i, unit), stats in sorted(counted(wide, triples, rows).items()):
        eligible, matched = stats["all"]
        if eligible < min_rows or matched < max(confidence, 0.95) * eligible:
            continue
        start, end, duration = triples[i]
        parts = [m / e for e, m in (stats[s] for s in SCOPES[1:]) if e >= max(4, min_rows // 3)]
        out.append({"start": start, "end": end, "duration": duration, "unit": unit, "eligible": eligible, "confidence": matched / eligible, "exact": matched == eligible, "stable": len(parts) >= 2 and min(parts) >= confidence})
    return out


def render(micros: Column, like: Column) -> Column:
    """A time in the ISO shape of another cell: its separator, its precision, its zone mark."""
    t = F.timestamp_micros(micros)
    mark = F.when(like.endswith("Z"), "Z").otherwise("")
    gap = F.when(like.contains("T"), "T").otherwise(" ")
    size = F.length(F.regexp_replace(like, "Z$", ""))
    day, clock = F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "HH:mm:ss")
    return F.when(size <= 10, day).when(size <= 16, F.concat(day, gap, F.substring(clock, 1, 5), mark)).otherwise(F.concat(day, gap, clock, mark))


def projections(wide: DataFrame, relation: dict) -> DataFrame:
    """The one missing of start, end and duration, by an exact relation."""
    s, e, d, k = relation["start"], relation["end"], relation["duration"], UNITS[relation["unit"]]
    cell = lambda c: F.col(f"`{c}`").cast("string")
    t = wide.select("_row", cell(s).alias("s"), cell(e).alias("e"), cell(d).alias("d")).select("*", F.unix_micros(X.to_ts(F.col("s"))).alias("ts"), F.unix_micros(X.to_ts(F.col("e"))).alias("te"), X.to_num(F.col("d")).alias("n"))
    shift = (F.col("n") * k * 1_000_000).cast("long")
    each = F.array(
        F.when((F.col("e") == "") & F.col("ts").isNotNull() & F.col("n").isNotNull(), F.struct(F.lit(e).alias("column"), render(F.col("ts") + shift, F.col("s")).alias("expected"))),
        F.when((F.col("s") == "") & F.col("te").isNotNull() & F.col("n").isNotNull(), F.struct(F.lit(s).alias("column"), render(F.col("te") - shift, F.col("e")).alias("expected"))),
        F.when((F.col("d") == "") & F.col("ts").isNotNull() & F.col("te").isNotNull(), F.struct(F.lit(d).alias("column"), X.fmt_num(((F.col("te") - F.col("ts")) / (1_000_000 * k)).cast("decimal(18,6)")).alias("expected"))),
    )
    return t.select("_row", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("v")).select("_row", "v.column", F.lit("").alias("value"), "v.expected")
