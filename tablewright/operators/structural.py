"""What the issues of all analyzers say together: consensus, syndromes, faults."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ordered import BUCKET, cut

WEIGHT = {"error": 10, "warning": 3, "info": 1}


def weight() -> Column:
    return F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in WEIGHT.items()], F.lit(0)).cast("long")


def score(issues: DataFrame) -> DataFrame:
    """``repairable, total``: the objective that a repair must lower."""
    return issues.agg(F.coalesce(F.sum(F.when(F.col("repairable"), weight())), F.lit(0)).alias("repairable"), F.coalesce(F.sum(weight()), F.lit(0)).alias("total"))


def consensus(issues: DataFrame, families: int = 2) -> DataFrame:
    """``_row, column, expected, families, conflict``: cells for which different analyzers,
    by different evidence, expect the same value; a conflict where two values have that."""
    said = issues.where("column is not null and expected is not null").withColumn("norm", X.canonical(F.col("expected")))
    by = said.groupBy("_row", "column", "norm").agg(F.min("expected").alias("expected"), F.countDistinct("analyzer").alias("families"), F.countDistinct("evidence").alias("n")).where((F.col("families") >= families) & (F.col("n") >= 2))
    return by.groupBy("_row", "column").agg(F.min("expected").alias("expected"), F.max("families").alias("families"), (F.count("*") > 1).alias("conflict"))


def syndrome(issues: DataFrame) -> DataFrame:
    """``_row, column, violations, weight, families, class``: what is known of each cell."""
    cells = issues.where("column is not null")
    by = cells.groupBy("_row", "column").agg(F.count("*").alias("violations"), F.sum(weight()).alias("weight"), F.countDistinct("analyzer").alias("families"), F.countDistinct(F.when(F.col("expected").isNotNull(), X.canonical(F.col("expected")))).alias("values"), F.countDistinct(F.when(F.col("expected").isNotNull(), F.struct("analyzer", "evidence"))).alias("witnesses"))
    kind = F.when(F.col("values") > 1, "CONFLICTING").when(F.col("values") == 0, "LOCALIZED_NO_RECONSTRUCTION").when(F.col("witnesses") >= 2, "UNIQUE_MULTI_WITNESS").otherwise("SINGLE_WITNESS")
    return by.select("_row", "column", "violations", "weight", "families", kind.alias("class"), F.least(F.lit(1.0), F.col("witnesses") / 4).alias("reliability"))


def ranking(issues: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` likeliest faulty cells: weight, then violations, then place."""
    return syndrome(issues).orderBy(F.desc("weight"), F.desc("violations"), "_row", "column").limit(k)


def column_reliability(issues: DataFrame, rows: int) -> DataFrame:
    """``column, faulty, reliability``: the share of its cells without an issue."""
    return issues.where("column is not null").groupBy("column").agg(F.countDistinct("_row").alias("faulty")).select("column", "faulty", F.round(1 - F.col("faulty") / rows, 6).alias("reliability"))


def _joined(pieces: DataFrame, *by: str) -> DataFrame:
    """``column, start, end`` of the pieces ``start`` to ``end`` that meet, within ``by``."""
    w = Window.partitionBy(*by).orderBy("start")
    fresh = F.coalesce(F.col("start") > F.lag("end").over(w) + 1, F.lit(True)).cast("int")
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("_new", fresh).withColumn("_run", run).groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("column", "start", "end")


def common_runs(issues: DataFrame, least: int = 3, size: int = BUCKET) -> DataFrame:
    """``column, start, length`` of runs of faulty rows: gaps and islands by column.

    Runs are found in buckets of consecutive rows; what touches an end of its bucket, two
    pieces at most, meets its neighbours in wider buckets, so no task holds a column."""
    pieces = issues.where("column is not null").select("column", F.col("_row").alias("start"), F.col("_row").alias("end"))
    length = F.col("end") - F.col("start") + 1
    done = None
    for width in (size, size << 10, size << 20):
        found = _joined(pieces.withColumn("_bucket", F.floor(F.col("start") / width)), "column", "_bucket")
        edge = (F.col("start") % width == 0) | ((F.col("end") + 1) % width == 0)
        if done is None:  # the shorter runs go here, and what is left is read more than once
            found = cut(found.where(edge | (length >= least)))
        done, pieces = (found.where(~edge) if done is None else done.unionAll(found.where(~edge))), found.where(edge)
    return done.unionAll(_joined(pieces, "column")).select("column", "start", length.alias("length")).where(F.col("length") >= least)


def hitting_set(edges: list[frozenset], most: int = 6) -> tuple[list, bool]:
    """A least set of cells that meets every edge, and whether it's proven least.

    Exact for up to 24 cells and 40 edges; beyond, and for sets larger than ``most``,
    the cell of most open edges is taken each time."""
    edges = [e for e in edges if e]
    cells = sorted({c for e in edges for c in e})
    if not edges:
        return [], True
    if len(cells) <= 24 and len(edges) <= 40:
        for k in range(1, most + 1):
            for s in combinations(cells, k):
                if all(e & set(s) for e in edges):
                    return list(s), True
    left, out = list(edges), []
    while left:
        best = max(cells, key=lambda c: (sum(c in e for e in left), [-ord(x) for x in str(c)]))
        out.append(best)
        left = [e for e in left if best not in e]
    return out, False


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change, relation``: relations by identity that were added, removed or stay."""
    a, b = old.select("relation").distinct(), new.select("relation").distinct()
    return a.exceptAll(b).select(F.lit("removed").alias("change"), "relation").unionAll(b.exceptAll(a).select(F.lit("added").alias("change"), "relation")).unionAll(a.intersect(b).select(F.lit("stable").alias("change"), "relation"))


def sample(df: DataFrame, size: int, seed: str) -> DataFrame:
    """A sample that depends on the seed and row numbers alone."""
    return df.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("_row").cast("string")), 256)).orderBy("_h").limit(size).drop("_h")


def distinct_witnesses(witnesses: DataFrame) -> DataFrame:
    """One witness for each lineage of a cell: copies of one source count once."""
    return witnesses.groupBy("_row", "column", F.coalesce("lineage", "source").alias("lineage")).agg(F.min("source").alias("source"), F.min("expected").alias("expected"))


def relation_degrees(relations: DataFrame) -> DataFrame:
    """``column, relations, families, stable`` of a frame ``relation, family, columns, stable``."""
    each = relations.select("relation", "family", "stable", F.explode("columns").alias("column")).distinct()
    return each.groupBy("column").agg(F.countDistinct("relation").alias("relations"), F.countDistinct("family").alias("families"), F.count_if("stable").alias("stable"))


def cell_support(wide: DataFrame, votes: DataFrame) -> DataFrame:
    """``column, cells, supported, share``: how many cells a relation can speak about."""
    names = [c for c in wide.columns if c != "_row"]
    cells = wide.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("cells")) for i, c in enumerate(names)])))
    said = votes.groupBy("column").agg(F.countDistinct("_row").alias("supported"))
    return cells.join(said, "column", "left").select("column", "cells", F.coalesce("supported", F.lit(0)).alias("supported"), F.round(F.coalesce("supported", F.lit(0)) / F.col("cells"), 6).alias("share"))


def selection_ledger(tried: dict[str, int], accepted: dict[str, int]) -> list[dict]:
    """By family: how many relations were tried and kept, and how many chance would keep at 5 per cent."""
    return [{"family": f, "tried": n, "accepted": accepted.get(f, 0), "by_chance": round(0.05 * n, 6)} for f, n in sorted(tried.items())]
