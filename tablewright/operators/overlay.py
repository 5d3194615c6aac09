"""Edits as joins.

An edit is a row ``kind, _row, column, old, new``; kinds are ``set_cell`` and
``delete_row``.  Rows keep their number for good, so that a deletion is a tombstone and
no index shifts.  Each edit is guarded: it applies only where the cell holds ``old``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import beside

EDIT = "kind string, _row long, column string, old string, new string"


def apply(wide: DataFrame, edits: DataFrame, written: bool = False, deletes: bool = True) -> DataFrame:
    """``wide`` after the edits, one join however many columns they touch.

    Edits that are ``written`` already are measured, and broadcast where they are few.
    ``deletes`` is false where it's known that no row goes."""
    names = [c for c in wide.columns if c != "_row"]
    cells = edits.where("kind = 'set_cell'").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("old", "new")))).alias("_e"))
    gone = edits.where("kind = 'delete_row'").select("_row")
    if written:
        sizes = F.aggregate(F.map_entries("_e"), F.lit(80), lambda n, x: n + 60 + F.coalesce(F.octet_length(x["value"]["old"]), F.lit(0)) + F.coalesce(F.octet_length(x["value"]["new"]), F.lit(0)))
        out = beside(wide, cells, "_row", "left", sizes)
    else:
        out = wide.join(cells, "_row", "left")

    def cell(c: str):  # noqa: ANN202
        e = F.try_element_at("_e", F.lit(c))
        now = F.col(f"`{c}`").cast("string")
        return F.when(e["old"].eqNullSafe(now) & e.isNotNull(), e["new"]).otherwise(now).alias(c)

    out = out.select("_row", *[cell(c) for c in names])
    if not deletes:
        return out
    return beside(out, gone, "_row", "left_anti", 16) if written else out.join(gone, "_row", "left_anti")


def invert(edits: DataFrame) -> DataFrame:
    """The edits that take the cells back; deleted rows come back by ``restore``."""
    return edits.where("kind = 'set_cell'").select("kind", "_row", "column", F.col("new").alias("old"), F.col("old").alias("new"))


def restore(repaired: DataFrame, edits: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """What was there before: cells taken back and deleted rows, as kept, put in again."""
    out = apply(repaired, invert(edits))
    return out if deleted is None else out.unionByName(deleted)


def conflicts(candidates: DataFrame) -> DataFrame:
    """``_row, column`` of cells for which candidates have different values."""
    return candidates.groupBy("_row", "column").agg(F.countDistinct("new").alias("n")).where("n > 1").select("_row", "column")


def digest(wide: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of row hashes that is the same in any order."""
    names = sorted(c for c in wide.columns if c != "_row")
    r = wide.agg(F.count("*").alias("n"), F.sum(F.xxhash64("_row", *[F.col(f"`{c}`").cast("string") for c in names]).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def truth(dirty: DataFrame, repaired: DataFrame, clean: DataFrame) -> DataFrame:
    """Cell quality of a repair: one row of counts and ratios, by a join of the three.

    Joined from the rows of ``dirty``, each side is shuffled once, as it is typed; only where
    another side has rows of its own must the joins be outer on both sides."""
    names = [c for c in clean.columns if c != "_row"]
    rows, has = lambda k: F.col(f"{k}._row"), ("r", "c")
    total = lambda f: reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.when(f(c), 1).otherwise(0)), F.lit(0)) for c in names])
    d, r, t = (lambda c, k=k: F.col(f"{k}.`{c}`").cast("string") for k in "drc")
    left = dirty.alias("d").join(repaired.alias("r"), rows("d") == rows("r"), "left").join(clean.alias("c"), rows("d") == rows("c"), "left")
    got = _truth(left, total, d, r, t, *[F.count(rows(k)).alias(f"_{k}") for k in has]).first()
    if (got["_r"], got["_c"]) == (repaired.count(), clean.count()):
        counts = dirty.sparkSession.createDataFrame([tuple(got)[:5]], ", ".join(f"{n} long" for n in got.__fields__[:5]))
    else:
        both = dirty.alias("d").join(repaired.alias("r"), rows("d") == rows("r"), "full_outer")
        counts = _truth(both.join(clean.alias("c"), F.coalesce(rows("d"), rows("r")) == rows("c"), "full_outer"), total, d, r, t)
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6), F.lit(1.0))
    return counts.select("*", ratio("repaired", "touched").alias("precision"), ratio("repaired", "wrong_before").alias("recall"), (F.col("wrong_after") == 0).alias("exact"))


def _truth(j: DataFrame, total: Callable, d: Callable, r: Callable, t: Callable, *more: Column) -> DataFrame:
    return j.agg(
        total(lambda c: ~d(c).eqNullSafe(t(c))).alias("wrong_before"),
        total(lambda c: ~d(c).eqNullSafe(r(c))).alias("touched"),
        total(lambda c: ~d(c).eqNullSafe(r(c)) & r(c).eqNullSafe(t(c))).alias("repaired"),
        total(lambda c: ~d(c).eqNullSafe(r(c)) & d(c).eqNullSafe(t(c))).alias("false_mutations"),
        total(lambda c: ~r(c).eqNullSafe(t(c))).alias("wrong_after"),
        *more,
    )
