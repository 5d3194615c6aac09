"""Rows of the wrong width and headers of the wrong form."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def kind(v: Column) -> Column:
    """``empty, number, datetime`` or ``string``."""
    return F.when(X.strip(v) == "", "empty").when(X.to_num(v).isNotNull(), "number").when(X.to_ts(v).isNotNull(), "datetime").otherwise("string")


def dominant_kinds(raw: DataFrame, width: int) -> list[str]:
    """The most frequent kind of each column over the rows of the right width."""
    cells = raw.where(F.size("_cells") == width).select(F.posexplode("_cells").alias("c", "v")).select("c", kind(F.col("v")).alias("k")).where("k <> 'empty'")
    best = cells.groupBy("c", "k").agg(F.count("*").alias("n")).groupBy("c").agg(F.max_by("k", F.struct("n", "k")).alias("k"))
    got = {r["c"]: r["k"] for r in best.collect()}
    return [got.get(i, "empty") for i in range(width)]


def realigned(raw: DataFrame, width: int) -> DataFrame:
    """``_row, operation, position, mismatches, new_cells`` of rows that are one cell short
    or long and whose best alignment has fewer type mismatches than any other.

    A short row gets a blank somewhere; of a long one a blank goes.  Each way is an array
    expression, so that a row is judged where it lies."""
    kinds = dominant_kinds(raw, width)
    fits = F.array(*[F.lit(k) for k in kinds])

    def mismatches(cells: Column) -> Column:
        bad = F.zip_with(cells, fits, lambda v, k: ((X.strip(v) != "") & (k != "empty") & (kind(v) != k)).cast("int"))
        return F.aggregate(bad, F.lit(0), lambda a, b: a + b)

    cells = F.col("_cells")
    short = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(F.lit("insert_blank").alias("operation"), i.alias("position"), F.concat(F.slice(cells, F.lit(1), i), F.array(F.lit("")), F.slice(cells, i + 1, F.lit(width))).alias("cells")))
    blanks = F.filter(F.sequence(F.lit(0), F.lit(width)), lambda i: X.strip(F.get(cells, i)) == "")
    long = F.transform(blanks, lambda i: F.struct(F.lit("remove_blank").alias("operation"), i.alias("position"), F.concat(F.slice(cells, F.lit(1), i), F.slice(cells, i + 2, F.lit(width))).alias("cells")))
    ways = raw.where(F.abs(F.size(cells) - width) == 1).select("_row", F.explode(F.when(F.size(cells) < width, short).otherwise(long)).alias("w"))
    scored = ways.select("_row", F.col("w.operation").alias("operation"), F.col("w.position").alias("position"), mismatches(F.col("w.cells")).alias("mismatches"), F.col("w.cells").alias("new_cells"))
    best = scored.groupBy("_row").agg(F.min("mismatches").alias("least"), F.min_by(F.struct("operation", "position", "mismatches", "new_cells"), F.struct("mismatches", "position")).alias("b"), F.sort_array(F.collect_list("mismatches")).alias("all"))
    alone = F.coalesce(F.get("all", F.lit(1)) > F.col("least"), F.lit(True))
    return best.where(alone).select("_row", "b.operation", F.col("b.position").cast("long").alias("position"), F.col("b.mismatches").cast("long").alias("mismatches"), "b.new_cells")


def affine_filled(wide: DataFrame, gaps: list[tuple[int, str]]) -> DataFrame:
    """``wide`` with blanks, by ``row, column``, filled where exact laws of other columns,
    of eight witnesses or more, all give the same value."""
    from . import numeric, overlay, scoped

    names = [c for c in wide.columns if c != "_row"]
    numbers = numeric.numeric_columns(wide, names)
    edits = []
    for row, column in gaps:
        cells = wide.where(F.col("_row") == row).first()
        said = set()
        for source in numbers:
            if column not in numbers or source == column:
                continue
            law = scoped.fits(wide.withColumn("_all", F.lit("all")), "_all", source, column).where("exact and stable and support >= 8").first()
            x = spark_number(cells[source])
            if law is not None and x is not None:
                said.add(round(law["slope"] * x + law["intercept"], 6))
        if len(said) == 1:
            v = said.pop()
            edits.append(("set_cell", row, column, "", str(int(v)) if v == int(v) else repr(v)))
    return overlay.apply(wide, wide.sparkSession.createDataFrame(edits, overlay.EDIT)) if edits else wide


def spark_number(v: str | None) -> float | None:
    try:
        return float(v) if v else None
    except ValueError:
        return None


def canonical_header(header: list[str]) -> list[tuple[int, str, str]]:
    """``column, old, new`` of names with other than word characters, blank or repeated."""
    seen: Counter = Counter()
    out = []
    for i, h in enumerate(header):
        base = "_".join(filter(None, re.split(r"\W+", h.strip()))) or f"column_{i + 1}"
        seen.update([base])
        again = seen[base]
        new = f"{base}__{again}" if again > 1 else base
        if new != h:
            out.append((i, h, new))
    return out


ALIASES = {"customer_id": ("cust_id", "client_id", "customerid"), "order_id": ("orderid", "order_no", "order_number"), "product_id": ("prod_id", "item_id", "sku"), "quantity": ("qty", "count", "units"), "amount": ("amt", "total_value"), "date": ("dt", "day", "order_date"), "country": ("nation", "country_code"), "price": ("unit_price", "cost")}


def header_bridges(header: list[str]) -> list[tuple[str, str]]:
    """``name, concept`` of headers that are another word for a known concept."""
    known = {a: c for c, names in ALIASES.items() for a in names}
    return [(h, known[t]) for h in header if (t := "_".join(filter(None, re.split(r"\W+", h.strip().lower())))) in known]
