"""Rules that look at one cell, with what its column is like.

They take the ``wide`` view, ``_row`` and text columns, and return issues: ``_row,
column, value, expected`` and, where a rule has more to say, further columns.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def long(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``_row, column, value`` of each cell that its row has."""
    names = columns or [c for c in wide.columns if c != "_row"]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])
    return wide.select("_row", F.inline(cells)).where("value is not null")


def outer_whitespace(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return long(wide, columns).withColumn("expected", X.strip(F.col("value"))).where("value <> expected")


def null_markers(wide: DataFrame, columns: list[str] | None = None, contextual: bool = True) -> DataFrame:
    """Markers, ``repairable`` where the column leaves blanks anyway, has three observed
    cells and no more markers than 2 or a fifth of those."""
    cells = long(wide, columns).withColumn("marker", X.is_marker(F.col("value"))).withColumn("blank", X.strip(F.col("value")) == "")
    found = cells.where("marker").select("_row", "column", "value", F.lit("").alias("expected"))
    if not contextual:
        return found.withColumn("repairable", F.lit(True))
    seen = cells.groupBy("column").agg(F.count_if("blank").alias("blanks"), F.count_if("marker").alias("markers"), F.count_if(~F.col("blank") & ~F.col("marker")).alias("observed"))
    ok = seen.select("column", ((F.col("blanks") >= 1) & (F.col("observed") >= 3) & (F.col("markers") <= F.greatest(F.lit(2), F.floor(F.col("observed") / 5)))).alias("repairable"))
    return found.join(F.broadcast(ok), "column").select("_row", "column", "value", "expected", "repairable")


def boolean_spelling(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Other spellings of ``true`` and ``false`` in columns of nine tenths boolean words."""
    cells = long(wide, columns).where("value <> ''").withColumn("expected", X.boolean_word(F.col("value")))
    ok = cells.groupBy("column").agg(F.count("*").alias("n"), F.count("expected").alias("words")).where("n >= 2 and words >= 0.9 * n").select("column")
    return cells.where("value <> expected").join(F.broadcast(ok), "column").select("_row", "column", "value", "expected")


def dominant_type(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cells of another type than four fifths of their column (of three or more)."""
    cells = long(wide, columns).withColumn("type", X.value_type(F.col("value"))).where("type <> 'empty'")
    n = lambda t: F.count_if(F.col("type") == t).alias(t)
    kinds = ("bool", "int", "float", "date", "string")
    counts = cells.groupBy("column").agg(F.count("*").alias("n"), *[n(k) for k in kinds])
    most = F.greatest(*kinds)
    name = F.when(F.col("int") + F.col("float") > most, "number")
    for k in kinds:
        name = name.when(F.col(k) == most, k)
    top = counts.select("column", "n", name.alias("dominant"), F.when(name == "number", F.col("int") + F.col("float")).otherwise(most).alias("most"))
    top = top.where("n >= 3 and most >= 0.8 * n").select("column", "dominant")
    fits = (F.col("type") == F.col("dominant")) | ((F.col("dominant") == "number") & F.col("type").isin("int", "float"))
    return cells.join(F.broadcast(top), "column").where(~fits).select("_row", "column", "value", "type", "dominant")


def issues(wide: DataFrame, contextual: bool = True) -> DataFrame:
    """``code, _row, column, value, expected, repairable`` of the four rules above, in two
    passes over the cells: one counts what each column holds, one tells what each cell is.

    A bare number is its own stripped form and neither word nor marker, so it's told by one
    match; rows of nothing but bare numbers where such belong aren't looked at again."""
    v = F.col("value")
    told = _told(long(wide))
    verdict = _verdict(told, contextual)
    columns = verdict.collect()
    verdict = wide.sparkSession.createDataFrame([tuple(r) for r in columns], verdict.schema)
    fine = []
    for r in columns:
        cell = F.col(f"`{r['column']}`").cast("string")
        bare = {"int": X.BARE_INTEGER, "number": X.BARE, None: X.BARE}.get(r["dominant"])
        fine.append(cell.isNull() | (cell == "") | cell.rlike(bare) if bare else F.lit(False))
    told = _told(long(wide.where(~reduce(and_, fine)) if fine else wide))
    fits = (F.col("type") == F.col("dominant")) | ((F.col("dominant") == "number") & F.col("type").isin("int", "float"))
    said = lambda code, when, expected, repair: F.when(when, F.struct(F.lit(code).alias("code"), expected.cast("string").alias("expected"), repair.alias("repairable")))
    each = F.array(
        said("cell_outer_whitespace", v != F.col("s"), F.col("s"), F.lit(True)),
        said("noncanonical_null_marker", F.col("marker"), F.lit(""), F.col("blankable")),
        said("mixed_boolean_spelling", F.col("boolean") & (v != "") & (v != F.col("word")), F.col("word"), F.lit(True)),
        said("dominant_type_violation", F.col("dominant").isNotNull() & (F.col("type") != "empty") & ~fits, F.lit(None), F.lit(False)),
    )
    found = told.join(F.broadcast(verdict), "column").select("_row", "column", "value", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("i"))
    return found.select("i.code", "_row", "column", "value", "i.expected", "i.repairable")


def _told(cells: DataFrame) -> DataFrame:
    v = F.col("value")
    bare = v.rlike(X.BARE)
    cells = cells.withColumn("s", F.when(bare, v).otherwise(X.strip(v))).withColumn("w", F.when(bare, "").otherwise(F.lower("s")))
    word = F.when(F.col("w").isin(*X.TRUE_WORDS), "true").when(F.col("w").isin(*X.FALSE_WORDS), "false")
    day = F.when(F.col("s").rlike(X.DATE), F.replace("s", F.lit("/"), F.lit("-")).try_cast("date"))
    kind = F.when(F.col("s") == "", "empty").when(F.col("word").isNotNull(), "bool").when(F.col("s").rlike(X.INTEGER), "int").when(F.col("s").rlike(X.NUMBER), "float").when(day.isNotNull(), "date").otherwise("string")
    return cells.withColumn("word", word).select("_row", "column", "value", "s", "word", F.col("w").isin(*X.NULL_MARKERS).alias("marker"), kind.alias("type"))


def _verdict(told: DataFrame, contextual: bool) -> DataFrame:
    v, kinds = F.col("value"), ("bool", "int", "float", "date", "string")
    n = told.groupBy("column").agg(F.count_if(F.col("s") == "").alias("blanks"), F.count_if("marker").alias("markers"), F.count_if((F.col("s") != "") & ~F.col("marker")).alias("observed"), F.count_if(v != "").alias("held"), F.count_if((v != "") & F.col("word").isNotNull()).alias("words"), F.count_if(F.col("type") != "empty").alias("typed"), *[F.count_if(F.col("type") == k).alias(k) for k in kinds])
    most = F.greatest(*kinds)
    name = F.when(F.col("int") + F.col("float") > most, "number")
    for k in kinds:
        name = name.when(F.col(k) == most, k)
    share = F.when(name == "number", F.col("int") + F.col("float")).otherwise(most)
    ok = (F.col("blanks") >= 1) & (F.col("observed") >= 3) & (F.col("markers") <= F.greatest(F.lit(2), F.floor(F.col("observed") / 5))) if contextual else F.lit(True)
    return n.select("column", ok.alias("blankable"), ((F.col("held") >= 2) & (F.col("words") >= 0.9 * F.col("held"))).alias("boolean"), F.when((F.col("typed") >= 3) & (share >= 0.8 * F.col("typed")), name).alias("dominant"))


def exact_duplicates(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``_row, first`` of each row that equals an earlier one.

    Rows meet by 128 bits of hash; least rows are counted in parts and joined back, so no
    task holds all copies of a row."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns or [c for c in wide.columns if c != "_row"]]
    keyed = wide.select("_row", F.xxhash64(*cells).alias("_a"), F.xxhash64(F.lit(1), *cells[::-1]).alias("_b"))
    met = keyed.groupBy("_a", "_b").agg(F.min("_row").alias("first"), F.count("*").alias("_n")).where("_n > 1")
    return keyed.join(met, ["_a", "_b"]).where("_row > first").select("_row", "first")


def duplicate_families(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``parent, members, forms``: rows that mean the same in all cells, least row first."""
    key = F.sha2(F.to_json(F.array(*[X.canonical(F.col(f"`{c}`")) for c in columns])), 256)
    raw = F.sha2(F.to_json(F.array(*[F.col(f"`{c}`") for c in columns])), 256)
    return wide.select("_row", key.alias("k"), raw.alias("r")).groupBy("k").agg(F.min("_row").alias("parent"), F.count("*").alias("members"), F.countDistinct("r").alias("forms")).where("members > 1").drop("k")


def canonical_cell(v: Column, boolean: bool) -> Column:
    """The stateless repair of a cell: trim, then blank for a marker, then boolean words."""
    s = X.strip(v)
    out = F.when(X.is_marker(s), "").otherwise(F.coalesce(X.boolean_word(s), s) if boolean else s)
    return out


def column_profile(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts of each cell type, distinct values, and numeric range of each column."""
    cells = long(wide, columns).withColumn("type", X.value_type(F.col("value"))).withColumn("x", X.to_num(F.col("value")))
    count = lambda t: F.count_if(F.col("type") == t).alias(f"n_{t}")
    return cells.groupBy("column").agg(F.count("*").alias("n"), *[count(t) for t in ("empty", "bool", "int", "float", "date", "string")], F.countDistinct("value").alias("n_distinct"), F.min("x").alias("low"), F.max("x").alias("high"))


def top_values(wide: DataFrame, columns: list[str] | None = None, k: int = 16) -> DataFrame:
    """The ``k`` most frequent values of each column; ties go to the lesser value."""
    counts = long(wide, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def missing_state(v: Column) -> Column:
    """One of six states of a cell."""
    w = X.folded(v)
    censored = X.strip(v).rlike(r"^(<=?|>=?)\s*[+-]?\d+(\.\d+)?$")
    return (F.when(w == "", "MISSING_KNOWN").when(w.isin("not applicable", "not_applicable"), "STRUCTURALLY_NOT_APPLICABLE").when(w.isin("absent", "none observed"), "ABSENT_CERTIFIED")
            .when(w.isin(*X.NULL_MARKERS, "unknown", "?"), "UNKNOWN").when(censored, "CENSORED").otherwise("OBSERVED"))


def censor_bounds(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``_row, column, value, lower, upper, closed`` of cells like ``<5`` or ``>=2.5``."""
    cells = long(wide, columns).where(missing_state(F.col("value")) == "CENSORED")
    bound = F.regexp_extract("value", r"([+-]?\d+(\.\d+)?)", 1).cast("double")
    below = F.trim("value").startswith("<")
    return cells.select("_row", "column", "value", F.when(~below, bound).alias("lower"), F.when(below, bound).alias("upper"), F.col("value").contains("=").alias("closed"))


def quantum(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Half of the last written digit's place, of each numeric cell."""
    cells = long(wide, columns).where(X.to_num(F.col("value")).isNotNull())
    digits = F.when(F.col("value").contains("."), F.length(F.regexp_extract("value", r"\.(\d*)", 1))).otherwise(0)
    return cells.select("_row", "column", "value", F.round(F.lit(0.5) * F.pow(F.lit(10.0), -digits), 9).alias("half_step"))


UNITS = {"mm": ("length", 0.001), "cm": ("length", 0.01), "m": ("length", 1.0), "km": ("length", 1000.0), "mg": ("mass", 1e-6), "g": ("mass", 0.001), "kg": ("mass", 1.0), "t": ("mass", 1000.0), "ms": ("time", 0.001), "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0), "day": ("time", 86400.0), "usd": ("currency", 1.0), "eur": ("currency", 1.0)}


def base_units(wide: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``_row, column, value, family, base``: numbers with a known unit, in its base unit."""
    cells = long(wide, columns).withColumn("unit", F.lower(F.regexp_extract("value", r"^\s*[+-]?\d+(?:\.\d+)?\s*([A-Za-z]+)\s*$", 1)))
    known = F.create_map(*[x for u, (f, s) in UNITS.items() for x in (F.lit(u), F.struct(F.lit(f).alias("family"), F.lit(s).alias("scale")))])
    number = F.regexp_extract("value", r"([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
    return cells.where(F.col("unit").isin(*UNITS)).withColumn("u", known[F.col("unit")]).select("_row", "column", "value", F.col("u.family").alias("family"), F.round(number * F.col("u.scale"), 9).alias("base"))
