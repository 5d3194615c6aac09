"""What several tables have to do with each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def value_sets(tables: dict[str, DataFrame]) -> DataFrame:
    """``file, column, value``, distinct: every column of every table in one frame."""
    parts = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "_row"]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
        parts.append(df.select(F.lit(name).alias("file"), F.inline(cells)).where("value is not null and value <> ''").distinct())
    return reduce(DataFrame.unionByName, parts)


def inclusions(tables: dict[str, DataFrame], least: float = 0.95) -> DataFrame:
    """``child, child_column, parent, parent_column, coverage`` of likely foreign keys.

    The parent's column must be unique; child and parent values meet by an equi-join."""
    sets = value_sets(tables)
    sizes = sets.groupBy("file", "column").agg(F.count("*").alias("n"))
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).withColumn("file", F.lit(n)) for n, df in tables.items()])
    unique = sizes.join(F.broadcast(rows), "file").where("n = rows").select(F.col("file").alias("parent"), F.col("column").alias("parent_column"))
    key = F.lower("column").rlike(r"(_id|key|^id|^code)$")
    child = sets.where(key).select(F.col("file").alias("child"), F.col("column").alias("child_column"), "value")
    parent = sets.select(F.col("file").alias("parent"), F.col("column").alias("parent_column"), "value").join(F.broadcast(unique), ["parent", "parent_column"])
    met = child.join(parent, "value").where("child <> parent").groupBy("child", "child_column", "parent", "parent_column").agg(F.count("*").alias("met"))
    out = met.join(F.broadcast(sizes.select(F.col("file").alias("child"), F.col("column").alias("child_column"), "n")), ["child", "child_column"])
    return out.select("child", "child_column", "parent", "parent_column", F.round(F.col("met") / F.col("n"), 6).alias("coverage")).where(F.col("coverage") >= least)


def overlaps(tables: dict[str, DataFrame], least: float = 0.8) -> DataFrame:
    """``a, a_column, b, b_column, shared`` of columns of two tables with common values."""
    sets = value_sets(tables)
    sizes = sets.groupBy("file", "column").agg(F.count("*").alias("n")).where("n >= 3")
    a = sets.select(F.col("file").alias("a"), F.col("column").alias("a_column"), "value")
    b = sets.select(F.col("file").alias("b"), F.col("column").alias("b_column"), "value")
    met = a.join(b, "value").where("a < b").groupBy("a", "a_column", "b", "b_column").agg(F.count("*").alias("met"))
    na = sizes.select(F.col("file").alias("a"), F.col("column").alias("a_column"), F.col("n").alias("na"))
    nb = sizes.select(F.col("file").alias("b"), F.col("column").alias("b_column"), F.col("n").alias("nb"))
    share = F.round(F.col("met") / F.least("na", "nb"), 6)
    same = X.canon_token(F.col("a_column")) == X.canon_token(F.col("b_column"))
    return met.join(F.broadcast(na), ["a", "a_column"]).join(F.broadcast(nb), ["b", "b_column"]).select("a", "a_column", "b", "b_column", share.alias("shared"), same.alias("_same")).where((F.col("shared") >= least) | (F.col("_same") & (F.col("shared") >= 0.5))).drop("_same")


def fuzzy_parents(orphans: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """``value, suggestion``: the one parent of the same token or, failing that, one edit away.

    Tokens meet by equi-joins only: an edit distance of one or less means that some
    deletion of a character, or none, makes both the same."""
    kid = orphans.select(F.col("value")).distinct().withColumn("t", X.canon_token(F.col("value")))
    top = parent.select(F.col(f"`{column}`").cast("string").alias("suggestion")).distinct().withColumn("t", X.canon_token(F.col("suggestion")))
    exact = kid.join(top, "t").groupBy("value").agg(F.min("suggestion").alias("suggestion"), F.count("*").alias("n"))

    def cuts(df: DataFrame) -> DataFrame:
        drop = F.transform(F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1))), lambda i: F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, F.length("t"))))
        return df.withColumn("cut", F.explode(F.array_distinct(F.concat(F.array("t"), drop))))

    rest = kid.join(exact.select("value"), "value", "left_anti")
    near = cuts(rest).withColumnRenamed("t", "t1").join(cuts(top).withColumnRenamed("t", "t2"), "cut").where(F.levenshtein("t1", "t2", 1) >= 0).select("value", "suggestion").distinct()
    one = near.groupBy("value").agg(F.min("suggestion").alias("suggestion"), F.count("*").alias("n"))
    return exact.unionByName(one).where("n = 1").select("value", "suggestion")


def lookup_repairs(child: DataFrame, key: str, parent: DataFrame, parent_key: str, attribute: str, parent_attribute: str | None = None, support: int = 8, agreement: float = 0.95) -> DataFrame:
    """``_row, column, value, expected``: an attribute that differs from its parent's, where
    almost all rows agree.  The parent's key must be unique, else nothing is proposed."""
    of = parent_attribute or attribute
    p = parent.select(F.col(f"`{parent_key}`").cast("string").alias("k"), F.col(f"`{of}`").cast("string").alias("expected")).groupBy("k").agg(F.min("expected").alias("expected"), F.count("*").alias("n"))
    c = child.select("_row", F.col(f"`{key}`").cast("string").alias("k"), F.lit(attribute).alias("column"), F.col(f"`{attribute}`").cast("string").alias("value"))
    both = c.join(p, "k").where("expected <> ''").withColumn("same", X.collapsed(F.col("value")) == X.collapsed(F.col("expected")))
    sure = both.agg(F.count("*").alias("rows"), F.avg(F.col("same").cast("int")).alias("rate"), F.max("n").alias("most")).where((F.col("rows") >= support) & (F.col("rate") >= agreement) & (F.col("most") == 1)).select(F.lit(True).alias("_ok"))
    return both.where("not same").crossJoin(F.broadcast(sure)).select("_row", "column", "value", "expected")


def blank_fills(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, column, expected`` of cells that are blank in ``a`` and not in ``b``; both keys unique."""
    one = lambda df: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), *[F.min(F.col(c).cast("string")).alias(c) for c in columns]).where("n = 1")
    left, right = one(a).alias("a"), one(b).alias("b")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("value"), F.col(f"b.{c}").alias("expected")) for c in columns])
    return left.join(right, "key").select("key", F.inline(cells)).where("value = '' and expected <> ''").select("key", "column", "expected")


def proposals_without_conflict(proposals: DataFrame) -> DataFrame:
    """Proposals ``file, _row, column, expected`` of cells that have only one."""
    return proposals.groupBy("file", "_row", "column").agg(F.min("expected").alias("expected"), F.countDistinct("expected").alias("n")).where("n = 1").drop("n")


def join_keys(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """``column, a_rows, matched, unique``: columns that both tables have, as keys one to one."""
    out = None
    for c in columns:
        one = a.groupBy(F.col(f"`{c}`").cast("string").alias("k")).agg(F.count("*").alias("n"))
        two = b.groupBy(F.col(f"`{c}`").cast("string").alias("k")).agg(F.count("*").alias("m"))
        r = one.join(two, "k", "left").agg(F.sum("n").alias("a_rows"), F.count("m").alias("matched"), ((F.max("n") == 1) & (F.coalesce(F.max("m"), F.lit(1)) == 1)).alias("unique"))
        r = r.select(F.lit(c).alias("column"), "a_rows", "matched", "unique")
        out = r if out is None else out.unionAll(r)
    return out


def schema_versions(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """``file, versions`` of the values of a version column, where a table has one."""
    parts = [df.select(F.lit(n).alias("file"), F.col(column).cast("string").alias("v")) for n, df in tables.items() if column in df.columns]
    return reduce(DataFrame.unionByName, parts).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("versions"))


def file_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``file, column, n, n_distinct, blanks`` over many tables at once."""
    parts = []
    for name, df in tables.items():
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns if c != "_row"])
        parts.append(df.select(F.lit(name).alias("file"), F.inline(cells)))
    return reduce(DataFrame.unionByName, parts).groupBy("file", "column").agg(F.count("v").alias("n"), F.countDistinct("v").alias("n_distinct"), F.count_if(F.col("v") == "").alias("blanks"))
