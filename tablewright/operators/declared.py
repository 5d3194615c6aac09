"""Declared rules: keys, dependencies, formulas, units, references, values, ranges.

Each takes the ``wide`` view and returns issues with ``_row, column, value, expected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def unique_key(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``_row, first`` of each row whose key an earlier row has."""
    key = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")).alias(f"_k{i}") for i, c in enumerate(columns)]
    names = [f"_k{i}" for i in range(len(columns))]
    keyed = wide.select("_row", *[f"`{c}`" for c in columns], *key)
    met = keyed.groupBy(*names).agg(F.min("_row").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(met, names).where("_row > first").select("_row", *columns, "first")


def dependency(wide: DataFrame, determinants: list[str], dependent: str, min_support: int = 3, min_confidence: float = 0.66) -> DataFrame:
    """Cells that differ from their group's majority.

    A key is skipped when all its parts are blank, a dependent when it is; the winner
    must beat the runner-up, have ``min_confidence`` of the group and the group
    ``min_support`` rows.  Two group-bys; only (key, value) counts are joined back."""
    key = [text(d).alias(f"k{i}") for i, d in enumerate(determinants)]
    names = [f"k{i}" for i in range(len(determinants))]
    rows = wide.select("_row", *key, text(dependent).alias("value")).where(" or ".join(f"{k} <> ''" for k in names)).where("value <> ''")
    counts = rows.groupBy(*names, "value").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    best = counts.groupBy(*names).agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("expected"), F.max("n").alias("most"), F.sum("n").alias("support"), F.count("*").alias("values"))
    ties = counts.join(best.where((F.col("values") > 1) & (F.col("support") >= min_support) & (F.col("most") >= F.col("support") * min_confidence)), names)
    sure = ties.groupBy(*names, "expected", "support").agg(F.count_if(F.col("n") == F.col("most")).alias("top")).where("top = 1").drop("top")
    return rows.join(sure, names).where("value <> expected").select("_row", F.lit(dependent).alias("column"), "value", "expected", "support")


def formula(wide: DataFrame, target: str, kind: str, sources: list[str], tolerance: float = 0.01) -> DataFrame:
    """Rows whose target isn't what the equation gives; ``expected`` is that number."""
    value = X.evaluate(kind, [X.to_dec(text(s)) for s in sources])
    rows = wide.select("_row", F.lit(target).alias("column"), text(target).alias("value"), value.alias("want"))
    off = F.abs(X.to_dec(F.col("value")) - F.col("want")) > tolerance
    return rows.where(off).select("_row", "column", "value", X.fmt_num(F.col("want")).alias("expected"))


def units(wide: DataFrame, column: str, canonical: str, factors: dict[str, int | float], separator: str = " ") -> DataFrame:
    """``code, expected``: cells in another unit, converted, and those in an unknown one."""
    v = text(column)
    shape = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-zµ°]+)\s*$"
    rows = wide.select("_row", F.lit(column).alias("column"), v.alias("value"), F.regexp_extract(v, shape, 1).try_cast("decimal(18,6)").alias("x"), F.regexp_extract(v, shape, 2).alias("unit")).where("unit <> ''")
    table = F.create_map(*[x for u, f in factors.items() for x in (F.lit(u), F.lit(f).cast("decimal(18,6)"))])
    known = F.col("unit").isin(*factors)
    out = rows.where(F.col("unit") != canonical).withColumn("code", F.when(known, "noncanonical_unit").otherwise("unknown_unit"))
    return out.select("_row", "column", "value", "code", F.when(known, F.concat(X.fmt_num(F.col("x") * F.try_element_at(table, F.col("unit"))), F.lit(separator + canonical))).alias("expected"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Cells that the parent's column lacks; blanks are skipped.  Which side travels is
    the optimizer's choice, by the sizes it sees."""
    keys = parent.select(text(parent_column).alias("value")).distinct()
    rows = child.select("_row", F.lit(column).alias("column"), text(column).alias("value")).where("value <> ''")
    return rows.join(keys, "value", "left_anti").select("_row", "column", "value")


def allowed(wide: DataFrame, column: str, values: list[str]) -> DataFrame:
    return wide.select("_row", F.lit(column).alias("column"), text(column).alias("value")).where((F.col("value") != "") & ~F.col("value").isin(*values))


def in_range(wide: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Numeric cells outside inclusive bounds."""
    x = X.to_num(F.col("value"))
    bad = (x < low if low is not None else F.lit(False)) | (x > high if high is not None else F.lit(False))
    return wide.select("_row", F.lit(column).alias("column"), text(column).alias("value")).where(bad)


def missing_columns(header: list[str], rules: dict[str, list[dict]]) -> list[tuple[str, str]]:
    """``rule, column`` of each column that a rule names and the table lacks."""
    out = []
    for kind, each in rules.items():
        for rule in each:
            names = [*(rule.get("columns") or []), *(rule.get("determinants") or []), *(rule.get("sources") or []), *[rule[k] for k in ("column", "dependent", "target") if rule.get(k)]]
            out += [(kind, c) for c in names if c not in header]
    return out


def validate(rules: dict) -> dict[str, list[dict]]:
    """The rule sets by kind; raises ``ValueError`` on what can't be understood."""
    kinds = {"unique": ("columns",), "functional_dependencies": ("determinants", "dependent"), "row_formulas": ("target", "operation", "sources"), "units": ("column", "canonical", "factors"), "foreign_keys": ("column", "reference", "reference_column"), "allowed_values": ("column", "values"), "ranges": ("column",)}
    if not isinstance(rules, dict):
        raise ValueError("rules must be an object")
    out = {}
    for kind, each in rules.items():
        if kind == "version":
            continue
        if kind not in kinds:
            raise ValueError(f"unknown rules: {kind}")
        if not isinstance(each, list):
            raise ValueError(f"{kind} must be a list")
        for rule in each:
            lacks = [k for k in kinds[kind] if k not in rule]
            if lacks:
                raise ValueError(f"{kind}: {', '.join(lacks)} missing")
            if kind == "row_formulas" and rule["operation"] not in ("sum", "product", "difference", "ratio"):
                raise ValueError(f"row_formulas: unknown operation {rule['operation']}")
        out[kind] = each
    return out


def issues(wide: DataFrame, rules: dict[str, list[dict]], references: dict[str, DataFrame] | None = None) -> DataFrame:
    """Issues of all rules: ``analyzer, code, severity, _row, column, value, expected, repairable``."""
    parts = []

    def add(df: DataFrame, code: str | None, severity: str, repair: bool) -> None:
        has = df.columns
        parts.append(df.select(F.lit("rules").alias("analyzer"), F.lit(code).alias("code") if code else F.col("code"), F.lit(severity).alias("severity"), "_row", F.col("column") if "column" in has else F.lit(None).cast("string").alias("column"), F.col("value") if "value" in has else F.lit(None).cast("string").alias("value"), F.col("expected") if "expected" in has else F.lit(None).cast("string").alias("expected"), (F.lit(repair) & F.col("expected").isNotNull() if "expected" in has else F.lit(False)).alias("repairable")))

    for r in rules.get("unique", []):
        add(unique_key(wide, r["columns"]), "unique_key_violation", "error", False)
    for r in rules.get("functional_dependencies", []):
        add(dependency(wide, r["determinants"], r["dependent"], r.get("min_support", 3), r.get("min_confidence", 0.66)), "functional_dependency_violation", "error", r.get("repair", True))
    for r in rules.get("row_formulas", []):
        add(formula(wide, r["target"], r["operation"], r["sources"], r.get("tolerance", 0.01)), "row_formula_violation", "warning", r.get("repair", True))
    for r in rules.get("units", []):
        add(units(wide, r["column"], r["canonical"], r["factors"], r.get("separator", " ")), None, "info", r.get("repair", True))
    for r in rules.get("foreign_keys", []):
        parent = (references or {}).get(r["reference"])
        if parent is None:
            raise ValueError(f"reference_file_missing: {r['reference']}")
        if r["reference_column"] not in parent.columns:
            raise ValueError(f"reference_column_missing: {r['reference_column']}")
        add(orphans(wide, r["column"], parent, r["reference_column"]), "foreign_key_violation", "error", False)
    for r in rules.get("allowed_values", []):
        add(allowed(wide, r["column"], r["values"]), "allowed_value_violation", "warning", False)
    for r in rules.get("ranges", []):
        add(in_range(wide, r["column"], r.get("min"), r.get("max")), "range_violation", "warning", False)
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
