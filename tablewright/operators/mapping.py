"""Mappings that hold in the data: how well, how stably, and what they can fill in.

Statistics of several scopes (all rows, even, odd, first and second half) come from one
pass: a row goes to its three scopes, then counts by (scope, key, value) are folded.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ordered import cut

SCOPES = ("all", "even", "odd", "first", "second")
MIN_ROWS, CONFIDENCE, COVERAGE, TOLERANCE, NULL_RATE = 12, 0.95, 0.5, 0.05, 0.25


def scoped(wide: DataFrame, rows: int) -> Column:
    return F.explode(F.array(F.lit("all"), F.when(F.col("_row") % 2 == 0, "even").otherwise("odd"), F.when(F.col("_row") < rows // 2, "first").otherwise("second")))


def keyed(wide: DataFrame, determinants: list[str], dependent: str, normalize: bool = False) -> DataFrame:
    """``_row, k0.., value`` of rows with all determinants."""
    clean = X.folded if normalize else (lambda c: c)
    keys = [clean(F.col(f"`{c}`").cast("string")).alias(f"k{i}") for i, c in enumerate(determinants)]
    out = wide.select("_row", *keys, clean(F.col(f"`{dependent}`").cast("string")).alias("value")).where("value is not null")
    for i in range(len(determinants)):
        out = out.where(f"k{i} <> ''")
    return out


def relation_stats(wide: DataFrame, determinants: list[str], dependent: str, rows: int, normalize: bool = False) -> DataFrame:
    """``scope, eligible, considered, repeated_groups, confidence, coverage, null_rate``."""
    names = [f"k{i}" for i in range(len(determinants))]
    cells = keyed(wide, determinants, dependent, normalize)
    counts = cells.select(scoped(cells, rows).alias("scope"), *names, "value").groupBy("scope", *names, "value").agg(F.count("*").alias("n"))
    blank = F.col("value") == ""
    groups = counts.groupBy("scope", *names).agg(F.sum("n").alias("eligible"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(~blank, F.col("n"))), F.lit(0)).alias("observed"), F.coalesce(F.max(F.when(~blank, F.col("n"))), F.lit(0)).alias("most"))
    repeated = F.col("observed") >= 2
    total = lambda c: F.coalesce(F.sum(F.when(repeated, F.col(c))), F.lit(0))
    sums = groups.groupBy("scope").agg(F.sum("eligible").alias("eligible"), total("observed").alias("considered"), F.count_if(repeated).alias("repeated_groups"), total("most").alias("matched"), F.sum("nulls").alias("nulls"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return sums.select("scope", "eligible", "considered", "repeated_groups", ratio("matched", "considered").alias("confidence"), ratio("considered", "eligible").alias("coverage"), ratio("nulls", "eligible").alias("null_rate"))


def judge(stats: dict[str, dict], normalized: dict, confidence: float = CONFIDENCE, tolerance: float = TOLERANCE, min_rows: int = MIN_ROWS, coverage: float = COVERAGE) -> list[str]:
    """Reasons against a relation; none if it's stable."""
    none = {"considered": 0, "repeated_groups": 0, "confidence": 0.0, "coverage": 0.0, "null_rate": 0.0}
    raw = stats.get("all", none)
    parts = [stats[s] for s in SCOPES[1:] if s in stats and stats[s]["considered"] >= max(4, min_rows // 3) and stats[s]["repeated_groups"] >= 1]
    margin = 0.01 if not tolerance else sorted((0.005, tolerance / 2, 0.02))[1]
    probe = min(confidence + margin, 1 - 1e-6)
    out = []
    if not (raw["considered"] >= min_rows and raw["repeated_groups"] >= 2 and raw["confidence"] >= confidence and raw["coverage"] >= coverage):
        out.append("base_relation_not_strong_enough")
    if len(parts) < 2:
        out.append("insufficient_partition_evidence")
    elif any(p["confidence"] < confidence - tolerance for p in parts):
        out.append("row_scope_sensitive")
    if raw["confidence"] < probe:
        out.append("confidence_threshold_sensitive")
    if abs(raw["confidence"] - (normalized or none)["confidence"]) > max(0.01, tolerance):
        out.append("normalization_sensitive")
    if raw["null_rate"] > NULL_RATE:
        out.append("missing_value_scope_sensitive")
    return out


def stability(wide: DataFrame, determinants: list[str], dependent: str, rows: int, **config: float) -> tuple[dict[str, dict], list[str]]:
    """Statistics by scope and the reasons against the relation."""
    raw = {r["scope"]: r.asDict() for r in relation_stats(wide, determinants, dependent, rows).collect()}
    same = [r.asDict() for r in relation_stats(wide, determinants, dependent, rows, normalize=True).where("scope = 'all'").collect()]
    return raw, judge(raw, same[0] if same else {}, **config)


def pair_stats(wide: DataFrame, pairs: list[tuple[tuple[str, ...], str]], rows: int) -> tuple[dict[int, dict[str, dict]], dict[int, dict]]:
    """Statistics of many relations by index and scope, and normalised over all rows.

    One pass: each row goes to the key of each relation once, with counts of its quarter
    (even or odd, first or second half); all scopes are sums of quarters."""
    key = lambda det: F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in det]))
    there = lambda det, dep: F.col(f"`{dep}`").isNotNull() & ~F.greatest(*[F.coalesce(F.col(f"`{c}`").cast("string") == "", F.lit(True)) for c in (*det, *det)])
    each = F.array(*[F.when(there(det, dep), F.struct(F.lit(i).alias("i"), key(det).alias("k"), F.col(f"`{dep}`").cast("string").alias("v"))) for i, (det, dep) in enumerate(pairs)])
    quarter = (F.col("_row") % 2 * 2 + (F.col("_row") >= rows // 2).cast("int")).cast("int")
    spread = wide.select(quarter.alias("q"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("q", "x.*")
    counts = cut(spread.groupBy("i", "k", "v").agg(*[F.count_if(F.col("q") == q).alias(f"q{q}") for q in range(4)]))
    parts = {"all": (0, 1, 2, 3), "even": (0, 1), "odd": (2, 3), "first": (0, 2), "second": (1, 3)}
    blank = F.col("v") == ""

    def by_scope(counts: DataFrame, scopes: dict) -> dict[int, dict[str, dict]]:
        n = {s: sum((F.col(f"q{q}") for q in qs), F.lit(0)) for s, qs in scopes.items()}
        groups = counts.groupBy("i", "k").agg(*[x for s, c in n.items() for x in (F.sum(c).alias(f"e_{s}"), F.sum(F.when(blank, c).otherwise(0)).alias(f"b_{s}"), F.max(F.when(blank, 0).otherwise(c)).alias(f"m_{s}"))])
        seen = {s: F.col(f"e_{s}") - F.col(f"b_{s}") for s in n}
        total = lambda s, c: F.sum(F.when(seen[s] >= 2, c).otherwise(0))
        sums = groups.groupBy("i").agg(*[x for s in n for x in (F.sum(f"e_{s}").alias(f"e_{s}"), F.sum(f"b_{s}").alias(f"b_{s}"), total(s, seen[s]).alias(f"c_{s}"), total(s, F.col(f"m_{s}")).alias(f"m_{s}"), F.count_if(seen[s] >= 2).alias(f"g_{s}"))]).collect()
        ratio = lambda a, b: a / b if b else 0.0
        return {r["i"]: {s: {"scope": s, "eligible": r[f"e_{s}"], "considered": r[f"c_{s}"], "repeated_groups": r[f"g_{s}"], "confidence": ratio(r[f"m_{s}"], r[f"c_{s}"]), "coverage": ratio(r[f"c_{s}"], r[f"e_{s}"]), "null_rate": ratio(r[f"b_{s}"], r[f"e_{s}"])} for s in n if r[f"e_{s}"]} for r in sums}

    raw = by_scope(counts, parts)
    parsed = F.from_json("k", "array<string>")
    same = counts.groupBy("i", F.to_json(F.transform(parsed, X.folded)).alias("k"), X.folded(F.col("v")).alias("v")).agg(*[F.sum(f"q{q}").alias(f"q{q}") for q in range(4)])
    folded = {i: s.get("all", {}) for i, s in by_scope(same, {"all": (0, 1, 2, 3)}).items()}
    return raw, folded


def discover(wide: DataFrame, columns: list[str], rows: int, determinant_columns: int = 1, about: set[str] | None = None, **config: float) -> list[dict]:
    """All relations of up to so many determinants, with their verdicts, in one job.

    Determinants of which three quarters of the rows are distinct can't reach the coverage
    that a relation needs; an estimate of distinct counts leaves them out.
    ``about``: only relations with one of these columns."""
    sets = [det for size in range(1, determinant_columns + 1) for det in combinations(columns, size)]
    pairs = [(det, dep) for det in sets for dep in columns if dep not in det and (about is None or about & {*det, dep})]
    if not pairs:
        return []
    used = sorted({det for det, _ in pairs})
    d = wide.agg(*[F.approx_count_distinct(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in det]), 0.02).alias(f"d{i}") for i, det in enumerate(used)]).first()
    keys = {det for i, det in enumerate(used) if config.get("coverage", COVERAGE) >= 0.5 and d[f"d{i}"] > 0.85 * rows}
    left = [p for p in pairs if p[0] not in keys]
    raw, same = pair_stats(wide, left, rows) if left else ({}, {})
    at = {p: i for i, p in enumerate(left)}
    out = []
    for det, dep in pairs:
        i = at.get((det, dep))
        stats = raw.get(i, {})
        reasons = judge(stats, same.get(i, {}), **config)
        out.append({"determinants": list(det), "dependent": dep, "stable": not reasons, "reasons": reasons, **{k: v for k, v in stats.get("all", {}).items() if k != "scope"}})
    return out


def winners(wide: DataFrame, determinants: list[str], dependent: str) -> DataFrame:
    """``k0.., expected, support, group_confidence`` of groups of two or more."""
    names = [f"k{i}" for i in range(len(determinants))]
    counts = keyed(wide, determinants, dependent).where("value <> ''").groupBy(*names, "value").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    best = counts.groupBy(*names).agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("expected"), F.sum("n").alias("support"), (F.max("n") / F.sum("n")).alias("group_confidence"))
    return best.where("support >= 2")


def violations(wide: DataFrame, determinants: list[str], dependent: str, min_support: int = 3, confidence: float = CONFIDENCE) -> DataFrame:
    """Cells that differ from a sure group's winner."""
    names = [f"k{i}" for i in range(len(determinants))]
    sure = winners(wide, determinants, dependent).where((F.col("support") >= min_support) & (F.col("group_confidence") >= confidence))
    return keyed(wide, determinants, dependent).where("value <> ''").join(sure, names).where("value <> expected").select("_row", F.lit(dependent).alias("column"), "value", "expected", "support")


def projections(wide: DataFrame, determinants: list[str], dependent: str, min_support: int = 3, confidence: float = CONFIDENCE) -> DataFrame:
    """Blank cells with what a group of at least .98 says."""
    names = [f"k{i}" for i in range(len(determinants))]
    sure = winners(wide, determinants, dependent).where((F.col("support") >= min_support) & (F.col("group_confidence") >= max(confidence, 0.98)))
    return keyed(wide, determinants, dependent).where("value = ''").join(sure, names).select("_row", F.lit(dependent).alias("column"), "value", "expected", "support")


def answers(wide: DataFrame, determinants: list[str], dependent: str, min_support: int = 3, confidence: float = CONFIDENCE) -> DataFrame:
    """Both of the above, by one count of the groups."""
    names = [f"k{i}" for i in range(len(determinants))]
    sure = winners(wide, determinants, dependent).where((F.col("support") >= min_support) & (F.col("group_confidence") >= confidence))
    told = keyed(wide, determinants, dependent).join(sure, names).where("value <> expected")
    return told.where((F.col("value") != "") | (F.col("group_confidence") >= 0.98)).select("_row", F.lit(dependent).alias("column"), "value", "expected", "support")


def unique_keys(wide: DataFrame, columns: list[str], size: int = 1) -> DataFrame:
    """``columns, rows, distinct_rows, is_key`` of every set of up to ``size`` columns, in one pass."""
    sets = [c for n in range(1, size + 1) for c in combinations(columns, n)]
    aggs = [F.countDistinct(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in s]))).alias(f"d{i}") for i, s in enumerate(sets)]
    one = wide.agg(F.count("*").alias("rows"), *aggs)
    each = F.array(*[F.struct(F.lit(",".join(s)).alias("columns"), F.col(f"d{i}").alias("distinct_rows")) for i, s in enumerate(sets)])
    return one.select("rows", F.inline(each)).select("columns", "rows", "distinct_rows", (F.col("rows") == F.col("distinct_rows")).alias("is_key"))
