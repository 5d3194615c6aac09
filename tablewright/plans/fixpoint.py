"""Repair to a fixpoint.

Each cycle analyzes a frozen table, takes the candidates that don't conflict, lays them
over the table in one join, and analyzes again.  The batch is kept only if the objective,
the weight of what could be repaired and then of all issues, falls; otherwise it's tried
family by family.  It ends when nothing more is accepted.  The driver sees counts and the
learnt relations; rows stay distributed, and each accepted table is written to the shared
folder, so that the plan doesn't grow with the cycles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import cut
from ..operators import declared, diagnostics, local, mapping, numeric, overlay, scoped, sequential, temporal
from .knowledge import validated

WEIGHT = {"error": 10, "warning": 3, "info": 1}


@dataclass(frozen=True)
class Config:
    max_cycles: int = 8
    trim: bool = True
    normalize_null_markers: bool = True
    contextual_nulls: bool = True
    normalize_booleans: bool = True
    remove_exact_duplicates: bool = False
    rules: dict = field(default_factory=dict)
    discover_mappings: bool = False
    determinant_columns: int = 1
    numeric: bool = False
    formula_terms: int = 2
    numeric_independent: int = 2
    numeric_max_columns: int | None = None
    temporal: bool = False
    scoped: bool = False
    sequential: bool = False
    locale: bool = False
    rank_one: bool = False
    min_rows: int = 12
    confidence: float = 0.95
    dry_run: bool = False
    analyzers: tuple[Callable[[DataFrame], DataFrame], ...] = ()


@dataclass
class Result:
    table: DataFrame
    edits: DataFrame
    issues: DataFrame
    status: str
    score_before: tuple[int, int]
    score_after: tuple[int, int]
    cycles: int
    relations: dict[str, list[dict]]
    replay: bool
    undo: bool


def auto(wide: DataFrame, rows: int, config: Config) -> Config:
    """Families that the shape of the table allows, by one look at its columns."""
    names = [c for c in wide.columns if c != "_row"]
    numbers = numeric.numeric_columns(wide, names, config.numeric_max_columns)
    wide_enough, long_enough = len(numbers) >= 3, rows >= config.min_rows
    return replace(config, numeric=config.numeric or (wide_enough and long_enough), discover_mappings=config.discover_mappings or (len(names) > len(numbers) and rows >= 2 * config.min_rows), sequential=config.sequential or (len(numbers) >= 2 and rows >= 16), temporal=config.temporal or (len(numbers) >= 1 and long_enough), scoped=config.scoped or (len(numbers) >= 2 and len(names) > len(numbers) and rows >= 2 * config.min_rows), locale=True, rank_one=config.rank_one or (wide_enough and long_enough))


def learn(wide: DataFrame, rows: int, config: Config) -> dict[str, list[dict]]:
    """Stable relations of each enabled family."""
    names = [c for c in wide.columns if c != "_row"]
    out: dict[str, list[dict]] = {}
    numbers = numeric.numeric_columns(wide, names, config.numeric_max_columns)
    texts = [c for c in names if c not in numbers]
    if config.numeric:
        out["numeric"] = [r for r in numeric.discover(wide, numbers, rows, config.formula_terms, config.min_rows, config.confidence, known=True) if r["stable"]]
    if config.sequential:
        out["sequential"] = sequential.discover(wide, numbers, rows)
    if config.temporal:
        times = time_columns(wide, texts)
        out["temporal"] = [r for r in temporal.discover(wide, times, numbers, rows, config.confidence, config.min_rows) if r["stable"]]
    if config.discover_mappings:
        out["mapping"] = [r for r in mapping.discover(wide, texts, rows, config.determinant_columns, confidence=config.confidence, min_rows=config.min_rows) if r["stable"]]
    if config.scoped:
        out["scoped"] = scoped.discover(wide, scoped.scope_columns(wide, texts, rows), numbers)
    return out


def time_columns(wide: DataFrame, columns: list[str]) -> list[str]:
    from ..functions import exprs as X

    if not columns:
        return []
    r = wide.agg(*[F.count_if(F.col(f"`{c}`").cast("string") != "").alias(f"n{i}") for i, c in enumerate(columns)], *[F.count(X.to_ts(F.col(f"`{c}`").cast("string"))).alias(f"t{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[f"t{i}"] >= 4 and r[f"t{i}"] >= 0.9 * r[f"n{i}"]]


def analyze(wide: DataFrame, relations: dict[str, list[dict]], config: Config, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """``analyzer, code, severity, _row, column, value, expected, repairable``."""
    parts: list[DataFrame] = []

    def add(df: DataFrame, analyzer: str, code: str | Column, severity: str | Column, repair: bool | str) -> None:
        has = df.columns
        code, severity = (x if isinstance(x, Column) else F.lit(x) for x in (code, severity))
        c = lambda n: F.col(n) if n in has else F.lit(None).cast("string").alias(n)
        parts.append(df.select(F.lit(analyzer).alias("analyzer"), code.alias("code"), severity.alias("severity"), "_row", c("column"), c("value"), c("expected"), (F.col(repair) if isinstance(repair, str) else F.lit(repair)).alias("repairable")))

    told_by = {"cell_outer_whitespace": ("whitespace", "warning", config.trim), "noncanonical_null_marker": ("null_markers", "info", config.normalize_null_markers), "mixed_boolean_spelling": ("boolean_format", "info", config.normalize_booleans), "dominant_type_violation": ("type_consistency", "warning", False)}
    pick = lambda i: F.coalesce(*[F.when(F.col("code") == k, F.lit(x[i])) for k, x in told_by.items()])
    parts.append(local.issues(wide, config.contextual_nulls).select(pick(0).alias("analyzer"), "code", pick(1).alias("severity"), "_row", "column", "value", "expected", (F.col("repairable") & pick(2)).alias("repairable")))
    add(local.exact_duplicates(wide), "duplicates", "exact_duplicate_row", "warning", config.remove_exact_duplicates)
    if config.rules:
        ruled = declared.issues(wide, declared.validate(config.rules), references)
        if ruled is not None:
            parts.append(ruled)
    if relations.get("numeric"):
        code = F.when(F.col("value") == "", "missing_numeric_value_reconstructible").otherwise("redundant_constraint_consensus")
        add(numeric.answers(wide, relations["numeric"], config.numeric_independent), "numeric", code, "error", True)
    for r in relations.get("mapping", []):
        add(mapping.violations(wide, r["determinants"], r["dependent"]), "mapping", "discovered_functional_dependency_violation", "warning", True)
        add(mapping.projections(wide, r["determinants"], r["dependent"]), "mapping", "missing_value_reconstructible_from_mapping", "warning", True)
    for r in relations.get("temporal", []):
        if r["exact"]:
            add(temporal.projections(wide, r), "temporal", "missing_temporal_value_reconstructible", "warning", True)
    for r in relations.get("sequential", []):
        add(sequential.two_sided(wide, r), "sequential", "two_sided_sequential_reconstruction", "error", True)
        if r["exact"]:
            add(sequential.projections(wide, r), "sequential", "missing_sequential_value_reconstructible", "error", True)
    for r in relations.get("scoped", []):
        add(scoped.projections(wide, r), "scoped", "missing_value_reconstructible_in_scope", "error", True)
    names = [c for c in wide.columns if c != "_row"]
    if config.locale:
        add(diagnostics.locale_repairs(wide, names), "locale", "locale_numeric_canonicalization", "info", True)
    if config.rank_one and len(numbers := numeric.numeric_columns(wide, names, config.numeric_max_columns)) >= 3:
        add(diagnostics.proportional_fills(wide, numbers), "rank_one", "rank1_missing_reconstruction", "error", True)
    for told in config.analyzers:
        own, name = told(wide), getattr(told, "__name__", type(told).__name__)
        rest = {"code": name, "severity": "warning", "repairable": False}
        add(own.withColumns({n: F.lit(x) for n, x in rest.items() if n not in own.columns}), name, F.col("code"), F.col("severity"), "repairable")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def objective(issues: DataFrame) -> tuple[int, int]:
    """Weight of the repairable issues, and of all."""
    w = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in WEIGHT.items()], F.lit(0))
    r = issues.agg(F.coalesce(F.sum(F.when(F.col("repairable"), w)), F.lit(0)), F.coalesce(F.sum(w), F.lit(0))).first()
    return int(r[0]), int(r[1])


def edits_of(issues: DataFrame) -> DataFrame:
    """Candidates without a conflict, as edits; each with the analyzer it came from."""
    cells = issues.where("repairable and column is not null and expected is not null")
    said = cells.groupBy("_row", "column", "value").agg(F.min("expected").alias("new"), F.countDistinct("expected").alias("n"), F.min("analyzer").alias("analyzer")).where("n = 1")
    sets = said.select(F.lit("set_cell").alias("kind"), "_row", "column", F.col("value").alias("old"), "new", "analyzer")
    gone = issues.where("repairable and code = 'exact_duplicate_row'").select(F.lit("delete_row").alias("kind"), "_row", F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), "analyzer").distinct()
    return sets.unionByName(gone)


SEARCH, TRIALS = 10, 56


def search(table: DataFrame, batch: DataFrame, score: tuple[int, int], rows: int, config: Config, references: dict[str, DataFrame] | None):  # noqa: ANN201
    """The best of single edits, of edits with what they lead to, and of pairs, where up to
    ``SEARCH`` edits are left.

    A step may pay only together with the next: a marker made blank can make two rows
    equal, of which one then goes."""
    few = batch.orderBy("kind", "_row", "column").limit(SEARCH + 1).collect()
    if len(few) > SEARCH:
        return None

    def tried(trial: DataFrame) -> tuple:
        after = overlay.apply(table, trial)
        learnt = learn(after, rows, config)
        found = analyze(after, learnt, config, references)
        return objective(found), trial, after, learnt, found

    one = lambda pick: table.sparkSession.createDataFrame([tuple(r) for r in pick], batch.schema)
    best = None
    for size in (1, 2):
        for pick in list(combinations(few, size))[:TRIALS]:
            got = tried(one(pick))
            if got[0] >= score and size == 1:
                then = edits_of(got[4]).join(got[1].select("_row", "column"), ["_row", "column"], "left_anti").select(batch.columns)
                got = min(got, tried(cut(got[1].unionByName(then))), key=lambda x: x[0])
            if got[0] < (best[0] if best else score):
                best = got
        if best:
            got, trial, after, learnt, found = best
            return trial, cut(after), learnt, cut(found), got
    return None


def repair(wide: DataFrame, config: Config = Config(), references: dict[str, DataFrame] | None = None, autoconfigure: bool = False, analyzers: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> Result:  # noqa: B008
    """``analyzers``: functions of the table that return ``_row, column, value, expected``
    and, if they like, ``code, severity, repairable``; what they say takes part in the loop
    as what the own families say does."""
    spark, config = wide.sparkSession, replace(validated(config), analyzers=(*config.analyzers, *analyzers))
    text = cut(wide.select("_row", *[F.col(f"`{c}`").cast("string").alias(c) for c in wide.columns if c != "_row"]))
    rows = (text.agg(F.max("_row")).first()[0] or 0) + 1
    if autoconfigure:
        config = auto(text, rows, config)
    table, log = text, spark.createDataFrame([], overlay.EDIT + ", analyzer string, cycle int")
    relations = learn(table, rows, config)
    issues = cut(analyze(table, relations, config, references))
    before = score = objective(issues)
    cycle, accepted = 0, False
    while cycle < config.max_cycles and not config.dry_run:
        cycle += 1
        batch = cut(edits_of(issues))
        held = batch.groupBy("analyzer").agg(F.count_if(F.col("kind") == "delete_row").alias("gone")).orderBy("analyzer").collect()
        names, deletes = [None, *[r["analyzer"] for r in held]] if held else [None], any(r["gone"] for r in held)
        accepted = False
        for family in names if names != [None] else []:
            trial = batch if family is None else batch.where(F.col("analyzer") == family)
            after = cut(overlay.apply(table, trial, deletes=deletes))
            found_relations = learn(after, rows, config)
            found = cut(analyze(after, found_relations, config, references))
            got = objective(found)
            if got < score:
                log = cut(log.unionByName(trial.withColumn("cycle", F.lit(cycle))))
                table, relations, issues, score, accepted = after, found_relations, found, got, True
                break
        if not accepted and names != [None]:
            found = search(table, batch, score, rows, config, references)
            if found is not None:
                trial, table, relations, issues, score = found
                log, accepted = cut(log.unionByName(trial.withColumn("cycle", F.lit(cycle)))), True
        if not accepted:
            break
    replayed, undone = text, table
    gone = {r["cycle"]: r["gone"] for r in log.groupBy("cycle").agg(F.count_if(F.col("kind") == "delete_row").alias("gone")).collect()}
    for c in sorted(gone):
        replayed = overlay.apply(replayed, log.where(F.col("cycle") == c).drop("cycle", "analyzer"), deletes=gone[c] > 0)
    for c in sorted(gone, reverse=True):
        undone = overlay.apply(undone, overlay.invert(log.where(F.col("cycle") == c)), deletes=False)
    if any(gone.values()):
        undone = undone.unionByName(text.join(log.where("kind = 'delete_row'").select("_row"), "_row", "left_semi"))
    replay, undo = overlay.digest(replayed) == overlay.digest(table), overlay.digest(undone) == overlay.digest(text)
    limited = accepted and cycle == config.max_cycles  # the next cycle might have found more
    if not (replay and undo):
        status = "REPLAY_FAILED"
    elif limited:
        status = "LIMIT_REACHED_WITH_REPORTED_ISSUES" if score[1] else "CLEAN_LIMIT_REACHED"
    elif score[0]:
        status = "OPEN_REPAIRABLE"
    elif score[1]:
        status = "STABLE_WITH_REPORTED_ISSUES"
    else:
        status = "PASS"
    return Result(table, log, issues, status, before, score, cycle, relations, replay, undo)
