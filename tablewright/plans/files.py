"""Repair of files: CSV in, repaired CSV and a report out, and the way back."""

from __future__ import annotations

import json
import os
import shutil
from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, bundle, overlay
from ..sources import csv as source
from . import fixpoint

REASONS = {
    "dominant_type_violation": "no evidence says what the value should be",
    "unique_key_violation": "which of the rows is wrong isn't known",
    "foreign_key_violation": "no parent is named; add the reference row or a mapping",
    "range_violation": "a bound tells that a value is wrong, not what is right",
    "allowed_value_violation": "the value has no declared replacement",
    "unknown_unit": "declare the unit's factor",
    "row_width_mismatch": "cells are missing or too many; no unique alignment",
}


def repair_file(spark: SparkSession, path: str, output: str, report: str | None = None, config: fixpoint.Config = fixpoint.Config(), autoconfigure: bool = True, references: dict | None = None) -> dict:  # noqa: B008
    raw, header, dialect = source.read_raw(spark, path)
    digest_in = source.sha256(path)
    aligned = [r.asDict() for r in alignment.realigned(raw, len(header)).collect()] if not source.shape_issues(raw, header).isEmpty() else []
    wide = source.widen(raw, header)
    if aligned:
        rows = spark.createDataFrame([(r["_row"], r["new_cells"]) for r in aligned], "_row long, _cells array<string>")
        wide = source.widen(raw.join(rows.select("_row"), "_row", "left_anti").unionByName(rows), header)
        wide = alignment.affine_filled(wide, [(r["_row"], wide.columns[r["position"] + 1]) for r in aligned if r["operation"] == "insert_blank"])
    result = fixpoint.repair(wide, config, references, autoconfigure)
    edits = [r.asDict() for r in result.edits.orderBy("cycle", "_row", "column").collect()]
    names = [c for c in result.table.columns if c != "_row"]
    renamed = {i: new for code, i, _, new in source.header_issues(header) if code == "header_outer_whitespace" and new}
    new_header = [renamed.get(i, h) for i, h in enumerate(header)]
    out = {"input_sha256": digest_in, "format": dialect.contract(), "header": header, "new_header": new_header, "columns": names, "realigned": [{"row": r["_row"], "operation": r["operation"], "position": r["position"]} for r in aligned], "status": result.status, "score_before": list(result.score_before), "score_after": list(result.score_after), "cycles": result.cycles, "replay": result.replay, "undo": result.undo, "relations": result.relations, "edits": edits, "unrepaired": [{"code": r["code"], "count": r["count"], "reason": REASONS.get(r["code"], "evidence is too weak")} for r in result.issues.groupBy("code").count().orderBy("code").collect()], "config": {k: v for k, v in asdict(config).items() if k not in ("rules", "analyzers")}}
    if aligned:
        old = {r["_row"]: r["_cells"] for r in raw.where(raw["_row"].isin([r["_row"] for r in aligned])).collect()}
        out["ragged"] = [[k, v] for k, v in sorted(old.items())]
    if not config.dry_run:
        deleted = {e["_row"] for e in edits if e["kind"] == "delete_row"}
        if deleted:
            out["deleted"] = [[r["_row"], *[r[c] for c in names]] for r in wide.where(wide["_row"].isin(list(deleted))).collect()]
        out["output_sha256"] = source.write_exact(result.table, new_header, dialect, output)
    if report:
        with open(report, "w", encoding="utf-8") as f:
            json.dump(out, f, ensure_ascii=False, indent=1, default=str)
    return out


def undo_file(spark: SparkSession, repaired: str, report: str, output: str) -> str:
    """The file as it was before, from the repaired one and its report."""
    with open(report, encoding="utf-8") as f:
        return undo_told(spark, repaired, json.load(f), output)


def _steps(told: dict) -> list[int]:
    """Row numbers of the repaired file from which one more deleted row lies before."""
    gone = sorted(e["_row"] for e in told["edits"] if e["kind"] == "delete_row")
    return [r - i for i, r in enumerate(gone)]


def renumbered(wide: DataFrame, steps: list[int]) -> DataFrame:
    """Rows that moved up when others were deleted, with the numbers they had."""

    @F.pandas_udf("long")
    def before(row: pd.Series) -> pd.Series:
        return row + np.searchsorted(steps, row, side="right")

    return wide.withColumn("_row", before("_row"))


def undo_told(spark: SparkSession, repaired: str, told: dict, output: str) -> str:
    if source.sha256(repaired) != told["output_sha256"]:
        raise ValueError("the repaired file isn't the one of the report")
    wide, _, dialect = source.read_wide(spark, repaired)
    wide = wide.toDF("_row", *told["columns"])
    gone = _steps(told)
    if gone:
        wide = renumbered(wide, gone)
    for c in sorted({e["cycle"] for e in told["edits"]}, reverse=True):
        edits = spark.createDataFrame([(e["kind"], e["_row"], e["column"], e["old"], e["new"]) for e in told["edits"] if e["cycle"] == c], overlay.EDIT)
        wide = overlay.apply(wide, overlay.invert(edits))
    if gone:
        wide = wide.unionByName(spark.createDataFrame([tuple(r) for r in told["deleted"]], wide.schema))
    if told.get("ragged"):
        n = len(told["columns"])
        old = spark.createDataFrame([(k, *(v + [None] * n)[:n]) for k, v in told["ragged"] if len(v) <= n], wide.schema)
        if any(len(v) > n for _, v in told["ragged"]):
            raise ValueError("rows with surplus cells can't be taken back by columns")
        wide = wide.join(old.select("_row"), "_row", "left_anti").unionByName(old)
    return source.write_exact(wide, told["header"], dialect, output)


def recover(folder: str) -> bool:
    """Takes back a commit that didn't end; whether there was one."""
    log, kept = os.path.join(folder, ".journal.json"), os.path.join(folder, ".before")
    if not os.path.exists(log):
        shutil.rmtree(kept, ignore_errors=True)
        return False
    with open(log, encoding="utf-8") as f:
        journal = json.load(f)
    for name, there in journal.items():
        target = os.path.join(folder, name)
        if there:
            shutil.copy2(os.path.join(kept, name), target)
        elif os.path.exists(target):
            os.remove(target)
    os.remove(log)
    shutil.rmtree(kept)
    return True


def commit(staging: str, folder: str) -> None:
    """All files of ``staging`` into ``folder``, or none: what stood there is kept, and a
    journal says so, until the last has moved; ``recover`` takes back a broken move."""
    recover(folder)
    names, kept, log = sorted(os.listdir(staging)), os.path.join(folder, ".before"), os.path.join(folder, ".journal.json")
    os.makedirs(kept)
    journal = {n: os.path.exists(os.path.join(folder, n)) for n in names}
    for n in names:
        if journal[n]:
            shutil.copy2(os.path.join(folder, n), os.path.join(kept, n))
    with open(f"{log}.part", "w", encoding="utf-8") as f:
        json.dump(journal, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{log}.part", log)
    try:
        for n in names:
            os.replace(os.path.join(staging, n), os.path.join(folder, n))
    except OSError:
        recover(folder)
        raise
    os.remove(log)
    shutil.rmtree(kept)
    os.rmdir(staging)


def _staging(folder: str) -> str:
    staging = os.path.join(folder, ".staging")
    shutil.rmtree(staging, ignore_errors=True)
    os.makedirs(staging)
    return staging


def repair_bundle(spark: SparkSession, manifest: str, output_dir: str, report: str | None = None) -> dict:
    """All tables of a manifest, or none: repaired apart, then by their parents, into a
    staging folder that is moved into place when everything holds and no input changed.

    Edits by a parent are edits of the child's report, in a cycle of their own."""
    with open(manifest, encoding="utf-8") as f:
        told = json.load(f)
    base = os.path.dirname(os.path.abspath(manifest))
    paths = {d["name"]: os.path.join(base, d["input"]) for d in told["datasets"]}
    outputs = {d["name"]: d.get("output", os.path.basename(d["input"])) for d in told["datasets"]}
    before = {n: source.sha256(p) for n, p in paths.items()}
    recover(output_dir)
    staging = _staging(output_dir)
    staged = {n: os.path.join(staging, o) for n, o in outputs.items()}
    parts = {}
    for d in told["datasets"]:
        rules = {}
        if d.get("rules"):
            with open(os.path.join(base, d["rules"]), encoding="utf-8") as f:
                rules = json.load(f)
        config = fixpoint.Config(**{**d.get("config", {}), "rules": rules})
        parts[d["name"]] = repair_file(spark, paths[d["name"]], staged[d["name"]], None, config)
    tables = {n: source.read_wide(spark, p) for n, p in staged.items()}
    found: dict[str, int] = {}
    for key in bundle.inclusions({n: t[0].drop("_row") for n, t in tables.items()}).collect():
        name = key["child"]
        child, header, dialect = tables[name]
        parent = tables[key["parent"]][0]
        proposals = None
        for c in set(child.columns) & set(parent.columns) - {"_row", key["child_column"]}:
            got = bundle.lookup_repairs(child, key["child_column"], parent, key["parent_column"], c)
            proposals = got if proposals is None else proposals.unionByName(got)
        if proposals is None:
            continue
        edits = [(r["_row"], r["column"], r["value"], r["expected"]) for r in proposals.collect()]
        if edits:
            part = parts[name]
            found[name] = found.get(name, 0) + len(edits)
            frame = spark.createDataFrame([("set_cell", *e) for e in edits], overlay.EDIT)
            steps, column, cycle = _steps(part), dict(zip(child.columns[1:], part["columns"], strict=True)), 1 + max((e["cycle"] for e in part["edits"]), default=0)
            part["edits"] += [{"kind": "set_cell", "_row": row + bisect_right(steps, row), "column": column[c], "old": old, "new": new, "analyzer": "bundle", "cycle": cycle} for row, c, old, new in sorted(edits, key=lambda e: e[:2])]
            part["output_sha256"] = source.write_exact(overlay.apply(child, frame), header, dialect, staged[name])
            tables[name] = source.read_wide(spark, staged[name])
    bad = [n for n, p in parts.items() if p["status"] == "REPLAY_FAILED"]
    if bad or any(source.sha256(p) != before[n] for n, p in paths.items()):
        shutil.rmtree(staging)
        raise RuntimeError(f"nothing was committed: {bad or 'an input changed meanwhile'}")
    commit(staging, output_dir)
    out = {"datasets": parts, "outputs": outputs, "cross_table_edits": found, "inputs": before}
    if report:
        with open(report, "w", encoding="utf-8") as f:
            json.dump(out, f, ensure_ascii=False, default=str)
    return out


def undo_bundle(spark: SparkSession, repaired_dir: str, report: str, output_dir: str) -> dict[str, bool]:
    """All tables of a bundle as they were, or none; by name whether the bytes are the same."""
    with open(report, encoding="utf-8") as f:
        told = json.load(f)
    os.makedirs(output_dir, exist_ok=True)
    recover(output_dir)
    staging = _staging(output_dir)
    try:
        same = {n: undo_told(spark, os.path.join(repaired_dir, o), told["datasets"][n], os.path.join(staging, o)) == told["inputs"][n] for n, o in told["outputs"].items()}
    except ValueError:
        shutil.rmtree(staging)
        raise
    commit(staging, output_dir)
    return same


def in_parallel(jobs: dict, workers: int = 4) -> dict:
    """Results of independent jobs by name, in the order of the names."""
    with ThreadPoolExecutor(workers) as pool:
        running = {k: pool.submit(f) for k, f in sorted(jobs.items())}
        return {k: f.result() for k, f in running.items()}
