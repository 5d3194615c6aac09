"""``python -m tablewright.cli``: repair, undo, bundle and stream from the shell.

Exit codes: 0 for success, 1 for an error, 2 when an edit can't be replayed or undone.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import files, fixpoint, knowledge
from .sources import csv as source
from .streaming import local as stream


FLAGS = {"undo": "take a repair back by its report", "bundle": "input is a manifest of several tables", "stream": "the stateless repair only", "no-auto": "only what is asked for", "dry-run": "report without writing", "numeric": "", "mappings": "", "temporal": "", "scoped": "", "sequential": "", "remove-duplicates": ""}
TEXTS = {"output": "", "report": "", "rules": "declared rules, JSON", "export-rules": "where learnt relations go"}
NUMBERS = {"formula-terms": 2, "determinant-columns": 1, "confidence": 0.95, "max-cycles": 8}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tablewright", description="Find and repair inconsistencies in tables.")
    out.add_argument("input")
    for name, text in TEXTS.items():
        out.add_argument(f"--{name}", help=text)
    for name, text in FLAGS.items():
        out.add_argument(f"--{name}", action="store_true", help=text)
    for name, value in NUMBERS.items():
        out.add_argument(f"--{name}", type=type(value), default=value)
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tablewright").getOrCreate()
    try:
        if a.undo and a.bundle:
            print(json.dumps(files.undo_bundle(spark, a.input, a.report, a.output)))
            return 0
        if a.undo:
            print(files.undo_file(spark, a.input, a.report, a.output))
            return 0
        if a.bundle:
            told = files.repair_bundle(spark, a.input, a.output, a.report)
            print(json.dumps({n: d["status"] for n, d in told["datasets"].items()}))
            return 0
        if a.stream:
            wide, header, dialect = source.read_wide(spark, a.input)
            columns = [c for c in wide.columns if c != "_row"]
            print(source.write_exact(stream.repaired(wide, columns, stream.boolean_columns(wide, columns)), header, dialect, a.output))
            return 0
        rules = {}
        if a.rules:
            with open(a.rules, encoding="utf-8") as f:
                rules = json.load(f)
        config = knowledge.validated(fixpoint.Config(max_cycles=a.max_cycles, rules=rules, discover_mappings=a.mappings, determinant_columns=a.determinant_columns, numeric=a.numeric, formula_terms=a.formula_terms, temporal=a.temporal, scoped=a.scoped, sequential=a.sequential, remove_exact_duplicates=a.remove_duplicates, confidence=a.confidence, dry_run=a.dry_run))
        told = files.repair_file(spark, a.input, a.output, a.report, config, not a.no_auto)
        if a.export_rules:
            knowledge.export_rules(told["relations"], a.export_rules)
        print(json.dumps({k: told[k] for k in ("status", "score_before", "score_after", "cycles", "replay", "undo")}))
        return 0 if told["replay"] and told["undo"] else 2
    except (ValueError, OSError, RuntimeError) as e:
        sys.stderr.write(f"{e}\n")
    return 1


if __name__ == "__main__":
    sys.exit(main())
