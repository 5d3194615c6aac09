"""What the driver keeps beside the tables: small dictionaries, never rows."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import time
from collections.abc import Iterable

import pyspark
from pyspark.sql import SparkSession

BOUNDS = {"max_cycles": (1, None), "min_rows": (4, None), "confidence": (0.5, 1.0), "determinant_columns": (1, 2), "formula_terms": (2, 3), "numeric_independent": (2, None)}


def validated(config):  # noqa: ANN001, ANN201
    """The configuration itself, or ``ValueError`` for a value out of its bounds."""
    for name, (low, high) in BOUNDS.items():
        v = getattr(config, name)
        if v < low or (high is not None and v > high):
            raise ValueError(f"{name} must be {'at least ' + str(low) if high is None else f'{low} to {high}'}")
    return config


PARTS = {"balance", "dependent", "determinants", "duration", "end", "inflow", "kind", "outflow", "scope", "source", "sources", "start", "target", "unit"}


def identity(family: str, relation: dict) -> str:
    """A short id of a relation by what it says, not by how well it holds."""
    what = {k: relation[k] for k in sorted(PARTS) if k in relation}
    text = json.dumps([family, what], default=str, sort_keys=True)
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


class Knowledge:
    """How each relation fared from cycle to cycle; it orders candidates, no more."""

    def __init__(self) -> None:
        self.relations: dict[str, dict] = {}
        self.timeline: list[dict] = []

    def observe(self, relations: dict[str, list[dict]], cycle: int, edits: int) -> None:
        now = {identity(f, r): (f, r) for f, rs in relations.items() for r in rs}
        moves: dict[str, int] = {}
        for key, (family, r) in now.items():
            stable, confidence = bool(r.get("stable", True)), float(r.get("confidence", 1.0))
            old = self.relations.get(key)
            if old is None:
                how = "revealed_after_repair" if edits else "initial_discovery"
                old = self.relations[key] = {"family": family, "first": cycle, "certified": None, "revealed": bool(edits), "strengthened": False, "seen": []}
            else:
                last = old["seen"][-1]
                up, down = confidence > last["confidence"] + 1e-12, confidence < last["confidence"] - 1e-12
                if stable and not last["stable"]:
                    how = "certified_after_repair" if edits else "certified_on_recheck"
                elif edits and (up or down):
                    how = "strengthened_after_repair" if up else "weakened_after_repair"
                else:
                    how = "revalidated_certified" if stable else "rediscovered_weak"
                old["strengthened"] |= bool(edits and up)
            if stable and old["certified"] is None:
                old["certified"] = cycle
            old["status"] = "certified" if stable else "weak"
            old["seen"].append({"cycle": cycle, "stable": stable, "confidence": confidence, "how": how})
            moves[how] = moves.get(how, 0) + 1
        for key, old in self.relations.items():
            if key not in now:
                old["status"] = "historical_certified" if old["certified"] is not None else "historical_weak"
                old["seen"].append({"cycle": cycle, "stable": False, "confidence": 0.0, "how": "not_observed_after_repair" if edits else "not_observed_on_recheck"})
        self.timeline.append({"cycle": cycle, "edits": edits, "observed": len(now), "moves": moves})

    def priority(self, key: str | None) -> int:
        """0 to 3, the best first; 4 for what isn't known."""
        r = self.relations.get(key or "")
        if r is None:
            return 4
        return {"certified": 0 if r["strengthened"] or r["revealed"] else 1, "weak": 2}.get(r["status"], 3)


def snapshot(paths: Iterable[str]) -> dict[str, dict]:
    out = {}
    for p in paths:
        with open(p, "rb") as f:
            out[p] = {"sha256": hashlib.file_digest(f, "sha256").hexdigest(), "bytes": os.path.getsize(p)}
    return out


def changed(before: dict[str, dict]) -> list[str]:
    """Files that are gone or other than in the snapshot."""
    return sorted(p for p, x in before.items() if not os.path.exists(p) or snapshot([p])[p] != x)


def export_rules(relations: dict[str, list[dict]], path: str) -> str:
    """Stable relations as a rules file; its hash, which the file holds too."""
    body = {"relations": {f: [r for r in rs if r.get("stable", True)] for f, rs in sorted(relations.items())}}
    text = json.dumps(body, sort_keys=True, default=str)
    digest = hashlib.sha256(text.encode()).hexdigest()
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body | {"sha256": digest}, f, default=str)
    return digest


def checkpoint(state: dict, path: str) -> None:
    text = json.dumps(state, sort_keys=True, default=str)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump({"state": text, "sha256": hashlib.sha256(text.encode()).hexdigest()}, f)
    os.replace(f"{path}.part", path)


def load_checkpoint(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    if hashlib.sha256(told["state"].encode()).hexdigest() != told["sha256"]:
        raise ValueError(f"{path} was changed")
    return json.loads(told["state"])


def touched(relations: dict[str, list[dict]], columns: Iterable[str]) -> dict[str, list[dict]]:
    """The relations that must be measured again after edits of these columns."""
    columns = set(columns)
    names = lambda r: {x for v in r.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)}
    return {f: [r for r in rs if names(r) & columns] for f, rs in relations.items()}


def graph(relations: dict[str, list[dict]]) -> dict[str, list]:
    """Columns, and relations as rows of a sparse matrix over them."""
    ids, rows = [], []
    columns = sorted({x for rs in relations.values() for r in rs for k in PARTS - {"kind", "unit", "sources", "determinants"} if (x := r.get(k))} | {c for rs in relations.values() for r in rs for k in ("sources", "determinants") for c in r.get(k, [])})
    at = {c: i for i, c in enumerate(columns)}
    for f, rs in sorted(relations.items()):
        for r in rs:
            ids.append(identity(f, r))
            rows.append(sorted({at[x] for v in r.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and x in at}))
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r))
    return {"columns": columns, "relations": ids, "starts": starts, "members": [c for r in rows for c in r]}


def reachable(known: set[str], equations: list[tuple[str, list[str]]]) -> set[str]:
    """Columns that follow from the known ones through ``(target, sources)``."""
    out = set(known)
    while new := {t for t, s in equations if t not in out and set(s) <= out}:
        out |= new
    return out


def sources_metadata(paths: Iterable[str], now: float | None = None) -> list[dict]:
    """Size and age of each source; the clock is an argument."""
    now = time.time() if now is None else now
    return [{"path": p, "bytes": os.path.getsize(p), "age_s": round(now - os.path.getmtime(p), 3)} for p in paths]


def shards(rows: int, n: int) -> list[tuple[int, int]]:
    """Half-open row ranges of sizes that differ by one at most."""
    cut = [rows * i // n for i in range(n + 1)]
    return [(a, b) for a, b in zip(cut, cut[1:]) if b > a]


def platform_report(spark: SparkSession) -> dict:
    conf = spark.conf
    return {"spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "master": spark.sparkContext.master, "adaptive": conf.get("spark.sql.adaptive.enabled"), "codegen": conf.get("spark.sql.codegen.wholeStage"), "shuffle_partitions": conf.get("spark.sql.shuffle.partitions")}
