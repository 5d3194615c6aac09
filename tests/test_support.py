"""Alignment, bundles, knowledge, command line."""

from __future__ import annotations

import json

import pytest

from tablewright import cli
from tablewright.operators import alignment, bundle, structural
from tablewright.plans import fixpoint, knowledge


def test_realignment(spark):
    rows = [(i, [str(i), f"name{i}", str(10 + i), f"C{i}x"]) for i in range(20)]
    rows[7] = (7, ["7", "name7", "C7x"])
    rows[9] = (9, ["9", "", "name9", "19", "C9x"])
    rows[11] = (11, ["11"])
    raw = spark.createDataFrame(rows, "_row long, _cells array<string>")
    got = {r["_row"]: (r["operation"], r["position"], r["new_cells"]) for r in alignment.realigned(raw, 4).collect()}
    assert got == {7: ("insert_blank", 2, ["7", "name7", "", "C7x"]), 9: ("remove_blank", 1, ["9", "name9", "19", "C9x"])}
    same = spark.createDataFrame([(i, ["a", "b"]) for i in range(5)] + [(5, ["a"])], "_row long, _cells array<string>")
    assert alignment.realigned(same, 2).count() == 0  # either place fits as well


def test_headers():
    assert alignment.canonical_header([" a b ", "x", "x", "", "Québec"]) == [(0, " a b ", "a_b"), (2, "x", "x__2"), (3, "", "column_4")]
    assert alignment.header_bridges(["cust_id", "Qty", "name"]) == [("cust_id", "customer_id"), ("Qty", "quantity")]


def test_fuzzy_parents(spark):
    top = spark.createDataFrame([("New York",), ("Boston",), ("Austin",), ("Austen",)], "city string")
    kids = spark.createDataFrame([("new-york",), ("Bostn",), ("Austxn",), ("Nowhere",)], "value string")
    assert {tuple(r) for r in bundle.fuzzy_parents(kids, top, "city").collect()} == {("new-york", "New York"), ("Bostn", "Boston")}


def test_lookup_abstains(spark):
    parent = spark.createDataFrame([(str(i), "FR") for i in range(10)] + [("1", "DE")], "k string, c string")
    child = spark.createDataFrame([(i, str(i % 10), "XX" if i == 3 else "FR") for i in range(40)], "_row long, k string, c string")
    assert bundle.lookup_repairs(child, "k", parent, "k", "c").count() == 0  # a repeated key
    assert [r["expected"] for r in bundle.lookup_repairs(child, "k", parent.where("c = 'FR'"), "k", "c").collect()] == ["FR"]
    assert bundle.lookup_repairs(child.limit(5), "k", parent.where("c = 'FR'"), "k", "c").count() == 0  # too few


def test_knowledge_and_config(tmp_path):
    k = knowledge.Knowledge()
    weak = {"target": "a", "kind": "sum", "sources": ["b", "c"], "confidence": 0.9, "stable": False}
    key = knowledge.identity("numeric", weak)
    k.observe({"numeric": [weak]}, 0, 0)
    assert k.priority(key) == 2
    k.observe({"numeric": [{**weak, "confidence": 1.0, "stable": True}]}, 1, 3)
    assert k.priority(key) == 0 and k.relations[key]["seen"][-1]["how"] == "certified_after_repair"
    k.observe({}, 2, 1)
    assert k.priority(key) == 3 and k.priority("none") == 4
    for bad in ({"max_cycles": 0}, {"confidence": 0.2}, {"formula_terms": 4}, {"determinant_columns": 3}):
        with pytest.raises(ValueError):
            knowledge.validated(fixpoint.Config(**bad))
    p = str(tmp_path / "c.json")
    knowledge.checkpoint({"a": 1}, p)
    assert knowledge.load_checkpoint(p) == {"a": 1}
    text = open(p).read().replace('\\"a\\": 1', '\\"a\\": 2')
    open(p, "w").write(text)
    with pytest.raises(ValueError):
        knowledge.load_checkpoint(p)
    before = knowledge.snapshot([p])
    assert knowledge.changed(before) == []
    open(p, "a").write(" ")
    assert knowledge.changed(before) == [p]
    g = knowledge.graph({"numeric": [weak]})
    assert g["columns"] == ["a", "b", "c"] and g["members"] == [0, 1, 2] and g["starts"] == [0, 3]
    assert knowledge.touched({"numeric": [weak]}, ["z"]) == {"numeric": []} and knowledge.touched({"numeric": [weak]}, ["b"]) == {"numeric": [weak]}
    assert knowledge.reachable({"a", "b"}, [("c", ["a", "b"]), ("d", ["c"]), ("e", ["x"])]) == {"a", "b", "c", "d"}
    assert knowledge.shards(10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert structural.selection_ledger({"numeric": 40}, {"numeric": 6}) == [{"family": "numeric", "tried": 40, "accepted": 6, "by_chance": 2.0}]


def test_two_steps_pay_together(spark):
    t = spark.createDataFrame([(0, "true", ""), (1, "yes", "NA"), (2, "false", "x"), (3, "false", "y"), (4, "true", "z")], "_row long, active string, note string")
    got = fixpoint.repair(t, fixpoint.Config(remove_exact_duplicates=True))
    assert sorted(tuple(r) for r in got.table.collect()) == [(0, "true", ""), (2, "false", "x"), (3, "false", "y"), (4, "true", "z")]
    assert got.replay and got.undo


def test_command_line(spark, tmp_path, capsys):
    src, out, report, back = (str(tmp_path / n) for n in ("a.csv", "b.csv", "r.json", "c.csv"))
    with open(src, "w") as f:
        f.write("id,name\n1, x\n2,y\n3,z\n")
    assert cli.main([src, "--output", out, "--report", report, "--no-auto"]) == 0
    assert open(out).read() == "id,name\n1,x\n2,y\n3,z\n" and json.loads(capsys.readouterr().out)["status"] == "PASS"
    assert cli.main([out, "--undo", "--report", report, "--output", back]) == 0 and open(back).read() == open(src).read()
    assert cli.main([src, "--stream", "--output", back]) == 0 and open(back).read() == open(out).read()
    assert cli.main([str(tmp_path / "none.csv"), "--output", out]) == 1
