"""Local and declared rules on small tables: what they find and what they leave."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.functions import exprs as X
from tablewright.functions.ordered import neighbours, running_sum, with_row
from tablewright.operators import declared, local, overlay


def wide(spark, header: str, *rows):
    names = header.split(",")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row long, " + ", ".join(f"`{n}` string" for n in names))


def cells(df):
    return {(r["_row"], r["column"], r["expected"]) for r in df.collect()}


def value(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_expressions(spark):
    assert value(spark, X.strip, "\t a \n", "  b", "c") == ["a", "b", "c"]
    assert value(spark, X.to_num, "1", "-2.5", "1e3", "1_000", "NaN", "Infinity", "1d", "", "−4", ".5", "x") == [1.0, -2.5, 1000.0, None, None, None, None, None, -4.0, 0.5, None]
    assert value(spark, lambda v: X.fmt_num(X.to_dec(v)), "100.500", "100", "-0.0", "1e2", "0.000001") == ["100.5", "100", "0", "100", "0.000001"]
    assert value(spark, X.value_type, "", " yes ", "12", "1.5", "2024-01-02", "2024/1/2", "2024-13-01", "abc", "1_0") == ["empty", "bool", "int", "float", "date", "date", "string", "string", "string"]
    assert value(spark, lambda v: X.locale_number(v, "us"), "1,234.5", "1,23", "1234", "12,345,678") == [1234.5, None, None, 12345678.0]
    assert value(spark, lambda v: X.locale_number(v, "eu"), "1.234,5", "1,5", "1.23") == [1234.5, 1.5, None]
    assert value(spark, X.canonical, "1.50", "1.5", " A  b", "a B", "2024-01-02") == ["#n:1.5", "#n:1.5", "#s:a b", "#s:a b", "#t:2024-01-02T00:00:00"]
    assert value(spark, X.acronym, "United Nations", "One") == ["un", None]


@pytest.mark.parametrize("kind", list(X.EQUATIONS))
def test_solve_inverts_evaluate(spark, kind):
    n = 3 if kind in ("sum3", "sum_minus", "product_plus", "product_minus") else 2
    s = [F.lit(float(x)) for x in (6, 3, 4)[:n]]
    y = X.evaluate(kind, s)
    got = spark.range(1).select(*[X.solve(kind, s, y, i).alias(f"s{i}") for i in range(n)]).first()
    assert list(got) == pytest.approx([6, 3, 4][:n])


def test_row_order(spark):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("k"), (F.col("id") % 7).alias("x")).repartition(7)
    t = with_row(df, "k")
    assert [r["k"] for r in t.orderBy("_row").collect()] == list(range(1, 1001))
    n = neighbours(t, {"p": lambda w: F.lag("k").over(w), "n": lambda w: F.lead("k").over(w)}, back=1, ahead=1, size=64).collect()
    assert len(n) == 1000 and all(r["p"] == (r["k"] - 1 or None) and r["n"] == (r["k"] + 1 if r["k"] < 1000 else None) for r in n)
    s = {r["k"]: r["s"] for r in running_sum(t, F.col("k"), "s", size=64).collect()}
    assert all(s[k] == k * (k + 1) // 2 for k in s)


def test_local_rules(spark):
    t = wide(spark, "name,flag,note", (" a", "YES", "x"), ("b", "no", "NA"), ("c", "true", ""), ("d\t", "f", "y"), ("e", "true", "z"), ("e", "true", "z"))
    assert cells(local.outer_whitespace(t)) == {(0, "name", "a"), (3, "name", "d")}
    assert cells(local.boolean_spelling(t)) == {(0, "flag", "true"), (1, "flag", "false"), (3, "flag", "false")}
    assert {(r["_row"], r["repairable"]) for r in local.null_markers(t).collect()} == {(1, True)}
    assert [tuple(r) for r in local.exact_duplicates(t).collect()] == [(5, 4)]
    crowded = wide(spark, "v", ("NA",), ("NA",), ("NA",), ("a",), ("b",), ("c",), ("",))
    assert not any(r["repairable"] for r in local.null_markers(crowded).collect())
    typed = wide(spark, "n", *[(str(i),) for i in range(8)], ("1.5",), ("oops",), ("",))
    assert {(r["_row"], r["type"], r["dominant"]) for r in local.dominant_type(typed).collect()} == {(9, "string", "number")}
    assert local.dominant_type(wide(spark, "n", ("1",), ("a",), ("b",), ("2",))).count() == 0


def test_declared_rules(spark):
    t = wide(spark, "k,city,qty,price,total,len", ("1", "Paris", "2", "3", "6", "5 cm"), ("1", "Paris", "2", "3", "7", "5 m"), ("1", "Pairs", "2", "x", "7", "3 feet"), ("2", "Rome", "1", "1", "", ""), ("2", "Oslo", "0", "9", "0", "10mm"))
    assert cells(declared.dependency(t, ["k"], "city")) == {(2, "city", "Paris")}
    assert declared.dependency(t, ["k"], "city", min_support=4).count() == 0
    assert cells(declared.formula(t, "total", "product", ["qty", "price"])) == {(1, "total", "6")}
    assert {(r["_row"], r["code"], r["expected"]) for r in declared.units(t, "len", "m", {"mm": 0.001, "m": 1, "cm": 0.01}).collect()} == {(0, "noncanonical_unit", "0.05 m"), (2, "unknown_unit", None), (4, "noncanonical_unit", "0.01 m")}
    assert {r["_row"] for r in declared.unique_key(t, ["k"]).collect()} == {1, 2, 4}
    assert {r["_row"] for r in declared.orphans(t, "city", wide(spark, "c", ("Paris",), ("Rome",)), "c").collect()} == {2, 4}
    assert {r["_row"] for r in declared.allowed(t, "city", ["Paris", "Rome"]).collect()} == {2, 4}
    assert {r["_row"] for r in declared.in_range(t, "total", 1, 6).collect()} == {1, 2, 4}
    assert declared.missing_columns(["k"], {"unique": [{"columns": ["k", "z"]}]}) == [("unique", "z")]
    for bad in ([], {"what": []}, {"unique": {}}, {"ranges": [{}]}, {"row_formulas": [{"target": "a", "operation": "power", "sources": ["b"]}]}):
        with pytest.raises(ValueError):
            declared.validate(bad)


def test_overlay_and_back(spark):
    t = wide(spark, "a,b", ("1", "x"), ("2", None), ("3", "z"))
    edits = spark.createDataFrame([("set_cell", 0, "a", "1", "9"), ("set_cell", 1, "b", None, "y"), ("set_cell", 2, "a", "stale", "0"), ("delete_row", 2, None, None, None)], overlay.EDIT)
    after = overlay.apply(t, edits)
    assert sorted(tuple(r) for r in after.collect()) == [(0, "9", "x"), (1, "2", "y")]
    back = overlay.restore(after, edits, t.where("_row = 2"))
    assert overlay.digest(back) == overlay.digest(t)
    got = overlay.truth(t, after, t).first()
    assert got["false_mutations"] == 4 and not got["exact"]


def test_truth_of_rows_that_another_side_lacks(spark):
    make = lambda *rows: spark.createDataFrame(rows, "_row long, a string")
    dirty, clean = make((0, "x"), (1, "y"), (2, "z")), make((0, "x"), (1, "Y"), (3, "w"))
    got = overlay.truth(dirty, make((0, "x"), (1, "Y"), (3, "w")), clean).first()
    assert tuple(got)[:5] == (3, 3, 3, 0, 0) and got["exact"]
    assert tuple(overlay.truth(dirty, dirty, make((0, "x"), (1, "y"))).first())[:5] == (1, 0, 0, 0, 1)


def test_runs_over_the_ends_of_buckets(spark):
    from tablewright.operators import structural

    rows = [*range(3, 8), 11, 12, 13, *range(15, 18), 20, 4, *range(40, 4200), 5000, 5001]
    t = spark.createDataFrame([("a", r) for r in rows] + [("b", 6), ("b", 7), ("b", 8)] + [(None, 1)], "column string, _row long")
    got = structural.common_runs(t, size=4)
    assert {tuple(r) for r in got.select("column", "start", "length").collect()} == {("a", 3, 5), ("a", 11, 3), ("a", 15, 3), ("a", 40, 4160), ("b", 6, 3)}


def test_bootstrap_weights():
    import numpy as np

    from tablewright.operators import regimes

    w = np.array(list(regimes.poisson_weights(np.arange(40_000), 5, 731)))
    assert w.shape == (5, 40_000) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert np.abs(np.corrcoef(w) - np.eye(5)).max() < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert (np.array(list(regimes.poisson_weights(np.array([7, 39_999]), 5, 731))) == w[:, [7, 39_999]]).all()
