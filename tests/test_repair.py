"""The repair loop on tables whose defects are known; and what it must leave alone."""

from __future__ import annotations

import csv
import json
import random

import pytest

from tablewright.operators import numeric, scoped, sequential, structural, temporal
from tablewright.plans import files, fixpoint
from tablewright.sources import csv as source
from tablewright.streaming import local as stream


def wide(spark, header: str, rows):
    names = header.split(",")
    return spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(rows)], "_row long, " + ", ".join(f"`{n}` string" for n in names))


def cells(df):
    return {(r["_row"], r["column"], r["expected"]) for r in df.collect()}


def ledger(n: int = 60):
    return [(i, 1 + i % 7, 2 + i % 5, (1 + i % 7) * (2 + i % 5), 3 + i % 3, (1 + i % 7) * (2 + i % 5) + 3 + i % 3) for i in range(n)]


def put(rows, *changes):
    rows = [list(r) for r in rows]
    for r, c, v in changes:
        rows[r][c] = v
    return rows


HEADER = "id,q,p,sub,fee,total"


def test_two_witnesses_repair_and_one_abstains(spark):
    t = wide(spark, HEADER, put(ledger(), (7, 3, 99), (20, 3, ""), (31, 4, "")))
    got = fixpoint.repair(t, fixpoint.Config(numeric=True))
    clean = {(i, *map(str, r)) for i, r in enumerate(ledger())}
    assert {tuple(r) for r in got.table.collect()} == clean
    assert got.replay and got.undo and got.status == "PASS" and got.score_after < got.score_before
    one = wide(spark, "a,b,c", put([(i, 3 * i % 11, i + 3 * i % 11) for i in range(60)], (9, 2, 500)))
    alone = fixpoint.repair(one, fixpoint.Config(numeric=True))
    assert alone.edits.count() == 0


@pytest.mark.parametrize(("share", "found"), [(0.2, True), (0.4, False)])
def test_how_much_corruption_is_borne(spark, share, found):
    r = random.Random(1)
    bad = [(i, 3, 1000 + i) for i in sorted(r.sample(range(100), int(share * 100)))]
    t = wide(spark, HEADER, put(ledger(100), *bad))
    got = numeric.consensus(t, [x for x in numeric.discover(t, HEADER.split(",")[1:], 100) if x["stable"]])
    assert cells(got) == ({(i, "sub", str(ledger(100)[i][3])) for i, _, _ in bad} if found else set())


def test_batched_statistics_agree(spark):
    t = wide(spark, HEADER, put(ledger(), (7, 3, 99)))
    relations = numeric.candidates(["q", "p", "sub", "fee", "total"], 3)
    a = {tuple(r) for r in numeric.relation_stats(t, relations[:12], 60, batches=False).collect()}
    b = {tuple(r) for r in numeric.relation_stats(t, relations[:12], 60, batches=True).collect()}
    assert a == b and len(relations) == 5 * (6 * 6 + 4 * 10)


def test_time_balance_and_scope(spark):
    rows = [(f"2024-01-02T{8 + i // 60:02d}:{i % 60:02d}:00", 5 + i % 9, f"2024-01-02T{8 + (i + 5 + i % 9) // 60:02d}:{(i + 5 + i % 9) % 60:02d}:00") for i in range(40)]
    t = wide(spark, "start,took,end", put(rows, (3, 2, ""), (9, 1, ""), (15, 0, "")))
    one = next(r for r in temporal.discover(t, ["start", "end"], ["took"], 40) if r["stable"] and r["start"] == "start")
    assert one["unit"] == "minutes"
    assert cells(temporal.projections(t, one)) == {(3, "end", rows[3][2]), (9, "took", str(rows[9][1])), (15, "start", rows[15][0])}
    b, rows = 100, []
    for i in range(40):
        b += i % 7 - i % 3
        rows.append((b, i % 7, i % 3))
    t = wide(spark, "b,i,o", put(rows, (12, 0, 999)))
    one = next(r for r in sequential.discover(t, ["b", "i", "o"], 40) if r["balance"] == "b" and r["inflow"] == "i")
    assert one["outflow"] == "o" and cells(sequential.two_sided(t, one)) == {(12, "b", str(rows[12][0]))}
    r = random.Random(3)
    noise = wide(spark, "a,b,c", [[r.randint(0, 999) for _ in range(3)] for _ in range(40)])
    assert sequential.discover(noise, ["a", "b", "c"], 40) == []
    rows = [("A" if i % 2 else "B", i, i * (2 if i % 2 else 3)) for i in range(40)]
    t = wide(spark, "mode,x,y", [*put(rows, (11, 2, ""), (14, 2, "")), ("A", 999, "")])
    law = next(x for x in scoped.discover(t, ["mode"], ["x", "y"]) if x["target"] == "y")
    assert cells(scoped.projections(t, law)) == {(11, "y", "22"), (14, "y", "42")}  # 999 is out of range


def test_relation_that_evenly_spaced_rows_contradict(spark):
    rows = [(i, 3 + i % 7, 5 + i % 11, (3 + i % 7) * (5 + i % 11) + (1 if i % 10 == 0 else 0)) for i in range(4000)]
    t = spark.createDataFrame(rows, "_row long, a int, b int, c int")
    got = {(r["target"], r["kind"], tuple(r["sources"])): r for r in numeric.discover(t, ["a", "b", "c"], 4000)}
    one = got["c", "product", ("a", "b")]
    assert one["stable"] and one["eligible"] == 4000 and one["confidence"] == 0.9


def test_votes_of_whole_numbers_and_others(spark):
    rows = [("2", "3", "6"), ("2", "3", "7"), (" 2 ", "3", "6"), ("2.5", "2", "5"), ("2.5", "2", "6"), ("0", "3", ""), ("x", "3", "6"), ("2", "0", "0"), ("99999999999", "2", "5"), ("4", "", "8")]
    t = wide(spark, "a,b,c", rows)
    laws = [{"target": "c", "kind": "product", "sources": ["a", "b"]}, {"target": "a", "kind": "ratio", "sources": ["c", "b"]}]
    said = {(r["_row"], r["column"], r["expected"]) for r in numeric.votes(t, laws).collect()}
    assert said == {(1, "c", "6"), (1, "a", "2.333333"), (4, "c", "5"), (4, "a", "3"), (5, "c", "0"), (6, "a", None), (8, "c", "199999999998"), (8, "a", "2.5")} - {(6, "a", None)}
    assert [r["_row"] for r in t.where(~numeric._surely(laws[0])).orderBy("_row").collect()] == [1, 3, 4, 5, 6, 8, 9]


def test_loop_tells_cells_as_the_single_rules_do(spark):
    from tablewright.operators import local

    rows = [(str(i), "yes" if i % 2 else "True", f"w{i}", "1.5" if i == 3 else str(i)) for i in range(20)]
    t = wide(spark, "n,b,s,m", put(rows, (4, 0, " 4"), (5, 0, "n/a"), (6, 0, ""), (7, 2, "x "), (8, 3, "word"), (9, 3, "9\n"), (10, 0, "1_0")))
    said = {(r["code"], r["_row"], r["column"]) for r in fixpoint.analyze(t, {}, fixpoint.Config(normalize_booleans=False)).collect()}
    each = (("cell_outer_whitespace", local.outer_whitespace(t)), ("noncanonical_null_marker", local.null_markers(t)), ("mixed_boolean_spelling", local.boolean_spelling(t)), ("dominant_type_violation", local.dominant_type(t)))
    assert said == {(code, r["_row"], r["column"]) for code, found in each for r in found.collect()}


def test_wrong_balance_far_above_its_flows(spark):
    b, rows = 40_000_000, []
    for i in range(80):
        b += i % 7 - i % 3
        rows.append((b + (9 if i % 40 == 13 else 0), i % 7, i % 3))
    t = wide(spark, "b,i,o", rows)
    stats = {r["scope"]: (r["eligible"], r["matched"]) for r in sequential.relation_stats(t, [("b", "i", "o")], 80).collect()}
    assert stats["all"] == (79, 75) and stats["odd"] == (40, 38)
    assert cells(sequential.two_sided(t, {"balance": "b", "inflow": "i", "outflow": "o"})) == {(i, "b", str(rows[i][0] - 9)) for i in (13, 53)}


def test_balance_and_scope_beyond_the_sixth_number(spark):
    r = random.Random(8)
    rows, balance = [], 500
    for i in range(48):
        flow, x, g = r.randint(1, 90), r.randint(1, 900), "ab"[i % 2]
        balance += flow
        rows.append((i, g, *[str(r.randint(1, 10**6)) for _ in range(6)], str(flow), str(balance), str(x), str(3 * x + 1 if g == "a" else 5 * x + 2)))
    t = spark.createDataFrame(rows, "_row long, g string, " + ", ".join(f"n{k} string" for k in range(6)) + ", flow string, balance string, x string, y string")
    found = fixpoint.learn(t, 48, fixpoint.Config(sequential=True, scoped=True))
    assert {(f["balance"], f["inflow"], f["outflow"]) for f in found["sequential"]} == {("balance", "flow", None)}
    assert ("g", "x", "y") in {(f["scope"], f["source"], f["target"]) for f in found["scoped"]}
    assert not fixpoint.learn(t, 48, fixpoint.Config(sequential=True, numeric_max_columns=6))["sequential"]


def test_whole_loop_on_files(spark, tmp_path):
    rows = [["id", " name ", "flag", "code"]] + [[str(i), f"n{i}", "true" if i % 2 else "false", f"C{i}"] for i in range(30)]
    rows[4][1], rows[5][2], rows[6][2], rows[9][3], rows[10][3] = " n3 ", "no", "YES", "NA", ""
    for d, end, bom in ((",", "\n", False), (";", "\r\n", True), ("\t", "\n", True), ("|", "\r\n", False)):
        dirty, out, report, back = (str(tmp_path / x) for x in ("in.csv", "out.csv", "report.json", "back.csv"))
        with open(dirty, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
            csv.writer(f, delimiter=d, lineterminator=end).writerows(rows)
        told = files.repair_file(spark, dirty, out, report, autoconfigure=False)
        assert told["replay"] and told["undo"] and told["format"]["delimiter"] == d and told["format"]["bom"] == bom
        with open(out, encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
            text = f.read()
        assert end in text and " n3 " not in text and "NA" not in text and text.startswith(d.join(["id", "name", "flag", "code"]))
        files.undo_file(spark, out, report, back)
        assert open(dirty, "rb").read() == open(back, "rb").read()
        again = files.repair_file(spark, out, str(tmp_path / "twice.csv"), autoconfigure=False)
        assert again["edits"] == [] and again["output_sha256"] == told["output_sha256"]
    with open(report, encoding="utf-8") as f:
        assert json.load(f)["status"] == told["status"]


def test_reading_is_strict(spark, tmp_path):
    p = str(tmp_path / "x.csv")
    open(p, "wb").write(b"a,b\n1,\xff\n")
    with pytest.raises(ValueError, match="UTF-8"):
        source.probe(p)
    open(p, "w").write('a,b\n1,"x\ny"\n2,"q""q"\n3\n4,5,6\n')
    raw, header, _ = source.read_raw(spark, p)
    assert {r["_row"]: r["_cells"] for r in raw.collect()} == {0: ["1", "x\ny"], 1: ["2", 'q"q'], 2: ["3"], 3: ["4", "5", "6"]}
    assert {(r["_row"], r["actual"]) for r in source.shape_issues(raw, header).collect()} == {(2, 1), (3, 3)}
    open(p, "w").write('a,b\n1,"x\n')
    with pytest.raises(Exception, match="line|end of data"):
        source.read_raw(spark, p)[0].collect()
    assert source.header_issues([" a", "b", "b"]) == [("header_outer_whitespace", 0, " a", "a"), ("duplicate_column_name", 2, "b", None)]
    assert source.header_issues([]) == [("missing_header", 0, "", None)]
    with open(p, "w") as f:
        f.write("id,v\n" + "".join(f"{i},{i % 10}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        w, _, _ = source.read_wide(spark, p)
        assert all(r["_row"] == int(r["id"]) for r in w.collect()) and w.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bundle(spark, tmp_path):
    with open(tmp_path / "customers.csv", "w") as f:
        f.write("customer_id,country\n" + "".join(f"C{i},{'FR' if i % 2 else 'DE'}\n" for i in range(20)))
    with open(tmp_path / "orders.csv", "w") as f:
        f.write("order_id,customer_id,country\n" + "".join(f"O{i},C{i % 20},{'XX' if i in (7, 40) else 'FR' if i % 20 % 2 else 'DE'}\n" for i in range(100)))
    manifest = {"datasets": [{"input": f"{n}.csv", "name": n} for n in ("customers", "orders")]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    out = tmp_path / "out"
    out.mkdir()
    told = files.repair_bundle(spark, str(tmp_path / "m.json"), str(out))
    assert "XX" not in (out / "orders.csv").read_text() and (out / "customers.csv").read_text() == (tmp_path / "customers.csv").read_text()
    assert not (out / ".staging").exists() and set(told["datasets"]) == {"customers", "orders"}
    assert [(e["_row"], e["column"], e["old"]) for e in told["datasets"]["orders"]["edits"] if e["analyzer"] == "bundle"] == [(7, "country", "XX"), (40, "country", "XX")]


def test_bundle_is_undone(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,country\n" + "".join(f"C{i},{'FR' if i % 2 else 'DE'}\n" for i in range(20)))
    lines = [f"O{i},C{i % 20},{'XX' if i in (7, 40) else 'FR' if i % 20 % 2 else 'DE'}\n" for i in range(100)]
    (tmp_path / "orders.csv").write_text("order_id,customer_id,country\n" + "".join([*lines[:5], lines[3], *lines[5:]]))
    sets = [{"input": f"{n}.csv", "name": n, "config": {"remove_exact_duplicates": True}} for n in ("customers", "orders")]
    (tmp_path / "m.json").write_text(json.dumps({"datasets": sets}))
    out, back, report = tmp_path / "out", tmp_path / "back", str(tmp_path / "r.json")
    out.mkdir()
    told = files.repair_bundle(spark, str(tmp_path / "m.json"), str(out), report)
    assert told["cross_table_edits"] == {"orders": 2} and len((out / "orders.csv").read_text().splitlines()) == 101
    assert files.undo_bundle(spark, str(out), report, str(back)) == {"customers": True, "orders": True}
    (out / "orders.csv").write_text("changed\n")
    with pytest.raises(ValueError, match="report"):
        files.undo_bundle(spark, str(out), report, str(back))
    assert (back / "orders.csv").read_bytes() == (tmp_path / "orders.csv").read_bytes()


def test_broken_commit_is_taken_back(tmp_path, monkeypatch):
    staging = tmp_path / ".staging"
    staging.mkdir()
    (tmp_path / "a").write_text("old")
    for n in "abc":
        (staging / n).write_text("new")
    move, moved = files.os.replace, []

    def broken(src, to):
        if str(src).startswith(str(staging)):
            moved.append(to)
            if len(moved) == 3:
                raise OSError("disk")
        move(src, to)

    monkeypatch.setattr(files.os, "replace", broken)
    with pytest.raises(OSError, match="disk"):
        files.commit(str(staging), str(tmp_path))
    assert (tmp_path / "a").read_text() == "old" and not (tmp_path / "b").exists() and not files.recover(str(tmp_path))


def test_parts_keep_line_ends(spark, tmp_path):
    for end in ("\n", "\r\n"):
        p = str(tmp_path / "in.csv")
        with open(p, "w", newline="") as f:
            f.write(end.join(["a;b", "1;x", "2;y", ""]))
        w, _, dialect = source.read_wide(spark, p)
        source.write_parts(w.coalesce(1), dialect, str(tmp_path / "parts"))
        text = b"".join(x.read_bytes() for x in sorted((tmp_path / "parts").glob("*.csv")))
        assert text.count(end.encode()) == text.count(b"\n") and {b"1;x", b"2;y"} < set(text.split(end.encode()))


def test_all_numbers_bounds_limit_and_own_analyzers(spark):
    r = random.Random(4)
    t = wide(spark, ",".join(f"n{i}" for i in range(14)), [[*[r.randint(1, 10**6) for _ in range(11)], a := r.randint(1, 999), b := r.randint(1, 999), a + b] for _ in range(40)])
    assert any(x["target"] == "n13" and x["kind"] == "sum" for x in fixpoint.learn(t, 40, fixpoint.Config(numeric=True))["numeric"])
    with pytest.raises(ValueError, match="confidence"):
        fixpoint.repair(t, fixpoint.Config(confidence=0.2))
    small = wide(spark, "k,v", [(i, " x " if i == 3 else "bad" if i == 5 else "x") for i in range(8)])

    def no_bad(w):
        return w.where("v = 'bad'").selectExpr("_row", "'v' column", "v value", "'x' expected", "true repairable")

    got = fixpoint.repair(small, analyzers=[no_bad])
    assert {(e["_row"], e["analyzer"]) for e in got.edits.collect()} == {(3, "whitespace"), (5, "no_bad")} and got.status == "PASS"
    assert fixpoint.repair(small, fixpoint.Config(max_cycles=1), analyzers=[no_bad]).status == "CLEAN_LIMIT_REACHED"


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f" n{i} ", "YES" if i % 2 else "no", "N/A") for i in range(10)], "_row long, name string, flag string, note string")
    src, sink, state = (str(tmp_path / x) for x in ("src", "sink", "state"))
    df.write.parquet(src)
    flags = stream.boolean_columns(df, ["name", "flag", "note"])
    assert flags == ["flag"]
    stream.start(spark, src, df.schema.simpleString()[7:-1].replace(":", " "), sink, state, ["name", "flag", "note"], flags).awaitTermination()
    got, want = spark.read.parquet(sink), stream.repaired(df, ["name", "flag", "note"], flags)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    edits = stream.journal(df, ["name", "flag", "note"], flags)
    assert edits.count() == 30 and stream.digest(stream.undo(want, edits)) == stream.digest(df) != stream.digest(want)


def test_hitting_set():
    edges = [frozenset(x) for x in ({1, 2}, {2, 3}, {4})]
    assert structural.hitting_set(edges) == ([2, 4], True)
    assert structural.hitting_set([]) == ([], True)
    many = [frozenset({i, 100}) for i in range(50)]
    assert structural.hitting_set(many) == ([100], False)
