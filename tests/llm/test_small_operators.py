"""URL filter, chat formatting, licenses and packing."""

from __future__ import annotations

import random
import textwrap

import pytest

from tablewright.llm import chat, licenses, packing, queries, urls


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, small, duck, same, name):
    same(queries.QUERIES[name](spark, small), duck.execute(queries.SQL[name]).df())


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_url_boundaries_and_cases(spark):
    pages = [(1, "http://a.com/casino"), (2, "http://casinos.com/"), (3, "http://x.com/win-casino/win"), (4, None), (5, ""), (6, "http://spam-farm.org"), (7, "http://spamfarm.org"), (8, "http://XXX.com"), (8, "http://XXX.com"), (9, "http://bet.bet.bet/" + "a" * 100_000 + "/porn")]
    df = spark.createDataFrame([(*p, "x", 0) for p in pages], "page_id long, url string, html string, score long")
    got = {(r["page_id"], r["strict_hits"], r["soft_hits"], r["soft_distinct"], r["score"], r["rejected"]) for r in urls.url_filter(df).collect()}
    assert got == {(1, 0, 1, 1, 4, False), (2, 0, 0, 0, 0, False), (3, 0, 3, 2, 6, True), (4, 0, 0, 0, 0, False), (5, 0, 0, 0, 0, False), (6, 1, 0, 0, 10, True), (7, 0, 0, 0, 0, False), (8, 1, 0, 0, 10, True), (9, 1, 3, 1, 16, True)}
    assert urls.url_filter(df).count() == len(pages)
    assert urls.url_filter(df.limit(0)).count() == 0
    assert urls.url_filter(spark.createDataFrame([(None, "http://xxx.com")], "page_id long, url string")).collect()[0]["page_id"] is None


def test_chat_prefix_mask_and_cases(spark):
    turns = "array<struct<role:string,text:string>>"
    pairs = [
        (1, [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no"), ("user", "why"), ("assistant", "so")]),
        (2, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")]),
        (3, [("user", None), (None, "x")], [("system", "s")]),
        (4, [], [("user", "a")]),
        (5, None, [("user", "a")]),
        (6, [("user", "é" * 50_000)], [("user", "b")]),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pairs], f"pair_id long, chosen {turns}, rejected {turns}, prompt string")
    got = {r["pair_id"]: r for r in chat.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3, 6}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["prompt_turns"] == 1
    for r in got.values():
        for side in ("chosen", "rejected"):
            for span in filter(None, r[f"{side}_mask"].split(",")):
                a, b = map(int, span.split("-"))
                assert r[side][:a].endswith("<|assistant|>\n") and r[side][a:b].endswith("<|end|>\n")
    assert [got[1]["rejected"][int(a) : int(b)] for a, b in (s.split("-") for s in got[1]["rejected_mask"].split(","))] == ["no<|end|>\n", "so<|end|>\n"]
    assert got[2]["prompt_turns"] == 1 and got[2]["chosen"] == got[2]["rejected"]
    assert got[3]["chosen"] == "<|user|>\n<|end|>\n<|user|>\nx<|end|>\n" and got[3]["chosen_mask"] == ""
    convs = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", "z"), (2, 0, "user", "q"), (None, 0, "assistant", "a"), (3, None, "assistant", None)], "conv_id long, turn long, role string, text string")
    made = {r["pair_id"]: r for r in chat.preference_pairs(convs).collect()}
    assert set(made) == {1, 3} and len(made[1]["chosen"]) == 3 and made[3]["rejected"][-1]["text"] == ""
    assert chat.format_preferences(chat.preference_pairs(convs.limit(0))).count() == 0


def test_license_wording(spark):
    texts = {
        1: "Some prose.\nReleased under the MIT License.",
        2: "This work is licensed under the GNU General Public License, version 2.",
        3: "This work is licensed under the GNU General Public License, version 9.",
        4: "no cue here",
        5: None,
        6: "",
        7: ("word " * 40_000) + "\nLicensed under CC BY-SA 4.0. " + ("word " * 40_000),
        8: "Licensed under CC BY-NC 4.0.\n" + "pad\n" * 5 + "All rights reserved.",
        9: "Please renew your driving license at the office.",
    }
    df = spark.createDataFrame([(k, t, "x", True) for k, t in texts.items()] + [(None, texts[1], "x", True)], "doc_id long, text string, license string, confirmed boolean")
    out = licenses.license_scan(df).collect()
    got = {(r["doc_id"], r["license"], r["confirmed"]) for r in out}
    assert {(1, "MIT", True), (None, "MIT", True), (2, "GPL-2.0", True), (7, "CC-BY-SA-4.0", True), (8, "CC-BY-NC-4.0", True), (8, "Proprietary", True)} <= got
    assert not any(c for d, _, c in got if d in (3, 9)) and not {4, 5, 6} & {d for d, _, _ in got}
    assert all(texts[r["doc_id"] or 1][r["start"] :][:3].strip() for r in out)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_every_license_template_confirms_itself(spark):
    texts, want = [], {}
    for name, t in licenses.TEMPLATES.items():
        for mark in ("", "# ", " * "):
            for form in (mark + t, *[textwrap.fill(t, w, initial_indent=mark, subsequent_indent=mark) for w in (40, 57, 72, 80)]):
                want[len(texts)] = [name]
                texts.append(f"Some prose.\n{form}\nMore prose.")
    gpl = "This program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free Software\nFoundation, either version 3 of the License, or (at your option) any later\nversion.\n"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    for text, names in ((gpl, ["GPL-3.0/or-later"]), (gpl.replace("version 3", "version 4"), []), (mpl, ["MPL-2.0/notice"]), ("Licensed under the MIT License. Licensed under CC BY 4.0. All rights reserved.", ["MIT/licensed", "CC-BY-4.0/short", "Proprietary/reserved"])):
        want[len(texts)] = names
        texts.append(text)
    out = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "start").collect()
    assert {k: [r["template"] for r in out if r["doc_id"] == k and r["confirmed"]] for k in want} == want


def test_licenses_that_share_sentences(spark):
    """Each whole text, with numbered clauses and a holder of its own, is itself alone."""
    t = licenses.TEMPLATES
    own = lambda x: "Copyright (c) 2020 The Authors\n\n" + textwrap.fill(x, 76)
    numbered = t["BSD-3-Clause/text"].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither").replace("copyright holder nor", "University nor")
    texts = {1: own(t["BSD-2-Clause/text"]), 2: own(numbered), 3: own(t["ISC/text"]), 4: own(t["0BSD/text"]), 5: own(t["MIT/text"]), 6: own(t["MIT-0/text"]), 7: own(t["Zlib/text"]), 8: "Redistribution and use in source and binary forms, with or without modification, are permitted.", 9: "# SPDX-License-Identifier: GPL-3.0-or-later\nimport x", 10: "Licensed under the MIT License.\nLicensed under CC BY 4.0.", 11: own(t["MIT/text"]) * 40}
    out = licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {k: [x["license"] for x in out if x["doc_id"] == k and x["confirmed"]] for k in texts}
    want = {1: ["BSD-2-Clause"], 2: ["BSD-3-Clause"], 3: ["ISC"], 4: ["0BSD"], 5: ["MIT"], 6: ["MIT-0"], 7: ["Zlib"], 8: [], 9: ["GPL-3.0-or-later"], 10: ["MIT", "CC-BY-4.0"], 11: ["MIT"] * 40}
    assert {k: [x for x in v if x != "Proprietary"] for k, v in got.items()} == want


def test_licenses_against_every_run():
    """All runs of words up to a template's length and a tenth, without screens."""
    scanner = licenses.Scanner({k: licenses.TEMPLATES[k] for k in ("Unlicense/notice", "MPL-2.0/notice", "CC-BY-4.0/short", "CC-BY-NC-4.0/short")})
    r = random.Random(3)
    for _ in range(12):
        name = r.choice(sorted(scanner.words))
        words = licenses.TEMPLATES[name].split()
        if r.random() < 0.6:
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice(([], [words[at], "plain"], ["plain"]))
        text = " ".join(["pad"] * r.randint(0, 3) + words + ["pad"] * r.randint(0, 3))
        spans = text.split()
        brute = {x[0] for i in range(len(spans)) for j in range(i + 3, len(spans) + 1) if (x := scanner.scan(" ".join(spans[i:j])))[-1]}
        assert {x[0] for _, x in scanner.candidates(text) if x[-1]} == brute, text


def by_hand(lengths: list[int], capacity: int):
    """Sum-of-squares placement by trying every bin."""
    gaps: list[int] = []
    order: list[int] = []  # since when a bin has its gap
    out, clock = [], 0
    cost = lambda g: sum(n * n for n in (g.count(x) for x in set(g) if x))
    for i, length in enumerate(lengths):
        at = 0
        while length - at >= capacity:
            out.append((i, at, capacity, len(gaps), 0))
            gaps.append(0), order.append(clock)
            at += capacity
        size = length - at
        if not size:
            continue
        best = None
        for b in [*range(len(gaps)), None]:
            if b is not None and (gaps[b] < size or gaps[b] == 0):
                continue
            after = list(gaps)
            if b is None:
                after.append(capacity - size)
            else:
                after[b] -= size
            key = (cost(after), b is None, 0 if b is None else gaps[b], 0 if b is None else order[b])
            if best is None or key < best[0]:
                best = (key, b)
        b = best[1]
        clock += 1
        if b is None:
            gaps.append(capacity), order.append(clock)
            b = len(gaps) - 1
        out.append((i, at, size, b, capacity - gaps[b]))
        gaps[b] -= size
        order[b] = clock
    return out


def test_packing_by_hand():
    r = random.Random(5)
    for capacity in (1, 7, 20):
        lengths = [r.randint(1, 3 * capacity) if r.random() < 0.1 else r.randint(1, capacity) for _ in range(150)]
        assert packing.pack(lengths, capacity) == by_hand(lengths, capacity)


def test_packing_cases(spark):
    docs = [(1, "a b c"), (2, None), (3, ""), (4, " \n "), (5, "w " * 5000), (6, "x"), (6, "x"), (None, "n n"), (2**53 + 1, "big id")]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, source string, size long")
    out = packing.best_fit(df, capacity=2048).collect()
    assert sum(r["size"] for r in out) == 3 + 5000 + 2 + 2 + 2
    assert {r["doc_id"] for r in out} == {1, 5, 6, None, 2**53 + 1}
    for r in out:
        assert 0 <= r["bin_start"] and r["bin_start"] + r["size"] <= 2048
    used: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in out:
        used.setdefault((r["shard"], r["bin"]), []).append((r["bin_start"], r["bin_start"] + r["size"]))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert packing.best_fit(df.limit(0)).count() == 0
    many = packing.best_fit(df, shard_items=2).collect()
    assert sum(r["size"] for r in many) == sum(r["size"] for r in out) and len({r["shard"] for r in many}) > 1


def test_packing_by_shards_against_the_packer(spark):
    """A shard is what the packer makes of its documents in order, whatever comes after, and
    an id that most rows have is split."""
    r = random.Random(13)
    docs = [(i, r.randint(1, 60)) for i in range(40)] + [(40, 7)] * 90 + [(None, 3)] * 11
    rows = lambda xs: spark.createDataFrame([(i, "w " * n) for i, n in xs], "doc_id long, text string")
    got: dict[int, list] = {}
    for x in packing.best_fit(rows(docs), capacity=64, shard_items=25).collect():
        got.setdefault(x["shard"], []).append((x["doc_id"], x["doc_start"], x["size"], x["bin"], x["bin_start"]))
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    for shard in range(-(-len(order) // 25)):
        part = order[shard * 25 : shard * 25 + 25]
        want = [(part[i][0], a, n, b, c) for i, a, n, b, c in packing.pack([n for _, n in part], 64)]
        assert sorted(got[shard], key=key) == sorted(want, key=key)
    more = packing.best_fit(rows(docs + [(1000 + i, 5) for i in range(60)]), capacity=64, shard_items=25).where("shard < 5").collect()
    assert sorted(map(tuple, more), key=repr) == sorted(((s, b, c, d, a, n) for s, xs in got.items() if s < 5 for d, a, n, b, c in xs), key=repr)
    named = packing.best_fit(rows(docs).selectExpr("'k' || doc_id AS doc_id", "text"), capacity=64).collect()
    assert sum(x["size"] for x in named) == sum(n for _, n in docs) and "k3" in {x["doc_id"] for x in named}


def test_ids_of_text(spark):
    df = spark.createDataFrame([("a17", "http://xxx.com", "Released under the MIT License."), ("a17", "http://xxx.com", "Released under the MIT License.")], "page_id string, url string, text string")
    assert [x["page_id"] for x in urls.url_filter(df).collect()] == ["a17", "a17"]
    assert [(x["doc_id"], x["confirmed"]) for x in licenses.license_scan(df, "page_id").collect()] == [("a17", True)] * 2
