"""Near duplicates, decontamination, likelihood, quality rules, PII, substrings, pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import decontaminate, lattice, minhash, pii, quality, substrings
from tablewright.llm.common import mix, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lo", "mi")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def documents(spark, texts: dict):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], SCHEMA)


def edited(r: random.Random, text: str, share: float) -> str:
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


# === near duplicates ===


def one_signature(elements: list[int], places: int) -> list[int]:
    """SuperMinHash of one set, an element at a time."""
    out = [(1 << 64) - 1] * places
    for e in elements:
        p = list(range(places))
        for j in range(places):
            v, k = minhash.draw(np.array([e], np.uint64), j, places)
            p[j], p[int(k[0])] = p[int(k[0])], p[j]
            out[p[j]] = min(out[p[j]], (j << 32) + int(v[0]))
    return out


def test_signature_is_superminhash():
    r = random.Random(1)
    sets = [[r.getrandbits(64) for _ in range(n)] for n in (1, 3, 40, 300)]
    at = np.cumsum([0] + [len(s) for s in sets])
    got = minhash.signatures(np.array(sum(sets, []), np.uint64), at, 32)
    assert got.tolist() == [one_signature(s, 32) for s in sets]


def shingles_of(text: str, n: int = 3) -> set:
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(2)
    texts = {}
    for i in range(60):
        base = prose(r, r.randint(30, 200))
        texts[i * 10] = base
        for k in range(r.randint(0, 3)):
            texts[i * 10 + 1 + k] = edited(r, base, r.choice([0.0, 0.02, 0.05, 0.3]))
    got = {(x["doc_id"], x["group_id"]) for x in minhash.near_duplicates(documents(spark, texts)).collect()}
    group = dict(got)
    sets = {k: shingles_of(t) for k, t in texts.items()}
    sim = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(texts), 2)}
    close = [p for p, j in sim.items() if j >= 0.6]
    assert sum(a in group and group.get(a) == group.get(b) for a, b in close) >= 0.9 * len(close) > 0
    for a in group:  # each member resembles another of its group
        assert any(group.get(b) == group[a] and sim[tuple(sorted((a, b)))] > 0.35 for b in group if b != a)
    df = documents(spark, texts)
    assert {(x["doc_id"], x["group_id"]) for x in minhash.near_duplicates(df, block=2).collect()} == got
    named = df.withColumn("doc_id", F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    assert {(int(x["doc_id"][1:]), int(x["group_id"][1:])) for x in minhash.near_duplicates(named).collect()} == got


def test_near_copies_over_many_blocks(spark):
    """A bucket of many blocks is one group, and a pair with one other text is found in it."""
    r = random.Random(21)
    base = prose(r, 200)
    texts = {i: edited(r, base, 0.01) for i in range(120)} | {500: prose(r, 60)}
    got = {(x["doc_id"], x["group_id"], x["group_size"]) for x in minhash.near_duplicates(documents(spark, texts), block=16).collect()}
    assert got == {(i, 0, 120) for i in range(120)}


def test_texts_of_one_id_join_their_groups(spark):
    r = random.Random(22)
    a, b = prose(r, 60), prose(r, 60)
    df = spark.createDataFrame([(5, a), (7, a), (7, b), (9, b)], "doc_id long, text string")
    assert {tuple(x) for x in minhash.near_duplicates(df).collect()} == {(5, 5, 3), (7, 5, 3), (9, 5, 3)}


def test_near_duplicate_cases(spark):
    same = "one two three four five six seven"
    rows = [(5, same, 1), (3, same, 1), (9, same.upper() + "!", 1), (None, same, 1), (1, None, 1), (2, "", 1), (4, "...", 1), (6, "hi", 1), (7, "hi", 1), (8, "word " * 60_000, 1), (10, "only once here at all", 1), (10, "only once here at all", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_id int")
    got = {tuple(r) for r in minhash.near_duplicates(df).collect()}
    assert got == {(3, 3, 3), (5, 3, 3), (9, 3, 3), (6, 6, 2), (7, 6, 2)}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# === decontamination ===


def least_edits(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_contaminated_against_dynamic_programming(spark):
    r = random.Random(3)
    items = {i: prose(r, r.randint(8, 25)) for i in range(12)} | {50: "Zi", 51: None, 52: "?!", 53: ""}
    texts = {}
    for i in range(60):
        t = prose(r, 60)
        if i % 2:
            leak = list(items[i % 12])
            for _ in range(r.randint(0, int(len(leak) * 0.12))):
                p = r.randrange(len(leak))
                leak[p : p + 1] = r.choice([[], [r.choice("abcdefg")], [leak[p], "x"]])
            t = prose(r, 20) + " " + "".join(leak) + " " + prose(r, 20)
        texts[i] = t
    texts |= {70: "zi!", 71: "zig", 72: None, 73: "", 74: prose(r, 20_000) + ". " + items[3].upper().replace(" ", ",  ") + "! " + prose(r, 100)}
    bench = spark.createDataFrame([(k, t, "en") for k, t in items.items()] + [(None, "x y z", "en")], "item_id long, text string, distance string")
    got = {tuple(x) for x in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    want = set()
    for d, t in texts.items():
        if d == 74:
            want.add((74, 3, 0))
            continue
        for i, item in items.items():
            n = decontaminate.normal(item or "")
            if n and t:
                e = least_edits(f" {n} ", f" {decontaminate.normal(t)} ")
                if e <= int(len(n) * decontaminate.RATE):
                    want.add((d, i, e))
    assert got == want and len(want) > 10 and (70, 50, 0) in got
    shards = {tuple(x) for x in decontaminate.contaminated(documents(spark, texts), bench, shard_chars=300).collect()}
    assert shards == got
    twice = documents(spark, texts).unionByName(documents(spark, {1: texts[3], None: texts[5]})).unionByName(documents(spark, texts))
    again = {tuple(x) for x in decontaminate.contaminated(twice, bench.unionByName(bench.where("item_id = 3").withColumn("item_id", F.lit(300).cast("long")))).collect()}
    least = {}
    for d, i, n in [*want, *[(1, i, n) for d, i, n in want if d == 3]]:
        least[d, i] = min(n, least.get((d, i), 99))
    assert again == {(d, i, n) for (d, i), n in least.items()} | {(d, 300, n) for (d, i), n in least.items() if i == 3}
    named = documents(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(int(d[1:]), i, n) for d, i, n in (tuple(x) for x in decontaminate.contaminated(named, bench).collect())} == want
    assert decontaminate.contaminated(documents(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.contaminated(documents(spark, texts), bench.limit(0)).count() == 0


# === likelihood ===


def test_lattice_sums_all_segmentations():
    pieces = {"▁": -2.0, "a": -1.5, "b": -2.5, "ab": -1.2, "▁a": -1.1, "ba": -3.0, "aba": -4.0, "▁ab": -2.2}
    lat = lattice.Lattice(pieces, [-9.0] * 256)

    def brute(s: str) -> float:
        if not s:
            return 1.0
        total = 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in pieces:
                total += math.exp(pieces[s[:n]]) * brute(s[n:])
        if s[0] not in pieces:
            total += math.exp(-9.0 * len(s[0].encode())) * brute(s[1:])
        return total

    words_ = ["", *("".join(p) for n in range(1, 7) for p in itertools.product("abé", repeat=n) if n < 4 or "é" not in p)]
    got = lat.scores(words_)
    for w in words_:
        assert got[w] == pytest.approx(math.log(brute("▁" + w)), abs=1e-9)


def test_likelihood_cases(spark):
    texts = {1: "the cat  sat\non the mat", 2: "the cat sat on the mat", 3: "", 4: None, 5: " \n", 6: "x" * 20_000, 7: "日本語 ☃"}
    df = documents(spark, texts).withColumn("log_prob", F.lit("clash")).unionByName(documents(spark, {None: "the cat"}).withColumn("log_prob", F.lit("clash")))
    got = {r["doc_id"]: r for r in lattice.likelihood(df).collect()}
    assert got[1]["log_prob"] == pytest.approx(got[2]["log_prob"]) and got[1]["chars"] == 22 and got[1]["words"] == 6
    assert got[3]["log_prob"] == 0.0 == got[5]["log_prob"] and got[3]["bits_per_char"] is None
    assert got[4]["log_prob"] is None and got[4]["words"] is None
    assert -1e6 < got[6]["log_prob"] < 0 and got[7]["log_prob"] < 0 and got[None]["words"] == 2
    plain = documents(spark, texts).select("text")
    counts = {r["word"]: r["n"] for r in lattice.word_counts(plain).collect()}
    assert counts["the"] == 4
    lat = lattice.lattice(lattice.piece_counts(lattice.word_counts(plain), lattice.MODEL), lattice.MODEL)
    assert sum(map(math.exp, lat.pieces.values())) + sum(map(math.exp, lat.bytes)) == pytest.approx(1)
    named = lattice.likelihood(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).unionByName(df.withColumn("doc_id", F.lit("d1")).where("text = 'the cat'"))).collect()
    assert {x["doc_id"] for x in named} == {None, *[f"d{k}" for k in texts]} and sum(x["doc_id"] == "d1" for x in named) == 2
    long = {n: "".join(random.Random(n).choices("abcdeé", k=n)) for n in (1, 30, 62, 63, 64, 65, 70, 300)}
    both = lat.scores(list(long.values()))
    assert all(both[w] == pytest.approx(lat.score(w), rel=1e-9) for w in long.values())
    assert got[2]["log_prob"] != 0 and lattice.likelihood(df.limit(0)).count() == 0


# === quality rules ===


def test_quality_by_hand(spark):
    r = random.Random(4)
    rows = []
    for i in range(200):
        lines = [prose(r, 12) for _ in range(3)]
        if i % 3 == 0:
            lines.insert(0, "  Accept   ALL cookies ")
        if i % 50 == 7:
            lines = ["accept all cookies"]
        rows.append((i, "\n".join(lines), "en", "host" if i % 4 else None, 0, "kept"))
    rows += [(300 + i, "A copied text.\nIt has\nthree lines.", "en", "host", 0, "kept") for i in range(50)]
    rows += [(400, None, "en", "host", 0, "kept"), (401, " \n\n", "en", "host", 0, "kept"), (402, "", "en", "x", 0, "kept"), (403, "long " * 100_000, "en", "x", 0, "kept"), (None, "no id", "en", "x", 0, "kept")]
    df = spark.createDataFrame(rows, SCHEMA + ", line string")
    got = {x["doc_id"]: x for x in quality.quality_rules(df).collect()}
    rejected = {i for i in range(200) if i % 50 == 7} | {400, 401, 402}
    assert set(got) == {x[0] for x in rows} - rejected  # copies don't condemn each other
    for i in range(200):
        if i in got:
            assert "cookies" not in got[i]["text"].lower() and got[i]["removed_lines"] == (1 if i % 3 == 0 else 0)
    assert got[300]["text"] == rows[210][1] and quality.quality_rules(df.limit(0)).count() == 0
    for most in (quality.BROADCAST_BYTES, -1):
        assert quality.judged(df, broadcast_bytes=most).select("row.*").columns == df.columns
    plain = lambda d: sorted((repr(tuple(x)) for x in d.collect()))
    assert plain(quality.judged(df, broadcast_bytes=-1)) == plain(quality.judged(df))
    assert quality.quality_rules(df.limit(0), broadcast_bytes=-1).count() == 0


# === PII ===


def test_gradients_are_right():
    w = {k: v.astype(np.float64) for k, v in pii.initial(3, 1).items()}
    ids, tags = pii.Samples(2).batch(2, 12)
    loss, g = pii.gradients(w, ids, tags)
    r = np.random.default_rng(0)
    for k in w:
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in w[k].shape)
            if k == "step" and not pii.ALLOWED[at]:
                continue
            keep = w[k][at]
            w[k][at] = keep + 1e-3
            up = pii.gradients(w, ids, tags)[0]
            w[k][at] = keep - 1e-3
            down = pii.gradients(w, ids, tags)[0]
            w[k][at] = keep
            assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-2, rel=5e-2)


def test_viterbi_against_all_paths():
    w = pii.initial(4, 3)
    ids, _ = pii.Samples(1).batch(1, 4)
    e, _ = pii.run(w, ids)
    step = w["step"] + pii._FORBIDDEN
    start = np.zeros(pii.TAGS)
    start[2::2] = -1e-3
    best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda p: start[p[0]] + sum(e[0, i, t] for i, t in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:])))
    assert tuple(pii.decode(w, ids)[0]) == best


def test_held_out_accuracy_and_skipped_windows():
    w, samples = pii.model(), pii.Samples(4242)
    texts, want = [], []
    for _ in range(300):
        t, spans = samples.window(pii.WINDOW * 3)
        texts.append(t)
        want.append({s for s in spans if s[0] > 0 and s[1] < len(t)})
    got = [set(x) for x in pii.find(texts, w)]
    hits = sum(len(a & b) for a, b in zip(got, want))
    assert hits >= 0.95 * sum(map(len, want)) and hits >= 0.95 * sum(len([s for s in g if s[0] > 0 and s[1] < len(t)]) for g, t in zip(got, texts))
    every = pii.find(texts, w, every=True)
    assert [set(x) for x in every] == got
    r = random.Random(6)
    quiet = [prose(r, 500) for _ in range(20)]
    assert not any(pii.find(quiet, w)) and not any(pii.find(quiet, w, every=True))


def test_secrets_of_letters(spark):
    """Without a digit: long ones are found by themselves, short ones by what announces them."""
    w, samples = pii.model(), pii.Samples(99)

    def found(low: int, high: int, before: str) -> float:
        texts, at = [], []
        for _ in range(200):
            lead, key = " ".join(samples.word() for _ in range(15)) + " " + before, samples.key(pii._LETTERS, low, high)
            texts.append(f"{lead}{key} {samples.word()}")
            at.append((len(lead), len(lead) + len(key)))
        return sum(any(a <= x and y <= b for a, b, _ in s) for s, (x, y) in zip(pii.find(texts, w), at)) / 200

    assert found(20, 44, "") >= 0.95 and found(8, 13, "password: ") >= 0.5


def test_reconcile_against_all_sets():
    """The set of the greatest weight among those without an overlap, by trying all."""
    r = random.Random(12)
    for _ in range(60):
        spans = {(a, a + r.randint(1, 12), r.randrange(3)) for a in (r.randrange(1, 40) for _ in range(r.randint(1, 7)))}
        found = [(0, 60, x) for x in spans]
        marked = np.array([r.random() < 0.5 for _ in range(60)])
        legal = [x for x in spans if marked[x[0] : x[1]].any()]
        best = max((len(s) for n in range(len(legal) + 1) for s in itertools.combinations(legal, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(s, 2))), default=0)
        got = pii.reconcile(found, marked)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:])) and set(got) <= set(legal) and len(got) == best


def test_personal_data_cases(spark):
    r = random.Random(7)
    mail, card = "kim.42@mail3.example.com", "4785380592391139"
    texts = {1: f"{prose(r, 30)} {mail} {prose(r, 3000)} {card}.", 2: prose(r, 50), 3: None, 4: "", 5: mail, 6: f'token = "{"0a1b2c3d" * 60}"', 7: "Version 2.0. of 2024"}
    df = documents(spark, texts).withColumn("spans", F.lit(1)).withColumn("row", F.lit(2))
    got = {x["doc_id"]: x for x in pii.personal_data(df).collect()}
    assert set(got) == {1, 5, 6}
    assert mail not in got[1]["text"] and card not in got[1]["text"] and got[5]["text"] == "<EMAIL>" and "0a1b2c3d" not in got[6]["text"]
    out = pii.masked(df)
    assert out.columns == df.columns and out.count() == df.count()
    after = {x["doc_id"]: x["text"] for x in out.collect()}
    assert after[2] == texts[2] and after[3] is None and after[4] == "" and after[7] == texts[7] and after[1] == got[1]["text"]
    more = df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text").unionByName(df.where("doc_id = 5").select(F.lit(None).cast("string").alias("doc_id"), "text"))
    named = [(x["doc_id"], x["text"]) for x in pii.personal_data(more.unionByName(more)).collect()]
    assert len(named) == 8 and named.count((None, "<EMAIL>")) == 2 == named.count(("d5", "<EMAIL>"))
    assert pii.personal_data(df.limit(0)).count() == 0 and pii.masked(df.limit(0)).count() == 0


# === substrings ===


def repeated_words(texts: dict, least: int) -> dict:
    """By brute force: words in a window of ``least`` that a document of a lesser id has."""
    seen: set = set()
    out = {}
    for d in sorted(k for k in texts if k is not None):
        w = words([texts[d]])[0].tolist() if texts[d] else []
        windows = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        hit = {p for i, x in enumerate(windows) if x in seen for p in range(i, i + least)}
        if hit:
            out[d] = hit
        seen.update(windows)
    return out


def removed_words(text: str, spans: str) -> set:
    _, _, a, b = words([text])
    raw = text.encode()
    chars = [tuple(map(int, s.split("-"))) for s in spans.split(",")]
    byte = lambda n: len(text[:n].encode())
    cuts = [(byte(x), byte(y)) for x, y in chars]
    assert len(raw) >= max(y for _, y in cuts)
    return {i for i in range(len(a)) if any(x <= a[i] and b[i] <= y for x, y in cuts)}


def test_substrings_against_brute_force(spark):
    r = random.Random(8)
    passages = [prose(r, r.randint(40, 160)) for _ in range(12)]
    texts = {}
    for i in range(120):
        parts = [prose(r, r.randint(5, 80))]
        for _ in range(r.randint(0, 3)):
            parts += [edited(r, r.choice(passages), r.choice([0, 0, 0.01, 0.03])), prose(r, r.randint(0, 40))]
        texts[i] = ". ".join(parts)
    texts |= {200: None, 201: "", 202: texts[3], 203: texts[3], 204: "É " + texts[5].upper(), 205: "la " * 400, 206: "la " * 300}
    got = {x["doc_id"]: x for x in substrings.without_repeats(documents(spark, texts).withColumn("refs", F.lit(0))).collect()}
    want = repeated_words(texts, substrings.LEAST)
    assert set(got) == set(want) and len(want) > 20
    for d, x in got.items():
        assert removed_words(texts[d], x["spans"]) == want[d]
        assert all(ref < d for ref in x["refs"]) and x["removed_words"] == len(want[d])
        left = "".join(texts[d][b:a] for b, a in zip([0, *[int(s.split("-")[1]) for s in x["spans"].split(",")]], [*[int(s.split("-")[0]) for s in x["spans"].split(",")], len(texts[d])]))
        assert x["text"] == left
    assert substrings.without_repeats(documents(spark, texts).limit(0)).count() == 0
    want_spans = {d: x["spans"] for d, x in got.items()}
    assert {x["doc_id"]: x["spans"] for x in substrings.without_repeats(documents(spark, texts), shard_contexts=1).collect()} == want_spans
    named = documents(spark, texts).withColumn("doc_id", F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    out = {x["doc_id"]: x for x in substrings.without_repeats(named).collect()}
    assert {int(d[1:]): x["spans"] for d, x in out.items()} == want_spans
    assert all(ref < d for d, x in out.items() for ref in x["refs"])


def test_substring_ids(spark):
    r = random.Random(9)
    a, b = prose(r, 80), prose(r, 80)
    df = spark.createDataFrame([(1, a), (2, a), (2, a), (3, b), (3, a), (4, b), (None, a)], "doc_id long, text string")
    got = sorted((x["doc_id"], x["text"].strip(), tuple(x["refs"])) for x in substrings.without_repeats(df).collect())
    assert got == [(2, "", (1,)), (2, "", (1,)), (3, "", (1,)), (4, "", (3,))]


def test_automaton_matching_statistics():
    r = random.Random(10)
    for _ in range(30):
        texts = [[r.randrange(3) for _ in range(r.randint(1, 30))] for _ in range(3)]
        auto = substrings.Automaton()
        for i, t in enumerate(texts):
            auto.insert(t, i)
        probe = [r.randrange(3) for _ in range(40)]
        covered = {p for a, b, _ in auto.spans(probe, 4) for p in range(a, b)}
        inside = lambda x: [i for i, t in enumerate(texts) if any(t[k : k + len(x)] == x for k in range(len(t)))]  # noqa: E731, B023
        assert covered == {p for k in range(37) if inside(probe[k : k + 4]) for p in range(k, k + 4)}
        for a, b, ref in auto.spans(probe, 4):
            assert ref == inside(probe[a:b])[0]


def test_hash_mixes():
    x = mix(np.arange(1000, dtype=np.uint64))
    assert len(np.unique(x)) == 1000


# === pipeline ===


def by_stages(spark, df, sf_dir):
    out = [df]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = by_stages(spark, docs, small)
    for s in stages[:-1]:
        assert s.columns == docs.columns and dict(s.dtypes) == dict(docs.dtypes)
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in stages[:-1]]
    assert set(texts[1]) == {r["doc_id"] for r in quality.quality_rules(docs).collect()}
    groups = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(stages[1]).collect()}
    assert set(texts[2]) == {d for d in texts[1] if groups.get(d, d) == d}
    leaks = {r["doc_id"] for r in decontaminate.contaminated(stages[2], spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert set(texts[3]) == set(texts[2]) - leaks
    assert set(texts[4]) == set(texts[3])
    found = {r["doc_id"]: r["text"] for r in pii.personal_data(stages[3]).collect()}
    assert texts[4] == {**texts[3], **found}
    packed = stages[-1].groupBy("doc_id").agg(F.sum("size").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {d: len(t.split()) for d, t in texts[4].items()}
    whole = {tuple(r) for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {tuple(r) for r in stages[-1].collect()}


def test_pipeline_cases(spark, small):
    r = random.Random(11)
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, prose(r, 40), None, None, 1, "x"), (2, prose(r, 30), "en", "s", 2, "x"), (3, "mail kim.42@mail3.example.com now", "en", "s", 3, "x"), (4, prose(r, 30_000), "en", "s", 4, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", `row` string")
    stages = by_stages(spark, df, small)
    assert all(s.columns == df.columns for s in stages[:-1])
    assert "<EMAIL>" in {x["text"] for x in stages[4].collect() if x["doc_id"] == 3}.pop()
    assert stages[-1].count() > 10
    assert by_stages(spark, df.limit(0), small)[-1].count() == 0
