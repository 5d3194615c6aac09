"""Substring deduplication with suffix automata of reference shards.

A passage of ``least`` words or more that also occurs in a document of a smaller id is
removed from the later one.  An automaton of the whole corpus fits no machine, and
sending every document past every shard is quadratic, so shards are cut by content
and documents go only to the shards that can hold a match:

1. Anchors.  Every window of ``least`` words chooses the least hash among its
   ``GRAM``-word grams.  Equal windows choose equal anchors wherever they stand, so any
   repeated passage meets its original at an anchor; nothing is sampled or capped.  Of an
   anchor move its hash, its place and a hash of its context, the words of all windows
   that chose it.
2. An anchor's contexts that are equal as a whole are settled by their hash: those in
   later documents are removed entirely.
3. Of anchors with differing contexts, each different one is a reference.  A shard holds
   the contexts of many anchors.  They are streamed in order of ids past the suffix
   automaton of the earlier ones; the matching statistics give the spans.  Only contexts
   that share a window hash with another document get that far.  An anchor of more than
   ``shard_contexts`` different contexts fits no shard: its windows are compared by their
   hashes, counted in parts, which gives the same spans.
4. Spans of a document are united and cut from its text.

What is joined to the texts, places and spans, grows with the corpus, so these joins are
shuffles at every size.  Least and greatest ids of an anchor are aggregates joined back, so
no task holds all places of an anchor that a third of all documents have.

Words are runs of letters, digits and other non-ASCII characters in lower case.

Cases: null ids and texts without ``least`` words have no span; repeats within one
document stay; rows of one id and one text are cut alike; different texts of one id are
documents of their own, in the order of their hashes; ids may be numbers or texts, and texts
are ordered as such; documents of any length are read whole; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _BASE, _INV, _powers, chunks, cut, fold, forget, id_type, mix, texts_of, words, written

LEAST, GRAM, SHARD_CONTEXTS = 50, 20, 4000


def sums_of(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _powers("base", _BASE, len(h)), out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of words, from the running sums of their weighted hashes."""
    return mix((sums[end] - sums[start]) * _powers("inverse", _INV, len(sums))[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def anchors(h: np.ndarray, at: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each anchor: document, hash, hash of its context, place, first and last window."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none.astype(U64), none.astype(U64), none, none, none
    sums = sums_of(h)
    i = np.arange(n - gram + 1)
    grams = hashes(sums, i, i + gram)
    width = least - gram + 1
    chosen = np.empty(n - least + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    for a in range(0, len(chosen), 1 << 15):
        chosen[a : a + (1 << 15)] = view[a : a + (1 << 15)].argmin(axis=1)
    start = np.arange(len(chosen))
    inside = doc[start] == doc[start + least - 1]
    start, chosen = start[inside], (start + chosen)[inside]
    if not len(start):
        return none, none.astype(U64), none.astype(U64), none, none, none
    edge = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(start) != 1)) + 1
    first, last = start[np.concatenate([[0], edge])], start[np.concatenate([edge - 1, [len(start) - 1]])]
    place = chosen[np.concatenate([[0], edge])]
    context = hashes(sums, first, last + least)
    context = mix(context + ((place - first) * 64 + (last - first)).astype(U64))
    base = at[:-1][doc[first]]
    return doc[first], grams[place], context, place - base, first - base, last - base


class Automaton:
    """Suffix automaton of several strings, told apart by the document of each."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [-1]

    def _state(self, length: int, doc: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after), self.link.append(link), self.length.append(length), self.doc.append(doc)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.doc[q], self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def insert(self, text: list[int], doc: int) -> None:
        last = 0
        for c in text:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new = self._state(self.length[last] + 1, doc, 0, {})
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def spans(self, text: list[int], least: int) -> list[tuple[int, int, int]]:
        """Maximal spans of ``text`` that occur, of ``least`` or more; with the document."""
        out: list[tuple[int, int, int]] = []
        state = size = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            after = self.next[state].get(c)
            if after is None:
                size = 0
                continue
            state, size = after, size + 1
            if size >= least:
                start = i + 1 - size
                if out and out[-1][0] == start:
                    out.pop()
                out.append((start, i + 1, self.doc[state]))
        return out


def settle(rows: list[tuple[int, int, int, list[int]]], least: int) -> list[tuple[int, int, int, int]]:
    """``doc, start, end, ref`` of spans; rows of one anchor: doc, place of the context, -, words."""
    out, automaton = [], Automaton()
    waiting: list[tuple[int, list[int]]] = []
    for doc, first, _, text in rows:
        if waiting and waiting[0][0] != doc:
            for d, t in waiting:
                automaton.insert(t, d)
            waiting = []
        out += [(doc, first + a, first + b, ref) for a, b, ref in automaton.spans(text, least)]
        waiting.append((doc, text))
    return out


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``doc_id, start, end, ref`` in words: spans that ``ref``, an earlier document, has too."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches):
            h, at, _, _ = words(texts_of(pdf))
            doc, f, context, _, first, last = anchors(h, at, least, gram)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[doc], "f": f.astype(np.int64), "context": context.astype(np.int64), "first": first.astype(np.int32), "last": last.astype(np.int32)})

    found = cut(docs.mapInPandas(find, "doc_id long, f long, context long, first int, last int"))
    stale = written()[-1:]
    ends = found.groupBy("f").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("context") != F.max("context")).alias("varied")).where("low < high")
    held = cut(found.join(ends.select("f", "varied"), "f"))
    stale += written()[-1:]
    firsts = held.groupBy("f", "context").agg(F.min("doc_id").alias("ref"))
    met = cut(held.join(firsts, ["f", "context"]).select("doc_id", "f", "context", "first", "last", "varied", "ref"))
    forget(stale)
    whole = met.where("doc_id > ref").select("doc_id", F.col("first").alias("start"), (F.col("last") + least).alias("end"), "ref")
    variants = met.where("varied and doc_id = ref")
    hot = cut(variants.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > shard_contexts).select("f", F.lit(True).alias("hot")))
    shards = max(1, -(-variants.count() // shard_contexts))
    # a set: its size is bounded by the length of a document
    places = cut(variants.groupBy("doc_id").agg(F.collect_set(F.struct("f", "first", "last")).alias("at")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches):
            h, at, _, _ = words(texts_of(pdf))
            small = (h >> U64(32)).astype(np.uint32)
            rows = [(d, x["f"], x["first"], small[a + x["first"] : a + x["last"] + least].tobytes()) for d, a, xs in zip(pdf["doc_id"], at, pdf["at"]) for x in xs]
            yield pd.DataFrame(rows, columns=["doc_id", "f", "first", "words"]).astype({"doc_id": "int64", "f": "int64", "first": "int32"})

    texts = docs.join(places.hint("shuffle_merge"), "doc_id").mapInPandas(read, "doc_id long, f long, first int, words binary")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["f", "doc_id", "first"]).reset_index(drop=True)
        each = [np.frombuffer(x, np.uint32) for x in pdf["words"]]
        size = np.array([len(x) for x in each])
        flat = np.concatenate(each).astype(U64)
        row = np.repeat(np.arange(len(each)), size)
        start = np.arange(max(0, len(flat) - least + 1))
        start = start[row[start] == row[start + least - 1]]
        # only contexts with a window that another document has too go on
        window, inverse = np.unique(hashes(sums_of(mix(flat)), start, start + least), return_inverse=True)
        ids = pdf["doc_id"].to_numpy()[row[start]]
        low, high = np.full(len(window), np.iinfo(np.int64).max), np.full(len(window), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids), np.maximum.at(high, inverse, ids)
        shared = np.zeros(len(each), bool)
        shared[row[start][(low < high)[inverse]]] = True
        out: list[tuple[int, int, int, int]] = []
        f = pdf["f"].to_numpy()
        edge = np.flatnonzero(np.diff(f)) + 1
        for a, b in zip([0, *edge], [*edge, len(f)]):
            take = [i for i in range(a, b) if shared[i]]
            if len(take) > 1:
                out += settle([(int(pdf["doc_id"][i]), int(pdf["first"][i]), 0, each[i].tolist()) for i in take], least)
        return pd.DataFrame(out, columns=["doc_id", "start", "end", "ref"]).astype({"doc_id": "int64", "start": "int32", "end": "int32", "ref": "int64"})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [np.frombuffer(x, np.uint32) for x in pdf["words"]]
            held = np.array([max(0, len(x) - least + 1) for x in each], np.int64)
            row, start = np.repeat(np.arange(len(each)), held), np.concatenate([np.arange(n) for n in held]) if len(held) else held
            window = [hashes(sums_of(mix(x.astype(U64))), np.arange(n), np.arange(n) + least) for x, n in zip(each, held)]
            out = {c: pdf[c].to_numpy()[row] for c in ("doc_id", "f")} | {"start": (pdf["first"].to_numpy()[row] + start).astype(np.int32), "w": np.concatenate(window).astype(np.int64) if window else held}
            yield pd.DataFrame(out)

    if hot.isEmpty():
        usual = texts
        part = None
    else:
        marked = cut(texts.join(hot, "f", "left"))
        usual = marked.where("hot is null").drop("hot")
        each = cut(marked.where("hot").drop("hot").mapInPandas(windows, "doc_id long, f long, start int, w long"))
        least_id = each.groupBy("f", "w").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last")).where("ref < last")
        part = each.join(least_id, ["f", "w"]).where("doc_id > ref").select("doc_id", "start", (F.col("start") + least).alias("end"), "ref")
    sharded = usual.withColumn("shard", F.pmod(F.xxhash64("f"), F.lit(shards))).groupBy("shard").applyInPandas(match, "doc_id long, start int, end int, ref long")
    out = whole.unionByName(sharded)
    return out if part is None else out.unionByName(part)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``doc_id, spans, removed_words, refs, text`` of each document that loses spans.

    ``spans`` lists ``start-end`` of the removed parts in characters of the old text;
    ``refs`` are the ids of documents that have them and keep them; ``text`` is the rest.
    """
    kind = id_type(docs, id_col)
    plain = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    spans = lambda d: d.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("at"), F.array_sort(F.collect_set("ref")).alias("refs"))
    if kind == "long" and plain.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        lost = plain.join(cut(spans(repeated_spans(plain, least, gram, shard_contexts))).hint("shuffle_merge"), "doc_id")
    else:
        # each different text of an id is searched once, under a number in their order
        hashed = plain.withColumn("same", F.xxhash64("text"))
        ordered = hashed.select("doc_id", "same").distinct().repartitionByRange("doc_id", "same").sortWithinPartitions("doc_id", "same")
        units = cut(ordered.withColumn("unit", F.monotonically_increasing_id()))
        once = hashed.dropDuplicates(["doc_id", "same"]).join(units, ["doc_id", "same"]).select(F.col("unit").alias("doc_id"), "text")
        by_unit = cut(spans(repeated_spans(once, least, gram, shard_contexts)))
        named = by_unit.select("doc_id", F.explode("refs").alias("unit")).join(units.select("unit", F.col("doc_id").alias("ref")), "unit").groupBy("doc_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
        told = by_unit.drop("refs").join(named, "doc_id").withColumnRenamed("doc_id", "unit").join(units, "unit")
        lost = hashed.join(told.hint("shuffle_merge"), ["doc_id", "same"]).select("doc_id", "text", "at", "refs")

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches):
            rows = []
            for d, text, at, refs in zip(pdf["doc_id"], pdf["text"], pdf["at"], pdf["refs"]):
                _, _, starts, ends = words([text])
                spans: list[list[int]] = []
                for x in at:
                    if spans and x["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["end"])
                    else:
                        spans.append([x["start"], x["end"]])
                raw = fold(text).encode("utf-8", "surrogatepass")
                chars = []
                byte = char = 0
                for a, b in spans:
                    for to in (starts[a], ends[b - 1]):
                        char += len(raw[byte:to].decode("utf-8", "surrogatepass"))
                        byte = to
                        chars.append(char)
                pairs = list(zip(chars[::2], chars[1::2]))
                left = "".join(text[a:b] for a, b in zip([0, *chars[1::2]], [*chars[::2], len(text)]))
                rows.append((d, ",".join(f"{a}-{b}" for a, b in pairs), sum(b - a for a, b in spans), list(refs), left))
            yield pd.DataFrame(rows, columns=["doc_id", "spans", "removed_words", "refs", "text"])

    return lost.select("doc_id", "text", "at", "refs").mapInPandas(drop, f"doc_id {kind}, spans string, removed_words long, refs array<{kind}>, text string")
