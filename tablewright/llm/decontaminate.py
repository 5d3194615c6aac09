"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised: lower case, each run of other than letters and digits one
space.  An item of L characters may differ by k = floor(L * rate) edits.  It is cut
in k + 1 pieces, one of which any match must hold unchanged; an Aho-Corasick automaton
finds the pieces, and each stretch around a hit is verified with Myers' bit-parallel
distance.  Before that, a stretch must share as many trigrams with the item as k edits
leave (the q-gram lemma), which never loses a match.

Items are taken in shards of up to ``shard_chars`` characters; each shard is a pass
over the documents, so what a task holds doesn't grow with the benchmark.

Cases: null or empty texts and items without a letter or digit match nothing; items
shorter than 1/rate characters must occur unchanged; a match must start and end at
words; documents of any length are read whole; repeated rows and ids of documents
give one row with the least distance; equal items are each reported; null ids are
left out; ids may be numbers or texts; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

RATE, SHARD_CHARS = 0.08, 4_000_000
_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges that cover the length, of sizes that differ by one at most."""
    cut = [length * i // (k + 1) for i in range(k + 2)]
    return list(zip(cut, cut[1:]))


class Pattern:
    """An item ready for Myers' search."""

    def __init__(self, text: str, k: int) -> None:
        self.text, self.k, self.size = text, k, len(text)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.grams = Counter(text[i : i + 3] for i in range(len(text) - 2))
        self.shared = max(0, len(text) - 2 - 3 * k)

    def may_match(self, stretch: str) -> bool:
        if self.shared <= 0:
            return True
        held = {stretch[i : i + 3] for i in range(len(stretch) - 2)}
        return sum(n for g, n in self.grams.items() if g in held) >= self.shared

    def distance(self, stretch: str) -> int:
        """The least edit distance of the item to any part of the stretch."""
        if self.text in stretch:
            return 0
        full, high = (1 << self.size) - 1, 1 << (self.size - 1)
        pv, mv, score, best = full, 0, self.size, self.size
        masks = self.masks
        for c in stretch:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best = score
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.patterns: list[tuple[int, Pattern]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item, raw in items:
            text = normal(raw)
            if not text:
                continue
            k = int(len(text) * rate)
            self.patterns.append((item, Pattern(f" {text} ", k)))
            for a, b in pieces(len(text), k):
                at.setdefault(text[a:b], []).append((len(self.patterns) - 1, a + 1))
        self.found = ahocorasick.Automaton()
        for piece, places in at.items():
            self.found.add_word(piece, (len(piece), places))
        if at:
            self.found.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Least distance by item, for the items within their error budget."""
        out: dict[int, int] = {}
        if not self.patterns or not text:
            return out
        whole = f" {normal(text)} "
        starts: dict[int, list[int]] = {}
        for end, (size, places) in self.found.iter(whole):
            for p, offset in places:
                starts.setdefault(p, []).append(end - size + 1 - offset)
        for p, hits in starts.items():
            item, pattern = self.patterns[p]
            reach = pattern.size + pattern.k
            best = pattern.k + 1
            hits.sort()
            low, i = None, 0
            while i < len(hits):  # hits whose stretches overlap are verified at once
                low = high = hits[i]
                while i < len(hits) and hits[i] - high <= pattern.k:
                    high = hits[i]
                    i += 1
                stretch = whole[max(0, low - pattern.k) : high + reach]
                if best and pattern.may_match(stretch):
                    best = min(best, pattern.distance(stretch))
            if best <= pattern.k:
                out[item] = min(best, out.get(item, best))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``doc_id, item_id, distance`` of each document and item that it holds."""
    kind, item_kind = id_type(docs, id_col), id_type(benchmark, item_col)
    items = benchmark.select(F.col(item_col).cast(item_kind).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    shards = max(1, -(-int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // shard_chars))
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = None
    for shard in range(shards):
        part = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard).collect()]

        def run(batches: Iterator[pd.DataFrame], part: list[tuple[int, str]] = part) -> Iterator[pd.DataFrame]:
            matcher = Matcher(part, rate)
            for pdf in batches:
                found = [(d, i, n) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, n in matcher.matches(t).items()]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance"]).astype({"doc_id": "int64" if kind == "long" else object, "item_id": "int64" if item_kind == "long" else object, "distance": "int64"})

        one = rows.mapInPandas(run, f"doc_id {kind}, item_id {item_kind}, distance long")
        out = one if out is None else out.unionAll(one)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
