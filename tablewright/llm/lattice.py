"""Document likelihood over all segmentations in pieces of an existing vocabulary.

The vocabulary is that of a public tokenizer; it isn't trained here.  Its file holds
merge ranks, no probabilities, so the unigram scores of its pieces are measured: the
tokenizer's own segmentation of every word of the corpus, counted and smoothed by
``alpha``.  A document's probability is the sum over all its segmentations, by forward
recursion in log space; pieces never cross white space, so that the sum is a product
over words.  A character without a piece is spelled in byte pieces.

Words are counted once per partition and merged by a shuffle, which grows with the
corpus; what the driver gets is a number for each piece of the vocabulary.

Cases: a null text has null scores; a text without words has probability 1 and no bits
a character; any run of white space is one space; texts and words of any length are
scored whole; repeated rows and ids stay separate; null ids stay null; other columns
are ignored; on an empty table the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INV, _powers, chunks, cut, id_type, texts_of, U64

MODEL, ALPHA = "/opt/tokenizers/piece_bpe_32k.model", 0.5
SPACE = "▁"
_CACHE, _WIDE = 300_000, 64


class _Table:
    """Scores of the pieces of one length by a hash of their characters.

    Two tables without a chain: what collides in the first is in the second."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(6, int(len(keys) * 16 - 1).bit_length())
        random = np.random.default_rng(1)
        while True:
            self.factors = random.integers(1, 1 << 63, 2).astype(U64) * U64(2) + U64(1)
            first = np.unique(self._slot(keys, 0), return_index=True)[1]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            if len(np.unique(self._slot(keys[rest], 1))) == rest.sum():
                break
        self.keys, self.values = np.zeros((2, 1 << self.bits), U64), np.full((2, 1 << self.bits), -np.inf)
        for k, part in ((0, first), (1, np.flatnonzero(rest))):
            slot = self._slot(keys[part], k)
            self.keys[k, slot], self.values[k, slot] = keys[part], values[part]

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys * self.factors[k]) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Scores, minus infinity where there's no such piece."""
        a, b = self._slot(keys, 0), self._slot(keys, 1)
        out = np.where(self.keys[0][a] == keys, self.values[0][a], -np.inf)
        other = self.keys[1][b] == keys
        out[other] = self.values[1][b[other]]
        return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Lattice:
    """Pieces with their log probabilities."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float]) -> None:
        self.pieces, self.bytes = pieces, bytes_
        self.longest = max(map(len, pieces), default=1)
        self.tables: dict[int, _Table] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None, "single": None}

    def _prepare(self) -> None:
        by: dict[int, list[str]] = {}
        for p in self.pieces:
            by.setdefault(len(p), []).append(p)
        self.tables = {}
        for n in sorted(by.keys() - {1}):
            c = _codes(by[n]).reshape(-1, n).astype(U64)
            self.tables[n] = _Table((c * _powers("base", _BASE, n)).sum(axis=1, dtype=U64), np.array([self.pieces[p] for p in by[n]]))
        self.single = np.full(0x110000, np.nan)
        for p in by.get(1, []):
            self.single[ord(p)] = self.pieces[p]

    def spelled(self, c: str) -> float:
        return sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))

    def score(self, word: str) -> float:
        """Log probability of one word, by the recursion as it is written."""
        s, alpha = SPACE + word, [0.0]
        for j in range(1, len(s) + 1):
            ways = [alpha[i] + self.pieces[s[i:j]] for i in range(max(0, j - self.longest), j) if s[i:j] in self.pieces]
            if s[j - 1] not in self.pieces:
                ways.append(alpha[j - 1] + self.spelled(s[j - 1]))
            top = max(ways)
            alpha.append(top + math.log(sum(math.exp(w - top) for w in ways)))
        return alpha[-1]

    def scores(self, words: Iterable[str]) -> dict[str, float]:
        """Log probability of each word.

        Words are sorted, so that those with a common prefix share its sums; the recursion
        takes all words' next character at once.  Words of over ``_WIDE`` characters
        are done one by one."""
        words = set(words)
        out = {w: self.score(w) for w in words if len(w) >= _WIDE}
        order = sorted(words - out.keys())
        if not order:
            return out
        if self.tables is None:
            self._prepare()
        size = np.fromiter(map(len, order), np.int64, len(order)) + 1
        wide = int(size.max())
        chars = np.full((len(order), wide), 0x7FFFFFFF, np.uint32)
        chars[:, 0] = ord(SPACE)
        row = np.repeat(np.arange(len(order)), size - 1)
        chars[row, np.arange(len(row)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + 1] = _codes(order)
        new = np.ones((len(order), wide), bool)
        new[1:] = np.logical_or.accumulate(chars[1:] != chars[:-1], axis=1)
        new &= np.arange(wide) < size[:, None]
        sums = np.zeros((len(order), wide + 1), U64)
        np.cumsum(chars.astype(U64) * _powers("base", _BASE, wide), axis=1, out=sums[:, 1:])
        inverse = _powers("inverse", _INV, wide)
        alpha = [np.zeros(len(order))]
        total = np.zeros(len(order))
        for j in range(1, wide + 1):
            at = np.flatnonzero(new[:, j - 1])
            one = self.single[chars[at, j - 1]]
            for k in np.flatnonzero(np.isnan(one)):
                one[k] = self.single[chars[at[k], j - 1]] = self.spelled(chr(chars[at[k], j - 1]))
            ways = [alpha[j - 1][at] + one]
            end = sums[at, j]
            for n, t in self.tables.items():
                if n > j:
                    break
                ways.append(alpha[j - n][at] + t.find((end - sums[at, j - n]) * inverse[j - n]))
            here = np.full(len(order), -np.inf)
            if len(at):
                both = np.array(ways)
                top = both.max(axis=0)
                here[at] = top + np.log(np.exp(both - top).sum(axis=0))
                # a word without a new prefix here has that of the last one before it
                source = np.zeros(len(order), np.int64)
                source[at] = at
                here = here[np.maximum.accumulate(source)]
            alpha.append(here)
            done = size == j
            total[done] = here[done]
        out.update(zip(order, total.tolist()))
        return out


def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for pdf in chunks(batches):
            for text in texts_of(pdf):
                if text:
                    held.update(text.split())
            if len(held) > _CACHE:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, model: str) -> dict[int, int]:
    """How often the tokenizer uses each piece, by id; at most one entry a piece."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = processor(model)
        held: Counter[int] = Counter()
        for pdf in batches:
            for n, ids in zip(pdf["n"].tolist(), tokens.encode(pdf["word"].tolist(), num_threads=1)):
                for i in ids:
                    held[i] += n
        yield pd.DataFrame({"piece": list(held), "n": list(held.values())}).astype("int64")

    return {r["piece"]: r["n"] for r in words.mapInPandas(split, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def lattice(counts: dict[int, int], model: str, alpha: float = ALPHA) -> Lattice:
    tokens = processor(model)
    usable = [i for i in range(tokens.get_piece_size()) if not (tokens.is_control(i) or tokens.is_unknown(i) or tokens.is_unused(i))]
    total = math.log(sum(counts.get(i, 0) + alpha for i in usable))
    score = {i: math.log(counts.get(i, 0) + alpha) - total for i in usable}
    bytes_ = [0.0] * 256
    for i in usable:
        if tokens.is_byte(i):
            bytes_[int(tokens.id_to_piece(i)[3:-1], 16)] = score[i]
    return Lattice({tokens.id_to_piece(i): s for i, s in score.items() if not tokens.is_byte(i)}, bytes_)


def likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, words, chars, log_prob, bits_per_char`` of every row (natural logarithm).

    ``model`` must be readable under this path on every machine."""
    kind = id_type(docs, id_col)
    plain = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scorer = lattice(piece_counts(cut(word_counts(plain)), model), model, alpha)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for pdf in chunks(batches):
            split = [None if t is None else t.split() for t in texts_of(pdf)]
            if len(known) > _CACHE:
                known.clear()
            known.update(scorer.scores({w for ws in split if ws for w in ws} - known.keys()))
            logs = [None if ws is None else sum(map(known.__getitem__, ws), 0.0) for ws in split]
            size = [None if ws is None else sum(map(len, ws)) + max(0, len(ws) - 1) for ws in split]
            bits = [-x / n / math.log(2) if n else None for x, n in zip(logs, size)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "words": pd.array([None if ws is None else len(ws) for ws in split], "Int64"), "chars": pd.array(size, "Int64"), "log_prob": pd.array(logs, "Float64"), "bits_per_char": pd.array(bits, "Float64")})

    return plain.mapInPandas(score, "doc_id string, words long, chars long, log_prob double, bits_per_char double").withColumn("doc_id", F.col("doc_id").cast(kind))
