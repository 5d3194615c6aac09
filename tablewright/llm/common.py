"""Shared pieces of the corpus operators: table access, lineage cuts, text hashing.

Every operator of this subpackage takes a DataFrame and returns a DataFrame.
Rows with a null or empty text never fail: each operator states what it returns
for them.  Input columns other than the ones named by an operator are ignored
unless the operator says that it carries them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.ordered import BROADCAST_BYTES, beside, cut, forget, written  # noqa: F401

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_type(docs: DataFrame, id_col: str) -> str:
    """``long`` for ids that are whole numbers, else ``string``: ids keep their kind."""
    return "long" if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def slices(sizes: Iterable[int], most: int = _BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``most``."""
    at, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if i >= 0:
        yield at, i + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, 1024), base, U64)
        p[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(p)
    return have[:n]


#: Bytes that belong to words: ASCII letters and digits, and all of non-ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    IS_WORD[_c] = True


def fold(text: str) -> str:
    """Lower case of the same length, so that positions stay those of ``text``."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _block_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word in a buffer of bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = IS_WORD[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    n = len(raw)
    sums = np.zeros(n + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers("base", _BASE, n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers("inverse", _INV, n + 1)[starts]
    return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)), starts, ends


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts: hashes, offsets by text, byte starts, byte ends.

    A word is a maximal run of letters, digits and non-ASCII characters, in lower
    case.  Texts are worked on in blocks cut between words, so a very long text
    needs memory for its words, not for its bytes several times over.
    """
    raws = [fold(t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    hashes, starts, ends, counts = [], [], [], np.zeros(len(raws) + 1, np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        buffer = np.frombuffer(b" ".join(raws[i] for i in group) + b" ", np.uint8)
        h, s, e = _block_words(buffer)
        at = np.cumsum([0] + [len(raws[i]) + 1 for i in group])
        first = np.searchsorted(s, at)
        for k, i in enumerate(group):
            counts[i + 1] = first[k + 1] - first[k]
        base = np.repeat(at[:-1], np.diff(first))
        hashes.append(h), starts.append(s - base), ends.append(e - base)
        group.clear()
        size = 0

    for i, raw in enumerate(raws):
        if len(raw) <= _BLOCK:
            if size + len(raw) > _BLOCK:
                flush()
            group.append(i)
            size += len(raw) + 1
            continue
        flush()
        at = 0
        whole = np.frombuffer(raw, np.uint8)
        while at < len(raw):
            to = min(len(raw), at + _BLOCK)
            while to < len(raw) and IS_WORD[whole[to]] and IS_WORD[whole[to - 1]]:
                to += 1
            h, s, e = _block_words(whole[at:to])
            hashes.append(h), starts.append(s + at), ends.append(e + at)
            counts[i + 1] += len(h)
            at = to
    flush()
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(hashes, U64), np.cumsum(counts), join(starts, np.int64), join(ends, np.int64)


def chunks(batches: Iterable[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """The same rows in pieces of about a million characters."""
    for pdf in batches:
        for a, b in slices((len(t) if isinstance(t, str) else 0 for t in pdf[column])):
            yield pdf.iloc[a:b]


def texts_of(pdf: pd.DataFrame, column: str = "text") -> list[str | None]:
    return [t if isinstance(t, str) else None for t in pdf[column]]
