"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Signature.  Each element of a document's shingle set draws a random value for
each step j = 0, 1, ... and a random permutation of the m places; place p(j)
gets the minimum of ``j + value``.  An element may stop as soon as the largest
place is below j.  All elements of all documents of a batch take step j
together, which yields the same minima and turns the early stop into dropping
finished documents from the next step.

Candidates.  The m places are cut in bands; documents that agree in a whole
band meet in a bucket.  Documents with one and the same signature are merged
first, so thousands of exact copies make one member of a bucket.  There is no
cap on buckets: members are visited breadth first, each visit comparing one member
with all that are still unvisited, which finds the same connected sets as all pairs
would.  A bucket of more than ``BLOCK`` members is cut in blocks by a hash, and every
two of its blocks are visited together in a task of their own; so no task holds more than
two blocks, and no two members of a bucket are left uncompared.

Cases: a document without words (null, empty, punctuation only) or without an id
has no signature and is never in a group; one with fewer words than a shingle has
one shingle of all of them; rows of one id are one document, joined to what any
of its texts resembles; ids may be numbers or texts; extra columns are ignored; an
empty table gives no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, cut, forget, id_type, mix, texts_of, words, written

PLACES, BANDS, SHINGLE, THRESHOLD, BLOCK = 128, 32, 3, 0.5, 4096
_STEP = U64(0x9E3779B97F4A7C15)
_NONE = U64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and offsets by text."""
    h, at, _, _ = words(texts)
    count = np.diff(at)
    held = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(held)])
    start = np.repeat(at[:-1] - to[:-1], held) + np.arange(to[-1])
    last = np.repeat(at[1:], held)
    out = np.zeros(to[-1], U64)
    for k in range(n):
        i = start + k
        out = mix(out * U64(31) + np.where(i < last, h[np.minimum(i, max(len(h) - 1, 0))], U64(7))) if len(h) else out
    return out, to


def draw(elements: np.ndarray, step: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """An element's value (32 bits) and its Fisher-Yates partner at a step."""
    x = mix(elements + U64((step + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
    return x & U64(0xFFFFFFFF), (U64(step) + (((x >> U64(32)) * U64(places - step)) >> U64(32))).astype(np.int64)


def signatures(elements: np.ndarray, at: np.ndarray, places: int = PLACES) -> np.ndarray:
    """One row of ``places`` values for each document; all ones where it has no element."""
    docs = len(at) - 1
    out = np.full(docs * places, _NONE, U64)
    owner = np.repeat(np.arange(docs), np.diff(at))
    state: np.ndarray | None = None
    for step in range(places):
        if not len(elements):
            break
        value, k = draw(elements, step, places)
        if state is None:
            place = k
        else:
            rows = np.arange(len(elements))
            place = state[rows, k].astype(np.int64)
            state[rows, k] = state[:, step]
        np.minimum.at(out, owner * places + place, value + (U64(step) << U64(32)))
        open_docs = out.reshape(docs, places).max(axis=1) >= (U64(step + 1) << U64(32))
        left = open_docs[owner]
        elements, owner = elements[left], owner[left]
        if state is None:
            k = k[left]
            state = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(elements), 1))
            state[np.arange(len(elements)), k] = 0
        else:
            state = state[left]
    return out.reshape(docs, places)


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one signature with many."""
    return (many == one).mean(axis=1)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: int = PLACES, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, key_a, key_b, bands, sig`` of each document that has words."""
    width = places // bands

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "text"):
            elements, at = shingles(texts_of(pdf), shingle)
            held = np.diff(at) > 0
            if not held.any():
                continue
            sig = signatures(elements, at, places)[held]
            key_a = np.zeros(len(sig), U64)
            key_b = np.full(len(sig), 0x5851F42D4C957F2D, U64)
            band = np.zeros((len(sig), bands), U64)
            for j in range(places):
                key_a = mix(key_a * U64(31) + sig[:, j])
                key_b = mix(key_b ^ (sig[:, j] * _STEP))
                band[:, j // width] = mix(band[:, j // width] * U64(31) + sig[:, j] + U64(j // width + 1))
            small = mix(sig).astype(np.uint16)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[held], "key_a": key_a.astype(np.int64), "key_b": key_b.astype(np.int64), "bands": list(band.astype(np.int64)), "sig": [x.tobytes() for x in small]})

    kind = id_type(docs, id_col)
    kept = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return kept.mapInPandas(run, f"doc_id {kind}, key_a long, key_b long, bands array<long>, sig binary")


def linked(ids: list, sig: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Edges of a spanning forest of the members that agree by ``threshold``."""
    left = np.arange(len(ids))
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            hit = agreement(sig[queue.pop()], sig[left]) >= threshold
            for x in left[hit]:
                yield ids[root], ids[x]
            queue += list(left[hit])
            left = left[~hit]


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each connected set, by star contraction.

    Alternates large stars (neighbours above a node move to its least neighbour)
    with small stars (neighbours up to a node do) until nothing changes.  A node's least
    neighbour is an aggregate that is joined back, so no row or task holds the neighbours
    of a node; each round is written to the shared folder and the one before is deleted.
    """
    pairs, sign = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    while True:
        before = written()[-1:]
        both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = cut(both.where("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        before += written()[-1:]
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        pairs = cut(small.unionAll(least.select("a", F.col("low").alias("b"))).distinct())
        forget(before)
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sign:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = now


def candidates(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``bucket, i, j, doc_id, sig``: the members of each bucket, by pairs of its blocks.

    Buckets of the same members, which near copies have many of, are one; they are known
    by counts and hashes of members, never by a list."""
    spread = reps.select("member", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("member").alias("x"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("y")).where("n > 1")
    kept = sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).alias("k"))
    own = F.pmod(F.xxhash64("member", F.lit(2)), F.col("k"))
    each = F.when(F.col("k") > 1, F.transform(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("own")), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    members = spread.join(kept, "bucket").withColumn("own", own).select("bucket", "member", F.explode(F.coalesce(each, F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j"))))).alias("at"))
    return members.join(reps.select("member", "doc_id", "sig"), "member").select("bucket", "at.i", "at.j", "doc_id", "sig")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, places: int = PLACES, bands: int = BANDS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``doc_id, group_id, group_size`` of each document in a group of two or more.

    ``group_id`` is the least id of the group.
    """
    kind = id_type(docs, id_col)
    signs = cut(signed(docs, id_col, text_col, places, bands, shingle))
    merged = signs.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = cut(merged.withColumn("member", F.xxhash64("key_a", "key_b")))
    exact = signs.select("doc_id", "key_a", "key_b").join(reps.where("doc_id <> last").select("key_a", "key_b", F.col("doc_id").alias("b")), ["key_a", "key_b"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            edges = [e for ids, sigs in zip(pdf["ids"], pdf["sigs"]) for e in linked(ids.tolist(), np.frombuffer(b"".join(sigs), np.uint16).reshape(len(ids), -1), threshold)]
            yield pd.DataFrame(edges, columns=["a", "b"]).astype("int64" if kind == "long" else object)

    # a group is two blocks of signatures at most, 256 bytes a member
    grouped = candidates(reps, block).groupBy("bucket", "i", "j").agg(F.array_sort(F.collect_list(F.struct("doc_id", "sig"))).alias("m")).select(F.col("m.doc_id").alias("ids"), F.col("m.sig").alias("sigs"))
    close = grouped.mapInPandas(verify, f"a {kind}, b {kind}")
    roots = components(close.unionByName(exact))
    every = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id")).unionAll(roots.select(F.col("root").alias("doc_id"), F.col("root").alias("group_id")).distinct())
    sizes = every.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return every.join(sizes, "group_id").select("doc_id", "group_id", "group_size")
