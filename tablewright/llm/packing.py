"""Sum-of-squares packing of documents into training sequences.

Items are placed one after another, by id.  With N(g) open bins of gap g, an item goes
where the sum of all N(g) squared becomes smallest: into an open bin that holds it or
a new one; ties go to the smaller gap.  A bin without gap is closed and not counted.
Documents longer than a bin fill whole bins; their rest is an item.

Packing is sequential, so the documents are cut in shards of ``shard_items`` in the order
of ids, and each shard is packed by itself.  Documents of larger ids, however many, change
no shard but the last.  Rows of one id and length can't be told apart by packing: they
move as one row with a count, so that an id that a third of all rows have is split
exactly, like any other.  Only ids, lengths and counts move.

Cases: a length is the count of words between white space; documents without any
(null, empty) are left out; a null id stays null, its rows come first; repeated rows
are packed each; ids may be numbers or texts; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_type

CAPACITY, SHARD_ITEMS = 2048, 20_000


class Packer:
    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins = capacity, 0
        self.open = np.zeros(capacity + 1, np.int64)
        self.by_gap: list[deque[int]] = [deque() for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """Bin and start of an item of 1 to ``capacity``."""
        n, full = self.open, self.capacity
        # half of the change of the sum of squares, less what is the same for all
        change = n[: full - size + 1] - n[size:] + 1.0
        change[0] = 0.5 - n[size]  # closes the bin
        change[n[size:] == 0] = np.inf
        k = int(change.argmin())
        new = n[full - size] + 0.5 if size < full else 0.0
        if change[k] <= new:
            gap = k + size
            bin_ = self.by_gap[gap].popleft()
            n[gap] -= 1
        else:
            gap, bin_ = full, self.bins
            self.bins += 1
        left = gap - size
        if left:
            n[left] += 1
            self.by_gap[left].append(bin_)
        return bin_, full - gap


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``item, start in the item, size, bin, start in the bin`` of each piece."""
    packer, out = Packer(capacity), []
    for i, length in enumerate(lengths):
        at = 0
        while length - at >= capacity:
            out.append((i, at, capacity, packer.bins, 0))
            packer.bins += 1
            at += capacity
        if length > at:
            out.append((i, at, length - at, *packer.place(length - at)))
    return out


def sharded(sized: DataFrame, shard_items: int) -> DataFrame:
    """``shard, doc_id, size, copies``: the items in order, ``shard_items`` to a shard.

    Ranges of items are sorted apart; each is offset by the copies in those before."""
    ranged = sized.groupBy("doc_id", "size").agg(F.count("*").alias("n")).repartitionByRange("doc_id", "size").sortWithinPartitions("doc_id", "size")
    placed = cut(ranged.withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part").agg(F.sum("n").alias("held"))  # a row for each range
    offset = parts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = placed.withColumn("within", within).join(F.broadcast(offset), "part").select("doc_id", "size", (F.col("offset") + F.col("within")).alias("at"), "n")
    shards = F.explode(F.sequence(F.floor(F.col("at") / shard_items), F.floor((F.col("at") + F.col("n") - 1) / shard_items)))
    first, last = F.col("shard") * shard_items, (F.col("shard") + 1) * shard_items
    return at.withColumn("shard", shards).select("shard", "doc_id", "size", (F.least(F.col("at") + F.col("n"), last) - F.greatest("at", first)).alias("copies"))


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``shard, bin, bin_start, doc_id, doc_start, size`` of each piece of a document."""
    kind = id_type(docs, id_col)
    sized = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^ \t\r\n\f]+")).alias("size")).where("size > 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])]
        out = pd.DataFrame(pack(pdf["size"].tolist(), capacity), columns=["item", "doc_start", "size", "bin", "bin_start"])
        out["doc_id"] = pdf["doc_id"].to_numpy()[out.pop("item")]
        out["shard"] = int(pdf["shard"].iloc[0])
        return out[["shard", "bin", "bin_start", "doc_id", "doc_start", "size"]]

    # as a number, a null among ids would make floats of them all in pandas
    order = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id", "size"))
    keyed = sharded(sized, shard_items).withColumn("place", order).withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = keyed.groupBy("shard").applyInPandas(run, "shard long, bin long, bin_start long, doc_id string, doc_start long, size long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
