"""Row order without a global sort in one task.

``_row`` is a dense number of the data rows.  Neighbours of a row are reached inside
buckets of consecutive rows; each bucket also gets copies of the rows just before and
after it, so that ``lag`` and ``lead`` see across its ends.  Running sums add the totals
of the buckets before.  Either is one shuffle by bucket, whatever the size of the table.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder all executors share; a local one only where
    the session runs in one process and names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_WRITTEN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table of the shared folder: no lineage, nothing to recompute.

    The table is deleted when the driver ends, or before by ``forget``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Tables that ``cut`` made and that still stand, the oldest first."""
    return list(_WRITTEN)


def forget(paths: Iterable[str]) -> None:
    """Delete tables of ``cut`` that no plan reads any more."""
    context = SparkContext._active_spark_context
    for p in paths:
        if p in _WRITTEN:
            _WRITTEN.remove(p)
        if context is not None and context._jsc is not None:
            at = context._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        elif p.startswith("file:"):
            shutil.rmtree(p.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


@atexit.register
def _forget_all() -> None:
    try:
        forget(written())
    except Exception:  # noqa: BLE001  the session is gone; its folder is the cluster's to empty
        return


#: A side is broadcast when its rows, as measured, take up to so many bytes.
BROADCAST_BYTES = 32 << 20


def beside(big: DataFrame, small: DataFrame, on: str | list[str], how: str, row_bytes: int | Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` joined with ``small``: without a shuffle of ``big`` while ``small``, whose
    rows are measured, takes up to ``most`` bytes; else by a shuffled join.

    ``row_bytes`` is what a row takes in memory, an expression where rows differ."""
    size = small.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    if size <= most:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("shuffle_merge"), on, how)


def with_row(df: DataFrame, *keys: str, name: str = "_row") -> DataFrame:
    """``df`` numbered from 0 in the order of ``keys``, which should be unique.

    Ranges are sorted apart; a range's rows are offset by the counts of those before."""
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before")).drop("_at", "_part", "_before")


def neighbours(df: DataFrame, columns: dict[str, Column], row: str = "_row", back: int = 1, ahead: int = 0, size: int = BUCKET) -> DataFrame:
    """``df`` with ``columns``, expressions of ``lag``/``lead`` built by ``over(window)``.

    ``columns`` maps a name to a function's result on the window: pass callables."""
    bucket = F.floor(F.col(row) / size)
    homes = [F.struct(bucket.alias("b"), F.lit(False).alias("h"))]
    at = F.pmod(F.col(row), F.lit(size))
    extra = []
    if back:
        extra.append(F.when(at >= size - back, F.struct((bucket + 1).alias("b"), F.lit(True).alias("h"))))
    if ahead:
        extra.append(F.when(at < ahead, F.struct((bucket - 1).alias("b"), F.lit(True).alias("h"))))
    copies = F.filter(F.array(*homes, *extra), lambda x: x.isNotNull())
    spread = df.withColumn("_home", F.explode(copies)).select("*", F.col("_home.b").alias("_bucket"), F.col("_home.h").alias("_halo")).drop("_home")
    window = Window.partitionBy("_bucket").orderBy(row)
    return spread.select("*", *[make(window).alias(name) for name, make in columns.items()]).where("not _halo").drop("_bucket", "_halo")


def running_sum(df: DataFrame, value: Column, name: str, row: str = "_row", size: int = BUCKET) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row."""
    bucketed = df.withColumn("_v", value).withColumn("_bucket", F.floor(F.col(row) / size))
    totals = bucketed.groupBy("_bucket").agg(F.sum("_v").alias("_t"))
    before = totals.select("_bucket", F.coalesce(F.sum("_t").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_v").over(Window.partitionBy("_bucket").orderBy(row).rowsBetween(Window.unboundedPreceding, 0))
    return bucketed.join(before, "_bucket").withColumn(name, F.col("_before") + within).drop("_v", "_bucket", "_before")
