"""The stateless repair of cells, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as X
from ..operators.local import canonical_cell

SHARE = 0.995


def boolean_columns(wide: DataFrame, columns: list[str]) -> list[str]:
    """Columns of which all rows, two values at least and but for a few, are boolean words."""
    r = wide.agg(*[F.count_if(X.strip(F.col(c)) != "").alias(f"n{i}") for i, c in enumerate(columns)], *[F.count(X.boolean_word(F.col(c))).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[f"n{i}"] >= 2 and r[f"b{i}"] >= SHARE * r[f"n{i}"]]


def repaired(df: DataFrame, columns: list[str], booleans: list[str]) -> DataFrame:
    """One projection; it holds for batches and streams alike."""
    return df.select(*[canonical_cell(F.col(c), c in booleans).alias(c) if c in columns else F.col(c) for c in df.columns])


def journal(before: DataFrame, columns: list[str], booleans: list[str]) -> DataFrame:
    """``_row, column, old, new`` of each cell that the repair changes."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("old"), canonical_cell(F.col(c), c in booleans).alias("new")) for c in columns])
    return before.select("_row", F.inline(cells)).where("old <> new")


def undo(after: DataFrame, edits: DataFrame) -> DataFrame:
    from ..operators import overlay

    return overlay.apply(after, edits.select(F.lit("set_cell").alias("kind"), "_row", "column", F.col("new").alias("old"), F.col("old").alias("new")))


def digest(df: DataFrame) -> str:
    """Of the rows in their order: a hash of each row, folded by range, then over the ranges."""
    names = [c for c in df.columns if c != "_row"]
    row = F.sha2(F.concat_ws("", *[F.concat(F.length(F.coalesce(F.col(c), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c), F.lit(""))) for c in names]), 256)
    parts = df.select(F.floor(F.col("_row") / 65536).alias("b"), "_row", row.alias("h")).groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256)).first()[0]


def start(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, columns: list[str], booleans: list[str], dedup: tuple[list[str], str, str] | None = None) -> StreamingQuery:
    """Parquet files as they come, repaired and appended to ``sink``.

    ``dedup``: key columns, a time column and how late a copy may come; beyond that
    a key is forgotten, so that the state is bounded."""
    df = spark.readStream.schema(schema).parquet(source)
    out = repaired(df, columns, booleans)
    if dedup:
        keys, time, late = dedup
        out = out.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
