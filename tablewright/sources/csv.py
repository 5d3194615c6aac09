"""Strict CSV in and out.

The contract: UTF-8, a header row, one of ``, ; tab |`` as delimiter, ``"`` as quote.
Rows may be ragged: they come as ``_row, _cells`` and are widened apart.  Anything that
isn't valid raises.  Files without a quote character are split and read in parallel, the
row numbers by a count of the rows in the splits before; others are read a file a task.
"""

from __future__ import annotations

import csv
import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DELIMITERS = tuple(",;\t|")
PROBE = 1 << 16
csv.field_size_limit(1 << 30)


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    lineterminator: str = "\n"
    bom: bool = False
    quoted: bool = False
    encoding: str = "utf-8"

    def contract(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "quoted"}


def line_terminator(text: str) -> str:
    pairs, returns, feeds = (text.count(x) for x in ("\r\n", "\r", "\n"))
    if pairs:
        return "\r\n"
    return "\r" if returns and not feeds else "\n"


def delimiter_of(text: str) -> str:
    """The delimiter that parses to the most regular table of several columns."""
    best, choice = None, None
    for d in DELIMITERS:
        try:
            rows = [r for r in csv.reader(text.splitlines(keepends=True), delimiter=d, strict=True) if r]
        except csv.Error:
            continue
        if not rows:
            continue
        widths = Counter(map(len, rows))
        rank = (len(rows[0]) > 1, widths[len(rows[0])] / len(rows), max(widths.values()) / len(rows), min(len(rows[0]), 1024), len(rows))
        if best is None or rank > best:
            best, choice = rank, d
    if choice is not None and best[0]:
        return choice
    try:
        return csv.Sniffer().sniff(text, "".join(DELIMITERS)).delimiter
    except csv.Error:
        return ","


def probe(path: str) -> tuple[Dialect, list[str]]:
    """Dialect and header by the first 64 KiB; ``ValueError`` for what isn't UTF-8."""
    with open(path, "rb") as f:
        raw = f.read(PROBE)
        whole = len(raw) < PROBE
        rest = b""
        while chunk := f.read(1 << 20):
            rest = rest or (b'"' if b'"' in chunk else b"")
    bom = raw.startswith(b"\xef\xbb\xbf")
    body = raw[3:] if bom else raw
    if not whole:
        body = body[: max(body.rfind(b"\n"), body.rfind(b"\r")) + 1] or body
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError(f"{path}: not UTF-8 at byte {e.start}") from e
    d = delimiter_of(text)
    header = next(csv.reader(text.splitlines(keepends=True), delimiter=d), [])
    return Dialect(d, line_terminator(text), bom, '"' in text or bool(rest)), header


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def records(path: str, dialect: Dialect) -> Iterator[list[str]]:
    """All records after the header; an error names its line."""
    with open(path, encoding="utf-8-sig" if dialect.bom else "utf-8", newline="") as f:
        reader = csv.reader(f, delimiter=dialect.delimiter, strict=True)
        try:
            next(reader, None)
            for r in reader:
                if r:
                    yield r
        except csv.Error as e:
            raise ValueError(f"{path}: line {reader.line_num}: {e}") from e
        except UnicodeDecodeError as e:
            raise ValueError(f"{path}: not UTF-8 after line {reader.line_num}") from e


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        dialect, _ = probe(partition.value)
        for i, cells in enumerate(records(partition.value, dialect)):
            yield partition.value, i, cells


class StrictCsv(DataSource):
    """``spark.read.format("strict_csv").option("paths", json list)``; a task for each file."""

    @classmethod
    def name(cls) -> str:
        return "strict_csv"

    def schema(self) -> str:
        return "file string, _row bigint, _cells array<string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(json.loads(self.options["paths"]))


def read_raw(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], Dialect]:
    """``_row, _cells`` of one file, its header and its dialect."""
    dialect, header = probe(path)
    if dialect.quoted or dialect.lineterminator == "\r":
        spark.dataSource.register(StrictCsv)
        return spark.read.format("strict_csv").option("paths", json.dumps([path])).load().select("_row", "_cells"), header, dialect
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = sizes.select("_block", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = lines.join(F.broadcast(before), "_block").select((F.col("_id") - F.col("_first") + F.col("_before") - 1).alias("_row"), F.regexp_replace("value", "\r$", "").alias("value"))
    return numbered.where("_row >= 0 and value <> ''").select("_row", F.split("value", f"\\Q{dialect.delimiter}\\E", -1).alias("_cells")), header, dialect


def read_wide(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], Dialect]:
    """``_row`` and a text column for each header; a row's missing cells are NULL."""
    raw, header, dialect = read_raw(spark, path)
    return widen(raw, header), header, dialect


def widen(raw: DataFrame, header: list[str]) -> DataFrame:
    seen: Counter = Counter()
    names = []
    for i, h in enumerate(header):
        base = h or f"column_{i + 1}"
        seen.update([base])
        names.append(f"{base}__{seen[base]}" if seen[base] > 1 else base)
    return raw.select("_row", *[F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def shape_issues(raw: DataFrame, header: list[str]) -> DataFrame:
    """``_row, actual, expected`` of rows of another width than the header."""
    return raw.select("_row", F.size("_cells").cast("long").alias("actual"), F.lit(len(header)).cast("long").alias("expected")).where("actual <> expected")


def header_issues(header: list[str]) -> list[tuple[str, int, str, str | None]]:
    """``code, column, value, expected`` of what is wrong with the header alone."""
    if not header:
        return [("missing_header", 0, "", None)]
    out = []
    seen: dict[str, int] = {}
    for i, h in enumerate(header):
        if h in seen:
            out.append(("duplicate_column_name", i, h, None))
        seen.setdefault(h, i)
        t = h.strip()
        if t != h:
            out.append(("header_outer_whitespace", i, h, t if t and t not in header and [x.strip() for x in header].count(t) == 1 else None))
    return out


def write_exact(wide: DataFrame, header: list[str], dialect: Dialect, path: str) -> str:
    """One file in the dialect it came in, through the driver a row at a time; its SHA-256.

    Written beside and moved into place, so that a reader never sees half a file."""
    names = [c for c in wide.columns if c != "_row"]
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8-sig" if dialect.bom else "utf-8", newline="") as f:
        w = csv.writer(f, delimiter=dialect.delimiter, lineterminator=dialect.lineterminator, quoting=csv.QUOTE_MINIMAL)
        w.writerow(header)
        for r in wide.orderBy("_row").select(names).toLocalIterator(prefetchPartitions=True):
            cells = list(r)
            while cells and cells[-1] is None:
                cells.pop()
            w.writerow(["" if c is None else c for c in cells])
    os.replace(part, path)
    return sha256(path)


def write_parts(wide: DataFrame, dialect: Dialect, path: str) -> None:
    """A folder of CSV parts in row order, written by the executors."""
    wide.repartitionByRange("_row").sortWithinPartitions("_row").drop("_row").write.mode("overwrite").csv(path, sep=dialect.delimiter, header=True, quote='"', escape='"', lineSep=dialect.lineterminator, emptyValue="")
