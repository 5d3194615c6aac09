"""Cross-document line frequency.

Lines are normalised (spaces collapsed, lower case), hashed, and counted per host,
here the ``source``, by the number of different documents with them.  Documents of
one and the same text are one document, so that copies don't condemn each other.
A line is boilerplate where more than ``share`` of its host's documents, and more
than ``least`` documents, have it.  Such lines go; a document that keeps less than
``keep`` of its characters is depleted and rejected.

Only hashes are shuffled.  The boilerplate of all hosts, a few lines each, is broadcast
while its measured size allows, and texts stay where they are; beyond, each text travels
once to the boilerplate that it holds.

Cases: a null text or one of white space only has nothing to keep and is rejected;
a null source is a host of its own; empty lines neither count nor go; rows of one id
are separate; ``doc_id`` may be null; other columns are passed on as they are, whatever
their names (a column named like one computed here is kept too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut

SHARE, LEAST, KEEP = 0.02, 10, 0.4


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f]+", " ")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``host, same, line``: the different line hashes of each text, but the empty line's."""
    lines = docs.select("host", "same", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_hash))).alias("line"))
    return lines.where(F.col("line") != F.xxhash64(F.lit("")))


def boilerplate(keyed: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``host, line``: hashes of the lines that are in too many documents of a host."""
    counts = hashed_lines(keyed).groupBy("host", "line").agg(F.countDistinct("same").alias("n")).where(F.col("n") > least)
    hosts = keyed.where("text is not null").groupBy("host").agg(F.countDistinct("same").alias("documents"))
    return counts.join(hosts, "host").where(F.col("n") > F.col("documents") * share).select("host", "line")


def judged(docs: DataFrame, share: float = SHARE, least: int = LEAST, keep: float = KEEP, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``_text`` (what is left of it),
    ``_lines``, ``_removed`` (counts) and ``_rejected``."""
    text = F.col("text").cast("string")
    key = (F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("same"), text.alias("text"))
    keyed = docs.select(*key)
    frequent = cut(boilerplate(keyed, share, least))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(rest, *key)
    # a host has 1 / share times its mean number of lines at most
    by_host = frequent.groupBy("host").agg(F.collect_set("line").alias("bad"))
    size = by_host.agg(F.sum(F.octet_length("host") + F.size("bad") * 8 + 80)).first()[0] or 0
    if size <= broadcast_bytes:
        held = F.transform(F.split("text", "\n"), line_hash)
        met = F.when(F.col("known").isNotNull(), F.array_intersect(held, F.col("known")))
        # exploded, as a projection would be copied into each place that uses it
        joined = rows.join(F.broadcast(by_host.withColumnRenamed("bad", "known")), "host", "left").select("rest", "text", F.explode(F.array(met)).alias("met"))
        found = joined.select("rest", "text", F.when(F.size("met") > 0, F.col("met")).alias("bad"))
    else:
        met = hashed_lines(keyed).join(frequent, ["host", "line"]).groupBy("host", "same").agg(F.collect_set("line").alias("bad"))
        found = rows.join(met.hint("shuffle_merge"), ["host", "same"], "left")
    all_lines = F.split("text", "\n")
    left = F.filter(all_lines, lambda x: ~F.array_contains("bad", line_hash(x)))
    # texts without a hit, by far the most, are passed on as they are
    split = found.select("rest", "text", F.size(all_lines).cast("long").alias("_lines"), F.explode(F.array(F.when(F.col("bad").isNotNull(), left))).alias("left"))
    own = lambda c: F.length(F.translate(c, " \t\n\r\f", ""))
    row = F.struct(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]).alias("row")
    what = F.struct(F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("_text"), F.coalesce(F.col("_lines") - F.size("left"), F.lit(0)).cast("long").alias("_removed"))
    judged_ = split.select(row, "text", "_lines", F.explode(F.array(what)).alias("w")).select("row", "text", "w._text", "_lines", "w._removed")
    depleted = F.when(F.col("_removed") > 0, (own("_text") == 0) | (own("_text") < own("text") * keep)).otherwise(~F.col("_text").rlike(r"[^ \t\n\r\f]"))
    return judged_.select("row", "_text", "_lines", "_removed", F.coalesce(depleted, F.lit(True)).alias("_rejected"))


def quality_rules(docs: DataFrame, share: float = SHARE, least: int = LEAST, keep: float = KEEP, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, source, text, lines, removed_lines`` of the documents that stay."""
    return judged(docs, share, least, keep, broadcast_bytes).where("not _rejected").select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("_text").alias("text"), F.col("_lines").alias("lines"), F.col("_removed").alias("removed_lines"))


_NORM = r"lower(trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g'), ' '))"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(source, '') AS host FROM documents),
l AS (SELECT r, host, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
x AS (SELECT *, {_NORM} AS norm FROM l),
hosts AS (SELECT host, count(DISTINCT text) AS documents FROM d WHERE text IS NOT NULL GROUP BY host),
bad AS (SELECT host, norm, true AS is_bad FROM (SELECT host, norm, count(DISTINCT text) AS n FROM x WHERE norm <> '' GROUP BY host, norm) JOIN hosts USING (host)
        WHERE n > {LEAST} AND n > documents * {SHARE}::DOUBLE),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE is_bad IS NULL) AS left_text, count(*) AS lines, count(is_bad) AS removed
         FROM x LEFT JOIN bad USING (host, norm) GROUP BY r)
SELECT doc_id, source, left_text AS text, lines, removed AS removed_lines FROM d JOIN kept USING (r)
WHERE length(regexp_replace(left_text, '\\s+', '', 'g')) > 0
  AND length(regexp_replace(left_text, '\\s+', '', 'g')) >= length(regexp_replace(text, '\\s+', '', 'g')) * {KEEP}::DOUBLE"""
