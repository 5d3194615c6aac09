"""Preference formatting of chosen and rejected conversations.

Both are arrays of turns.  Their longest common prefix of turns, which always
leaves at least the last turn of either, is rendered once as the prompt; the rest
of each is a completion.  A completion's mask lists the half-open character spans
that carry loss: the texts of assistant turns with their end marks.  All of it is
built-in expressions, so it stays in the JVM.

Cases: a null text counts as empty and a null role as ``user``; rows of one
conversation with equal turn numbers go by role, then text, and repeated rows stay
repeated turns; rows without a conversation id belong to none; a conversation
without an assistant turn gives no pair; texts are never cut; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask(turns: Column) -> Column:
    """``start-end`` of each span with loss, joined by commas."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(so_far: Column, turn: Column) -> Column:
        start = so_far["at"] + F.length(turn["role"]) + len(OPEN) + len(CLOSE)
        end = start + F.length(turn["text"]) + len(END)
        span = F.array(F.concat_ws("-", start.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(turn["role"] == LEARNT, F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    return F.aggregate(turns, none, step, lambda x: F.array_join(x["spans"], ","))


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pair_id, prompt, prompt_turns, chosen, chosen_mask, rejected, rejected_mask``.

    ``pairs`` has two arrays of ``struct<role, text>``; a pair with an empty or null
    array is left out.
    """
    clean = lambda c: F.transform(F.col(c), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    two = pairs.select(F.col(id_col).alias("pair_id"), clean(chosen).alias("c"), clean(rejected).alias("r")).where((F.size("c") > 0) & (F.size("r") > 0))
    differs = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False).cast("int") - 1
    most = F.least(F.size("c"), F.size("r")) - 1
    cut = two.withColumn("k", F.when(differs < 0, most).otherwise(F.least(differs, most)))
    rest = lambda c: F.slice(c, F.col("k") + 1, F.size(c) - F.col("k"))
    parts = cut.select("pair_id", "k", F.slice("c", F.lit(1), F.col("k")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select("pair_id", render(F.col("p")).alias("prompt"), F.col("k").cast("long").alias("prompt_turns"), render(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), render(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation with an assistant turn.

    Chosen is the conversation up to its last assistant turn.  Rejected is the same
    with a stale answer there: the previous assistant turn's text or, where there is
    none, an echo of the turn before it (empty, if that is missing too).
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    turns = whole.select(F.col("conv_id").alias("pair_id"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("t"))
    last = F.size("t") - F.array_position(F.reverse(F.transform("t", lambda x: x["role"])), LEARNT).cast("int") + 1
    ended = turns.where(F.exists("t", lambda x: x["role"] == LEARNT)).select("pair_id", F.slice("t", F.lit(1), last).alias("t"))
    before = F.slice("t", F.lit(1), F.size("t") - 1)
    answers = F.filter("before", lambda x: x["role"] == LEARNT)
    stale = F.coalesce(F.try_element_at(answers, F.lit(-1))["text"], F.try_element_at("before", F.lit(-1))["text"], F.lit(""))
    return ended.withColumn("before", before).select("pair_id", F.col("t").alias("chosen"), F.concat("before", F.array(F.struct(F.lit(LEARNT).alias("role"), stale.alias("text")))).alias("rejected"))


SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, max(i) AS n FROM t WHERE role = '{LEARNT}' GROUP BY conv_id),
c AS (SELECT t.*, n.n FROM t JOIN n USING (conv_id) WHERE i <= n),
stale AS (SELECT conv_id, coalesce(arg_max(text, i) FILTER (WHERE role = '{LEARNT}' AND i < n), arg_max(text, i) FILTER (WHERE i = n - 1), '') AS text FROM c GROUP BY conv_id),
piece AS (SELECT conv_id, i, n, '{OPEN}' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM c),
final AS (SELECT c.conv_id, '{OPEN}' || role || '|>' || chr(10) AS head, c.text || '<|end|>' || chr(10) AS yes, stale.text || '<|end|>' || chr(10) AS no
          FROM c JOIN stale USING (conv_id) WHERE i = n)
SELECT final.conv_id AS pair_id,
       coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM piece WHERE piece.conv_id = final.conv_id AND piece.i < piece.n), '') AS prompt,
       n.n - 1 AS prompt_turns,
       head || yes AS chosen, length(head) || '-' || (length(head) + length(yes)) AS chosen_mask,
       head || no AS rejected, length(head) || '-' || (length(head) + length(no)) AS rejected_mask
FROM final JOIN n USING (conv_id)"""
