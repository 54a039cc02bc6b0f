"""Preference formatting: shared prompt, and the chosen and rejected completions with masks.

A pair names a chosen and a rejected conversation.  Their turns are put in order (turn
number, then role and text where a number repeats).  The longest common prefix of the two
is the prompt; it is rendered once.  What follows on either side is that side's completion.
The result has one row per rendered turn, so a conversation of any length is never one row
or one task: ``part`` is prompt, chosen or rejected, ``turn`` orders the rows of a part,
``rendered`` is the turn in the chat template, and ``loss`` is its mask: true for turns of
the trained role in a completion, false for the prompt and everything else.

The common prefix needs no ordering of whole conversations.  Turns of a pair are grouped by
(turn, role, text), which tells the sides that hold them; the prefix ends at the least
(turn, role, text) that one side lacks.

A pair of which one side has no turns gives the other side as completion, without a prompt.
Two equal conversations are all prompt.  Null roles render as ``unknown``, null texts as
empty, null turns come first.  Repeated rows are one turn.  Turns without a conversation and
pairs without an id or of a conversation with itself are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import table
from postlens.llm.registry import register

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def preferences(turns: DataFrame, pairs: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text", trained: str = TRAINED) -> DataFrame:
    """turns, pairs(pair_id, chosen_id, rejected_id) -> pair_id, part, turn, role, text,
    rendered, loss."""
    sides = pairs.where("pair_id is not null and not chosen_id <=> rejected_id").select(
        "pair_id", F.explode(F.array(F.struct(F.col("chosen_id").alias("conv"), F.lit(True).alias("chosen")),
                                     F.struct(F.col("rejected_id").alias("conv"), F.lit(False).alias("chosen")))).alias("s"))
    sides = sides.select("pair_id", "s.conv", "s.chosen").distinct()
    said = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = (said.join(sides, "conv").groupBy("pair_id", "turn", "role", "text")
            .agg(F.bool_or("chosen").alias("c"), F.bool_or(~F.col("chosen")).alias("r")))
    place = F.struct("turn", "role", "text")
    ends = (held.where("not (c and r)").groupBy("pair_id").agg(F.min(place).alias("end")))
    rows = held.join(ends, "pair_id", "left")
    shared = F.col("c") & F.col("r") & (F.col("end").isNull() | (place < F.col("end")))
    parts = F.when(shared, F.array(F.lit("prompt"))).otherwise(F.array_compact(F.array(
        F.when(F.col("c"), F.lit("chosen")), F.when(F.col("r"), F.lit("rejected")))))
    return rows.select(
        "pair_id", F.explode(parts).alias("part"), "turn", "role", "text",
        F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)).alias("rendered")).withColumn(
        "loss", (F.col("part") != "prompt") & (F.col("role") == trained))


_SQL = """
WITH said AS (
  SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), held AS (
  SELECT pair_id, turn, role, text, bool_or(chosen) AS c, bool_or(NOT chosen) AS r
  FROM said GROUP BY ALL
), placed AS (
  SELECT *, coalesce(bool_or(NOT (c AND r)) OVER (
    PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS past
  FROM held
), parts AS (
  SELECT *, 'prompt' AS part FROM placed WHERE NOT past
  UNION ALL SELECT *, 'chosen' FROM placed WHERE past AND c
  UNION ALL SELECT *, 'rejected' FROM placed WHERE past AND r
)
SELECT pair_id, part, turn, role, text,
       '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS loss
FROM parts
"""


@register("op1_preferences", _SQL)
def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of even id as chosen against the one of the next id as rejected."""
    turns = table(spark, sf_dir, "conversations")
    ids = turns.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).alias("pair_id")).distinct()
    pairs = ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
    return preferences(turns, pairs)
