"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of turns (same role and text, from the first turn on) is rendered once as the prompt.
What follows in either conversation is its completion. A completion's mask is a list of character spans [start, end) over
prompt + completion that a loss may count: the texts of assistant turns (with their end mark) after the prompt. The
prompt is fully masked. Rendering: ``<|role|>\\n`` text ``<|end|>\\n`` for each turn.

Only a conversation's own turns are brought together, to be rendered as one row; all else is row by row. A conversation is held whole, as
one array and one string, by the task that renders it: Spark's 2 GB for a value is the limit of a conversation's text.
``swapped_answers`` gives rejected conversations where a table holds no verdicts: each conversation with its last
assistant text replaced by that of the conversation with the next id.

Defined results: null role or text count as empty strings; turns are in order of ``turn`` (null first), ties by role and
text; exact repeats of a turn row count once; conversations with a null id take no part; if one side has no rows,
the prefix is empty and its completion is the empty string with no spans; equal conversations give two empty
completions; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, BREAK, TAIL = "<|", "|>\n", "<|end|>\n"


def clean_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, place, role, text)`` with places from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return rows.select("conv_id", place.cast("long").alias("place"), "role", "text")


def swapped_answers(turns: DataFrame) -> DataFrame:
    """:func:`clean_turns` rows with each last assistant text taken from the next id's conversation.

    Without such a conversation, or one without an assistant turn, that turn is left out.
    """
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("place", "text")).alias("last"))
    given = answers.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    swaps = answers.select("conv_id", F.col("last.place").alias("swap")).join(given, "conv_id", "left")
    rows = turns.join(swaps, "conv_id", "left")
    text = F.when(F.col("place") == F.col("swap"), F.col("other")).otherwise(F.col("text"))
    return rows.select("conv_id", "place", "role", text.alias("text")).where("text is not null")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(BREAK), t["text"], F.lit(TAIL))), "")


def _spans(prompt: Column, turns: Column) -> Column:
    """Character spans of assistant texts, counted from the start of the prompt."""
    start = F.struct(F.length(prompt).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        text_at = acc["at"] + len(HEAD) + F.length(t["role"]) + len(BREAK)
        end = text_at + F.length(t["text"]) + len(TAIL)
        counted = F.when(t["role"] == "assistant", F.array(F.struct(text_at.cast("long").alias("start"), end.cast("long").alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["spans"], counted).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per conv_id: n_common, prompt, and each side's completion and mask spans.

    Both sides have the columns of :func:`clean_turns`, with one conv_id for the two conversations of a pair.
    """
    sides = [
        df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias(f"{side}_turns"))
        for side, df in (("chosen", chosen), ("rejected", rejected))
    ]
    none = F.array().cast("array<struct<place:bigint,role:string,text:string>>")
    both = sides[0].join(sides[1], "conv_id", "full")
    both = both.withColumns({f"{s}_turns": F.coalesce(f"{s}_turns", none) for s in ("chosen", "rejected")})
    shorter = F.least(F.size("chosen_turns"), F.size("rejected_turns"))
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_other = F.array_position(same, False).cast("int")
    both = both.withColumn("n_common", F.when(first_other > 0, first_other - 1).otherwise(shorter))
    both = both.withColumn("prompt", _render(F.slice("chosen_turns", F.lit(1), F.col("n_common"))))
    for side in ("chosen", "rejected"):
        rest = F.slice(f"{side}_turns", F.col("n_common") + 1, F.greatest(F.size(f"{side}_turns"), F.lit(1)))
        both = both.withColumn(f"{side}_completion", _render(rest)).withColumn(f"{side}_spans", _spans(F.col("prompt"), rest))
    return both.select("conv_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_completion", "rejected_completion", "chosen_spans", "rejected_spans")
