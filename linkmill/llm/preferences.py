"""Preference formatting of chosen and rejected conversations (operator 4), in DataFrame functions only.

The longest common prefix of turns (equal role and text) is rendered once as the prompt. What follows
on either side is a completion, with a mask of the character spans that carry loss: the text and the
end mark of the assistant's turns. The prompt carries none.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text), so ties and
repeated rows have one order; rows with a null conversation id and conversations that only one side
has are left out; if one side continues the other, the shorter completion is empty; equal sides give
two empty completions; texts of any length are kept whole; empty tables give no rows; other columns,
whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_SPANS = "struct<at:int,spans:array<struct<start:int,stop:int>>>"


def _plain(turns: DataFrame, id_col: str) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)


def conversations(turns: DataFrame, name: str, id_col: str = "conv_id") -> DataFrame:
    """conv_id and the ordered list of (role, text) of each conversation."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return _plain(turns, id_col).groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit("<|end|>\n"))), "")


def loss_spans(turns: Column) -> Column:
    """Character spans of the assistant's texts and end marks within rendered(turns)."""

    def step(done: Column, t: Column) -> Column:
        start = done["at"] + F.char_length(head(t))
        stop = start + F.char_length(t["text"]) + F.lit(len("<|end|>\n"))
        spans = F.when(t["role"] == ASSISTANT, F.array_append(done["spans"], F.struct(start.alias("start"), stop.alias("stop")))).otherwise(done["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")).cast(_SPANS)
    return F.aggregate(turns, none, lambda done, t: step(done, t).cast(_SPANS), lambda done: done["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """Tables of turns (id, turn, role, text). Returns conv_id, n_prompt_turns, prompt, and for both
    sides the completion and its loss spans."""
    pairs = conversations(chosen, "a", id_col).join(conversations(rejected, "b", id_col), "conv_id")
    shorter = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, shorter), F.slice("b", 1, shorter), lambda x, y: x == y)
    first = F.array_position(same, False)
    pairs = pairs.withColumn("n", F.when(first > 0, first - 1).otherwise(shorter.cast("long")).cast("int"))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n") + 1, F.size(side))

    return pairs.select(
        "conv_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("a")).alias("chosen"),
        loss_spans(rest("a")).alias("chosen_spans"),
        rendered(rest("b")).alias("rejected"),
        loss_spans(rest("b")).alias("rejected_spans"),
    )


def shortened_answers(turns: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations: up to the last answer, as it is and cut behind its first
    sentence. Of repeated rows of the last answer only the last one is cut."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = _plain(turns, id_col).groupBy("conv_id").agg(listed.alias("turns"))
    # Turns are numbered by their place, so that of equal ones only the last is cut.
    back = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == ASSISTANT)), True)
    rows = rows.withColumn("last", (F.size("turns") - back).cast("int")).where(back > 0)
    rows = rows.select("conv_id", "last", F.posexplode("turns").alias("turn", "t")).where(F.col("turn") <= F.col("last"))
    cut = F.when(F.col("turn") == F.col("last"), F.substring_index("t.text", ".", 1)).otherwise(F.col("t.text"))
    return rows.select("conv_id", "turn", "t.role", "t.text"), rows.select("conv_id", "turn", "t.role", cut.alias("text"))


def digests(pairs: DataFrame) -> DataFrame:
    """Spans as text, start:stop joined by blanks."""

    def listed(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), " ")

    return pairs.select("conv_id", "n_prompt_turns", "prompt", "chosen", listed("chosen_spans").alias("chosen_mask"), "rejected", listed("rejected_spans").alias("rejected_mask"))


#: The same for shortened_answers() in DuckDB SQL.
SQL = """
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows),
last AS (SELECT conv_id, max(k) AS last FROM numbered WHERE role = 'assistant' GROUP BY conv_id),
sides AS (
  SELECT n.conv_id, k, role, text AS a, CASE WHEN k = last THEN split_part(text, '.', 1) ELSE text END AS b, last
  FROM numbered n JOIN last l ON n.conv_id = l.conv_id WHERE k <= last),
prompts AS (SELECT conv_id, coalesce(min(CASE WHEN a <> b THEN k END) - 1, max(last)) AS n FROM sides GROUP BY conv_id),
placed AS (
  SELECT s.*, p.n, length('<|' || role || '|>' || chr(10)) AS h,
    coalesce(sum(length('<|' || role || '|>' || chr(10) || a) + 8) OVER w, 0)::BIGINT AS at_a,
    coalesce(sum(length('<|' || role || '|>' || chr(10) || b) + 8) OVER w, 0)::BIGINT AS at_b
  FROM sides s JOIN prompts p ON s.conv_id = p.conv_id
  WINDOW w AS (PARTITION BY s.conv_id, k <= p.n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, any_value(n)::BIGINT AS n_prompt_turns,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || a || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k <= n), '') AS prompt,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || a || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k > n), '') AS chosen,
  coalesce(string_agg((at_a + h)::VARCHAR || ':' || (at_a + h + length(a) + 8)::VARCHAR, ' ' ORDER BY k) FILTER (k > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || b || '<|end|>' || chr(10), '' ORDER BY k) FILTER (k > n), '') AS rejected,
  coalesce(string_agg((at_b + h)::VARCHAR || ':' || (at_b + h + length(b) + 8)::VARCHAR, ' ' ORDER BY k) FILTER (k > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
