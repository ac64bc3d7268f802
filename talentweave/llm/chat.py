"""Preference formatting: a chosen and a rejected conversation share their beginning as one prompt.

The prompt is the longest common prefix of turns, rendered once; what follows in each conversation is its completion. The
mask of a completion is a list of runs "length:learn" in code points, one for the header and one for the body of each
turn; only bodies of assistant turns are learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import NO_ID, order_key, successors
from .scratch import Scratch

END = "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    learn = lambda t: F.when(t["role"].eqNullSafe(F.lit("assistant")), ":1").otherwise(":0")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(_header(t)), F.lit(":0,"), F.length(_body(t)), learn(t))), ",")


def _conversations(turns: DataFrame, name: str) -> DataFrame:
    """One array of turns for each pair: a conversation is one text in the end, so it is one row here."""
    return turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias(name))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) from two tables (pair_id, turn, role, text).

    Turns are ordered by (turn, role, text), repeated rows included; a turn is common if role and text agree, null with
    null. A null role or text is rendered as empty. A pair that one table lacks has an empty conversation there, and equal
    conversations are all prompt with empty completions. Rows without a pair_id are left out of neither table: they form
    one pair. Empty tables give an empty one.
    """
    sides = [x.select(order_key(x["pair_id"]).alias("pair_id"), x["turn"], x["role"], x["text"]) for x in (chosen, rejected)]
    a, b = (_conversations(x, n) for x, n in zip(sides, ("a", "b"), strict=True))
    none = F.array().cast(a.schema["a"].dataType)
    both = a.join(b, "pair_id", "full").select("pair_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    split = both.withColumn("differs", F.array_position(same, F.lit(False))).withColumn("n", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda name: F.expr(f"slice({name}, n + 1, size({name}))")
    return split.select(
        F.when(F.col("pair_id") != NO_ID, F.col("pair_id")).alias("pair_id"),
        F.col("n").cast("long").alias("prompt_turns"),
        _render(F.expr("slice(a, 1, n)")).alias("prompt"),
        _render(rest("a")).alias("chosen"),
        _mask(rest("a")).alias("chosen_mask"),
        _render(rest("b")).alias("rejected"),
        _mask(rest("b")).alias("rejected_mask"),
    )


def with_other_answers(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Rejected conversations for a table without judgements: each conversation, its last assistant turn answered with the
    last assistant turn of the next conversation (by conv_id, after the last the first; empty if that has none)."""
    rows = turns.select(order_key(turns["conv_id"]).alias("key"), "turn", "role", "text")
    last = rows.groupBy("key").agg(F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("last"))
    last = scratch.save(last.select("key", F.col("last.turn").alias("last_turn"), F.coalesce("last.text", F.lit("")).alias("answer")), "answers")
    chain = successors(last, scratch, "chain")
    others = chain.join(last.select(F.col("key").alias("next_key"), F.col("answer").alias("other")), "next_key")
    replies = last.join(others, "key").select("key", "last_turn", "other")
    replaced = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn")), F.col("other")).otherwise(F.col("text"))
    return rows.join(replies, "key").select(F.when(F.col("key") != NO_ID, F.col("key")).alias("pair_id"), "turn", "role", replaced.alias("text"))


ORACLE = """
WITH last_turns AS (
  SELECT conv_id, max(CASE WHEN role = 'assistant' THEN {'turn': turn, 'text': text} END) AS last FROM conversations GROUP BY conv_id),
answers AS (SELECT conv_id, last.turn AS last_turn, coalesce(last.text, '') AS answer FROM last_turns),
replies AS (
  SELECT conv_id, last_turn,
         coalesce(lead(answer) OVER (ORDER BY conv_id), first_value(answer) OVER (ORDER BY conv_id)) AS other
  FROM answers),
chosen AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
rejected AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
  FROM (SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn = r.last_turn THEN r.other ELSE c.text END AS text
        FROM conversations c JOIN replies r USING (conv_id))),
common AS (
  SELECT c.conv_id, count(*) AS turns, min(CASE WHEN c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN c.k END) AS differs
  FROM chosen c JOIN rejected r ON c.conv_id = r.conv_id AND c.k = r.k GROUP BY c.conv_id),
prefix AS (SELECT conv_id, CAST(coalesce(differs - 1, turns) AS BIGINT) AS n FROM common),
parts AS (
  SELECT 'c' AS side, *, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body FROM chosen
  UNION ALL
  SELECT 'r' AS side, *, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body FROM rejected),
rendered AS (
  SELECT conv_id, n, side, k, head || body AS piece,
         length(head) || ':0,' || length(body) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS mask
  FROM parts JOIN prefix USING (conv_id))
SELECT conv_id AS pair_id, n AS prompt_turns,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'c' AND k <= n), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'c' AND k > n), '') AS chosen,
       coalesce(string_agg(mask, ',' ORDER BY k) FILTER (side = 'c' AND k > n), '') AS chosen_mask,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'r' AND k > n), '') AS rejected,
       coalesce(string_agg(mask, ',' ORDER BY k) FILTER (side = 'r' AND k > n), '') AS rejected_mask
FROM rendered GROUP BY conv_id, n
"""
