"""Preference formatting: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAINED = ("assistant",)


def turns_of(df: DataFrame, side: int) -> DataFrame:
    return df.select(F.col("pair_id").cast("long").alias("pair_id"), F.lit(side).alias("side"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("t"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """pair_id, n_prefix, prompt, chosen, rejected, chosen_spans and rejected_spans of conversations given as turns
    (pair_id, turn, role, text).

    The longest common prefix of turns (equal role and text) is rendered once as prompt, the rest of each side as its
    completion: `<|role|>`, line break, text, line break for each turn. A completion's spans (start, length) are the
    characters that count for the loss, the texts of the `trained` roles; the prompt has none. One shuffle by pair; a
    pair's row holds its two conversations, as the rendered row does.
    Null role or text counts as empty; turns go by number (null first), ties by role, then text; repeated turns stay. A
    null pair_id is a pair of its own. A pair with turns on one side only has an empty other side. Empty tables: no
    rows. Other columns are not read.
    """
    both = turns_of(chosen, 0).unionAll(turns_of(rejected, 1)).groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("t")))).alias(name)
          for side, name in enumerate(("c", "r"))])
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.size("c"), F.size("r"), F.lit(1))), lambda i: F.coalesce(
        (F.get(F.col("c"), i - 1)["role"] == F.get(F.col("r"), i - 1)["role"])
        & (F.get(F.col("c"), i - 1)["text"] == F.get(F.col("r"), i - 1)["text"]), F.lit(False)))
    both = both.withColumn("same", same)
    first = F.array_position("same", False)
    both = both.withColumn("n_prefix", F.when(first == 0, F.size("c")).otherwise(first - 1).cast("int"))

    def head(t):
        return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))

    def render(turns):
        return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit("\n"))), "")

    def rest(side):
        return F.slice(F.col(side), F.col("n_prefix") + 1, F.size(side))

    def spans(turns):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found"))
        return F.aggregate(turns, start, lambda acc, t: F.struct(
            (acc["at"] + F.length(head(t)) + F.length(t["text"]) + 1).alias("at"),
            F.when(t["role"].isin(*trained), F.array_append(acc["found"], F.struct(
                (acc["at"] + F.length(head(t))).alias("start"), F.length(t["text"]).alias("length")))).otherwise(acc["found"]).alias("found"),
        ), lambda acc: acc["found"])

    return both.select(
        "pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), render(F.slice(F.col("c"), 1, F.col("n_prefix"))).alias("prompt"),
        render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"),
        spans(rest("c")).alias("chosen_spans"), spans(rest("r")).alias("rejected_spans"))


def last_answer_replaced(conversations: DataFrame) -> DataFrame:
    """Rejected conversations: the last assistant turn has the text of the assistant turn before it (none: empty)."""
    order = [F.col("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    by = Window.partitionBy("pair_id", "answer").orderBy(*order)
    df = conversations.withColumn("answer", F.coalesce(F.col("role") == "assistant", F.lit(False)))
    df = df.withColumn("before", F.lag(F.coalesce("text", F.lit(""))).over(by)).withColumn("after", F.lead(F.lit(1)).over(by))
    return df.withColumn("text", F.when(F.col("answer") & F.col("after").isNull(), F.coalesce("before", F.lit(""))).otherwise(F.col("text")))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of the table's conversations and the same with the last answer replaced, spans as texts `start+length`."""
    chosen = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    pairs = preference_pairs(chosen, last_answer_replaced(chosen))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")

    return pairs.select(F.col("pair_id").alias("conv_id"), "n_prefix", "prompt", "chosen", "rejected",
                        shown(F.col("chosen_spans")).alias("chosen_spans"), shown(F.col("rejected_spans")).alias("rejected_spans"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations
), a AS (
  SELECT *, lag(text) OVER w AS before, lead(1) OVER w AS after
  FROM t WINDOW w AS (PARTITION BY conv_id, role = 'assistant' ORDER BY k)
), r AS (
  SELECT *, CASE WHEN role = 'assistant' AND after IS NULL THEN coalesce(before, '') ELSE text END AS other FROM a
), f AS (
  SELECT *, coalesce(min(CASE WHEN text <> other THEN k END) OVER (PARTITION BY conv_id), 1 + max(k) OVER (PARTITION BY conv_id)) AS cut
  FROM r
), g AS (
  SELECT *, '<|' || role || '|>' || chr(10) AS head FROM f
), p AS (
  SELECT *,
         coalesce(sum(length(head) + length(text) + 1) OVER w, 0) AS at_c,
         coalesce(sum(length(head) + length(other) + 1) OVER w, 0) AS at_r
  FROM g WINDOW w AS (PARTITION BY conv_id, k >= cut ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, CAST(max(cut) - 1 AS BIGINT) AS n_prefix,
       coalesce(string_agg(head || text || chr(10), '' ORDER BY k) FILTER (k < cut), '') AS prompt,
       coalesce(string_agg(head || text || chr(10), '' ORDER BY k) FILTER (k >= cut), '') AS chosen,
       coalesce(string_agg(head || other || chr(10), '' ORDER BY k) FILTER (k >= cut), '') AS rejected,
       coalesce(string_agg(CAST(at_c + length(head) AS VARCHAR) || '+' || CAST(length(text) AS VARCHAR), ',' ORDER BY k)
                FILTER (k >= cut AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(CAST(at_r + length(head) AS VARCHAR) || '+' || CAST(length(other) AS VARCHAR), ',' ORDER BY k)
                FILTER (k >= cut AND role = 'assistant'), '') AS rejected_spans
FROM p GROUP BY conv_id
"""
