r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text
is trainable. A turn is written ``<|role|>ROLE<|text|>TEXT<|end|>``. Inside roles and texts each ``<``
that pipes follow gets one pipe more, so ``<|`` before a letter only ever starts a marker; taking that
pipe away again restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"


def escaped(text: Column) -> Column:
    """``text`` with no marker in it."""
    return F.regexp_replace(text, r"<(\|+)", r"<|$1")


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def formatted_turn(turn: Column) -> Column:
    return F.concat(F.lit(ROLE), escaped(turn["role"]), F.lit(TEXT), escaped(turn["text"]), F.lit(END))


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """Training examples: conv_id, alone, example (from 0), formatted, loss_start, loss_chars, last.

    ``formatted`` is a prefix of the conversation; the ``loss_chars`` code points from ``loss_start``
    (from 0) are the escaped reply and the only trainable ones. ``last`` marks the example that holds
    the whole conversation. Turns that follow the last reply come as one context-only example with
    ``loss_chars`` 0, so that no turn is lost.

    Turns are ordered by turn (null first), then role and text. Null roles and texts count as empty, a row
    without a conv_id is a conversation of its own and has a number in ``alone``, repeated rows are turns of their own, an empty table
    has no examples, and other columns are ignored. A conversation is one row here, and its examples
    together are as long as the square of its turns: that is what expanding every prefix means.
    """
    each = conversations.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("turn"),
    )
    turns = each.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    written = turns.select(
        "conv_id", "alone", "turns", F.size("turns").alias("n"), F.transform("turns", formatted_turn).alias("written")
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.col("n")),
        lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == F.col("n")),
    )
    each = written.select("conv_id", "alone", "turns", "n", "written", F.posexplode(ends).alias("example", "i"))
    turn = F.element_at("turns", F.col("i"))
    head = F.concat(
        F.array_join(F.slice("written", F.lit(1), F.col("i") - 1), ""),
        F.lit(ROLE),
        escaped(turn["role"]),
        F.lit(TEXT),
    )
    is_reply = turn["role"] == "assistant"
    reply = escaped(turn["text"])
    return each.select(
        "conv_id",
        "alone",
        F.col("example").cast("long").alias("example"),
        F.concat(head, reply, F.lit(END)).alias("formatted"),
        F.char_length(head).cast("long").alias("loss_start"),
        F.when(is_reply, F.char_length(reply)).otherwise(0).cast("long").alias("loss_chars"),
        (F.col("i") == F.col("n")).alias("last"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescaped(F.substring(F.split(x, r"<\|text\|>", 2)[0], len(ROLE) + 1, 2**31 - 1)).alias("role"),
            unescaped(F.split(x, r"<\|text\|>", 2)[1]).alias("text"),
        ),
    )


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples say when they are read back, one row per conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples. The turns come
    from the example that holds the whole conversation, the trained text from the loss spans of all.
    """
    turns = parsed_turns(F.col("formatted"))
    lines = F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    trained = F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    read = examples.select(
        "conv_id",
        "alone",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.when(F.col("last"), F.size(turns)).cast("long").alias("n_turns"),
        F.when(F.col("last"), F.sha2(lines, 256)).alias("turns_sha256"),
        F.struct("example", unescaped(trained).alias("text")).alias("trained"),
    )
    return (
        read.groupBy("conv_id", "alone")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.array_join(F.transform(F.sort_array(F.collect_list("trained")), lambda x: x["text"]), "").alias("loss"),
            F.sum("formatted_chars").alias("formatted_chars"),
            F.count("*").alias("n_examples"),
        )
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
            "n_examples",
        )
    )


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), u AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM rows_
), t AS (
  SELECT *, length(regexp_replace(role, '<(\|+)', '<|\1', 'g')) + length(regexp_replace(text, '<(\|+)', '<|\1', 'g')) + 23 AS chars,
    row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id, alone) AS n
  FROM u WINDOW o AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id, alone ORDER BY i ROWS UNBOUNDED PRECEDING) AS prefix FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(prefix) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
FROM c GROUP BY conv_id, alone
"""
