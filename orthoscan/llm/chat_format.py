"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
the context, and only the reply's text is under the loss mask.  The examples
of a conversation are prefixes of one formatted transcript, so until they are
exploded they are kept as spans of it (end, loss start, loss length);
``examples`` explodes them, one row each with its own text, and what is read
back is read from these rows.  A conversation whose last turn isn't the
assistant's ends with an example without a mask, so that no turn is lost.

Template: [INST]role\\ntext[/INST] for other roles, <s>role\\ntext</s> for the
assistant.  Control strings inside texts and roles get a backslash after their
first character, which is taken out again when read; a role's % and line
breaks are written %25 and %0A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoscan.llm.common import table

TARGET_ROLE = "assistant"
_ESCAPE = r"([\[<])(\\*)(/?(?:INST\]|s>))"
_UNESCAPE = r"([\[<])\\(\\*)(/?(?:INST\]|s>))"
_TURN = r"(?:\[INST\]|<s>)([^\n]*)\n((?s:.*?))(?:\[/INST\]|</s>)"


def escape(text: Column) -> Column:
    """Break control strings, reversibly: the result holds none of them."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, examples.

    ``examples`` are structs in order: turn, end (the example's text is the
    first ``end`` code points of ``formatted``), loss_start and loss_chars (the
    masked span; length 0 in the last one of a conversation that doesn't end
    with the assistant).

    Turns are ordered by turn, then role and text, nulls first; repeated rows
    are turns of their own.  Null texts and roles count as empty, a null
    conv_id is a conversation like any other, extra columns are ignored.  An
    empty table gives no row.
    """
    raw = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    target = F.col("role") == TARGET_ROLE
    head = F.concat(F.when(target, "<s>").otherwise("[INST]"), _escape_role(F.col("role")), F.lit("\n"))
    parts = raw.select("conv_id", "turn", "role", "text", target.alias("target"), head.alias("head"), escape(F.col("text")).alias("body"), F.when(target, "</s>").otherwise("[/INST]").alias("foot"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = F.char_length("head") + F.char_length("body") + F.char_length("foot")
    placed = parts.withColumns({"nth": F.row_number().over(order), "has_next": F.lead(F.lit(1)).over(order), "end": F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("end") - F.char_length("foot") - F.char_length("body")
    example = F.struct("turn", "end", F.when(F.col("target"), start).otherwise(F.col("end")).alias("loss_start"), F.when(F.col("target"), F.char_length("body").cast("long")).otherwise(F.lit(0).cast("long")).alias("loss_chars"))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", F.concat("head", "body", "foot").alias("segment")))), lambda x: x["segment"]), "").alias("formatted"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("target") | F.col("has_next").isNull(), F.struct("nth", example.alias("example"))))), lambda x: x["example"]).alias("examples"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """A row an example: conv_id, nth (from 0), turn, text, loss_start, loss_chars, last (of its conversation)."""
    each = formatted.select("conv_id", "formatted", F.size("examples").alias("many"), F.posexplode("examples").alias("nth", "e"))
    return each.select("conv_id", "nth", "e.turn", F.expr("left(formatted, e.end)").alias("text"), "e.loss_start", "e.loss_chars", (F.col("nth") + 1 == F.col("many")).alias("last"))


def turns_of(text: Column) -> Column:
    """The turns of an example's text: array<struct<role, text>>."""
    role, body = (F.regexp_extract_all(text, F.lit(_TURN), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(role.alias("role"), body.alias("text")), lambda t: F.struct(_unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def read_back(exploded: DataFrame) -> DataFrame:
    """Read conversations from their ``examples``: conv_id, turns (of the last example), masked (what each example's mask holds), formatted_chars."""
    masked = unescape(F.col("text").substr(F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    return exploded.select("conv_id", "nth", masked.alias("masked"), F.char_length("text").alias("chars"), F.when(F.col("last"), turns_of(F.col("text"))).alias("turns")).groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "masked"))), lambda x: x["masked"]).alias("masked"),
        F.sum("chars").alias("formatted_chars"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(examples(format_chats(chats)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("all_turns"), F.array_join("masked", "").alias("masked"), "formatted_chars").select(
        "conv_id", "n_turns", F.sha2("all_turns", 256).alias("turns_sha256"), F.char_length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars",
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (
  SELECT *, lead(1) OVER w IS NULL AS last_turn,
         sum(CASE WHEN role = 'assistant' THEN 8 ELSE 14 END
             + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([\[<])(\\*)(/?(?:INST\]|s>))', '\1\\\2\3', 'g'))
             + length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST\]|s>))', '\1\\\2\3', 'g'))) OVER w AS ends
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(ends) FILTER (WHERE role = 'assistant' OR last_turn), 0)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
