"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context and only that reply trainable.
Turns after the last reply (or all, where there is none) become one example without a trainable part, so that the
output holds every turn. A turn is written <|turn|>ROLE<|says|>TEXT<|end|>\\n; in roles and texts a backslash becomes
two, and <| becomes <\\|, so control strings of the template can't occur inside them and all of it can be read back.

The whole context is part of each example by definition, so a conversation's turns meet in one row; one shuffle by
conversation, none for the expansion.

Edge cases: null texts and roles are empty; turns are ordered by turn (null first), then role and text; repeated rows
are turns of their own; a null conv_id is one conversation; an empty table gives no examples. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _header(turn: Column) -> Column:
    return F.concat(F.lit(TURN), escape(turn["role"]), F.lit(SAYS))


def _whole(turn: Column) -> Column:
    return F.concat(_header(turn), escape(turn["text"]), F.lit(END))


def examples(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (the target's place among the turns, from 1), trainable, formatted, loss_start and loss_chars (code points of formatted, from 0)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    talks = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    talks = talks.withColumn("written", F.transform("turns", _whole))
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), n), lambda k: (F.element_at("turns", k)["role"] == "assistant") | (k == n))
    each = talks.select("conv_id", "turns", "written", F.explode(targets).alias("example"))
    target = F.element_at("turns", F.col("example"))
    trainable = target["role"] == "assistant"
    before = F.array_join(F.slice("written", F.lit(1), F.when(trainable, F.col("example") - 1).otherwise(F.col("example"))), "")
    context = F.when(trainable, F.concat(before, _header(target))).otherwise(before)
    reply = F.when(trainable, escape(target["text"])).otherwise(F.lit(""))
    made = each.select("conv_id", "example", trainable.alias("trainable"), context.alias("_context"), reply.alias("_reply"))
    return made.select(
        "conv_id", "example", "trainable",
        F.concat("_context", "_reply", F.when(F.col("trainable"), F.lit(END)).otherwise(F.lit(""))).alias("formatted"),
        F.length("_context").cast("long").alias("loss_start"),
        F.length("_reply").cast("long").alias("loss_chars"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted example."""
    parts = F.split(formatted, r"<\|end\|>\n")
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), SAYS, 1)).alias("role"), unescape(F.substr(p, F.instr(p, SAYS) + len(SAYS))).alias("text")),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """What the loss mask covers, read back."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), chars.cast("int")))


def digest(made: DataFrame) -> DataFrame:
    """A row for each conversation, from its examples alone."""
    kept = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.sort_array(F.collect_list(F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")))).alias("parts"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = kept.withColumn("turns", turns_of(F.col("last")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trick = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(trick).alias("text"),
    )
    return digest(examples(rows.unionByName(more)))


#: A turn is len(escaped role + escaped text) + 24 characters long in the template.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR k = n) AS n_examples
FROM c GROUP BY conv_id
"""
