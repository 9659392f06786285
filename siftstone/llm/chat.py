"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, its own text as the only trainable span. Turns after the last assistant
turn form one more example without a trainable span, so that nothing of a conversation is lost.

Template: a turn is ``<s>role NEWLINE text</s>``. Inside roles and texts ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and ``&lb;`` (a line break
in a role ``&nl;``), so no control string of this or a bracketed template can occur in them, and unescaping gives back every text.

An example holds its whole prefix by definition, so a conversation has to fit one row; its examples are made one after another from that row, never
all at once, and what is read back of them is reduced in the same task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: fixed values: character, its escape
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("\n", "&nl;"))


def escape(text: Column, role: bool = False) -> Column:
    for raw, safe in ESCAPES[: 4 if role else 3]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for raw, safe in reversed(ESCAPES[: 4 if role else 3]):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def block_of(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, True), F.lit("\n"), escape(text), F.lit(CLOSE))


def prefix_examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, turns (how many it spans), formatted, loss_start, loss_end (code points from 0, null without target), last.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, role, text with nulls first; null roles and texts are
    empty; repeated rows are repeated turns; a null conv_id is a conversation of its own. Empty tables give no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.col("role").alias("r"), F.col("text").alias("t"), (role == "assistant").alias("target"), block_of(role, text).alias("block"), F.length(escape(text)).alias("size")).alias("x"),
    )
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    n = F.size("xs")
    place = F.explode(F.sequence(F.lit(1), n))
    each = conv.select("conv_id", "xs", n.alias("n"), place.alias("i"))
    x = F.element_at("xs", F.col("i"))
    last = F.col("i") == F.col("n")
    each = each.where(x["target"] | last).withColumn("x", x).withColumn("last", last)
    formatted = F.array_join(F.transform(F.slice("xs", F.lit(1), F.col("i")), lambda y: y["block"]), "")
    each = each.select("conv_id", "i", "last", F.col("x.target").alias("target"), F.col("x.size").alias("size"), formatted.alias("formatted"))
    end = F.length("formatted") - F.lit(len(CLOSE))
    return each.select(
        "conv_id",
        F.col("i").alias("turns"),
        "formatted",
        F.when(F.col("target"), end - F.col("size")).alias("loss_start"),
        F.when(F.col("target"), end).alias("loss_end"),
        "last",
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    parts = F.slice(F.split(formatted, CLOSE, -1), F.lit(1), F.size(F.split(formatted, CLOSE, -1)) - 1)
    one = lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1), True).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
    )
    return F.transform(parts, one)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """Unescaped text under the loss mask; empty without one."""
    return F.coalesce(unescape(F.substr(formatted, start + 1, end - start)), F.lit(""))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    per = examples.select(
        "conv_id",
        "turns",
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), F.col("formatted")).alias("whole"),
    )
    conv = per.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turns", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole")
    )
    turns = read_turns(F.col("whole"))
    loss = F.array_join(F.transform("losses", lambda y: y["loss"]), "")
    lines = F.array_join(F.transform("turns", lambda y: F.concat(y["role"], F.lit("\n"), y["text"], F.lit("\n"))), "")
    conv = conv.select("conv_id", "formatted_chars", turns.alias("turns"), loss.alias("loss"))
    return conv.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT conv_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text,
  sum(8 + length(replace({_ESC.format("coalesce(role, '')")}, chr(10), '&nl;')) + length({_ESC.format("coalesce(text, '')")})) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id"""
