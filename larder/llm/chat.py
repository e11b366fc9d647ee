"""Chat formatting with DataFrame expressions only.

A turn reads <|im_start|>role NEWLINE text<|im_end|> NEWLINE. Adjacent turns of
one role share one block, their texts divided by <|part|>. A backslash in a text
or role is doubled and every "<|" becomes "<\\|", so control strings inside texts
are ordinary text and reading back is exact; a newline in a role is <|nl|>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP, PART, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|part|>", "<|nl|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _merged(turns: Column, starts: Column) -> Column:
    """array<struct<role, parts>> of sorted turns: the turns from each start to the next in one element."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(turns)))
    return F.zip_with(
        starts, ends, lambda a, b: F.struct(F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("parts"))
    )


def _starts(turns: Column) -> Column:
    """Where a turn has another role than the one before it; the time is linear in the turns."""
    return F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))


def _pieces(blocks: Column) -> Column:
    """array<struct<s, loss>>: the strings of the output in order, and whether they lie under the loss mask."""

    def piece(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    def block(b: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        parts = F.transform(
            b["parts"],
            lambda t, i: F.array(
                piece(F.when(i > 0, F.lit(PART)).otherwise(F.lit("")), F.lit(False)),
                piece(escape(t), b["role"] == LOSS_ROLE),
            ),
        )
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(parts), F.array(piece(F.lit(STOP), F.lit(False))))

    return F.flatten(F.transform(blocks, block))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start, length>>.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are sorted by
    (turn, role, text), nulls first, so ties and repeated rows have a fixed order.
    Null texts and roles are empty. loss_spans are in code points from 0 and cover
    exactly the texts of assistant turns. A null conv_id is a conversation of its
    own; an empty table gives no rows. A conversation is one value of the result, so
    its turns meet in one group; they are collected once, by conversation.
    """
    spans = F.expr(
        """aggregate(pieces, named_struct('at', 0, 'found', cast(array() as array<struct<start:int,length:int>>)),
             (a, p) -> named_struct('at', a.at + char_length(p.s),
                'found', if(p.loss, concat(a.found, array(named_struct('start', a.at, 'length', char_length(p.s)))), a.found)),
             a -> a.found)"""
    )
    empty = F.lit("")
    return (
        turns.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", "turns", _starts(F.col("turns")).alias("starts"))
        .select("conv_id", _merged(F.col("turns"), F.col("starts")).alias("blocks"))
        .select("conv_id", _pieces(F.col("blocks")).alias("pieces"))
        .select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss array<string>, from formatted and loss_spans alone."""
    blocks = F.filter(F.split("formatted", "<\\|im_end\\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.replace(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1), F.lit(NEWLINE), F.lit("\n")))
        body = F.substr(b, F.instr(b, "\n") + 1)
        return F.transform(F.split(body, "<\\|part\\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.expr("transform(loss_spans, s -> substring(formatted, s.start + 1, s.length))")
    return chats.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), F.transform(loss, unescape).alias("loss"), "formatted")


def digest(turns: DataFrame) -> DataFrame:
    """Formats and reads back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read_back(format_chats(turns)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests in DuckDB's SQL.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))
    + CASE WHEN before = role THEN 8
      ELSE 24 + length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), '<|nl|>')) END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
