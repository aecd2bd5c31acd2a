"""Chat formatting with Spark expressions only.

A conversation's turn structs are sorted (turn, role, text; nulls first), adjacent turns of one role are merged into one
block, and blocks are concatenated:

    <s><|turn|>role<|text|>first text<|more|>second text of that role<|end|>...</s>

Control strings inside roles and texts are escaped reversibly: after an opening ``<`` or ``[``, any run of backslashes
that a control string's rest follows gets one backslash more; reading back takes one away. Loss spans (start from 0,
length, in code points of the formatted string) cover each assistant text, not the marks.

Null roles and texts count as empty; a null turn sorts first. Repeated rows are repeated turns. Rows with a null
conv_id form one conversation. An empty table gives an empty result. Extra columns are not read. A conversation is one
output row and is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

CONTROL = r"\||/?s>|/?INST\]"
TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)(?={CONTROL})", r"$1$2\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)\\(?={CONTROL})", "$1$2")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: array<struct<start, len>>."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        """Each turn's opening mark, escaped text and closing mark; same-role neighbours share a block."""
        def piece(x: Column, i: Column) -> Column:
            opens = F.when((i > 0) & (t[i - 1]["role"] == x["role"]), F.lit(MORE)).otherwise(F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT)))
            closes = F.when((i + 1 < F.size(t)) & (t[i + 1]["role"] == x["role"]), F.lit("")).otherwise(F.lit(END))
            return F.struct(x["role"].alias("role"), opens.alias("a"), escape(x["text"]).alias("b"), closes.alias("c"))
        return F.transform(t, piece)

    got = got.select("conv_id", let(F.col("turns"), pieces).alias("p"))
    body = F.concat_ws("", F.transform("p", lambda x: F.concat(x["a"], x["b"], x["c"])))
    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin, n = acc["at"] + F.length(x["a"]), F.length(x["b"])
        span = F.array(F.struct(begin.alias("start"), n.alias("len")))
        mine = F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((begin + n + F.length(x["c"])).alias("at"), mine.alias("spans"))

    return got.select("conv_id", F.concat(F.lit("<s>"), body, F.lit("</s>")).alias("formatted"), F.aggregate("p", start, step)["spans"].alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns: array<struct<role, text>>, loss_texts, formatted: what the formatted string says."""
    def block(b: Column) -> Column:
        def texts(halves: Column) -> Column:
            return F.transform(F.split(halves[1], r"<\|more\|>", -1), lambda x: F.struct(unescape(halves[0]).alias("role"), unescape(x).alias("text")))
        return let(F.split(b, r"<\|text\|>", 2), texts)

    inner = F.col("formatted").substr(F.lit(4), F.length("formatted") - 7)
    blocks = F.filter(F.split(inner, r"<\|turn\|>", -1), lambda x: x != "")
    ended = F.transform(blocks, lambda b: b.substr(F.lit(1), F.length(b) - len(END)))
    return chats.select(
        "conv_id", "formatted", F.flatten(F.transform(ended, block)).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["len"]))).alias("loss_texts"),
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose texts are control strings."""
    say = "</s>[INST] ok [/INST]"
    probe = rows.sparkSession.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionAll(probe)


def op9(spark, sf_dir: str) -> DataFrame:
    back = read_back(format_chats(with_probe(table(spark, sf_dir, "conversations"))))
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss_texts")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, lag(role) over w is not distinct from role and row_number() over w > 1 as joined,
    row_number() over w as k,
    regexp_replace(text, '([<\[]\\*)(\||/?s>|/?INST\])', '\1\\\2', 'g') as et,
    regexp_replace(role, '([<\[]\\*)(\||/?s>|/?INST\])', '\1\\\2', 'g') as er
  from rows window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(7 + sum(length(et)) + sum(case when joined then 8 else 23 + length(er) end) as bigint) as formatted_chars
from marked group by conv_id
"""
