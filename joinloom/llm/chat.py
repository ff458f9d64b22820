"""Chat formatting with DataFrame expressions only.

Turns of a conversation are collected as structs and sorted; neighbours of one role are merged into one
block; blocks are concatenated:

    <|im_start|>role LF text (<|turn|> text)* <|im_end|> LF

Control strings cannot arise from texts or roles, since these are escaped reversibly: backslash as ``\\s``,
``<`` as ``\\l``, ``[`` as ``\\b``, and in roles a line feed as ``\\n``.
``loss`` has the spans of the formatted string under the loss mask: [begin, end) of each escaped assistant text, in code points.

Turns are ordered by (turn, role, text), nulls first. Null text is empty, a null role is the role ''; rows
of a null conversation id form one conversation. Repeated rows are turns of their own. An empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN = "<|im_start|>", "<|im_end|>\n", "<|turn|>"


def escaped(c: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for code, plain in (("\\n", "\n"), ("\\b", "["), ("\\l", "<"), ("\\s", "\\")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss``."""
    role = F.replace(escaped(F.coalesce(F.col(role_col), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    text = escaped(F.coalesce(F.col(text_col), F.lit("")))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    chats = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # A block begins where the role differs from the one before.
    chats = chats.withColumn("begins", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role != turns[greatest(i - 1, 0)].role)"))
    chats = chats.withColumn("blocks", F.expr("""transform(begins, (b, k) -> named_struct('role', turns[b].role, 'texts',
        transform(slice(turns, b + 1, if(k + 1 < size(begins), begins[least(k + 1, size(begins) - 1)], size(turns)) - b), t -> t.text)))"""))
    chats = chats.withColumn("parts", F.transform("blocks", lambda b: F.concat(F.lit(START), b.role, F.lit("\n"), F.array_join(b.texts, TURN), F.lit(END))))
    # Where each block begins: running sums of lengths, by array aggregation over the blocks.
    place = F.expr("""aggregate(sequence(0, size(blocks) - 1), named_struct('at', 0L, 'spans', cast(array() as array<struct<role:string,at:bigint,texts:array<string>>>)),
        (a, i) -> named_struct('at', a.at + length(parts[i]), 'spans', concat(a.spans, array(named_struct('role', blocks[i].role, 'at', a.at, 'texts', blocks[i].texts)))), a -> a.spans)""")
    chats = chats.withColumn("placed", F.filter(place, lambda b: b.role == F.lit(trained)))
    spans = F.expr(f"""flatten(transform(placed, b -> aggregate(b.texts, named_struct('at', b.at + {len(START)} + length(b.role) + 1, 'spans', cast(array() as array<struct<begin:bigint,end:bigint>>)),
        (a, x) -> named_struct('at', a.at + length(x) + {len(TURN)}, 'spans', concat(a.spans, array(named_struct('begin', a.at, 'end', a.at + length(x))))), a -> a.spans)))""")
    return chats.select("conv_id", F.array_join("parts", "").alias("formatted"), spans.alias("loss"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Formatted conversations read back: ``conv_id, turns`` (role and text of each row), ``loss_text``, ``formatted``."""
    blocks = F.slice(F.split("formatted", "<\\|im_start\\|>"), 2, F.greatest(F.size(F.split("formatted", "<\\|im_start\\|>")) - 1, F.lit(0)))
    turns = F.flatten(F.transform(blocks, _turns))
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s.begin + 1).cast("int"), (s.end - s.begin).cast("int")))), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def _turns(block: Column) -> Column:
    """Role and text of each turn of ``role LF text (TURN text)* END``."""
    head = F.instr(block, "\n")
    role = unescaped(F.substring(block, F.lit(1), head - 1))
    texts = F.split(F.substring(block, head + 1, F.length(block) - head - len(END)), "<\\|turn\\|>")
    return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))
