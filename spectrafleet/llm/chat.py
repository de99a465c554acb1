"""Chat formatting by relational expressions only: collected turn structs, merged runs, one formatted string.

Template. Each run of adjacent turns of one role is one message:

    ### <role>:\\n<text>[<|turn|>\\n<text>...]</turn>\\n

Inside roles and texts the control characters are escaped, so no marker can appear in content:
backslash -> \\b, '<' -> \\l, '#' -> \\h, and in roles also newline -> \\n and ':' -> \\c. After escaping, every
backslash starts exactly one escape, so undoing them one kind after another (backslash last) is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, BREAK, TAIL = "### ", "<|turn|>\n", "</turn>\n"
TEXT_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, ("\n", "\\n"), (":", "\\c"))


def escape(col: Column, codes: tuple = TEXT_ESCAPES) -> Column:
    for plain, code in codes:
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def unescape(col: Column, codes: tuple = TEXT_ESCAPES) -> Column:
    for plain, code in reversed(codes):
        col = F.replace(col, F.lit(code), F.lit(plain))
    return col


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start int, length int>>.

    turns needs conv_id, turn, role, text; other columns are ignored. Rows are ordered by turn (null first), ties by
    role then text, so repeated rows stay and their order is defined. Null text and null role are the empty string.
    A null conv_id is a conversation of its own. An empty table gives no rows. Spans count code points from 0 and
    cover the escaped text of each turn of loss_role, without markers.
    Texts of any length are kept whole; a conversation is one row, so one task holds all its turns, and all rows without
    a conv_id. Its pieces are appended one by one, work in proportion to the square of its number of turns.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    # Each turn's opening marker depends only on its neighbour, so formatting is one pass over the array.
    def piece(t: Column, i: Column) -> Column:
        before, after = F.get(F.col("turns"), i - 1)["role"], F.get(F.col("turns"), i + 1)["role"]
        opens = F.when((i > 0) & (before == t["role"]), F.lit("")).otherwise(F.concat(F.lit(HEAD), escape(t["role"], ROLE_ESCAPES), F.lit(":\n")))
        closes = F.when(after == t["role"], F.lit(BREAK)).otherwise(F.lit(TAIL))
        return F.struct(opens.alias("open"), escape(t["text"]).alias("body"), closes.alias("close"), (t["role"] == loss_role).alias("loss"))

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["open"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((start + F.length(p["body"]) + F.length(p["close"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["body"], p["close"])), "").alias("formatted"),
        F.aggregate("pieces", zero, walk)["spans"].alias("loss_spans"),
    )


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Read format_conversations() back: conv_id, formatted, turns array<struct<role,text>>, loss_text (unescaped)."""
    messages = F.slice(F.split("formatted", "</turn>\n"), 1, F.greatest(F.size(F.split("formatted", "</turn>\n")) - 1, F.lit(0)))

    def unpack(m: Column) -> Column:
        cut = F.instr(m, ":\n")
        role = unescape(F.substring(m, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1), ROLE_ESCAPES)
        body = F.substring(m, cut + 2, F.length(m))
        return F.transform(F.split(body, r"<\|turn\|>\n"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    spans = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(messages, unpack)).alias("turns"), F.array_join(spans, "").alias("loss_text"))


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """The digest columns of parse_formatted() rows."""
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
