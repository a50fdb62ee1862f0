"""Chat formatting as relational work: Spark expressions only.

Template: a conversation is a row of blocks ``### role:\\n text </turn>\\n``; adjacent turns of one role share a block and
are parted by ``</part>``. Inside roles and texts, ``\\e`` stands for a backslash, ``\\l`` for ``<`` and ``\\h`` for ``#``
(in roles also ``\\c`` for a colon): no control string can then arise from a text, and each escape reads back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings and escapes; the backslash is first to escape and last to read back.
OPEN, HEAD, PART, CLOSE = "### ", ":\n", "</part>", "</turn>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("#", "\\h"))
TRAINED = "assistant"
#: Turns whose positions are summed up together, and code points of the pieces in which spans are looked up.
BLOCK, CUT = 256, 1024


def escape(text: Column, more: tuple = ()) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (*ESCAPES, *more), text)


def unescape(text: Column, more: tuple = ()) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), (*more, *ESCAPES[::-1]), text)


_COLON = ((":", "\\c"),)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` (array of start, end in code points of ``formatted``).

    Turns are sorted by turn number, then role, then text (repeated rows stay); a null number comes first, a null role or text
    counts as empty, a null conv_id is a conversation of its own. Spans cover each text of an assistant, without markers.
    Other columns play no part. An empty table gives no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    # a conversation is one row of the output, so its turns meet in one row in any case
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def marked(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)
        same = (i > 0) & (before["role"] == t["role"])
        head = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(""), F.lit(OPEN), escape(t["role"], _COLON), F.lit(HEAD))
        return F.struct(F.when(same, F.lit(PART)).otherwise(head).alias("lead"), escape(t["text"]).alias("body"), (t["role"] == TRAINED).alias("trained"))

    pieces = sorted_turns.select("conv_id", F.transform("turns", marked).alias("pieces"))
    # positions are summed up within blocks of turns, from where each block begins, so that long conversations stay cheap
    last_block = F.floor((F.size("pieces") - 1) / F.lit(BLOCK)).cast("int")
    blocks = pieces.withColumn("blocks", F.transform(F.sequence(F.lit(0), last_block), lambda k: F.slice("pieces", k * BLOCK + 1, BLOCK)))
    length = lambda p: (F.char_length(p["lead"]) + F.char_length(p["body"])).cast("long")
    totals = F.transform("blocks", lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, p: acc + length(p)))
    sized = blocks.withColumn("begins", F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["lead"])
        end = begin + F.char_length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def spans(block: Column, k: Column) -> Column:
        start = F.struct(F.get(F.col("begins"), k).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
        return F.aggregate(block, start, add, lambda acc: acc["spans"])

    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(CLOSE))
    return sized.select("conv_id", formatted.alias("formatted"), F.flatten(F.transform("blocks", spans)).alias("loss_spans"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Read turns and loss texts back from ``format_conversations``' output: ``conv_id, turns, loss_texts, formatted``.

    Repeated rows are read each, an empty table gives no rows. Text that the formatter did not write has no defined turns: a
    block without a head becomes a turn without a role, a span beyond the text an empty one; null stays null.
    """
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        # the first colon and line feed end the role, in which no raw colon stands
        at = F.locate(HEAD, block) if isinstance(block, str) else F.call_function("locate", F.lit(HEAD), block)
        role = unescape(F.substring(block, len(OPEN) + 1, at - len(OPEN) - 1), _COLON)
        return F.transform(F.split(F.substring(block, at + len(HEAD), F.char_length(block)), PART), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    # the text is cut once, so that a span costs its own length and not all that is before it; as a lambda's variable the
    # pieces are made once for a conversation
    pieces = F.array(F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))

    def said(cut: Column, s: Column) -> Column:
        first = F.floor(s["start"] / F.lit(CUT)).cast("int")
        last = F.floor((F.greatest(s["end"], s["start"] + 1) - 1) / F.lit(CUT)).cast("int")
        near = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
        return unescape(F.substring(near, (s["start"] - first * CUT + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    loss = F.flatten(F.transform(pieces, lambda cut: F.transform(F.col("loss_spans"), lambda s: said(cut, s))))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), loss.alias("loss_texts"), "formatted")
