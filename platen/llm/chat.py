"""Chat formatting in Spark expressions only (operator 10).

A conversation's turns are sorted, adjacent turns of one role become one block, and the blocks are concatenated:

    <s>[INST]
    first text
    [TURN]
    second text of the same role
    </s>
    [BOT]
    an answer
    </s>

[SYS], [INST] and [BOT] open blocks of the roles system, user and assistant; [ROLE] opens one of any other role, whose
name is the block's first entry. Where a text holds a control string, the backslashes before it are doubled and one
more is put there, so that it can be told from the template's and read back exactly. The loss mask is an array of
(start, length) in code points: the assistant's texts, without markers.

Places are running sums of the pieces' lengths, taken block by block of CHUNK pieces and then over the blocks.

Defined cases: a null text or role is an empty one; equal turns are ordered by role and text (equal rows are alike), null
turns come first; rows of a null conv_id are one conversation; a very long text or conversation is formatted whole; an
empty table gives no rows; other columns, whatever their names, are ignored. A conversation is one output row, so its
turns do meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, TURN, OTHER = "<s>", "</s>", "[TURN]", "[ROLE]"
HEADERS = {"system": "[SYS]", "user": "[INST]", "assistant": "[BOT]"}
#: Pieces whose running sums are taken at once.
CHUNK = 256
#: All control strings, those of related templates too.
CONTROL = r"<s>|</s>|\[/?INST\]|\[SYS\]|\[BOT\]|\[TURN\]|\[ROLE\]|<</?SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"$1$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)\1\\({CONTROL})", r"$1$2")


def _blocks(turns: Column) -> Column:
    """Runs of equal roles as (role, texts)."""
    size = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(size))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct(F.get(turns, x["s"])["role"].alias("role"), F.transform(F.slice(turns, x["s"] + 1, x["e"] - x["s"]), lambda t: t["text"]).alias("texts")))


def _pieces(blocks: Column) -> Column:
    """The output in pieces (s, loss)."""

    def piece(s, loss=None):
        return F.struct((F.lit(s) if isinstance(s, str) else s).alias("s"), (F.lit(False) if loss is None else loss).alias("loss"))

    def one(b):
        role = b["role"]
        head = F.lit(OTHER)
        for name, mark in HEADERS.items():
            head = F.when(role == name, mark).otherwise(head)
        named = F.when(role.isin(*HEADERS), "\n").otherwise(F.concat(F.lit("\n"), escape(role), F.lit(f"\n{TURN}\n")))
        inner = F.flatten(F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i > 0, f"\n{TURN}\n").otherwise("")), piece(escape(t), role == "assistant"))))
        return F.concat(F.array(piece(F.concat(head, named))), inner, F.array(piece(f"\n{END}\n")))

    return F.concat(F.array(piece(BEGIN)), F.flatten(F.transform(blocks, one)))


def _sums(numbers: Column) -> Column:
    """0 and the running sums of a short array."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def _spans(pieces: Column) -> Column:
    """(start, length) of the pieces under the loss mask."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda c: F.slice(pieces, c * CHUNK + 1, CHUNK))
    inner = F.transform(chunks, lambda c: F.struct(c.alias("pieces"), _sums(F.transform(c, lambda p: F.length(p["s"]))).alias("sums")))
    bases = _sums(F.transform(inner, lambda c: F.element_at(c["sums"], -1)))
    based = F.zip_with(inner, bases, lambda c, b: F.struct(c.alias("c"), b.alias("base")))

    def spans(x):
        each = F.transform(x["c"]["pieces"], lambda p, i: F.struct(p["loss"].alias("loss"), (x["base"] + F.get(x["c"]["sums"], i)).alias("start"), F.length(p["s"]).alias("length")))
        return F.transform(F.filter(each, lambda e: e["loss"]), lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length")))

    return F.flatten(F.transform(F.filter(based, lambda x: x["c"].isNotNull()), spans))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask (array of start, length) of each conversation."""
    empty = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    chats = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.withColumn("blocks", _blocks(F.col("turns")))
    chats = chats.select("conv_id", _pieces(F.col("blocks")).alias("pieces"))
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), _spans(F.col("pieces")).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from the output."""
    blocks = F.filter(F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), rf"(?<=\n){END}\n"), lambda b: b != "")

    def one(b):
        head = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(head) + 2, F.length(b) - F.length(head) - 2)
        texts = F.transform(F.split(body, r"\n\[TURN\]\n"), unescape)
        known = F.lit(None).cast("string")
        for name, mark in HEADERS.items():
            known = F.when(head == mark, name).otherwise(known)
        role = F.coalesce(known, F.get(texts, F.lit(0)))
        return F.transform(F.slice(texts, F.when(known.isNull(), 2).otherwise(1), F.size(texts)), lambda t: F.struct(role.alias("role"), t.alias("text")))

    return F.flatten(F.transform(blocks, one))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")
