"""Chat formatting: a visitor flattens typed content parts into ordered placeholders, then a template marks the turns.

Everything is DataFrame functions.  Control strings inside texts are escaped reversibly: ``&``
becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so ``<|`` occurs in the output only where the
template put it.  A role's line feed becomes ``&#10;``.

Defined results: a null text or role is empty; rows of one conversation are ordered by turn, role
and parts (a null turn first), and repeated rows are repeated turns; rows with a null conv_id form
one conversation.  A conversation is one output value, so it has to fit in one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: One part of a message; numbers that a kind does not use are null.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"
#: Fixed production costs of attachments in tokens.
PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A message that is one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "millis": "bigint", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()]))


def made_parts(text: Column, turn: Column) -> Column:
    """Typed parts made of a text: an image amid it, an audio before it, or a document behind it, by its length."""
    t = F.coalesce(text, F.lit(""))
    n, half = F.length(t), F.floor(F.length(t) / F.lit(2)).cast("int")
    none = {"text": "string", "ref": "string", "width": "int", "height": "int", "millis": "bigint", "pages": "int"}
    part = lambda kind, **has: F.struct(F.lit(kind).alias("kind"), *[has.get(c, F.lit(None)).cast(k).alias(c) for c, k in none.items()])
    image = F.array(part("text", text=F.substring(t, F.lit(1), half)), part("image", ref=F.md5(t), width=n * 3, height=F.coalesce(turn, F.lit(0)) + 15), part("text", text=F.substring(t, half + 1, n)))
    audio = F.array(part("audio", ref=F.md5(t), millis=n * 10), part("text", text=t))
    return F.when(n % 3 == 0, image).when(n % 3 == 1, audio).otherwise(F.array(part("text", text=t), part("document", ref=F.md5(t), pages=n % 7)))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment stands for: image patches, audio frames, document pages; 0 for text."""
    per = lambda c, n: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(float(n)))
    return (
        F.when(part["kind"] == "image", per(part["width"], PATCH) * per(part["height"], PATCH))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["millis"], F.lit(0)) * F.lit(AUDIO_TOKENS_PER_SECOND) / F.lit(1000.0)))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * F.lit(TOKENS_PER_PAGE))
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(parts: Column) -> Column:
    """The visitor: struct(content, attachments, expanded) of an array of parts, taken in order.

    A text part gives its escaped text; another kind gives ``<|kind:n|>``, n counting that message's
    attachments from 1 in order, and a reference (n, kind, ref, tokens).  Unknown kinds count as
    attachments of no tokens; a null array is an empty message, a null part an empty text.
    """
    fields = ("text", "ref", "width", "height", "millis", "pages")
    p = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda x: F.when(x.isNull() | x["kind"].isNull(), F.struct(F.lit("text").alias("kind"), *[x[f].alias(f) for f in fields])).otherwise(x))
    media = F.filter(p, lambda x: x["kind"] != "text")
    # A control string may come about where two texts meet.
    text = lambda s, x: F.when(s.endswith("<") & x.startswith("|"), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), F.lit("&lt;"), escape(x))).otherwise(F.concat(s, escape(x)))
    kind = lambda x: F.regexp_replace(x["kind"], "[^A-Za-z0-9_]", "_")
    step = lambda a, x: F.when(x["kind"] == "text", F.struct(text(a["s"], F.coalesce(x["text"], F.lit(""))).alias("s"), a["n"].alias("n"))).otherwise(
        F.struct(F.concat(a["s"], F.lit("<|"), kind(x), F.lit(":"), (a["n"] + 1).cast("string"), F.lit("|>")).alias("s"), (a["n"] + 1).alias("n"))
    )
    return F.struct(
        F.aggregate(p, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step)["s"].alias("content"),
        F.transform(media, lambda x, i: F.struct((i + 1).alias("n"), x["kind"].alias("kind"), x["ref"].alias("ref"), expanded_tokens(x).alias("tokens"))).alias("attachments"),
        F.aggregate(media, F.lit(0).cast("long"), lambda a, x: a + expanded_tokens(x)).alias("expanded"),
    )


def format_chat(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask, attachments, expanded_tokens for messages(conv_id, turn, role, parts).

    ``mask`` holds the (start, length) in code points of each assistant content: the text under the loss.
    Every turn goes through the visitor, once the turns of its conversation are in order.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), "parts")))
    one = messages.groupBy("conv_id").agg(turns.alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), visit(t["parts"]).alias("v"))))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    full = lambda t: F.concat(head(t), t["v"]["content"], F.lit(END))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))
    span = lambda a, t: F.array(F.struct((a["at"] + F.length(head(t))).alias("start"), F.length(t["v"]["content"]).cast("long").alias("length")))
    walk = lambda a, t: F.struct((a["at"] + F.length(full(t))).alias("at"), F.when(t["role"] == "assistant", F.concat(a["mask"], span(a, t))).otherwise(a["mask"]).alias("mask"))
    return one.select(
        "conv_id",
        F.array_join(F.transform("turns", full), "").alias("formatted"),
        F.aggregate("turns", begin, walk)["mask"].alias("mask"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["v"]["attachments"], lambda x: F.struct(i.alias("turn"), x["n"].alias("n"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["v"]["expanded"]).alias("expanded_tokens"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns in a formatted string, as an array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = lambda t: F.substring(t, len(START) + 1, 1 << 30)
    return F.transform(
        turns, lambda t: F.struct(unescape_role(F.substring_index(body(t), "\n", 1)).alias("role"), unescape(F.regexp_replace(body(t), r"(?s)^[^\n]*\n", "")).alias("text"))
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def chat_digests(chats: DataFrame) -> DataFrame:
    """What the query returns, read back from format_chat's output."""
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_chat(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
