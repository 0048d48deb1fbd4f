"""Chat formatting with typed content parts.

A message has a list of parts: ``type`` (text, image, audio or document), ``text``
for text parts, ``uri`` for attachments and the measures ``width``, ``height``
(pixels), ``seconds`` and ``pages``. The visitor turns the list into one string:
text is escaped, an attachment becomes ``<image:k>``, ``<audio:k>`` or
``<document:k>`` with k counting the message's attachments from 0, and is recorded
with its reference and the number of tokens it will expand to.

Template of a turn: ``<turn>role<text>content</turn>`` and a line end. Inside
roles and texts a backslash is written ``\\s`` and ``<`` is written ``\\l``, so no
control string can come from a text and both steps can be undone.

The result keeps a conversation as segments with a loss flag (true for the
content of assistant turns); their concatenation is the formatted text.

Defined cases: null text, role or part list counts as empty; a part of unknown
type is left out; equal turn numbers are ordered by role and text; repeated rows
are kept as turns; an empty table gives an empty result; columns other than
``conv_id``, ``turn``, ``role`` and ``parts`` are not read. One conversation is one
output row, so it has to fit in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>\n"
PATCH = 14
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 500
PART_TYPE = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A part list that holds one text."""
    part = F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return F.array(part).cast(PART_TYPE)


def part_tokens(p: Column) -> Column:
    """Tokens that an attachment expands to: image patches, audio frames, document pages."""
    patches = F.ceil(F.coalesce(p["width"], F.lit(PATCH)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(PATCH)) / PATCH)
    return (
        F.when(p["type"] == "image", patches)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(1)) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visited(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (escaped text with placeholders), attachments (ord, type, uri, tokens)."""
    parts = F.filter(F.coalesce(F.col("parts").cast(PART_TYPE), F.array().cast(PART_TYPE)), lambda p: F.coalesce(p["type"].isin("text", "image", "audio", "document"), F.lit(False)))
    df = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    attached = F.transform(
        F.filter("parts", lambda p: p["type"] != "text"),
        lambda p, i: F.struct(i.alias("ord"), p["type"].alias("type"), p["uri"].alias("uri"), part_tokens(p).alias("tokens")),
    )
    # a part's number is the count of attachments before it, kept as a running pair (pieces, next number)
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("next"))
    text_only = F.concat_ws("", F.transform("parts", lambda p: escape(p["text"])))
    mixed = F.aggregate(
        "parts",
        start,
        lambda a, p: F.struct(
            F.array_append(
                a["pieces"],
                F.when(p["type"] == "text", escape(p["text"])).otherwise(F.concat(F.lit("<"), p["type"], F.lit(":"), a["next"].cast("string"), F.lit(">"))),
            ).alias("pieces"),
            (a["next"] + (p["type"] != "text").cast("int")).alias("next"),
        ),
        lambda a: F.concat_ws("", a["pieces"]),
    )
    content = F.when(F.forall("parts", lambda p: p["type"] == "text"), text_only).otherwise(mixed)
    return df.select("conv_id", "turn", "role", content.alias("content"), attached.alias("attachments"))


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, segments (text, loss), formatted, attachments (turn_no, ord, type, uri, tokens), attachment_tokens."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    turns = visited(messages).withColumn("no", F.row_number().over(order))
    loss = F.col("role") == "assistant"
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    row = F.struct(
        "no",
        F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(F.col("content").alias("text"), loss.alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        ).alias("segments"),
        F.transform("attachments", lambda a: F.struct(F.col("no").alias("turn_no"), a["ord"].alias("ord"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens"))).alias("attachments"),
    )
    joined = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return joined.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.flatten(F.col("rows.segments")).alias("segments"),
        F.flatten(F.col("rows.attachments")).alias("attachments"),
    ).select(
        "conv_id", "n_turns", "segments", F.concat_ws("", F.col("segments.text")).alias("formatted"), "attachments",
        F.aggregate(F.col("attachments.tokens"), F.lit(0).cast("long"), lambda a, t: a + t).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """role, line end, text, line end of every turn of a formatted text, in order; escapes undone, placeholders left."""
    plain = F.replace(F.replace(F.replace(formatted, F.lit(TURN), F.lit("")), F.lit(TEXT), F.lit("\n")), F.lit(END), F.lit("\n"))
    return unescape(plain)


def count_turns(formatted: Column) -> Column:
    gone = F.length(formatted) - F.length(F.replace(formatted, F.lit(TURN), F.lit("")))
    return (gone / len(TURN)).cast("long")


def read_loss(segments: Column) -> Column:
    """Text under the loss mask, escapes undone."""
    return unescape(F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"])))
