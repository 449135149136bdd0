"""Operator 2 (built-in functions only): chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens the parts in
order: text is escaped and kept, every image, audio and document part becomes a
numbered placeholder and is recorded as an attachment with its reference, the
turn and the number of tokens it expands to. Turns are then written in the
template below, one string per conversation, with the spans that carry loss
(assistant contents).

    <|turn|>ROLE<|says|>CONTENT<|end|>

Control strings cannot occur inside a role or a text: a backslash is put inside
each one, and backslashes themselves are doubled, so removing one level of
backslashes restores the text exactly. :func:`parse_formatted` does that.

Defined cases: null text and null parts are empty; very long texts are kept whole; an empty table gives no rows; a null role is the empty
role; turns are ordered by ``turn`` (null first), ties by role, then content;
repeated rows are repeated turns; a null ``conv_id`` is one conversation;
columns besides those named are not read. A conversation becomes one string,
so its turns meet in one task by definition of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"

#: What cannot stand in a role or text unescaped: this template's marks and those of common chat formats.
_CONTROL = r"(<)(?=\|[A-Za-z0-9_]+\|>|/?s>)|(\[)(?=/?INST\]|/?SYS\])|(<)(?=</?SYS>>)"

#: Type of one content part.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that an attachment expands to: images by 28-pixel patches, audio by 25 frames a second, documents by page.
PATCH, FRAMES, PAGE_TOKENS = 28, 25, 256
MEDIA = ("image", "audio", "document")


def escape(text: Column) -> Column:
    """Text without control strings; undone by :func:`unescape`."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1$2$3\\")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens an attachment expands to, 0 for text; unknown sizes count as one unit."""
    cells = lambda size: F.ceil(F.coalesce(size, F.lit(1)) / PATCH)
    return (
        F.when(part["type"] == "image", cells(part["width"]) * cells(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * FRAMES))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
    ).cast("long")


def _visit(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of a list of parts; unknown types are taken as text."""
    is_media = lambda p: F.coalesce(p["type"].isin(*MEDIA), F.lit(False))
    media = F.filter(parts, is_media)
    attachments = F.transform(media, lambda p, i: F.struct(
        i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    # neighbouring texts are joined before they are escaped: a control string could be spread over them
    start = F.struct(F.lit("").alias("content"), F.lit("").alias("text"), F.lit(0).alias("n"))
    flush = lambda s: F.concat(s["content"], escape(s["text"]))
    step = lambda s, p: F.when(is_media(p), F.struct(
        F.concat(flush(s), F.lit("<|"), p["type"], F.lit("_"), s["n"].cast("string"), F.lit("|>")).alias("content"),
        F.lit("").alias("text"), (s["n"] + 1).alias("n"))).otherwise(F.struct(
            s["content"].alias("content"), F.concat(s["text"], F.coalesce(p["text"], F.lit(""))).alias("text"), s["n"].alias("n")))
    content = F.aggregate(parts, start, step, flush)
    return F.coalesce(content, F.lit("")), F.coalesce(attachments, F.array().cast(
        "array<struct<place:int,type:string,ref:string,tokens:bigint>>"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments.

    ``turns`` has conv_id, turn, role and either ``parts`` (an array of
    :data:`PART`) or ``text``. ``loss_spans`` are (start, length) in code points
    of the assistant contents inside ``formatted``; ``attachments`` are
    (turn_no, place, type, ref, tokens) in order.
    """
    parts = F.col("parts") if "parts" in turns.columns else text_part(F.col("text"))
    content, attachments = _visit(parts)
    row = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attachments.alias("attachments"))
    whole = row.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("has_turn"), "turn", "role", "content", "attachments"))).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS)).alias("head"), t["content"].alias("content"),
        (t["role"] == "assistant").alias("loss")))
    whole = whole.select("conv_id", "turns", pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("pieces", start, lambda acc, p: F.struct(
        (acc["at"] + F.length(p["head"]) + F.length(p["content"]) + len(END)).alias("at"),
        F.when(p["loss"], F.array_append(acc["spans"], F.struct(
            (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["content"]).alias("length")))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    kept = F.flatten(F.transform("turns", lambda t, n: F.transform(t["attachments"], lambda a: F.struct(
        n.alias("turn_no"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"), kept.alias("attachments"), F.aggregate(
            kept, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"))


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Read :func:`format_conversations` back: its columns with ``turns``, array<struct<role, text>>."""
    segments = F.filter(F.split("formatted", r"<\|turn\|>"), lambda s: s != "")
    turns = F.transform(segments, lambda s: F.struct(
        unescape(F.substring_index(s, SAYS, 1)).alias("role"),
        unescape(F.regexp_extract(s, r"(?s)<\|says\|>(.*)<\|end\|>$", 1)).alias("text")))
    return formatted.withColumn("turns", turns)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of conversations, from what reading them back gives."""
    read = parse_formatted(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
