"""Operator 9: chat formatting with typed content parts, in DataFrame operations only.

A message's content is a list of parts, each a text, an image, an audio clip or a document. A visitor flattens them in order: texts are escaped, attachments become numbered
placeholders, and each attachment's reference and the number of tokens it expands to are recorded. The template marks turns with control strings that all begin with ``<``;
inside texts and roles ``\\``, ``<`` and ``[`` become ``\\e``, ``\\l`` and ``\\b``, so no control string of this template (nor ``</s>`` or ``[INST]``) can stand in a text, and unescaping restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the template.
BEGIN, TURN, TEXT, END = "<|conversation|>", "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
#: Tokens of an attachment: image patches of this many pixels a side, audio tokens a second, document tokens a page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; unknown kinds and missing measures count 1."""
    side = lambda x: F.ceil(part[x] / IMAGE_PATCH)
    n = F.when(part["type"] == "image", side("width") * side("height")).when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).when(part["type"] == "document", part["pages"].cast("long") * PAGE_TOKENS)
    return F.greatest(F.coalesce(n.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))


def visit(parts: Column) -> tuple[Column, Column]:
    """(content with numbered placeholders, attachments as ``kind, ref, n_tokens`` in order). A null list or part is an empty text; a part without a type is a text."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    attached = F.filter(parts, lambda p: ~is_text(p))
    zero = F.struct(F.lit("").alias("content"), F.lit(0).alias("n"))
    mark = lambda p, n: F.concat(F.lit("<|"), escape(p["type"]), F.lit(":"), n.cast("string"), F.lit("|>"))
    step = lambda s, p: F.struct(F.concat(s["content"], F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark(p, s["n"] + 1))).alias("content"), (s["n"] + F.when(is_text(p), 0).otherwise(1)).alias("n"))
    content = F.aggregate(parts, zero, step, lambda s: s["content"])
    return content, F.transform(attached, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("n_tokens")))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, n_turns, loss`` (places of the assistant's contents as start and length, in code points), ``attachments`` (turn, kind, ref,
    n_tokens in order) and ``n_attachment_tokens``.

    ``turns``: ``conv_id, turn, role, text`` and optionally ``parts`` (typed content, after the text, which is a text part itself; all parts go through ``visit``). Rows go by turn, then role, then content; repeated rows are repeated turns. Null
    texts and roles are empty, a null turn comes first, and a null conv_id is a conversation like others. The result's rows hold whole conversations, as a row per conversation
    must; nothing larger than one is gathered. An empty table gives an empty one.
    """
    given = {"type": F.lit("text"), "text": F.coalesce("text", F.lit(""))}
    fields = [f.split(":") for f in PART[len("struct<") : -1].split(",")]
    parts = F.array(F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]))
    if "parts" in turns.columns:
        parts = F.concat(parts, F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")))
    content, attached = visit(parts)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("_content"), attached.alias("_attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("_head", F.length(head)).withColumn("_turn", F.concat(head, "_content", F.lit(END)))
    upto = F.sum(F.length("_turn")).over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "_content").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto.cast("long"))
    start = F.col("_upto") - F.length("_turn") + F.col("_head") + len(BEGIN)
    mask = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("_content").cast("long").alias("length")))
    marked = F.transform("_attached", lambda a: F.struct(F.col("turn").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_upto", "_turn", mask.alias("loss"), marked.alias("attached")))).alias("_rows"))
    attachments = F.flatten(F.col("_rows.attached"))
    return whole.select(
        "conv_id", F.concat(F.lit(BEGIN), F.array_join("_rows._turn", "")).alias("formatted"), F.size("_rows").cast("long").alias("n_turns"),
        F.filter("_rows.loss", lambda x: x.isNotNull()).alias("loss"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("n_attachment_tokens"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads back: ``conv_id, turns`` (role, text) from the marks and ``loss_text`` (unescaped) from the mask. Slices are taken from fixed-width code points, so time follows length."""
    marked = F.split(F.substr("formatted", F.lit(len(BEGIN) + len(TURN) + 1)), r"<\|turn\|>")
    turn = lambda t: F.struct(
        unescape(F.substring_index(t, TEXT, 1)).alias("role"),
        unescape(F.substr(F.substring_index(F.substring_index(t, END, 1), TEXT, -1), F.lit(1))).alias("text"),
    )
    wide = F.encode("formatted", "UTF-32")
    bom = F.unhex(F.lit("0000FEFF"))
    piece = lambda m: F.decode(F.concat(bom, F.substr(F.col("_wide"), (4 * m["start"] + 1).cast("int"), (4 * m["length"]).cast("int"))), "UTF-32")
    rows = formatted.withColumn("_wide", wide).withColumn("turns", F.transform(marked, turn))
    return rows.select("conv_id", "turns", unescape(F.array_join(F.transform("loss", piece), "")).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
