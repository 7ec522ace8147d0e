"""Chat formatting: typed content parts flattened into one marked-up text per conversation, in DataFrame operations only.

A message is an array of parts ``(type, text, ref, units)``. Text parts are escaped; image, audio and document parts become
numbered placeholders, with their references and expanded token counts listed in order. Control strings inside texts and
roles lose their first character to a percent escape (and the percent sign itself is escaped), so no text can open or
close a turn, and reading back restores every character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Strings that this template or common public ones treat as control marks.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACE, PART_OF = "<|", "<|part:"  # a placeholder is <|image|> in the formatted text; read back, it is <|part:image|>
ESCAPES = {"<": "%3C", "[": "%5B", "%": "%25"}
# Tokens that one unit (tile, second, page) of an attachment expands to.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
KINDS = (*UNIT_TOKENS, "other")
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("%"), F.lit(ESCAPES["%"]))
    for c in CONTROLS:
        x = F.replace(x, F.lit(c), F.lit(ESCAPES[c[0]] + c[1:]))
    return x


def unescape(x: Column) -> Column:
    for plain in ("<", "[", "%"):
        x = F.replace(x, F.lit(ESCAPES[plain]), F.lit(plain))
    return x


def reread(x: Column) -> Column:
    """A body as it was, with its placeholders named as parts; texts hold no ``<|`` before they are unescaped."""
    return unescape(F.regexp_replace(x, rf"<\|({'|'.join(KINDS)})\|>", PART_OF + "$1|>"))


def text_parts(text: Column) -> Column:
    """A plain text as a message of one text part; null is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units")))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def flatten(parts: Column) -> tuple[Column, Column]:
    """Visit the parts in order: the escaped text with placeholders, and the attachments ``(type, ref, tokens)`` in placeholder order.

    Neighbouring text parts are joined before they are escaped, so that no control string can arise between them. A placeholder names one of a
    closed list of kinds, none of which is a control mark; a part of a kind outside the list is an ``other``, named in its attachment.
    """
    known = F.create_map(*[F.lit(x) for kv in UNIT_TOKENS.items() for x in kv])

    def mark(p: Column) -> Column:
        kind = p["type"]
        return F.concat(F.lit(PLACE), F.when(kind.isin(*UNIT_TOKENS), kind).otherwise("other"), F.lit("|>"))

    walked = F.aggregate(
        parts, F.struct(F.lit("").alias("done"), F.lit("").alias("text")),
        lambda a, p: F.when(_is_text(p), F.struct(a["done"].alias("done"), F.concat(a["text"], F.coalesce(p["text"], F.lit(""))).alias("text"))).otherwise(
            F.struct(F.concat(a["done"], escape(a["text"]), mark(p)).alias("done"), F.lit("").alias("text"))))
    attached = F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"),
        (F.coalesce(p["units"], F.lit(1)) * F.coalesce(F.element_at(known, p["type"]), F.lit(1))).cast("bigint").alias("tokens")))
    return F.concat(walked["done"], escape(walked["text"])), attached


def render(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, parts)`` -> ``(conv_id, formatted, loss, attachments, expanded_tokens, n_turns)``, one row per conversation.

    Turns are in order of turn (nulls first), then role, then body, so repeated or tied rows have a fixed order. Null role is empty; null or
    empty parts give an empty body. ``loss`` lists ``(start, length)`` of every assistant text in ``formatted``, in code points; attachments in
    an assistant turn are part of it. A null conv_id is a conversation of its own. A conversation is one row, as its output is one text.
    """
    body, attached = flatten(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")))
    turns = messages.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), body.alias("body"), attached.alias("attached")).alias("t"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    pieces = F.transform("ts", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"), t["body"].alias("body"), (t["role"] == "assistant").alias("loss")))
    conv = conv.withColumn("pieces", pieces)
    walked = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["loss"], F.array_append(a["loss"], F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))).otherwise(a["loss"]).alias("loss")))
    attachments = F.flatten(F.transform("ts", lambda t: t["attached"]))
    return conv.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        walked["loss"].alias("loss"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"), F.size("ts").cast("long").alias("n_turns"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read back: ``(conv_id, turns, loss_texts, formatted_chars)`` with ``turns`` an array of ``(role, text)``, unescaped, in order."""
    raw = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: F.length(x) > 0)
    turns = F.transform(raw, lambda x: F.struct(
        unescape(F.substring_index(x, BODY, 1)).alias("role"),
        reread(F.substring_index(F.substring_index(x, BODY, -1), END, 1)).alias("text")))
    masked = F.transform("loss", lambda s: reread(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", turns.alias("turns"), masked.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))
