"""Chat formatting with typed content parts (DataFrame functions only).

A turn's content is an array of parts: struct<kind, text, ref, amount>, kind being text, image, audio or
document. flatten_parts() visits them in order: a text part gives its escaped text; every other part gives
a placeholder <|kind:i|>, an entry of the attachment list, and the number of tokens that a model expands it
to (amount is pixels, seconds or pages).

Template: every turn is <|role|>ROLE<|text|>CONTENT<|end|>. Escaping inside roles and texts writes the
backslash as \\e, < as \\l and [ as \\b, so no control string (<|end|>, </s>, [INST], ...) can stand in a
formatted conversation but those of the template, and unescape() restores every text.

The result is the text and its loss mask: the spans (code points, end exclusive) of the assistants' contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: Tokens of an attachment: per started unit of its amount, and its unit.
EXPANSION = {"image": (85, 512 * 512), "audio": (25, 1), "document": (600, 1)}


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def flatten_parts(parts: Column) -> Column:
    """struct<content, attachments array<struct<place, kind, ref, tokens>>, attachment_tokens> of an array of parts.

    Null parts and null texts are empty; a part of an unknown kind counts as text; a null or negative amount as 0.
    """
    kept = F.filter(F.coalesce(parts, F.array().cast("array<struct<kind:string,text:string,ref:string,amount:double>>")), lambda p: p.isNotNull())
    media = lambda p: F.coalesce(p["kind"].isin(*EXPANSION), F.lit(False))

    def tokens(p: Column) -> Column:
        out = F.lit(0)
        for kind, (each, unit) in EXPANSION.items():
            out = F.when(p["kind"] == kind, F.lit(each) * F.ceil(F.greatest(F.coalesce(p["amount"].cast("double"), F.lit(0.0)), F.lit(0.0)) / unit)).otherwise(out)
        return out.cast("long")

    content = F.transform(kept, lambda p, i: F.when(media(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), i.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))))
    listed = F.filter(F.transform(kept, lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), tokens(p).alias("tokens"))), lambda a: F.coalesce(a["kind"].isin(*EXPANSION), F.lit(False)))
    total = F.aggregate(listed, F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return F.struct(F.array_join(content, "").alias("content"), listed.alias("attachments"), total.alias("attachment_tokens"))


def text_part(text: Column) -> Column:
    """A plain text as its only content part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<start, end>>, attachments, attachment_tokens) of each conversation.

    Turns go by turn number (null first), then role and text or parts as they were before escaping, so ties and repeated rows, which all stay, have one order.
    Null roles, texts and parts are empty; rows without conv_id form one conversation. A conversation is one value and so
    must fit in a task; there is no other bound on its turns. An empty table gives none; other columns are ignored.
    """
    content = F.col(f"`{parts_col}`") if parts_col else F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), content.alias("content"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("turns"))
    flat = lambda t: flatten_parts(t["content"] if parts_col else text_part(t["content"]))
    chats = chats.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT)).alias("head"), flat(t).alias("flat"))).alias("turns"))
    span = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("mask"))

    def add(a: Column, t: Column) -> Column:
        first = a["at"] + F.length(t["head"])
        last = first + F.length(t["flat"]["content"])
        mask = F.when(t["loss"], F.array_append(a["mask"], F.struct(first.alias("start"), last.alias("end")))).otherwise(a["mask"])
        return F.struct((last + F.lit(len(END))).cast("long").alias("at"), mask.cast(span).alias("mask"))

    mask = F.aggregate("turns", start, add, lambda a: a["mask"])
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["flat"]["content"], F.lit(END))), "")
    attachments = F.flatten(F.transform("turns", lambda t, i: F.transform(t["flat"]["attachments"], lambda a: F.struct(i.alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["flat"]["attachment_tokens"])
    return chats.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"), attachments.alias("attachments"), tokens.alias("attachment_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted) parsed from formatted and the loss mask alone.

    loss_text are the contents that lie at the mask's spans, one after the other; a span at which no content lies makes it null.
    """
    part = F.split("formatted", r"<\|end\|>", -1)
    chats = chats.select("conv_id", "formatted", "loss_mask", F.transform(F.slice(part, 1, F.size(part) - 1), lambda t: F.struct(F.length(t).alias("n"), F.substring_index(F.replace(t, F.lit(ROLE), F.lit("")), TEXT, 1).alias("role"), F.substring_index(t, TEXT, -1).alias("text"))).alias("parsed"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("texts"))

    def add(a: Column, t: Column) -> Column:
        last = a["at"] + t["n"]
        span = F.get("loss_mask", a["k"])
        hit = F.coalesce((span["end"] == last) & (span["start"] == last - F.length(t["text"])), F.lit(False))
        texts = F.when(hit, F.array_append(a["texts"], t["text"])).otherwise(a["texts"])
        return F.struct((last + F.lit(len(END))).cast("long").alias("at"), F.when(hit, a["k"] + 1).otherwise(a["k"]).alias("k"), texts.alias("texts"))

    loss = F.aggregate("parsed", start, add, lambda a: F.when(a["k"] == F.size("loss_mask"), F.array_join(F.transform(a["texts"], unescape), "")))
    turns = F.transform("parsed", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def chat_digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of format_chats()'s result."""
    back = read_back(chats)
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
