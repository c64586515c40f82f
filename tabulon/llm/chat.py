"""Chat formatting with typed content parts.

A message is a list of typed parts.  A visitor turns every part into one
segment: text becomes escaped text, an image, audio clip or document becomes
an ordered placeholder whose reference and expanded token count go to the
attachment list.  Segments of a conversation are joined by a template that
marks turns and parts; control strings inside texts are escaped so that the
output can be read back exactly, and the loss mask is a list of code point
spans over the formatted text.

Only built-in column functions run; one shuffle by conversation.  A
conversation is one output row, so its turns meet in one row by definition.

Defined results: null role, text or part fields read as empty; an unknown
part type is flattened as text; turns are ordered by (turn, role, parts) with
nulls first, so ties and repeated rows have one order; rows with a null
``conv_id`` form one conversation; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import let

TURN, END, PART = "<|turn|>", "<|end|>\n", "<|part|>"
# Control strings: an opening bracket and one of these rests.  Every "<|" counts as one.
_RESTS = r"\||/?s>|</?SYS>>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*(?:{_RESTS}))"
_UNESCAPE = rf"([<\[])\\(\\*(?:{_RESTS}))"

PART_TYPE = ("struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>")

# Expanded tokens: an image costs a base and so many for each tile, audio by the second, documents by the page.
IMAGE_BASE, IMAGE_TILE, IMAGE_TILE_SIDE = 85, 170, 512
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 800


def escape(text: Column) -> Column:
    """Puts one backslash behind the bracket of every control string (also of
    one that already has backslashes there); :func:`unescape` takes it out."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A list with one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("long").alias("pages"))).cast(f"array<{PART_TYPE}>")


def _expanded(part: Column) -> Column:
    def tiles(side: str) -> Column:
        return F.ceil(F.greatest(F.coalesce(part[side], F.lit(0)), F.lit(1)) / IMAGE_TILE_SIDE)
    return (F.when(part["type"] == "image", IMAGE_BASE + IMAGE_TILE * tiles("width") * tiles("height"))
            .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
            .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * DOCUMENT_TOKENS_PER_PAGE)
            .otherwise(0).cast("long"))


def visit(part: Column, turn: Column, index: Column, loss: Column) -> Column:
    """One part as a segment: its text in the output, whether the loss covers it, and the attachment it stands for."""
    attached = F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))
    mark = F.concat(F.lit("<|"), part["type"], F.lit(":"), turn.cast("string"), F.lit("."), index.cast("string"), F.lit("|>"))
    note = F.struct(turn.cast("long").alias("turn"), index.cast("long").alias("part"), part["type"].alias("type"),
                    F.coalesce(part["ref"], F.lit("")).alias("ref"), _expanded(part).alias("tokens"))
    return F.struct(F.when(attached, mark).otherwise(escape(F.coalesce(part["text"], F.lit("")))).alias("text"),
                    (loss & ~attached).alias("loss"), F.when(attached, note).alias("attachment"))


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``messages``: conv_id, turn, role, parts (list of typed parts).

    One row per conversation: conv_id, n_turns, formatted, loss_spans
    (start, end in code points), attachments (turn, part, type, ref, tokens),
    attachment_tokens.
    """
    rows = messages.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("parts"), F.array().cast(f"array<{PART_TYPE}>")).alias("parts")).alias("m"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("_tc_turns"))

    def plain(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"),
                        F.lit(None).cast("struct<turn:long,part:long,type:string,ref:string,tokens:long>").alias("attachment"))

    def turn_segments(m: Column, t: Column) -> Column:
        head = F.concat(F.lit(TURN), _role_out(m["role"]), F.lit("\n"))
        body = F.flatten(F.transform(m["parts"], lambda p, i: F.when(
            i == 0, F.array(visit(p, t, i, m["role"] == loss_role))).otherwise(
            F.array(plain(F.lit(PART)), visit(p, t, i, m["role"] == loss_role)))))
        return F.concat(F.array(plain(head)), body, F.array(plain(F.lit(END))))

    segs = convs.withColumn("_tc_segs", F.flatten(F.transform("_tc_turns", turn_segments)))
    ends = F.aggregate(
        F.col("_tc_segs"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("ends")),
        lambda a, s: F.struct((a["at"] + F.length(s["text"])).alias("at"),
                              F.array_append(a["ends"], a["at"] + F.length(s["text"])).alias("ends")))["ends"]
    spans = F.filter(F.transform("_tc_segs", lambda s, i: F.when(s["loss"], F.struct(
        (F.get(F.col("_tc_ends"), i) - F.length(s["text"])).alias("start"), F.get(F.col("_tc_ends"), i).alias("end")))),
        lambda x: x.isNotNull())
    notes = F.filter(F.transform("_tc_segs", lambda s: s["attachment"]), lambda x: x.isNotNull())
    return segs.withColumn("_tc_ends", ends).withColumn("attachments", notes).select(
        "conv_id", F.size("_tc_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_tc_segs", lambda s: s["text"]), "").alias("formatted"),
        spans.alias("loss_spans"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: list of (role, parts), texts unescaped, placeholders as they stand."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)

    def one(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(TURN) + 1))
        return let(F.instr(inner, "\n"), lambda at: F.struct(
            _role_in(F.substr(inner, F.lit(1), at - 1)).alias("role"),
            F.transform(F.split(F.substr(inner, at + 1), r"<\|part\|>", -1), unescape).alias("parts")))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Turns and loss text read back from the output of :func:`format_conversations`, as digests."""
    back = formatted.withColumn("_tc_back", read_turns(F.col("formatted"))) \
        .withColumn("_tc_loss", F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), ""))
    said = F.array_join(F.transform("_tc_back", lambda t: F.concat(
        t["role"], F.lit("\n"), F.array_join(t["parts"], ""), F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_tc_back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_tc_loss").cast("long").alias("loss_chars"), F.sha2("_tc_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "attachment_tokens")
