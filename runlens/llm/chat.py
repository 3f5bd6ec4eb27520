"""Chat formatting from typed content parts.

A turn is a role and a list of parts: text, image, audio or document.  A visitor
takes the parts in order: text is written with its control strings escaped,
any other part becomes a placeholder, and its reference and the number of
tokens it will expand to are recorded.  The template is

    <|im_start|>ROLE \\n BODY <|im_end|> \\n

Escaping puts a backslash into every ``<|`` (and one more into every ``<\\|``,
and so on), so that no text holds ``<|``; taking one out restores the text.
Roles have their line ends percent-encoded as well.

The formatted output has one row per turn, with the place of the loss (the body of an
assistant turn) in it: a conversation of any length is never one value here.
``whole`` joins the turns of each conversation.

Only DataFrame functions are used.  Defined results: null roles and texts are
empty; null parts are left out; null turns come last; turns of equal number
are ordered by role, then body; a null conversation id is a
conversation of its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of one unit (image tile, second of audio, page of a document), and those that frame the part.
UNIT_TOKENS = {"image": 170, "audio": 25, "document": 600}
FRAME_TOKENS = {"image": 85, "audio": 2, "document": 2}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def text_part(text: Column) -> Column:
    """A turn's parts when it is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def visit(part: Column) -> Column:
    """What one part writes: escaped text, or a placeholder (unknown types keep theirs, escaped)."""
    text = escape(F.coalesce(part["text"], F.lit("")))
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind == "text", text).otherwise(F.concat(F.lit("<|"), F.regexp_replace(kind, r"[^A-Za-z0-9_]", "_"), F.lit("|>")))


def tokens_of(part: Column) -> Column:
    """Tokens that a placeholder expands to (no units: one)."""
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
    cost = F.lit(1).cast("bigint")
    for kind in UNIT_TOKENS:
        cost = F.when(part["type"] == kind, FRAME_TOKENS[kind] + UNIT_TOKENS[kind] * units).otherwise(cost)
    return cost


def format_turns(turns: DataFrame, parts: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_chars, attachments per turn.

    ``loss_start`` counts code points from 0 within ``formatted``; turns of
    other roles have no loss (0 characters).  ``attachments``: type, ref and
    tokens of each placeholder, in order.
    """
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.withColumn("parts", F.filter("parts", lambda p: p.isNotNull()))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", head.alias("head"), F.array_join(F.transform("parts", visit), "").alias("body"),
                       F.transform(F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text"),
                                   lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens"))).alias("attachments"))
    loss = F.col("role") == "assistant"
    return rows.select("conv_id", "turn", F.concat("head", "body", F.lit(f"{END}\n")).alias("formatted"),
                       F.length("head").alias("loss_start"), F.when(loss, F.length("body")).otherwise(0).alias("loss_chars"), "attachments")


def parse_turns(formatted: DataFrame) -> DataFrame:
    """Read the output back: conv_id, turn, role, text, loss_text (unescaped), formatted.

    Role and text come from the marks in ``formatted``, the loss from its place there.
    """
    found = rf"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"
    role, text = (F.regexp_extract("formatted", found, i) for i in (1, 2))
    under = F.expr("substring(formatted, loss_start + 1, loss_chars)")
    return formatted.select("conv_id", "turn", "formatted", unescape_role(role).alias("role"), unescape(text).alias("text"), unescape(under).alias("loss_text"))


def whole(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (start and length of each span in the whole text) per conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").isNull(), "turn", "formatted").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("formatted")).over(order), F.lit(0))
    placed = formatted.withColumn("at", before)
    t = F.struct(F.col("turn").isNull().alias("none"), "turn", "formatted", (F.col("at") + F.col("loss_start")).alias("start"), F.col("loss_chars").alias("chars"))
    own = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["chars"] > 0), lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars")))
    return own.select("conv_id", F.array_join("t.formatted", "").alias("formatted"), spans.alias("loss"))
