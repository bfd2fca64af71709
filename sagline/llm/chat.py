"""Chat formatting of typed content parts, in DataFrame operations only.

A message holds parts of text, image, audio and document kind. Each kind has its own rule; text is escaped, the
others become placeholders, recorded as attachments with the number of tokens that they expand to. Turns are
put between control strings that no escaped text can hold, and the places of assistant text are kept as a loss
mask. The formatted string alone suffices to read the conversation back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, BODY, END = "<|start|>", "<|message|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Control strings of common templates start with one of these two characters and go on so.
_CONTROL = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
PARTS = "array<struct<kind:string, text:string, ref:string, width:int, height:int, seconds:double, pages:int>>"
# Image tokens per tile of so many pixels a side, audio tokens per second, document tokens per page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 512


def escape(text: Column) -> Column:
    """One more backslash inside every control string, so that none is left and :func:`unescape` undoes it exactly."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def text_parts(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``parts`` of one text part each; a null text is an empty one."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                    *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return messages.withColumn("parts", F.array(part))


def _written(p: Column) -> Column:
    """A part as it stands in the formatted string."""
    out = F.when(p.kind == "text", escape(F.coalesce(p.text, F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(p.kind == kind, F.lit(mark))
    return out.otherwise(F.lit(""))


def _expanded(p: Column) -> Column:
    """Tokens that a part which is not text expands to; unknown measures count as nothing."""
    tiles = F.ceil(p.width / TILE) * F.ceil(p.height / TILE)
    return F.coalesce(F.when(p.kind == "image", tiles).when(p.kind == "audio", F.ceil(p.seconds * AUDIO_RATE)).when(
        p.kind == "document", p.pages * PAGE_TOKENS), F.lit(0)).cast("long")


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss, attachments, expanded_tokens``, one row per conversation.

    ``loss`` has start (from 1) and length of each text of role ``learn`` in ``formatted``; ``attachments`` has
    turn, ordinal in the conversation, kind, ref and tokens. Rows go by turn, ties by role, then body; null roles
    and texts are empty, parts that are null or of an unknown kind write nothing, a null list of parts is empty.
    Repeated rows are turns of their own. Rows without a conversation id form one conversation with a null id. A
    conversation is one string and so one row.
    """
    every = F.filter(F.coalesce(F.col(parts), F.from_json(F.lit("[]"), PARTS)), lambda p: p.isNotNull())
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                           every.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", F.array_join(F.transform("parts", _written), "").alias("body"), F.transform(
        F.filter("parts", lambda p: p.kind.isin(list(PLACEHOLDERS))),
        lambda p: F.struct(p.kind.alias("kind"), p.ref.alias("ref"), _expanded(p).alias("tokens"))).alias("attached"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumns({"head": F.length(head), "piece": F.concat(head, "body", F.lit(END))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumns({
        "seq": F.row_number().over(order),
        "before": F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    span = F.when(F.col("role") == learn, F.struct((F.col("before") + F.col("head") + 1).cast("int").alias("start"),
                                                   F.length("body").alias("length")))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "seq", "piece", span.alias("span"), F.col("turn").alias("turn"), "attached"))).alias("t"))
    flat = F.flatten(F.transform("t", lambda t: F.transform(t.attached, lambda x: F.struct(
        t.turn.alias("turn"), x.kind.alias("kind"), x.ref.alias("ref"), x.tokens.alias("tokens")))))
    numbered = F.transform(flat, lambda x, i: F.struct((i + 1).alias("ordinal"), x.turn.alias("turn"), x.kind.alias("kind"),
                                                       x.ref.alias("ref"), x.tokens.alias("tokens")))
    return whole.select(
        "conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"), numbered.alias("attachments"),
        F.aggregate(numbered, F.lit(0).cast("long"), lambda a, x: a + x.tokens).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """Role and body of every turn of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: F.startswith(p, F.lit(START)))
    halves = F.transform(pieces, lambda p: F.split(F.substring(p, len(START) + 1, F.length(p)), r"<\|message\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("body")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.start, s.length))), "")
