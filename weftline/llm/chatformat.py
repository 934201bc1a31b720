"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A conversation is a log of events, partitioned by conversation and ordered by
sequence number. Events of one message fold to its final text:

* ``message`` sets the text, ``edit`` replaces it, ``delta`` appends to it;
* ``regenerate`` clears it, and the deltas that follow are the new attempt;
* ``delete`` clears it and, if nothing follows, removes the message.

The fold needs no state: the last event that sets or clears is a window
maximum, and the text is that event's and the later deltas', joined in order.

Rendering marks turns with ``<|im_start|>role`` and ``<|im_end|>``. Inside
texts and roles the characters that open control strings of common templates
("<" and "[") become entities, and so does "&", which makes this reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&NewLine;"))


def escaped(c: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column, pairs=ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log with conv_id, seq, message, kind, role and text.

    One row per message that is left: conv_id, seq (of the message's first
    event), role (the last non-null one, else empty) and text. Events of equal
    seq are ordered by kind, role and text; null texts are empty, an unknown or
    null kind counts as ``message``; null conv_id or message are groups of their
    own. A message of any length folds in one group, as its text is one value.
    """
    kinds = F.when(F.col("kind").isin("delta", "edit", "regenerate", "delete"), F.col("kind")).otherwise("message")
    at = F.struct(F.col("seq"), F.col("kind"), F.col("role"), F.col("text"), F.col("nth"))
    log = events.select(
        "conv_id", "message", F.col("seq").cast("bigint").alias("seq"), kinds.alias("kind"), "role",
        F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("nth"),
    )
    of_message = Window.partitionBy("conv_id", "message")
    set_at = F.max(F.when(F.col("kind") != "delta", at)).over(of_message)
    log = log.withColumn("at", at).withColumn("set_at", set_at)
    live = F.col("set_at").isNull() | (F.col("at") >= F.col("set_at"))
    shown = F.when(F.col("kind").isin("regenerate", "delete"), F.lit("")).otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.when(live, F.struct("at", shown.alias("shown")))))
    folded = log.groupBy("conv_id", "message").agg(
        F.min("seq").alias("seq"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role")))["role"].alias("role"),
        F.array_join(F.transform(parts, lambda p: p["shown"]), "").alias("text"),
        F.max(F.struct("at", "kind"))["kind"].alias("last"),
    )
    return folded.where(F.col("last") != "delete").select(
        "conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), "text"
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations: conv_id, formatted and loss.

    ``formatted`` joins the turns in order of seq (nulls first, then role and
    text). ``loss`` is the mask: for each turn of ``loss_role`` the turn's
    number, and the start and length, in code points from the turn's first, of
    its text as it stands in ``formatted``. Null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escaped(role, ROLE_ESCAPES), F.lit("\n"))
    body = escaped(text)
    turns = messages.select(
        "conv_id",
        F.struct(
            F.col("seq"), role.alias("role"), text.alias("text"),
            F.concat(head, body, F.lit(CLOSE)).alias("turn"),
            F.length(head).alias("start"), F.length(body).alias("length"),
        ).alias("t"),
    )
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    numbered = F.transform(
        F.col("t"),
        lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["role"].alias("role")),
    )
    loss = F.transform(
        F.filter(numbered, lambda t: t["role"] == loss_role),
        lambda t: F.struct(t["turn"].alias("turn"), t["start"].alias("start"), t["length"].alias("length")),
    )
    return turns.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss")
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss`` alone: conv_id, turns (role, text) and loss_text."""
    raw = F.split("formatted", F.lit(CLOSE.replace("|", r"\|")), -1)
    chunks = F.slice(raw, 1, F.size(raw) - 1)  # nothing follows the last mark
    cut = rendered.withColumn("chunks", chunks)
    inner = lambda c: F.substring(c, len(OPEN) + 1, 1 << 30)
    turns = F.transform(
        F.col("chunks"),
        lambda c: F.struct(
            unescaped(F.substring_index(inner(c), "\n", 1), ROLE_ESCAPES).alias("role"),
            unescaped(F.substring(inner(c), F.instr(inner(c), "\n") + 1, F.length(c))).alias("text"),
        ),
    )
    masked = F.transform(
        F.col("loss"),
        lambda m: unescaped(F.substring(F.element_at(F.col("chunks"), (m["turn"] + 1).cast("int")), m["start"] + 1, m["length"])),
    )
    return cut.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")
