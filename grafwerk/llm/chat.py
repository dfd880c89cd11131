"""Chat formatting with DataFrame functions only.

A declarative ``Template`` gives the marks around a turn, the roles under the loss and the
turns that may follow each other. The state of the finite-state machine is the role of the
turn before, so a window with ``lag`` runs it row by row. Every turn becomes text segments
(mark, body, mark) with a loss flag; control strings inside roles and bodies are written as
entities, which can be undone exactly.

Defined results: rows of a conversation are ordered by turn, then role, then text, nulls
first, so ties and repeated rows have one order and all stay; a null text or role is an
empty one; a null conv_id is a conversation of its own; a conversation that breaks the turn
order is formatted all the same and marked ``valid`` = false; empty tables give empty ones.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a piece of text that spans are read from.
PIECE = 4096


@dataclass(frozen=True)
class Template:
    """``open`` holds {role}; no mark may occur in text, see ``entities``."""

    open: str = "<turn>### {role}: "
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state (role before, "" at the start) -> roles that may come next
    next_roles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last_roles: tuple[str, ...] = ("assistant",)
    #: Written for a character wherever it occurs in a role or text; the first also guards the rest.
    entities: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), ("#", "&num;"), (": ", ":&sp;"))

    def escape(self, text: Column) -> Column:
        for plain, entity in self.entities:
            text = F.replace(text, F.lit(plain), F.lit(entity))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, entity in reversed(self.entities):
            text = F.replace(text, F.lit(entity), F.lit(plain))
        return text


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, nth, ok (the machine has this step), segments: array of
    (text, loss), and at, the code points of the turns before it. One shuffle, by conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    before = F.lag("role", 1, "").over(order)
    ok = F.lit(False)
    for state, following in template.next_roles.items():
        ok = ok | ((before == state) & F.col("role").isin(*following))
    begin, middle = template.open.split("{role}")
    head = F.concat(F.lit(begin), template.escape(F.col("role")), F.lit(middle))
    part = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    turns = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.row_number().over(order).alias("nth"),
        ok.alias("ok"),
        F.array(part(head, F.lit(False)), part(template.escape(F.col("text")), F.col("role").isin(*template.loss_roles)), part(F.lit(template.close), F.lit(False))).alias("segments"),
    )
    size = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.char_length(s["text"]))
    before_it = order.rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("size", size).select("conv_id", "nth", "role", "ok", "segments", F.coalesce(F.sum("size").over(before_it), F.lit(0)).alias("at"))


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted text, loss_spans (start and length in code points), valid."""
    # in a turn, the spans of its segments under the loss; few segments, so the sum is short
    begin = lambda s, k: F.aggregate(F.slice(s, 1, k), F.lit(0).cast("long"), lambda n, x: n + F.char_length(x["text"]))
    spans = F.filter(
        F.transform("segments", lambda p, k: F.struct((F.col("at") + begin(F.col("segments"), k)).alias("start"), F.char_length(p["text"]).cast("long").alias("length"), p["loss"].alias("loss"))),
        lambda p: p["loss"],
    )
    own = F.transform(spans, lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    rows = segments(conversations, template).select("conv_id", "ok", F.struct("nth", F.array_join("segments.text", "").alias("text"), own.alias("spans"), "role").alias("turn"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.bool_and("ok").alias("ok"))
    last = F.element_at("turns", -1)["role"]
    return turns.select("conv_id", F.array_join("turns.text", "").alias("formatted"), F.flatten("turns.spans").alias("loss_spans"), (F.col("ok") & last.isin(*template.last_roles)).alias("valid"))


def slices(text: Column, spans: Column) -> Column:
    """The code points of ``text`` in each span (start, length). The text is cut into pieces
    once, so that a span costs its own length and a piece, not all the text before it."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def one(pieces: Column, s: Column) -> Column:
        first, end = F.floor(s["start"] / PIECE), s["start"] + s["length"]
        part = lambda i: F.substr(F.get(pieces, i.cast("int")), (F.greatest(s["start"] - i * PIECE, F.lit(0)) + 1).cast("int"), (F.least(end, (i + 1) * PIECE) - F.greatest(s["start"], i * PIECE)).cast("int"))
        return F.when(s["length"] > 0, F.array_join(F.transform(F.sequence(first, F.floor((end - 1) / PIECE)), part), "")).otherwise("")

    # the one-element array binds the pieces, so that they are made once for each text
    return F.transform(F.array(cut), lambda pieces: F.transform(spans, lambda s: one(pieces, s)))[0]


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns: array of (role, text), loss_texts: array, all from the output alone."""
    begin, middle = template.open.split("{role}")
    pieces = F.transform(
        F.filter(F.split("formatted", "\\Q" + template.close + "\\E", -1), lambda p: p != ""),
        lambda p: F.struct(
            template.unescape(F.substring_index(F.substr(p, F.lit(len(begin) + 1)), middle, 1)).alias("role"),
            template.unescape(F.substr(p, F.position(F.lit(middle), p, F.lit(len(begin) + 1)) + len(middle))).alias("text"),
        ),
    )
    lost = F.transform(slices(F.col("formatted"), F.col("loss_spans")), template.unescape)
    return formatted.select("conv_id", "valid", "formatted", pieces.alias("turns"), lost.alias("loss_texts"))
