"""Chat formatting with typed content parts, in DataFrame expressions only.

A conversation is a set of turns, each a role and an array of typed parts. ``PartVisitor`` flattens the parts of a
turn into one string: texts are escaped, attachments become placeholders whose references and expanded token counts
are recorded in order. ``format_conversations`` lays the turns out by a template and returns the spans of the loss
mask; ``read_back`` parses the formatted string again.

Defined results: null text, role or part is empty; a null turn sorts first; rows equal in turn are ordered by role,
then by content; repeated rows are kept as turns of their own; null ``conv_id`` is one conversation; a conversation
without an assistant has an empty loss mask; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: The type of a content part: ``units`` counts tiles of an image, seconds of audio, pages of a document.
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    """Adds a backslash between ``<`` and ``|`` (after those already there), so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Inverse of ``escape``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    break_in_role: str = "<|nl|>"
    learn_from: tuple[str, ...] = ("assistant",)


@dataclass(frozen=True)
class PartVisitor:
    """One method for each kind of part; each gives the rendered string and the number of tokens it stands for."""

    tokens_per_unit: dict[str, int] = field(default_factory=lambda: {"image": 256, "audio": 25, "document": 512})

    def text(self, part: Column) -> tuple[Column, Column]:
        shown = F.coalesce(part["text"], F.lit(""))
        return escape(shown), F.regexp_count(shown, F.lit(WORD)).cast("bigint")

    def attachment(self, kind: str, part: Column) -> tuple[Column, Column]:
        units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
        return F.lit(f"<|{kind}|>"), (units * F.lit(self.tokens_per_unit[kind])).cast("bigint")

    def visit(self, part: Column) -> Column:
        """Unknown kinds are flattened as text."""
        shown, tokens = self.text(part)
        for kind in self.tokens_per_unit:
            placeholder, n = self.attachment(kind, part)
            shown, tokens = F.when(part["kind"] == kind, placeholder).otherwise(shown), F.when(part["kind"] == kind, n).otherwise(tokens)
        return F.struct(shown.alias("shown"), tokens.alias("tokens"), F.coalesce(part["kind"].isin(list(self.tokens_per_unit)), F.lit(False)).alias("attached"), part["kind"].alias("kind"), part["ref"].alias("ref"))


def text_parts(text: Column) -> Column:
    """A plain text as the only part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def format_conversations(turns: DataFrame, template: Template = Template(), visitor: PartVisitor = PartVisitor()) -> DataFrame:
    """``turns``: conv_id, turn, role, parts. Returns one row per conversation:

    conv_id, n_turns, formatted, loss_mask (a boolean per turn), loss_spans (start and length in code points of each
    learned text within ``formatted``), attachments (turn number, kind, ref, tokens, in order), n_tokens.
    One shuffle by conversation; offsets are a running sum, so long conversations cost no repeated copying.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    shown_role = F.replace(escape(role), F.lit("\n"), F.lit(template.break_in_role))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), shown_role.alias("shown_role"),
        F.transform(F.coalesce(F.col("parts"), F.array().cast(PARTS)), visitor.visit).alias("flat"),
    ).select(
        "conv_id", "turn", "role", "shown_role",
        F.array_join(F.transform("flat", lambda x: x["shown"]), "").alias("body"),
        F.filter("flat", lambda x: x["attached"]).alias("attached"),
        F.aggregate("flat", F.lit(0).cast("bigint"), lambda n, x: n + x["tokens"]).alias("tokens"),
    )
    whole = F.concat(F.lit(template.start), F.col("shown_role"), F.lit("\n"), F.col("body"), F.lit(template.end + "\n"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    laid = (
        rows.withColumn("whole", whole)
        .withColumn("seq", F.row_number().over(order))
        .withColumn("before", F.coalesce(F.sum(F.length("whole")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("learned", F.col("role").isin(list(template.learn_from)))
    )
    turn = F.struct(
        "seq", "whole", "learned",
        (F.col("before") + len(template.start) + F.length("shown_role") + 1).alias("start"),
        F.length("body").alias("length"), "attached",
    )
    gathered = laid.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"), F.sum("tokens").alias("n_tokens"))
    return gathered.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["whole"]), "").alias("formatted"),
        F.transform("t", lambda x: x["learned"]).alias("loss_mask"),
        F.transform(F.filter("t", lambda x: x["learned"]), lambda x: F.struct(x["start"].cast("bigint").alias("start"), x["length"].cast("bigint").alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct(x["seq"].alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        "n_tokens",
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns in a formatted string as array<struct<role, text>>, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, template.end.replace("|", r"\|") + "\n", -1)

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(template.start) + 1))
        role = F.substring_index(rest, "\n", 1)
        return F.struct(
            unescape(F.replace(role, F.lit(template.break_in_role), F.lit("\n"))).alias("role"),
            unescape(F.substr(rest, F.length(role) + 2)).alias("text"),
        )

    return F.transform(F.filter(pieces, lambda x: x != ""), turn)
