"""Operator 9, chat formatting: every participant's view of a conversation.

For each participant the dialogue is rendered with that speaker as the assistant and
all others as named users; the mask marks the characters that the assistant says,
its closing mark included. ``perspectives`` makes one segment a turn and view;
``rendered`` joins them to the text of each view, in parts: a part holds the turns of
``BLOCK`` turn numbers, starts where the part before it ends, and has its mask in
positions of the whole view. So a conversation of any length is never gathered in one
task: only the lengths of its parts are added up in a row. Rows of one turn number
stay together. The parts of a view in order, joined, are the view.

Speakers and contents can't forge a mark: where they hold ``<|``, or a speaker holds
``|>``, a backslash is put between the two characters, and one more where backslashes
stand there already, so ``unescaped`` gets the original back.

Defined results: a null role is the speaker "unknown"; the system speaks in every
view and has none itself; a null text is an empty turn; a null conv_id is a
conversation of its own; a null turn comes first, in a part of its own; ties of a
turn go by speaker, then by what is said; repeated rows are rendered as often as they
come; an empty table gives an empty result; columns of other names, results' names
among them, are never looked at; a very long text is one segment, as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import backquoted

SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Turn numbers of one part of a rendered view.
BLOCK = 1000


def _escaped(c: Column, first: str, second: str) -> Column:
    """A backslash more between two characters that are a mark's."""
    return F.regexp_replace(c, rf"{first}(\\*){second}", rf"{first}\\$1{second}".replace(r"\|", "|"))


def unescaped(c: Column) -> Column:
    """What an escaped content was."""
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, mask_start, mask_end (null where nothing is to be learnt) of each turn in each view."""
    said = turns.select(
        F.col(backquoted(conv)).alias("conv_id"),
        F.col(backquoted(turn)).alias("turn"),
        F.coalesce(F.col(backquoted(role)).cast("string"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col(backquoted(text)), F.lit("")).alias("content"),
    )
    said = said.withColumn("content", _escaped(F.col("content"), "<", r"\|"))
    # Few rows a conversation, summed up before the exchange.
    cast = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("cast_id"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(own, F.lit(f"{OPEN}assistant{CLOSE}"))
        .when(F.col("speaker") == SYSTEM, F.lit(f"{OPEN}system{CLOSE}"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), _escaped(_escaped(F.col("speaker"), "<", r"\|"), r"\|", ">"), F.lit(CLOSE)))
    )
    segment = F.concat(head, F.col("content"), F.lit(END))
    return (
        said.join(cast, F.col("conv_id").eqNullSafe(F.col("cast_id")))
        .select("conv_id", "perspective", "turn", "speaker", segment.alias("segment"), F.when(own, F.length(head)).cast("long").alias("mask_start"), F.when(own, F.length(segment)).cast("long").alias("mask_end"))
    )


def rendered(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, part, start, text and mask (array of start, end in the whole view) of each part of each view."""
    part = F.floor(F.col("turn") / block).cast("long")
    ordered = segments.groupBy("conv_id", "perspective", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "speaker", "segment", "mask_start", "mask_end"))).alias("s")
    )
    zero = F.lit(0).cast("long")
    length = F.aggregate("s", zero, lambda acc, x: acc + F.length(x["segment"]))
    ordered = ordered.select("conv_id", "perspective", "part", "s", length.alias("length"))
    # One row a part, whatever it holds: lengths alone are added up.
    lengths = ordered.select("conv_id", "perspective", "part", "length")
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    names = ("conv_id", "perspective", "part")
    starts = lengths.select(*[F.col(c).alias(f"of_{c}") for c in names], F.coalesce(F.sum("length").over(before), zero).alias("start"))
    placed = ordered.join(starts, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in names]).select(*names, "s", "start")
    state = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def add(acc, x):
        here = F.named_struct(F.lit("start"), acc["at"] + x["mask_start"], F.lit("end"), acc["at"] + x["mask_end"])
        return F.named_struct(F.lit("at"), acc["at"] + F.length(x["segment"]), F.lit("mask"), F.when(x["mask_start"].isNull(), acc["mask"]).otherwise(F.concat(acc["mask"], F.array(here))))

    return placed.select("conv_id", "perspective", "part", "start", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), F.aggregate("s", state, add)["mask"].alias("mask"))
