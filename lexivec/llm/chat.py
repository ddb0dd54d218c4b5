"""Chat formatting in budgeted windows, in DataFrame functions.

A conversation's turns are laid out as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control
strings in texts are escaped reversibly: ``<|`` becomes ``<\\|``, and what looks escaped
gets one more backslash. Prefix sums of turn tokens cut the turns into windows of at most
NEW tokens; a turn that straddles a cut has a window of its own, so only single turns can
be over it. Each later window begins with the system turn and the last turns before it
(at most HISTORY_TURNS and HISTORY tokens), whose targets are masked there: the loss mask
has each assistant text once, in the window where it is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens (words, and TURN for its marks) of new turns in a window, and of repeated history.
NEW, HISTORY, HISTORY_TURNS, TURN = 320, 128, 2, 4
#: Turns in a stretch of a conversation, by place; each stretch is cut into windows on its own.
STRETCH = 64
#: Turn numbers of a conversation that are counted together to find the places.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def head(role: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"))


def layout(turn: Column) -> Column:
    return F.concat(head(turn["role"]), escape(turn["text"]), F.lit(f"{END}\n"))


def with_place(turns: DataFrame) -> DataFrame:
    """turns (conv_id, t) with ``place``: the number of turns of the conversation before it.

    Turns are counted by blocks of BLOCK numbers (rows of a block are counted in each task
    first), blocks are summed up for each conversation, and rows are numbered within their
    block, so a long conversation is not sorted by one task.
    """
    blocks = turns.withColumn("block", F.coalesce(F.floor(F.col("t.turn") / BLOCK), F.lit(-(2**62))).cast("long"))
    counts = blocks.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # blocks that begin at place 0, nearly all, need no row
    offsets = counts.withColumn("before", before).where("before > 0").select(F.col("conv_id").alias("_of"), F.col("block").alias("_block"), "before")
    inside = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("t")) - 1
    joined = blocks.withColumn("inside", inside).join(offsets, F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_block")), "left")
    return joined.select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("place"), "t")


def windows(rows: DataFrame) -> DataFrame:
    """Windows of (conv_id, turn, role, text) rows.

    Returns conv_id, place (struct that orders the windows), text, n_context (turns
    repeated at the start), n_new, loss (array of struct start, length: code points of
    the escaped assistant texts under the loss mask).

    Null roles and texts count as empty, null turns come first, rows of the same turn
    follow by role and text, repeated rows are turns of their own, null ids are one
    conversation, and other columns don't matter. The system turn is a conversation's
    first row if its role is "system"; it comes on top of the budget. A conversation of
    very many turns is cut into stretches of turns by their place, whatever their numbers,
    which are spread over tasks; the last turns of a stretch are also sent to the next one
    as history.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    system = turns.groupBy("conv_id").agg(F.min("t").alias("system")).where(F.col("system.role") == "system").select(F.col("conv_id").alias("of"), "system")
    placed = with_place(turns)
    stretch = F.floor(F.col("place") / STRETCH).cast("long")
    late = F.pmod(F.col("place"), F.lit(STRETCH)) >= STRETCH - HISTORY_TURNS
    own, also = F.struct(stretch.alias("at"), F.lit(1).alias("new")), F.struct((stretch + 1).alias("at"), F.lit(0).alias("new"))
    dealt = placed.withColumn("to", F.explode(F.when(late, F.array(own, also)).otherwise(F.array(own)))).select("conv_id", F.col("to.at").alias("stretch"), F.col("to.new").alias("new"), "place", "t")
    counted = dealt.withColumn("tokens", F.regexp_count("t.text", F.lit(WORD)) + TURN)
    order = Window.partitionBy("conv_id", "stretch").orderBy("place")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        counted.withColumn("until", F.sum("tokens").over(run))
        .withColumn("old", F.sum(F.when(F.col("new") == 0, F.col("tokens")).otherwise(0)).over(run))
        .withColumn("past", F.collect_list(F.struct((F.col("until") - F.col("tokens")).alias("at"), "place", "t")).over(order.rowsBetween(-HISTORY_TURNS, -1)))
        .where("new = 1")
    )
    at, to = F.col("until") - F.col("old") - F.col("tokens"), F.col("until") - F.col("old")
    first = F.floor(at / NEW)
    placed = summed.withColumn("cut", first.cast("long")).withColumn("straddles", (F.floor((to - 1) / NEW) != first).cast("int"))
    # the system turn, which is at place 0, comes on its own
    near = F.filter("past", lambda p: F.col("until") - F.col("tokens") - p["at"] <= HISTORY)
    cut = placed.groupBy("conv_id", "stretch", "cut", "straddles").agg(
        F.sort_array(F.collect_list(F.struct("place", "t"))).alias("own"),
        F.min_by(near, "place").alias("history"),
    )
    joined = cut.join(system, cut["conv_id"].eqNullSafe(system["of"]), "left")
    is_late = F.col("system").isNotNull() & (F.get("own", F.lit(0))["place"] > 0)
    past = lambda history: F.transform(history, lambda p: p["t"])
    context = F.when(is_late, F.concat(F.array("system"), past(F.filter("history", lambda p: p["place"] > 0)))).otherwise(past(F.col("history")))
    parts = joined.select("conv_id", F.struct("stretch", "cut", "straddles").alias("place"), context.alias("context"), F.transform("own", lambda x: x["t"]).alias("own"))
    parts = parts.withColumn("before", F.transform("context", layout)).withColumn("after", F.transform("own", layout))
    size_before = F.length(F.array_join("before", ""))

    def span(t: Column, i: Column) -> Column:
        ahead = F.aggregate(F.slice("after", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
        return F.when(t["role"] == "assistant", F.struct((size_before + ahead + F.length(head(t["role"]))).alias("start"), F.length(escape(t["text"])).alias("length")))

    return parts.select(
        "conv_id",
        "place",
        F.concat(F.array_join("before", ""), F.array_join("after", "")).alias("text"),
        F.size("before").alias("n_context"),
        F.size("after").alias("n_new"),
        F.filter(F.transform("own", span), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, place, turns array<struct<role,text>>, targets array<string>): the new turns and unmasked texts of each window, unescaped."""
    parts = F.filter(F.split("text", r"<\|im_end\|>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(START) + 1), F.length(p))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    new = F.slice(parts, F.col("n_context") + 1, F.col("n_new"))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "place", F.transform(new, turn).alias("turns"), targets.alias("targets"), F.length("text").alias("chars"))
