"""Chat formatting: conversations as training windows under a token budget, with a loss mask on assistant texts.

Method: budgeted windows, in DataFrame operations only. Prefix sums of turn
tokens choose the windows: a window takes the turns that begin in one stretch of
the prefix sum, and a turn longer than a stretch has a window of its own. So no
window waits for another, and no turn is cut. A window repeats some of the turns
before it (at most ``history`` tokens and ``history_turns`` turns) and the
conversation's system turn; what is repeated is not under the loss mask, so each
assistant text is under it once.

    tokens of a window <= system turn + history + two stretches = budget,

with a quarter of the budget for the system turn; a window that holds a longer
system turn, or one turn beyond the budget, is marked ``over_budget``. Tokens are counted as
words, numbers and marks (``piece_count``) or by any column of the caller.

A conversation is cut into blocks of ``block_turns`` turn numbers; windows end
with their block, and a block gets the last ``history_turns`` turns of the one
before. So one conversation with a third of all rows is spread over many tasks, and
no task holds more than some turns of text at a time.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts, ``<|`` gets a backslash
in between, and ``<\\|`` one more, so nothing but the template holds ``<|``; roles
are URL-encoded. :func:`parse` reads the turns and the text under the mask back.

Defined results: null text and role are empty, a null turn counts as turn 0, null
conv_id is one conversation, whose system turn is not repeated; turns are ordered by turn, role, text; repeated rows
are turns of their own; empty tables give no windows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"
PIECE = r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\x{09}-\x{0D}\x{20}\p{L}\p{M}\p{N}]"
TURN_TOKENS = 4  # what the template adds to a turn

BUDGET, HISTORY, HISTORY_TURNS, BLOCK_TURNS = 1024, 128, 8, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def piece_count(text: Column) -> Column:
    """Words, numbers of up to three digits, and single marks."""
    return F.regexp_count(text, F.lit(PIECE))


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens: Column | None) -> DataFrame:
    counted = piece_count(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) if tokens is None else F.coalesce(tokens, F.lit(0))
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.greatest(counted, F.lit(0)) + TURN_TOKENS).cast("long").alias("tokens"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS,
            block_turns: int = BLOCK_TURNS, tokens: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text", by_conversation: bool = False) -> DataFrame:
    """(conv_id, block, window, formatted, mask, n_turns, n_repeated, n_tokens, over_budget), a row for each window.

    ``mask`` are spans of ``formatted`` in code points, end exclusive. The first ``n_repeated`` of the
    ``n_turns`` turns are repeated. ``by_conversation`` lays the turns out by conversation instead of by
    block: for a caller that gathers windows by conversation, who saves an exchange of the texts with it.
    """
    stretch = (budget - budget // 4 - history) // 2
    if stretch < 1 or history < 0 or not 0 <= history_turns <= block_turns:
        raise ValueError("the budget leaves no room for turns, or the history is longer than a block")
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col, tokens)
    laid = turns.repartition("conv_id") if by_conversation else turns

    # Each turn in its block, and the last ones also in the next block, for its history.
    block = F.floor(F.col("turn") / block_turns)
    late = F.pmod(F.col("turn"), F.lit(block_turns)) >= block_turns - history_turns
    own = F.struct(block.alias("block"), F.lit(False).alias("carried"))
    carried = F.struct((block + 1).alias("block"), F.lit(True).alias("carried"))
    rows = laid.withColumn("b", F.explode(F.when(late, F.array(own, carried)).otherwise(F.array(own)))).select("*", "b.*").drop("b")

    # Prefix sums choose the windows; a window begins where the stretch changes, or before and after a long turn.
    in_block = ["conv_id", "block"]
    order = Window.partitionBy(*in_block).orderBy("turn", "role", "text")
    rows = rows.withColumn("start", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    place = F.when(~F.col("carried"), F.floor(F.col("start") / stretch) * 2 + (F.col("tokens") > stretch).cast("long"))
    rows = rows.withColumn("place", place)
    by_start = Window.partitionBy(*in_block).orderBy("start")
    begins = F.coalesce(F.lag("place").over(by_start) != F.col("place"), F.col("place").isNotNull())
    rows = rows.withColumn("begins", begins)
    rows = rows.withColumn("window", F.sum(F.col("begins").cast("long")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    # A turn is repeated in the windows that begin within ``history`` tokens of its own beginning.
    rows = rows.withColumn("last", F.max("window").over(by_start.rangeBetween(0, history)))
    first = F.greatest(F.col("window"), F.lit(1))
    rows = rows.where(F.col("last") >= first).withColumn("at", F.explode(F.sequence(first, F.col("last"))))
    rows = rows.withColumn("fresh", ~F.col("carried") & (F.col("at") == F.col("window")))

    item = F.struct("start", "turn", "role", "text", "tokens", "fresh")
    made = rows.groupBy(*in_block, F.col("at").alias("window")).agg(
        F.sort_array(F.collect_list(item)).alias("turns"), F.min(F.when(F.col("fresh"), F.col("turn"))).alias("from"))
    near = F.filter("turns", lambda t: t["fresh"] | (t["turn"] >= F.col("from") - history_turns))
    made = made.where(F.col("from").isNotNull()).withColumn("turns", near)

    # The system turn, unless the window holds it anyway.
    opening = turns.groupBy("conv_id").agg(F.min(F.struct(
        "turn", "role", F.when(F.col("role") == SYSTEM_ROLE, F.struct("text", "tokens")).alias("it"))).alias("system"))
    opening = opening.where(F.col("system.role") == SYSTEM_ROLE).select(
        F.col("conv_id").alias("_conv"), F.struct("system.turn", "system.role", "system.it.text", "system.it.tokens").alias("system"))
    made = made.join(opening, F.col("conv_id") == F.col("_conv"), "left")
    lead = F.element_at("turns", 1)
    absent = F.col("system").isNotNull() & ~((lead["turn"] == F.col("system.turn")) & (lead["role"] == SYSTEM_ROLE) & (lead["text"] == F.col("system.text")))
    system = F.struct(F.lit(-1).cast("long").alias("start"), F.col("system.turn").alias("turn"), F.col("system.role").alias("role"),
                      F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"), F.lit(False).alias("fresh"))
    made = made.withColumn("turns", F.when(absent, F.concat(F.array(system), F.col("turns"))).otherwise(F.col("turns")))
    return _formatted(made, budget)


def _formatted(made: DataFrame, budget: int) -> DataFrame:
    """Turns of a window -> its text and mask; each turn is escaped once, its spans follow from lengths before it."""
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    made = made.withColumn("p", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), (t["fresh"] & (t["role"] == TARGET_ROLE)).alias("loss"))))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(a.alias("start"), (a + F.length(p["body"])).alias("end")))
        return F.struct((acc["at"] + size(p)).alias("at"), F.when(p["loss"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    total = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    return made.select(
        "conv_id", "block", "window",
        F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("p", empty, step, lambda acc: acc["mask"]).alias("mask"),
        F.size("turns").alias("n_turns"), F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("n_repeated"),
        total.alias("n_tokens"), (total > budget).alias("over_budget"))


def parse(made: DataFrame) -> DataFrame:
    """Windows with ``turns`` array<struct<role, text>> and ``losses`` array<string>, both read from ``formatted`` alone
    (``losses`` with the spans of ``mask``) and unescaped."""
    ends = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.filter(F.transform(ends, lambda p: F.substring(p, len(START) + 1, 1 << 30)), lambda p: p != "")
    line = lambda p: F.position(F.lit("\n"), p)
    turn = lambda p: F.struct(F.url_decode(F.substring(p, F.lit(1), line(p) - 1)).alias("role"),
                              unescape(F.substring(p, line(p) + 1, F.length(p))).alias("text"))
    loss = lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    return made.withColumn("turns", F.transform(pieces, turn)).withColumn("losses", F.transform("mask", loss))
