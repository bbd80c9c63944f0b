"""Conversations as budgeted, turn-aligned training windows, in column expressions only.

A turn costs its words plus one token.  Prefix sums of these costs place each
turn in a span of ``budget - history - system`` tokens, by where the turn
starts, so a window exceeds the budget by less than its last turn.  A window
repeats the system turn and, of the turns of the span before it, those that
start at most ``history`` tokens before its first new turn.  Only assistant
turns that are new to a window are under its loss mask, so each is trained
on once.  Prefix sums are taken in blocks of turns and then over the blocks'
totals: no task holds a whole long conversation.

The template writes a turn as ``<s>[role]`` line feed text ``</s>`` line
feed.  In roles and texts the characters ``\\ < [ ]`` become ``\\e \\l \\b
\\c``; as every backslash of an escaped text starts a code, replacing the
codes in the reverse order restores the text exactly.

Defined results: null text and null role are empty; a null conv_id is a
conversation of its own; null turns come first; equal turn numbers are
ordered by role and text, so repeated rows are repeated turns; a first turn
with role ``system`` is the system turn, later ones are ordinary turns; an
empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control characters and their codes, in the order of escaping.
CODES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c")]
BLOCK = 64
_WORD = r"[^\x20\x09-\x0D]+"


def escape(text: Column) -> Column:
    for char, code in CODES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal."""
    other = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = [left[k].eqNullSafe(other[f"{k}_r"]) for k in keys]
    return left.join(other, on, how).drop(*[f"{k}_r" for k in keys])


def _numbered(turns: DataFrame) -> DataFrame:
    """Number, system flag and tokens before and after each turn of its conversation."""
    turns = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({
        "block": F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK),
        "tokens": (F.regexp_count("text", F.lit(_WORD)) + 1).cast("long"),
    })
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = turns.withColumns({
        "in_block": F.row_number().over(inside),
        "sum_block": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    })
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("s")).select(
        "conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before"))
    rows = _join(rows, blocks, ["conv_id", "block"])
    number = F.col("n_before") + F.col("in_block")
    return rows.select("conv_id", "role", "text", "tokens", number.alias("number"),
                       ((number == 1) & (F.col("role") == "system")).alias("is_system"),
                       (F.col("s_before") + F.col("sum_block") - F.col("tokens")).alias("start"))


def chat_windows(turns: DataFrame, budget: int = 256, history: int = 64) -> DataFrame:
    """One row a window: conv_id, window, n_turns, n_repeated (they come first),
    formatted, loss (start and length of each masked-in text, in code points)
    and n_tokens.  ``turns`` needs conv_id, turn, role, text; others are not read."""
    rows = _numbered(turns)
    system = rows.filter("is_system").select("conv_id", F.col("tokens").alias("system_tokens"), F.col("role").alias("system_role"), F.col("text").alias("system_text"))
    rows = _join(rows, system.select("conv_id", "system_tokens"), ["conv_id"], "left")
    own = F.coalesce("system_tokens", F.lit(0))
    start = F.when(F.col("is_system"), 0).otherwise(F.col("start") - own)
    tokens = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumns({"start": start, "stop": start + tokens,
                             "window": F.floor(start / F.greatest(F.lit(1), F.lit(budget - history) - own))})
    spans = rows.groupBy("conv_id", "window").agg(F.max("stop").alias("span_stop")).withColumn(
        "next_window", F.lead("window").over(Window.partitionBy("conv_id").orderBy("window")))
    pieces = _join(rows, spans, ["conv_id", "window"])
    new = pieces.select("conv_id", "window", "number", "role", "text", "tokens", F.lit(0).alias("repeated"))
    recent = pieces.filter((F.col("span_stop") - F.col("start") <= history) & F.col("next_window").isNotNull() & ~F.col("is_system"))
    again = recent.select("conv_id", F.col("next_window").alias("window"), "number", "role", "text", "tokens", F.lit(1).alias("repeated"))
    kept = _join(spans.filter("window > 0").select("conv_id", "window"), system, ["conv_id"]).select(
        "conv_id", "window", F.lit(1).cast("long").alias("number"), F.col("system_role").alias("role"), F.col("system_text").alias("text"),
        F.col("system_tokens").alias("tokens"), F.lit(1).alias("repeated"))

    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]\n"))
    body = escape(F.col("text"))
    parts = new.union(again).union(kept).withColumns({"head": head, "body": body}).withColumn(
        "piece", F.concat("head", "body", F.lit("</s>\n")))
    inside = Window.partitionBy("conv_id", "window").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("at", F.sum(F.length("piece")).over(inside) - F.length("piece") + F.length("head"))
    learnt = (F.col("role") == "assistant") & (F.col("repeated") == 0)
    whole = parts.groupBy("conv_id", "window").agg(
        F.count("*").alias("n_turns"), F.sum("repeated").alias("n_repeated"), F.sum("tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("number", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(learnt, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length"))))).alias("loss"))
    return whole.select("conv_id", "window", "n_turns", "n_repeated", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss", "n_tokens")


def read_windows(windows: DataFrame) -> DataFrame:
    """Per window, read from ``formatted`` alone with n_repeated and loss: the new turns (role, text) and the loss text."""
    def turn(piece):
        close = F.instr(piece, "]\n")
        role = F.substring(piece, F.lit(5), close - 5)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, close + 2, F.length(piece))).alias("text"))
    pieces = F.slice(F.split("formatted", "</s>\n", -1), F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))
    learnt = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.select("conv_id", "window", F.length("formatted").alias("formatted_chars"),
                          F.transform(pieces, turn).alias("turns"), F.array_join(learnt, "").alias("loss_text"))


def digest_conversations(windows: DataFrame) -> DataFrame:
    """Per conversation: what read_windows restores, as counts and hashes."""
    read = read_windows(windows).withColumns({
        "n_turns": F.size("turns"),
        "said": F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")})
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss_text"))).alias("w"))
    said, learnt = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.loss_text"), "")
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"),
                        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")
