"""Preference formatting with DataFrame operations only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as
the prompt; what follows in either is its completion, with the spans that count in training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written, and whose words are learned.
OPEN, BREAK, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BREAK))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """``start-end`` of the learned words in the rendered turns, in characters, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(head(t))
        end = begin + F.length(t["text"])
        span = F.array(F.concat(begin.cast("string"), F.lit("-"), end.cast("string")))
        spans = F.when(t["role"] == LEARNED, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row for each pair of (pair_id, side, turn, role, text), side being chosen or rejected.

    pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, usable. Turns are
    equal if role and text are; they stand in order of turn, then role and text; a turn given twice
    counts once. A null role is written ``unknown``, a null text is empty; rows without a turn number go
    last, and rows without a pair_id are one pair of that key. A side without turns gives null, and then the prompt is
    empty. ``usable``: both sides go on after the prompt with learned words, differently by construction.
    """
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.groupBy("pair_id").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected"))
    )
    equal = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    common = F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")
    sides = sides.withColumn("n_prompt_turns", common)
    rest = {s: F.slice(s, F.col("n_prompt_turns") + 1, F.greatest(F.size(s) - F.col("n_prompt_turns"), F.lit(0))) for s in ("chosen", "rejected")}
    learned = {s: F.exists(rest[s], lambda t: t["role"] == LEARNED) for s in rest}
    return sides.select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        *(c for s in rest for c in (F.when(F.size(s) > 0, rendered(rest[s])).alias(s), F.when(F.size(s) > 0, mask(rest[s])).alias(f"{s}_mask"))),
        (learned["chosen"] & learned["rejected"]).alias("usable"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as pairs: of conv_ids 2i and 2i + 1 the first is chosen, the second rejected.

    Turns without a conv_id belong to no pair and are left out; other columns are not carried.
    """
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return conversations.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), side.alias("side"), "turn", "role", "text")
