"""Preference formatting of chosen and rejected conversations, with DataFrame operations only.

Conversations are tables of turns. The longest common prefix of a pair is found turn by turn, so that a
conversation of any length is spread over tasks; what comes out are rendered segments, not whole strings:
each turn of the prefix once as part "prompt", each later turn as part "chosen" or "rejected", with its
place, where it begins in its part, and whether it counts in the loss. examples() joins the segments of
each pair into one row for trainers that want strings and masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stage
from kinfold.llm.running import running_sums

#: A turn as it is rendered; the role and the text follow these.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with seq, the place of each turn in its conversation from 1.

    In the order of turn, nulls first; equal turns in the order of role and text. Rows without a conv_id
    belong to no conversation and are left out.
    """
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    return running_sums(rows, ["conv_id"], order, {"seq": F.lit(1)}, "turns").select("conv_id", "seq", "role", "text")


def segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part, seq, role, rendered, train, begin of all turns of all pairs.

    chosen and rejected hold pair_id, seq (from 1, no gaps), role and text. Turns are equal if their roles
    and texts are, null being a value of its own. A pair of which one side is missing has no prefix; of
    equal conversations all turns are prompt. train is true for assistant turns of completions. begin is
    the offset in characters within the part.
    """
    a = chosen.select("pair_id", "seq", F.col("role").alias("r1"), F.col("text").alias("t1"), F.lit(True).alias("in1"))
    b = rejected.select("pair_id", "seq", F.col("role").alias("r2"), F.col("text").alias("t2"), F.lit(True).alias("in2"))
    both = stage(a.join(b, ["pair_id", "seq"], "full"), "both")
    differ = ~(F.col("in1").eqNullSafe(F.col("in2")) & F.col("r1").eqNullSafe(F.col("r2")) & F.col("t1").eqNullSafe(F.col("t2")))
    split = both.where(differ).groupBy("pair_id").agg(F.min("seq").alias("split"))
    turns = both.join(split, "pair_id", "left").withColumn("shared", F.col("split").isNull() | (F.col("seq") < F.col("split")))
    sides = F.array(
        F.when(F.col("in1"), F.struct(F.when(F.col("shared"), "prompt").otherwise("chosen").alias("part"), F.col("r1").alias("role"), F.col("t1").alias("text"))),
        F.when(F.col("in2") & ~F.col("shared"), F.struct(F.lit("rejected").alias("part"), F.col("r2").alias("role"), F.col("t2").alias("text"))),
    )
    rows = turns.select("pair_id", "seq", F.explode(F.array_compact(sides)).alias("s")).select("pair_id", "s.part", "seq", "s.role", render(F.col("s.role"), F.col("s.text")).alias("rendered"))
    train = (F.col("part") != "prompt") & F.col("role").eqNullSafe(F.lit("assistant"))
    summed = running_sums(rows.withColumn("train", train), ["pair_id", "part"], [F.col("seq")], {"end": F.char_length("rendered")}, "segments")
    return summed.select("pair_id", "part", "seq", "role", "rendered", "train", (F.col("end") - F.char_length("rendered")).cast("long").alias("begin"))


def examples(parts: DataFrame) -> DataFrame:
    """One row a pair: prompt, chosen, rejected, and for both completions the trained spans as (begin, end) pairs.

    A training example is one string for its reader, so each pair is gathered into one row here.
    """
    of = lambda p, what: F.transform(F.filter("all", lambda s: s["part"] == p), what)
    text = lambda p: F.array_join(of(p, lambda s: s["rendered"]), "").alias(p)
    mask = lambda p: F.transform(F.filter("all", lambda s: (s["part"] == p) & s["train"]), lambda s: F.struct(s["begin"].alias("begin"), (s["begin"] + F.char_length(s["rendered"])).alias("end"))).alias(f"{p}_spans")
    every = parts.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part", "rendered", "train", "begin"))).alias("all"))
    return every.select("pair_id", text("prompt"), text("chosen"), text("rejected"), mask("chosen"), mask("rejected"))


def answer_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of alternatives out of plain conversations: each one as chosen, and as rejected the same conversation with its last answer replaced by the last answer of the next conversation that has one.

    The pair takes the conv_id of its chosen side. Conversations without an answer, and the last one,
    make no pair.
    """
    rows = stage(numbered(turns), "numbered")
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max("seq").alias("at"))
    answers = rows.join(last.withColumnRenamed("at", "seq"), ["conv_id", "seq"]).select("conv_id", F.col("seq").alias("at"), "text")
    ranked = stage(running_sums(answers, [], [F.col("conv_id")], {"rank": F.lit(1)}, "answers"), "answers")
    other = ranked.select((F.col("rank") - 1).alias("rank"), F.col("text").alias("other"))
    pairs = ranked.select("conv_id", "at", "rank").join(other, "rank").select(F.col("conv_id").alias("pair_id"), "at", "other")
    chosen = rows.withColumnRenamed("conv_id", "pair_id").join(pairs, "pair_id")
    swapped = F.when(F.col("seq") == F.col("at"), F.col("other")).otherwise(F.col("text"))
    return chosen.select("pair_id", "seq", "role", "text"), chosen.select("pair_id", "seq", "role", swapped.alias("text"))
