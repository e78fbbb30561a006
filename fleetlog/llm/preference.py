"""Chat formatting of preference pairs: one prompt for both sides, two masked completions.

Chosen and rejected conversations come as turns. Their longest common prefix of turns (same turn number, role
and text) is rendered once, as the prompt; what follows on either side is that side's completion.
A turn is rendered as ``<|role|>``, line feed, text, ``<|end|>``, line feed. Only assistant turns of
a completion carry loss, and there only text and end mark: ``loss_start`` and ``loss_end`` are
offsets in the sequence that prompt and completion make together; the rest is masked.

The result has one row a rendered turn, so no conversation is ever held in one cell. The prefix comes from
a minimum over turns of fingerprints that do not agree; offsets come from running sums on two levels,
chunks of turns and turns within a chunk. So a conversation may hold any share of the rows.

Defined cases: rows without a pair or turn belong to no conversation and are left out. A repeated
turn counts once; different rows of one turn are in the order of role and text, missing ones first. A
missing role is ``unknown``, a missing text empty. Sides that are equal give a prompt and no completion; a
side without a counterpart is a completion without a prompt. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.base import stored

END = "<|end|>\n"
ASSISTANT = "assistant"
CHUNK_TURNS = 256


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _turns(side: DataFrame, name: str) -> DataFrame:
    kept = side.where("pair is not null and turn is not null").select(
        "pair", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return kept.distinct().select(F.lit(name).alias("side"), "pair", "turn", "role", "text")


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Turns (pair, turn, role, text) of both sides -> rows pair, side (prompt, chosen or rejected),
    turn, role, segment, start, stop, loss_start, loss_end."""
    both = stored(_turns(chosen, "chosen").unionByName(_turns(rejected, "rejected")), "turns")
    mark = F.xxhash64("role", "text").cast("decimal(38,0)")
    one = F.when(F.col("side") == "chosen", 1).otherwise(-1)
    turns = both.groupBy("pair", "turn").agg(
        F.sum(one).alias("more"), F.sum(one * mark).alias("other"), F.sum(one * F.xxhash64("text", "role").cast("decimal(38,0)")).alias("again")
    )
    cut = turns.where("more <> 0 or other <> 0 or again <> 0").groupBy("pair").agg(F.min("turn").alias("cut"))
    cut = cut.withColumnRenamed("pair", "p")
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    rows = both.join(cut, F.col("pair") == F.col("p"), "left").where(~common | (F.col("side") == "chosen"))
    rows = rows.select("pair", F.when(common, "prompt").otherwise(F.col("side")).alias("side"), "turn", "role", "text")
    rows = rows.withColumn("segment", F.concat(header(F.col("role")), "text", F.lit(END)))
    return _offsets(rows)


def _offsets(rows: DataFrame) -> DataFrame:
    rows = stored(rows.withColumns({"n": F.length("segment").cast("long"), "chunk": F.floor(F.col("turn") / CHUNK_TURNS)}), "segments")
    sums = rows.groupBy("pair", "side", "chunk").agg(F.sum("n").alias("words"))
    order = Window.partitionBy("pair", "side").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    prompts = sums.where("side = 'prompt'").groupBy(F.col("pair").alias("p")).agg(F.sum("words").alias("prompt"))
    # completions begin where the prompt ends
    base = F.when(F.col("side") == "prompt", 0).otherwise(F.coalesce("prompt", F.lit(0)))
    at = before.join(prompts, F.col("pair") == F.col("p"), "left").select(
        F.col("pair").alias("b_pair"), F.col("side").alias("b_side"), F.col("chunk").alias("b_chunk"), (F.col("before") + base).alias("base")
    )
    within = Window.partitionBy("pair", "side", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = (F.col("pair") == F.col("b_pair")) & (F.col("side") == F.col("b_side")) & (F.col("chunk") == F.col("b_chunk"))
    start = F.col("base") + F.col("inner")
    loss = (F.col("side") != "prompt") & (F.col("role") == ASSISTANT)
    return placed.join(at, same).select(
        "pair",
        "side",
        "turn",
        "role",
        "segment",
        start.alias("start"),
        (start + F.col("n")).alias("stop"),
        F.when(loss, start + F.length(header(F.col("role")))).alias("loss_start"),
        F.when(loss, start + F.col("n")).alias("loss_end"),
    )


def echo_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations (conv_id, turn, role, text).

    Chosen: the conversation up to its last assistant turn. Rejected: the same, but that turn only repeats
    the last user turn before it (empty if there is none). Conversations without an assistant turn make
    no pair.
    """
    rows = conversations.select(F.col("conv_id").alias("pair"), F.col("turn").cast("long").alias("turn"), "role", "text").where("pair is not null and turn is not null")
    last = rows.where(F.col("role") == ASSISTANT).groupBy(F.col("pair").alias("l")).agg(F.max("turn").alias("last"))
    upto = rows.join(last, rows.pair == last.l).where("turn <= last").drop("l")
    asked = upto.where("role = 'user' and turn < last").groupBy(F.col("pair").alias("a")).agg(F.max(F.struct("turn", "text"))["text"].alias("echo"))
    answer = last.join(asked, last.l == asked.a, "left").select(
        F.col("l").alias("pair"), F.col("last").alias("turn"), F.lit(ASSISTANT).alias("role"), F.coalesce("echo", F.lit("")).alias("text")
    )
    rejected = upto.where("turn < last").drop("last").unionByName(answer)
    return upto.drop("last"), rejected
