"""Preference formatting: a chosen and a rejected conversation as one prompt and two masked completions.

The longest common prefix of turns (role and text equal, nulls equal to nulls) is rendered once as
the prompt; what follows on each side is that side's completion. Only assistant turns of a completion
carry loss, and there the text and the end mark but not the header. A null role or text renders as
empty. Turns without a number are left out; repeated rows of a turn count once, and of differing rows for one
turn (a tie) the smallest (role, text) counts. A conversation that is the other's prefix has an empty completion.
A turn's text is held whole, however long; a conversation is not: an example goes on in a further row (``piece``)
after ``ROW_TURNS`` turns, so no task gathers more of it. Empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from martloom.llm.rows import pick

START, END = "<|im_start|>", "<|im_end|>\n"
# Places at which pairs made out of plain conversations part.
FORKS = 4
# Numbers of turns that one row of examples spans.
ROW_TURNS = 256
LEARNED_ROLE = "assistant"
PROMPT, CHOSEN, REJECTED = "prompt", "chosen", "rejected"


def forked_pairs(conversations: DataFrame, forks: int = FORKS) -> DataFrame:
    """Pairs out of plain conversations: (pair_id, side, turn, role, text), made without a shuffle.

    Chosen is a whole conversation; rejected has its turns before a fork and those of its neighbour (ids 2k and
    2k + 1) from there on. Forks lie at turns 0 to ``forks`` - 1 by id, the same for both neighbours, so every turn
    is in one pair as chosen and in one as rejected. Where the neighbour is missing or ends before the fork, nothing follows the
    prompt on one side; a missing neighbour's own pair has the rejected side only.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    before = F.col("turn") < F.pmod(F.shiftright("conv_id", 1), F.lit(forks))
    owner = F.when(before, F.col("conv_id")).otherwise(F.col("conv_id").bitwiseXOR(F.lit(1)))
    sides = F.array(
        F.struct(F.col("conv_id").alias("pair_id"), F.lit(CHOSEN).alias("side")), F.struct(owner.alias("pair_id"), F.lit(REJECTED).alias("side"))
    )
    return rows.select(F.explode(sides).alias("s"), "turn", "role", "text").select("s.pair_id", "s.side", "turn", "role", "text")


def segments(pairs: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, header, body, loss): the rendered turns of prompt and completions.

    ``pairs`` has (pair_id, side, turn, role, text). Both sides of a turn meet in one row; the first
    turn that differs ends the prompt. A pair's turns stay rows, so a conversation of any length is
    never gathered in one task.
    """
    rows = pick(pairs, "pair_id", "side", "turn", "role", "text").where(F.col("side").isin(CHOSEN, REJECTED))
    said = F.struct("role", "text")
    met = rows.groupBy("pair_id", "turn").agg(*(F.min(F.when(F.col("side") == s, said)).alias(s) for s in (CHOSEN, REJECTED)))
    differs = F.col(CHOSEN).isNull() | F.col(REJECTED).isNull() | ~F.col(CHOSEN).eqNullSafe(F.col(REJECTED))
    ends = met.where(differs).groupBy("pair_id").agg(F.min("turn").alias("end"))
    placed = met.join(ends, "pair_id", "left")
    shared = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    parts = F.when(shared, F.array(F.struct(F.lit(PROMPT).alias("part"), F.col(CHOSEN).alias("said")))).otherwise(
        F.filter(
            F.array(*(F.struct(F.lit(s).alias("part"), F.col(s).alias("said")) for s in (CHOSEN, REJECTED))),
            lambda p: p["said"].isNotNull(),
        )
    )
    flat = placed.select("pair_id", "turn", F.explode(parts).alias("p")).select("pair_id", "p.part", "turn", "p.said.role", "p.said.text")
    return flat.select(
        "pair_id",
        "part",
        "turn",
        "role",
        F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n")).alias("header"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(END)).alias("body"),
        ((F.col("part") != PROMPT) & F.coalesce(F.col("role") == LEARNED_ROLE, F.lit(False))).alias("loss"),
    )


def examples(rendered: DataFrame, row_turns: int = ROW_TURNS) -> DataFrame:
    """(pair_id, piece, prompt, chosen, rejected, chosen_mask, rejected_mask): the training examples.

    A pair is one row, or, beyond ``row_turns`` numbers of turns, several: its parts are those of its pieces, joined
    in their order. Masks are [from, to) character ranges of the row's completion that carry loss.
    """
    piece = F.floor(F.col("turn") / row_turns).cast("long").alias("piece")
    part = rendered.select("pair_id", piece, "part", F.struct("turn", "header", "body", "loss").alias("s"))
    listed = part.groupBy("pair_id", "piece").agg(
        *(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("s")))).alias(p) for p in (PROMPT, CHOSEN, REJECTED))
    )

    def text(p: str):
        return F.array_join(F.transform(F.col(p), lambda s: F.concat(s["header"], s["body"])), "")

    def mask(p: str):
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))

        def step(told, s):
            body = told["at"] + F.length(s["header"])
            end = body + F.length(s["body"])
            spans = F.when(s["loss"], F.concat(told["spans"], F.array(F.array(body, end)))).otherwise(told["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        return F.aggregate(F.col(p), empty, step, lambda told: told["spans"])

    texts = (text(p).alias(p) for p in (PROMPT, CHOSEN, REJECTED))
    return listed.select("pair_id", "piece", *texts, mask(CHOSEN).alias("chosen_mask"), mask(REJECTED).alias("rejected_mask"))
