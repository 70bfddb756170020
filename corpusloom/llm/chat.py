"""Chat formatting by perspective rotation: every participant is the assistant once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import text_or_empty, written

PART_CHARS = 16_384
# Fixed values of the rendering.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Dialogues from every participant's side, in parts of bounded length.

    Returns ``conv, perspective, part, n_turns, text, mask_from, mask_to``: the rendering of consecutive turns with
    ``perspective`` as assistant, everybody else as a user with a name, system turns as they are, and the character
    ranges (from inclusive, to exclusive, within ``text``) that carry the loss: the assistant's words and the mark
    that closes them. The parts of a conversation joined in order are the whole dialogue; a part holds turns that
    begin within one stretch of ``part_chars`` characters, so no group grows with a conversation.

    Turns are ordered by number, null first, then speaker and text; repeated rows are turns of their own. A null
    speaker is called ``unknown``, a null text is empty, and rows with a null conversation id form one conversation.
    A conversation of system turns alone has no participant and gives no row. Columns beyond the four named are left out.
    """
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))
    rows = turns.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), speaker.alias("_s"), text_or_empty(text_col).alias("_x"))
    people = rows.where(F.col("_s") != SYSTEM).select(F.col("_c").alias("_pc"), F.col("_s").alias("perspective")).distinct()
    sides = rows.join(people, F.col("_c").eqNullSafe(F.col("_pc"))).drop("_pc")

    own = F.col("_s") == F.col("perspective")
    head = F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).when(F.col("_s") == SYSTEM, F.lit("system")).otherwise(
        F.concat(F.lit("user name="), F.regexp_replace("_s", r"\s", "_"))), F.lit("\n"))
    measured = sides.withColumn("_n", (F.char_length(head) + F.char_length("_x") + len(CLOSE)).cast("long"))

    laid = _offsets(measured, ["_c", "perspective"], ["_t", "_s", "_x"])
    laid = laid.withColumns({"_own": own, "_skip": F.char_length(head), "_text": F.concat(head, F.col("_x"), F.lit(CLOSE))})
    part = F.floor(F.col("_at") / part_chars)
    turn = F.struct("_at", "_text", "_own", "_skip", "_n")
    parts = (
        laid.withColumn("part", part).groupBy("_c", "perspective", "part").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
        .withColumn("_own", F.filter("_turns", lambda x: x["_own"])).withColumn("_from", F.col("_turns")[0]["_at"])
    )
    return parts.select(
        F.col("_c").alias(conv_col), "perspective", F.col("part").cast("long").alias("part"), F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda x: x["_text"]), "").alias("text"),
        F.transform("_own", lambda x: x["_at"] + x["_skip"] - F.col("_from")).alias("mask_from"),
        F.transform("_own", lambda x: x["_at"] + x["_n"] - 1 - F.col("_from")).alias("mask_to"),
    )


def _offsets(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``_at``: characters before a turn in its dialogue.

    The table is sorted into ranges and kept, so that the ranges stay as they are; sums run inside a range, and a
    range starts from the totals of the ranges before it. A long conversation lies over many ranges.
    """
    kept = written(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = kept.groupBy(*by, "_p").agg(F.sum("_n").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    base = base.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_p").alias("_bp"), "_base")
    match = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    joined = placed.join(base, [*match, F.col("_p") == F.col("_bp")])
    return joined.withColumn("_at", F.col("_base") + F.col("_in")).drop("_base", "_in", "_bp", *[f"_b{i}" for i in range(len(by))])
