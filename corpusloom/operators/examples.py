"""Training examples: shifted labels, padding, masks, batch-level padding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import (
    IGNORE,
    head,
    left_mask,
    not_equal_mask,
    pad_left,
    pad_right,
    position_ids,
    repeat,
    tail,
)


def lm_example(
    df: DataFrame,
    max_length: int,
    pad_id: int,
    prompt_ids: str = "prompt_ids",
    response_ids: str = "response_ids",
    max_prompt_length: int | None = None,
    label_shift: int = 1,
) -> DataFrame:
    """Fixed-length language-model examples.

    Labels are the inputs shifted by ``label_shift``; labels before the last prompt token
    are ignored. A null prompt (plain corpus) masks nothing but the padding. Built from
    slices and repeats, so no per-element lambda runs.
    """
    prompt, response = F.col(prompt_ids), F.col(response_ids)
    full = head(F.concat(F.coalesce(prompt, F.array().cast("array<int>")), response), max_length)
    staged = df.withColumn("_ids", full)
    ids, count = F.col("_ids"), F.size("_ids")
    kept = F.greatest(count - label_shift, F.lit(0)) if label_shift else count
    source = F.greatest(F.coalesce(F.size(prompt), F.lit(1)), F.lit(1))
    masked = F.least(source - label_shift, kept) if label_shift else F.least(F.size(prompt), kept)
    staged = staged.withColumn("_kept", kept).withColumn("_masked", F.greatest(masked, F.lit(0)))
    kept, masked = F.col("_kept"), F.col("_masked")
    live = F.slice(ids, masked + 1 + label_shift, kept - masked)
    positions = F.when(kept > 0, F.sequence(F.lit(0), F.greatest(kept - 1, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )
    out = (
        staged.withColumn("input_ids", pad_right(head(ids, kept), max_length, pad_id))
        .withColumn("attention_mask", F.concat(repeat(1, kept), repeat(0, F.lit(max_length) - kept)))
        .withColumn("position_ids", pad_right(positions, max_length, 0))
        .withColumn("label", F.concat(repeat(IGNORE, masked), live, repeat(IGNORE, F.lit(max_length) - kept)))
        .withColumn(
            "loss_mask",
            F.concat(repeat(0, masked), repeat(1, kept - masked), repeat(0, F.lit(max_length) - kept)),
        )
    )
    if max_prompt_length is not None:
        shown = tail(F.coalesce(prompt, F.array().cast("array<int>")), max_prompt_length)
        out = out.withColumn("gen_ids", pad_left(shown, max_prompt_length, pad_id)).withColumn(
            "gen_mask", left_mask(shown, max_prompt_length)
        )
    return out.drop("_ids", "_kept", "_masked")


def prompt_batch(df: DataFrame, max_prompt_length: int, pad_id: int, prompt_ids: str = "prompt_ids") -> DataFrame:
    """Left-padded prompt (its head) with mask; tokens past the prompt room follow as ``rest_ids``."""
    shown = head(F.col(prompt_ids), max_prompt_length)
    rest = F.slice(F.col(prompt_ids), max_prompt_length + 1, F.greatest(F.size(prompt_ids) - max_prompt_length, F.lit(0)))
    return (
        df.withColumn("input_ids", pad_left(shown, max_prompt_length, pad_id))
        .withColumn("attention_mask", left_mask(shown, max_prompt_length))
        .withColumn("rest_ids", rest)
    )


def prompt_response_example(
    df: DataFrame, query_ids: str, rest_ids: str, pad_id: int
) -> DataFrame:
    """Padded prompt and response as one sequence; only response tokens carry labels.

    ``query_ids`` is already left-padded and ``rest_ids`` right-padded. Padding is told from
    the id, as generated batches carry no other mark.
    """
    both = F.concat(F.col(query_ids), F.col(rest_ids))
    staged = df.withColumn("_all", both).withColumn("_q", F.size(query_ids))
    everything, n = F.col("_all"), F.size("_all")
    after = F.slice(everything, F.col("_q") + 1, n - F.col("_q"))
    answer = F.transform(after, lambda x: F.when(x == pad_id, F.lit(IGNORE)).otherwise(x))
    label = F.concat(repeat(IGNORE, F.col("_q") - 1), answer)
    staged = (
        staged.withColumn("input_ids", F.slice(everything, F.lit(1), n - 1))
        .withColumn("label", label)
        .withColumn("attention_mask", not_equal_mask(F.col("input_ids"), pad_id))
    )
    return (
        staged.withColumn("position_ids", position_ids(F.col("attention_mask")))
        .withColumn("loss_mask", F.transform("label", lambda x: (x != IGNORE).cast("int")))
        .drop("_all", "_q")
    )


def compact_sample(
    df: DataFrame, query_ids: str, response_ids: str, pad_id: int, max_length: int
) -> DataFrame:
    """Strip padding from a generated prompt and response and re-join them, unshifted labels."""
    real = lambda c: F.filter(F.col(c), lambda x: x != pad_id)
    staged = df.withColumn("_q", real(query_ids)).withColumn("_r", real(response_ids))
    joined = F.concat("_q", "_r")
    length = F.size("_q") + F.size("_r")
    return (
        staged.withColumn("input_ids", pad_right(joined, max_length, pad_id))
        .withColumn("attention_mask", F.concat(repeat(1, length), repeat(0, F.lit(max_length) - length)))
        .withColumn(
            "position_ids",
            pad_right(F.when(length > 0, F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")), max_length, 0),
        )
        .withColumn(
            "label", F.concat(repeat(IGNORE, F.size("_q")), F.col("_r"), repeat(IGNORE, F.lit(max_length) - length))
        )
        .drop("_q", "_r")
    )


def response_mask(df: DataFrame, query_ids: str, response_ids: str, pad_id: int) -> DataFrame:
    """Mask of the response shifted one left (it starts at the last prompt token), and its sum."""
    seen = F.concat(F.slice(F.col(query_ids), -1, 1), F.col(response_ids))
    shifted = F.slice(seen, F.lit(1), F.size(response_ids))
    return df.withColumn("mask", not_equal_mask(shifted, pad_id)).withColumn(
        "lens", F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    )


def pad_to_group_max(
    df: DataFrame,
    group: str,
    left: dict[str, int] | None = None,
    right: dict[str, float | int] | None = None,
) -> DataFrame:
    """Pad ragged arrays to the longest of their group: ``left`` columns on the left, ``right``
    ones on the right, each with its own fill. ``right`` columns share one length, as the
    per-token fields of a rollout do.

    Group maxima are partially aggregated and joined back, so a group is never gathered.
    """
    left, right = left or {}, right or {}
    longest = lambda cols: F.max(F.greatest(*[F.size(c) for c in cols]) if len(cols) > 1 else F.size(cols[0]))
    wanted = [longest([c]).alias(f"_max_{c}") for c in left]
    if right:
        wanted.append(longest(list(right)).alias("_max_right"))
    widths = df.groupBy(group).agg(*wanted).withColumnRenamed(group, "_g")
    out = df.join(widths, F.col(group).eqNullSafe(F.col("_g")))
    for name, fill in left.items():
        out = out.withColumn(name, pad_left(F.col(name), F.col(f"_max_{name}"), fill))
    for name, fill in right.items():
        out = out.withColumn(name, pad_right(F.col(name), F.col("_max_right"), fill))
    return out.select(*df.columns)


def label_map(df: DataFrame, idx: str, ids: str, answer: str) -> DataFrame:
    """First token of each row's first answer -> that answer; the latest row wins."""
    return (
        df.where(F.size(ids) > 0)
        .groupBy(F.get(F.col(ids), F.lit(0)).alias("token"))
        .agg(F.max_by(answer, idx).alias("answer"))
    )

