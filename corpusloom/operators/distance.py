"""Teacher/student comparison over logit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import IGNORE
from corpusloom.functions.logits import (
    ALL,
    cross_entropy,
    divergences_arrow,
    entropy,
    masked_mean,
    token_loss,
)


def pair_logits(student: DataFrame, teacher: DataFrame, keys: tuple[str, ...] = ("example_id", "pos")) -> DataFrame:
    """Join the two logit tables on example and position.

    Both sides are wide, so store them with ``write_logits``: the join then needs no
    shuffle. Nothing is broadcast.
    """
    right = teacher.select(*keys, F.col("logits").alias("teacher"))
    return student.withColumnRenamed("logits", "student").join(right, list(keys))


def position_divergences(df: DataFrame, **weights: float) -> DataFrame:
    """Per-position divergences, by the same arithmetic at any vocabulary."""
    return df.withColumn("d", divergences_arrow(F.col("student"), F.col("teacher"), **weights))


def divergence_report(df: DataFrame, label: str = "label", by: tuple[str, ...] = (), **kwargs) -> DataFrame:
    """Masked mean of every divergence, overall or by group."""
    scored = position_divergences(df, **kwargs)
    means = [masked_mean(F.col(f"d.{n}"), F.col(label)).alias(n) for n in ALL]
    live = F.count_if(F.col(label) != IGNORE).alias("positions")
    return scored.groupBy(*by).agg(*means, live) if by else scored.agg(*means, live)


def lm_loss(df: DataFrame, example: str = "example_id", logits: str = "logits", label: str = "label") -> DataFrame:
    """Token-mean loss over all positions and the mean of per-example means."""
    scored = df.select(example, token_loss(F.col(logits), F.col(label)).alias("nll"))
    per_row = scored.groupBy(example).agg(F.sum("nll").alias("s"), F.count("nll").alias("n"))
    return per_row.agg(
        F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("token_mean"),
        F.avg(F.try_divide(F.col("s"), F.col("n").cast("double"))).alias("row_mean"),
    )


def reg_loss(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Masked mean of cross-entropy (student to teacher) minus student entropy."""
    gap = cross_entropy(F.col("student"), F.col("teacher")) - entropy(F.col("student"))
    weighted = F.sum(gap * F.col(mask))
    return df.agg(F.try_divide(weighted, F.sum(mask).cast("double")).alias("reg_loss"))


def macro_loss(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """Mean of per-batch means beside the exact row mean."""
    per_batch = df.groupBy(batch).agg(F.avg(loss).alias("m"), F.sum(loss).alias("s"), F.count(loss).alias("n"))
    return per_batch.agg(
        F.avg("m").alias("macro_mean"),
        F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("row_mean"),
        F.count(F.lit(1)).alias("batches"),
    )
