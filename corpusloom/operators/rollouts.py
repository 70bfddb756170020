"""Rollout operators: advantages, whitening, policy objective, interval logs, thresholds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import remaining_length
from corpusloom.functions.rewards import CLIP_RATIO, GAMMA, clipped_objective, suffix_returns
from corpusloom.operators.ordered import carry, int_div, running_max

WHITEN_EPS = 1e-8
THRESHOLD_STEP = 0.1


def whiten(df: DataFrame, column: str, shift_mean: bool = True, ddof: int = 0, name: str | None = None) -> DataFrame:
    """Centre and scale by the global mean and variance (population unless ``ddof=1``).

    Statistics come from one partially aggregated pass, read as a scalar subquery.
    """
    spread = F.var_samp if ddof else F.var_pop
    stats = df.agg(F.struct(F.avg(column).alias("m"), spread(column).alias("v")).alias("st")).scalar()
    scaled = (F.col(column) - stats["m"]) / F.sqrt(stats["v"] + WHITEN_EPS)
    return df.withColumn(name or column, scaled if shift_mean else scaled + stats["m"])


def advantages(
    df: DataFrame, rewards: str = "rewards", mask: str = "mask", gamma: float = GAMMA,
    whitened: bool = True, ddof: int = 0, name: str = "advantages",
) -> DataFrame:
    """Suffix returns over remaining length (zero counts as one), whitened over every element.

    Padded positions take part in the whitening, as they do in a padded batch.
    """
    lens = F.transform(remaining_length(F.col(mask)), lambda n: F.greatest(n, F.lit(1)))
    raw = F.zip_with(suffix_returns(F.col(rewards), gamma), lens, lambda g, n: g / n)
    out = df.withColumn(name, raw)
    if not whitened:
        return out
    # Sums, not an explode: one row of partials per task.
    flat = out.select(F.explode(name).alias("x"))
    spread = F.var_samp if ddof else F.var_pop
    stats = flat.agg(F.struct(F.avg("x").alias("m"), spread("x").alias("v")).alias("st")).scalar()
    return out.withColumn("_st", stats).withColumn(
        name, F.transform(name, lambda x: (x - F.col("_st.m")) / F.sqrt(F.col("_st.v") + WHITEN_EPS))
    ).drop("_st")


def pg_objective(
    df: DataFrame, logprobs: str = "logprobs", old: str = "old_logprobs", adv: str = "advantages",
    mask: str = "mask", w: str = "w", clip: float = CLIP_RATIO,
) -> DataFrame:
    """Masked mean of the clipped objective, with counts of infinite and NaN inputs."""
    tokens = df.select(
        F.explode(F.arrays_zip(F.col(logprobs).alias("lp"), F.col(old).alias("old"), F.col(adv).alias("a"),
                               F.col(mask).alias("m"), F.col(w).alias("w"))).alias("t")
    ).select("t.*")
    tokens = tokens.withColumn("ratio", F.exp((F.col("lp") - F.col("old")) * F.col("m")) * F.col("w"))
    infinite = lambda c: F.count_if(F.abs(F.col(c)) == F.lit(float("inf")))
    loss = clipped_objective(F.col("a"), F.col("ratio"), clip)
    return tokens.agg(
        F.try_divide(F.sum(loss * F.col("m")), F.sum("m").cast("double")).alias("pg_loss"),
        infinite("a").alias("adv_inf"),
        infinite("ratio").alias("ratio_inf"),
        F.count_if(F.isnan("a")).alias("adv_nan"),
        F.count_if(F.isnan("ratio")).alias("ratio_nan"),
    )


def global_step(step: Column, accumulation: int) -> Column:
    """Optimizer step of a 1-based micro-step under gradient accumulation."""
    return step.cast("long") if accumulation == 1 else int_div(step, accumulation) + 1


def log_intervals(
    df: DataFrame, step: str, values: list[str], interval: int, accumulation: int = 1,
    by: tuple[str, ...] = (), exact: bool = False,
) -> DataFrame:
    """Means per logging block.

    A block closes at the micro-step whose global step is a multiple of ``interval`` and
    which is itself a multiple of ``accumulation``. Means divide by the nominal block size
    unless ``exact``; micro-steps after the last close are not reported.
    """
    s, ga = F.col(step), accumulation
    # Closing micro-steps: g*interval when ga is 1, else ga*(g*interval - 1).
    width, lead = (interval, 0) if ga == 1 else (interval * ga, ga)
    block = int_div(s + lead + width - 1, width)
    close = block * width - lead
    grouped = df.withColumn("block", block).withColumn("_close", close).groupBy(*by, "block")
    nominal = F.lit(float(interval * ga))
    sums = grouped.agg(
        F.max("_close").alias("_close"),
        F.max(s).alias("_last"),
        F.count(F.lit(1)).alias("micro_steps"),
        *[F.sum(v).alias(f"_s_{v}") for v in values],
    ).where(F.col("_last") >= F.col("_close"))
    divisor = F.col("micro_steps").cast("double") if exact else nominal
    return sums.select(
        *by,
        (F.col("block") * interval).alias("global_step"),
        "micro_steps",
        *[(F.col(f"_s_{v}") / divisor).alias(v) for v in values],
    )


def adaptive_threshold(
    df: DataFrame, run: str, order: str, loss: str, eps: float, start: float = 0.0,
    first_loss: float | None = None,
) -> DataFrame:
    """Replay the threshold rule over each run's evaluations in order.

    Threshold (+0.1, at most 1.0) and reference loss move only when the loss is at least the
    reference plus ``eps``; the first evaluation sets the reference unless ``first_loss``
    does. A null or NaN loss never moves them; as the first of a run it leaves a reference (null) that no loss reaches. With ``eps >= 0`` such a row exceeds every earlier loss, so
    only running-maximum rows, found by a bucketed scan, pass through the sequential
    fold; their state is then carried to the rows between them.
    """
    if eps < 0:
        raise ValueError("eps must not be negative")
    # NaN ranks above every number in Spark, so it is kept out of the maximum.
    number = F.when(~F.isnan(F.col(loss).cast("double")), F.col(loss))
    rows = running_max(df.select(run, order, loss), order, number, "_top", by=run)
    records = rows.where(F.col("_top").isNull() | (number > F.col("_top"))).select(
        run, F.col(order).cast("long").alias(order), F.col(loss).cast("double").alias(loss)
    )
    in_order = records.repartition(run).sortWithinPartitions(run, order)
    run_type = dict(records.dtypes)[run]

    def fold(batches):
        current, threshold, prev = None, start, first_loss
        for pdf in batches:
            moved = []
            for key, value in zip(pdf[run], pdf[loss]):
                if key != current:
                    current, threshold, prev = key, start, first_loss
                if prev is None:
                    prev = value
                elif value >= prev + eps:
                    threshold, prev = min(threshold + THRESHOLD_STEP, 1.0), value
                moved.append((threshold, prev))
            yield pd.DataFrame(
                {"_run": pdf[run], "_ord": pdf[order],
                 "threshold": [m[0] for m in moved], "reference_loss": [m[1] for m in moved]}
            )

    states = in_order.mapInPandas(fold, f"_run {run_type}, _ord long, threshold double, reference_loss double")
    joined = df.join(states, (F.col(run) == F.col("_run")) & (F.col(order) == F.col("_ord")), "left")
    state = F.when(F.col("threshold").isNotNull(), F.struct("threshold", "reference_loss"))
    carried = carry(joined, order, state, "_state", by=run, inclusive=True)
    return carried.select(*df.columns, "_state.threshold", "_state.reference_loss")
