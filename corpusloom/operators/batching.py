"""Epoch shuffling, rank sharding, batching and step arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordered import hex_bucket, int_div, number_rows


def shuffle_key(row_id: Column, seed: int, epoch: int = 0) -> Column:
    """Reproducible order key: a digest of seed, epoch and id (never a random draw)."""
    return F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed)), F.lit(str(epoch))))


def plan_batches(
    df: DataFrame,
    row_id: str,
    world: int,
    batch: int,
    seed: int,
    epoch: int = 0,
    drop_last: bool = True,
    drop_short: bool = False,
    shuffle: bool = True,
) -> DataFrame:
    """Assign each row its rank, batch and slot for one epoch.

    Rows are numbered in shuffled order and dealt round-robin to ranks. ``drop_last`` cuts
    to whole rounds of ``world`` rows; otherwise the last round is filled by repeating rows
    from the start. ``drop_short`` leaves out a rank's last batch when it is short.
    """
    if shuffle:
        keyed = df.withColumn("_key", shuffle_key(F.col(row_id), seed, epoch))
        placed = number_rows(keyed, "_key", "_pos", bucket=hex_bucket(F.col("_key"))).drop("_key")
    else:
        placed = number_rows(df, row_id, "_pos")
    count = df.agg(F.count(F.lit(1)).alias("n")).select("n")
    n = count.scalar()
    dealt = placed if drop_last else _wrap(placed, n, world)
    per_rank = int_div(n if drop_last else n + F.lit(world - 1), world)
    if drop_short:
        per_rank = int_div(per_rank, batch) * batch
    dealt = dealt.where(F.col("_pos") < per_rank * world)
    slot = int_div(F.col("_pos"), world)
    return dealt.select(
        *df.columns,
        F.pmod("_pos", F.lit(world)).cast("int").alias("rank"),
        int_div(slot, batch).alias("batch"),
        F.pmod(slot, F.lit(batch)).cast("int").alias("slot"),
    )


def _wrap(placed: DataFrame, n: Column, world: int) -> DataFrame:
    """Repeat leading rows, cycling, until every rank holds equally many."""
    target = int_div(n + F.lit(world - 1), world) * world
    again = F.sequence(F.col("_pos"), target - 1, n)
    fits = F.when(F.col("_pos") < target, again)
    return placed.withColumn("_pos", F.explode(fits))


def training_plan(
    df: DataFrame,
    rows: str,
    batch: str,
    world: str,
    accumulation: str,
    epochs: str | None = None,
    total_steps: str | None = None,
) -> DataFrame:
    """Steps per epoch, total steps and epochs; either of the last two may be given."""
    whole = F.col(batch) * F.col(world) * F.col(accumulation)
    per_epoch = int_div(F.col(rows), whole)
    if epochs is not None:
        total, count = per_epoch * F.col(epochs), F.col(epochs)
    else:
        total = F.col(total_steps)
        count = F.ceil(F.try_divide(F.col(total_steps), per_epoch))
    return df.select(
        *df.columns,
        per_epoch.cast("long").alias("steps_per_epoch"),
        total.cast("long").alias("planned_steps"),
        count.cast("long").alias("planned_epochs"),
    )


def zip_cycle(main: DataFrame, aux: DataFrame, batch: str = "batch", prefix: str = "aux_") -> DataFrame:
    """Pair each main batch with the next auxiliary batch, cycling through the auxiliary ones.

    Auxiliary batches are numbered 0..n-1; the pairing is an equi-join on the remainder.
    """
    n = aux.agg(F.max(batch) + 1).scalar()
    renamed = aux.select(*[F.col(c).alias(prefix + c) for c in aux.columns])
    keyed = main.withColumn("_turn", F.pmod(F.col(batch), n))
    return keyed.join(renamed, F.col("_turn") == F.col(prefix + batch)).drop("_turn")


def rollout_quota(df: DataFrame, order: str, total: int, devices: int, rank: str = "rank") -> DataFrame:
    """Each rank's first ``total // devices`` rollouts."""
    placed = number_rows(df, order, "_pos", by=rank)
    return placed.where(F.col("_pos") < total // devices).drop("_pos")
