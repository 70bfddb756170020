"""Latest, best, last and sampled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.batching import shuffle_key

MIN_CHECKPOINT_BYTES = 100_000_000


def _row(columns: list[str]):
    return F.struct(*[F.col(c) for c in columns])


def _pick(df: DataFrame, by: str, key, largest: bool = True) -> DataFrame:
    """One row per group by an aggregate, so no group is sorted or gathered."""
    rest = [c for c in df.columns if c != by]
    pick = F.max_by if largest else F.min_by
    return df.groupBy(by).agg(pick(_row(rest), key).alias("_r")).select(by, "_r.*").select(*df.columns)


def latest_checkpoint(df: DataFrame, run: str = "run") -> DataFrame:
    """Highest numeric step per run among checkpoints larger than 100 MB."""
    numeric = df.where(F.col("step").rlike(r"^\d+\z") & (F.col("size_bytes") > MIN_CHECKPOINT_BYTES))
    return _pick(numeric, run, F.col("step").try_cast("long"))


def best_checkpoint(df: DataFrame, metric: str, largest: bool = True, run: str = "run", step: str = "step") -> DataFrame:
    """Best row per run by a metric; the earlier step wins a tie. Null and NaN are no scores."""
    scored = df.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    if largest:
        return _pick(scored, run, F.struct(F.col(metric), -F.col(step)), True)
    return _pick(scored, run, F.struct(F.col(metric), F.col(step)), False)


def eligible_runs(df: DataFrame, by: str = "run") -> DataFrame:
    """Most recently changed directory per run that holds a config, ``eval`` directories aside."""
    fit = df.where((F.col("step") != "eval") & F.col("has_config"))
    return _pick(fit, by, F.struct("mtime", "step"))


def last_line(df: DataFrame, pattern: str, run: str = "run_id", order: str = "line_no", raw: str = "raw") -> DataFrame:
    """Last line of each log that matches ``pattern``."""
    hits = df.where(F.col(raw).rlike(pattern))
    return hits.groupBy(run).agg(F.max(order).alias(order), F.max_by(raw, order).alias(raw))


def replay_sample(
    df: DataFrame, capacity: int, k: int, seed: int, arrival: str = "arrival_seq", row_id: str = "row_id"
) -> DataFrame:
    """Draw ``k`` of the last ``capacity`` arrivals without replacement.

    Both limits are top-k operators: each task keeps at most ``capacity`` rows. Asking for
    more rows than the buffer holds is an error.
    """
    buffer = df.orderBy(F.desc(arrival)).limit(capacity)
    held = buffer.agg(F.count(F.lit(1))).scalar()
    enough = F.when(held >= k, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"sample of {k} is larger than the buffer")).cast("boolean")
    )
    return buffer.where(enough).orderBy(shuffle_key(F.col(row_id), seed)).limit(k)
