"""Declared schemas. Nothing is inferred; malformed input lands in ``_corrupt``."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


UPSTREAM = T.StructType(
    _strings("instruction", "prompt", "question", "context", "input", "response", "output", "answer", CORRUPT)
)
INSTRUCTION = T.StructType(_strings("instruction", "input", "output", CORRUPT))
EVENT_CORE = ("ts", "source", "event")
QUEUE = T.StructType(
    [
        *_strings("exp_id", "key", "cmd_type", "cmd", "created_at", "status", "gpus", "conda_env", "updated_at",
                  "last_reason", "error_hash", "last_failed_at"),
        *[T.StructField(n, T.IntegerType()) for n in (
            "seq", "attempt", "max_retries", "retry_sleep", "train_timeout", "hard_failure_threshold",
            "max_oom_retries", "consecutive_failures", "last_exit_code", "oom_backoff_count", "oom_at_min_count")],
        T.StructField("skip_vis", T.BooleanType()),
        T.StructField("train_opts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("oom_batch_candidates", T.ArrayType(T.IntegerType())),
        T.StructField("agent_fix_hashes", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField(CORRUPT, T.StringType()),
    ]
)
STATUS = T.StructType(
    [
        *_strings("status", "updated_at", "reason", "error_hash"),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("oom_backoff_count", T.IntegerType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)
