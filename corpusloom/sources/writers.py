"""Sinks. Every writer is a distributed Spark write in the session's own formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_generation, inline_newlines
from corpusloom.operators.prepare import prepare_corpus
from corpusloom.session import checkpointed
from corpusloom.sources.token_files import DTYPES, qualified, write_shard

SHARD_BYTES = 1 << 27  # what one task writes of a token dataset


def write_split_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Instruction, prompt, input and output as JSON lines, one folder per split."""
    wanted = [c for c in ("instruction", "prompt", "input", "output") if c in df.columns]
    df.select("split", *wanted).write.mode(mode).partitionBy("split").json(path)


def write_token_dataset(
    df: DataFrame, path: str, seq_id: str = "seq_id", partitions: int | None = None, mode: str = "overwrite"
) -> None:
    """Token sequences as Parquet by split, ranged and sorted on the id so scans by id prune.

    A ``size`` column lets later passes read lengths without the ids.
    """
    sized = df.withColumn("size", F.size("ids"))
    keys = ["split", seq_id]
    ranged = sized.repartitionByRange(partitions, *keys) if partitions else sized.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode(mode).partitionBy("split").parquet(path)


def write_corpus(df: DataFrame, path: str, text: str = "text", order: str | None = None, mode: str = "overwrite") -> None:
    """One document per line, newline runs as the sentinel; ranged by ``order`` when given."""
    lines = prepare_corpus(df, text)
    lines = lines.orderBy(order) if order else lines
    lines.select(F.col(text).alias("value")).write.mode(mode).text(path)


def prediction_lines(df: DataFrame, query: str, response: str) -> DataFrame:
    return df.select(F.concat_ws("\t\t", inline_newlines(F.col(query)), inline_newlines(F.col(response))).alias("value"))


def write_predictions(
    df: DataFrame, folder: str, query: str = "query", response: str = "response", idx: str = "idx", mode: str = "overwrite"
) -> None:
    """``preds`` (query and response on a line) and ``answers`` (cleaned text as JSON lines)."""
    ordered = df.orderBy(idx)
    prediction_lines(ordered, query, response).write.mode(mode).text(f"{folder}/preds")
    answers = ordered.select(clean_generation(F.col(response)).alias("text"))
    answers.write.mode(mode).json(f"{folder}/answers")


def write_logits(df: DataFrame, name: str, path: str, buckets: int, keys: tuple[str, ...] = ("example_id", "pos"), mode: str = "overwrite") -> DataFrame:
    """Logits as table ``name``, hashed on ``keys`` into ``buckets`` sorted files: tables of equal buckets join without a shuffle.

    Positions of one long example lie in different buckets. Take so many buckets that one, of both tables, fits a task: about
    the larger table's bytes by 256 MB. Rows pass one shuffle here, so that a bucket is one file.
    """
    placed = df.repartition(buckets, *keys)
    placed.write.mode(mode).option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def write_rollouts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rollouts as JSON lines, arrays as JSON arrays."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_token_shards(
    df: DataFrame, folder: str, split: str, dtype_code: int, shards: int, seq_id: str = "seq_id", shard_bytes: int = SHARD_BYTES
) -> int:
    """Export ``ids`` as indexed token shards ``{split}_{k}.bin/.idx``: ``shards``, or as many more as keep one at about
    ``shard_bytes``; returns their count.

    Rows are ranged on the id, one task per shard. A task streams ids to its data file and
    keeps only sizes, so a shard may exceed memory; a retried task rewrites its own files. The ids are
    worked out once and checkpointed, for their count, their ranges and the shards.
    """
    folder = qualified(df.sparkSession, folder)
    staged = checkpointed(df.select(seq_id, "ids"))
    stored = (staged.agg(F.sum(F.size("ids").cast("long")).alias("n")).first().n or 0) * np.dtype(DTYPES[dtype_code]).itemsize
    ranged = staged.repartitionByRange(max(shards, -(-stored // shard_bytes)), seq_id).sortWithinPartitions(seq_id)

    def export(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = TaskContext.get().partitionId()
        yield pd.DataFrame({"shard": [k], "sequences": [write_shard(f"{folder}/{split}_{k}", dtype_code, batches)]})

    return ranged.mapInPandas(export, "shard long, sequences long").count()
