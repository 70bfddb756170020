"""Instruction and corpus preparation: normalise, split, combine, encode pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import truncate_ids
from corpusloom.functions.text import escape_newlines

ALTERNATES: dict[str, Sequence[str]] = {
    "instruction": ("instruction", "prompt", "question"),
    "input": ("context", "input"),
    "output": ("response", "output", "answer"),
}


def _first_filled(columns: Sequence[str], available: Sequence[str]) -> list[Column]:
    return [F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns if c in available]


def normalize_instructions(df: DataFrame, spec: dict[str, Sequence[str]] = ALTERNATES) -> DataFrame:
    """First non-empty of each field's alternate names.

    Rows without an instruction or with a null output are dropped. The last output
    alternate may be empty: only null is missing there.
    """
    have = df.columns
    others = [c for c in df.columns if not any(c in names for names in spec.values())]
    outputs = [c for c in spec["output"] if c in have]
    last_output = [F.col(outputs[-1]).cast("string")] if outputs else []
    none = F.lit(None).cast("string")
    picked = df.select(
        *others,
        F.coalesce(*_first_filled(spec["instruction"], have), none).alias("instruction"),
        F.coalesce(*_first_filled(spec["input"], have), F.lit("")).alias("input"),
        F.coalesce(*_first_filled(outputs, have), *last_output, none).alias("output"),
    )
    return picked.where(F.col("instruction").isNotNull() & F.col("output").isNotNull())


def prepare_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop empty documents and put each on one line."""
    kept = df.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return kept.withColumn(text, escape_newlines(F.col(text)))


def cap(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """First ``n`` rows by row number; no cap when ``n`` is not positive."""
    return df.where(F.col(row_id) < n) if n > 0 else df


def split_head(df: DataFrame, dev_num: int, row_id: str = "row_id") -> DataFrame:
    """Rows before ``dev_num`` are ``valid``, the rest ``train``."""
    return df.withColumn("split", F.when(F.col(row_id) < dev_num, "valid").otherwise("train"))


def combine_sources(
    sources: dict[str, DataFrame], dev_from: str, dev_num: int, row_id: str = "row_id"
) -> DataFrame:
    """Union of sources, tagged; only ``dev_from`` gives up its first ``dev_num`` rows."""
    parts = [
        split_head(part, dev_num if tag == dev_from else 0, row_id).withColumn("source", F.lit(tag))
        for tag, part in sources.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def with_split_from(df: DataFrame, donor: DataFrame, split: str = "valid") -> DataFrame:
    """Replace one split by the donor's."""
    kept = df.where(F.col("split") != split)
    return kept.unionByName(donor.where(F.col("split") == split).select(*df.columns))


def split_response(full_ids: Column, prompt_ids: Column, eos_id: int) -> Column:
    """Ids after the prompt's count, then the end id; merges across the boundary are ignored."""
    closed = F.array_append(full_ids, F.lit(eos_id))
    room = F.greatest(F.size(closed) - F.size(prompt_ids), F.lit(0))
    return F.slice(closed, F.size(prompt_ids) + 1, room)


def encode_pairs(
    df: DataFrame, prompt: str, response: str, encoder, eos_id: int, max_prompt_length: int, side: str = "head"
) -> DataFrame:
    """Prompt and response ids of instruction rows. The response column is always named."""
    prompt_ids = encoder(F.col(prompt))
    full_ids = encoder(F.concat(F.col(prompt), F.col(response)))
    staged = df.withColumn("_p", prompt_ids).withColumn("_f", full_ids)
    return (
        staged.withColumn("response_ids", split_response(F.col("_f"), F.col("_p"), eos_id))
        .withColumn("prompt_ids", truncate_ids(F.col("_p"), max_prompt_length, side))
        .drop("_p", "_f")
    )


def encode_pair(prompt_ids: Column, response_ids: Column, sentinel: int = -1) -> Column:
    return F.concat(prompt_ids, F.array(F.lit(sentinel)), response_ids)


def decode_pair(ids: Column, sentinel: int = -1) -> Column:
    """``(prompt_ids, response_ids)`` around the first sentinel; no sentinel: prompt is null."""
    at = F.array_position(ids, F.lit(sentinel)).cast("int")
    prompt = F.when(at > 0, F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0))))
    rest = F.when(at > 0, F.slice(ids, at + 1, F.size(ids) - at)).otherwise(ids)
    return F.struct(prompt.alias("prompt_ids"), rest.alias("response_ids"))


def prompt_only(df: DataFrame, max_length: int, prompt_ids: str = "prompt_ids") -> DataFrame:
    """Rows whose prompt is shorter than ``max_length``."""
    return df.where(F.size(prompt_ids) < max_length)

