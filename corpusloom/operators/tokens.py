"""Tokenisation of text columns.

The pretrained vocabulary of a model is an outside artefact, so encoders are pluggable:
an Arrow UDF runs any object with ``encode_batch``, and a vocabulary table gives word ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE
from corpusloom.operators.ordered import number_sorted

HASH_DIGITS = 6  # hex digits of a hashed word id: 24 bits
HASH_EOS = 1 << 24  # first id outside the hashed range
BYTE_EOS = 256
SLICE_BYTES = 1 << 20  # text an encoder gets at once
KNOWN_WORDS = 1 << 16  # words whose id a worker remembers: about 15 MB
COMMON_WORDS = 1 << 18  # words of a vocabulary that go to every worker
COMMON_BYTES = 64  # of such a word at most


class Encoder(Protocol):
    """A user tokenizer: loaded once per Python worker, called once per Arrow batch."""

    eos_id: int

    def encode_batch(self, texts: pd.Series) -> pd.Series: ...


class ByteEncoder:
    """UTF-8 bytes as ids."""

    eos_id = BYTE_EOS

    def encode_batch(self, texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.frombuffer(t.encode("utf-8"), dtype=np.uint8))


class HashedWordEncoder:
    """Whitespace-separated words as the leading digits of their digest: needs no vocabulary.

    Frequent words are remembered per worker, so a digest is worked out once for most of
    a text; this beats the same expression in the JVM several times over.
    """

    eos_id = HASH_EOS

    def encode_batch(self, texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [_word_id(w) for w in t.split()])


@lru_cache(maxsize=KNOWN_WORDS)
def _word_id(word: str) -> int:
    return int(hashlib.md5(word.encode("utf-8"), usedforsecurity=False).hexdigest()[:HASH_DIGITS], 16)


def words(text: Column) -> Column:
    """Whitespace-separated words; empty strings dropped."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def hashed_word_ids(text: Column) -> Column:
    return encode(text, HashedWordEncoder())


def encode(text: Column, encoder: Encoder) -> Column:
    """Ids from a tokenizer; null text stays null. One flat Arrow buffer per batch.

    The encoder gets ``SLICE_BYTES`` of text at a time, so its Python objects do not grow with the batch.
    """

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        sizes, flat = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for part in _slices(texts):
            valid = part.is_valid()
            found = list(encoder.encode_batch(part.filter(valid).to_pandas()))
            lengths = np.zeros(len(part), dtype=np.int64)
            lengths[valid.to_numpy(zero_copy_only=False)] = [len(ids) for ids in found]
            sizes.append(lengths)
            flat += [np.concatenate([np.asarray(ids, dtype=np.int32) for ids in found])] if found else []
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)), mask=pc.is_null(texts))

    return run(text)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of about ``SLICE_BYTES`` of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def with_eos(ids: Column, eos_id: int) -> Column:
    return F.array_append(ids, F.lit(eos_id))


def tokenize(
    df: DataFrame,
    text: str,
    encoder: Callable[[Column], Column] = hashed_word_ids,
    eos_id: int | None = HASH_EOS,
    name: str = "ids",
    keep_eol: bool = False,
) -> DataFrame:
    """Add token ids of ``text``, with the end-of-sequence id unless ``eos_id`` is None.

    ``keep_eol`` encodes the line break that ends a corpus line as part of the document.
    """
    source = F.concat(F.col(text), F.lit("\n")) if keep_eol else F.col(text)
    ids = encoder(source)
    return df.withColumn(name, ids if eos_id is None else with_eos(ids, eos_id))


def build_vocab(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """Word table ``(token, count, id)``, ids by falling count then word.

    Stands in for a pretrained vocabulary file. Counts are combined before the shuffle, so
    a word that makes up a third of the corpus costs one row per task.
    """
    counts = df.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").count()
    kept = counts.where(F.col("count") >= min_count)
    return number_sorted(kept, F.desc("count"), F.asc("token"), name="id")


def encode_words(df: DataFrame, key: str, text: str, vocab: DataFrame, unk_id: int, name: str = "ids") -> DataFrame:
    """Add vocabulary ids of the words of ``text``; unknown words get ``unk_id``, a null text gets null.

    The ``COMMON_WORDS`` short words of least ids, in a vocabulary by frequency the most frequent ones, go to every worker. Of each
    different text the different other words alone meet the whole vocabulary, and those that are in it come back as one map: ids depend on the
    text, so shared or null values of ``key`` do no harm. Both joins split skewed keys. A word listed twice has its least id.
    """
    del key  # rows are matched by their text
    table = vocab.groupBy(F.col("token").alias("_w")).agg(F.min(F.col("id").cast("int")).alias("_id")).where("_id IS NOT NULL")
    common = table.where(F.octet_length("_w") <= COMMON_BYTES).orderBy("_id").limit(COMMON_WORDS).toArrow()
    held = df.sparkSession.sparkContext.broadcast((common.column("_w").combine_chunks(), common.column("_id").to_numpy()))
    digests = [F.xxhash64(F.col(text)).alias("_h1"), F.xxhash64(F.col(text), F.lit(1)).alias("_h2")]
    wanted = df.where(F.col(text).isNotNull()).select(*digests, F.explode(F.array_distinct(_others(words(F.col(text)), held))).alias("_w"))
    found = wanted.join(table, "_w")
    # Bounded group: a text's own distinct words; copies of a text send the same entries, of which one set stays.
    maps = found.groupBy("_h1", "_h2").agg(F.map_from_entries(F.collect_set(F.struct("_w", "_id"))).alias("_map"))
    maps = maps.withColumnsRenamed({"_h1": "_m1", "_h2": "_m2"})
    keyed = df.withColumn("_h1", digests[0]).withColumn("_h2", digests[1])
    joined = keyed.join(maps, (F.col("_h1") == F.col("_m1")) & (F.col("_h2") == F.col("_m2")), "left")
    return joined.withColumn(name, _lookup(words(F.col(text)), F.col("_map"), held, unk_id)).drop("_map", "_h1", "_h2", "_m1", "_m2")


def _others(tokens: Column, held: Broadcast) -> Column:
    """Those of ``tokens`` that are not among the common words."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        flat, offsets = _flat(rows)
        rest = pc.is_null(pc.index_in(flat, value_set=held.value[0]))
        before = np.concatenate([[0], np.cumsum(rest.to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(before[offsets].astype(np.int32)), flat.filter(rest), mask=pc.is_null(rows))

    return run(tokens)


def _lookup(tokens: Column, mapping: Column, held: Broadcast, unk_id: int) -> Column:
    """Ids of ``tokens`` among the common words, else through a per-row map (hash lookups; a SQL map is scanned linearly)."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array, maps: pa.Array) -> pa.Array:
        common, numbers = held.value
        flat, offsets = _flat(rows)
        place = pc.fill_null(pc.index_in(flat, value_set=common), -1).to_numpy(zero_copy_only=False)
        ids = np.append(numbers, unk_id).astype(np.int32)[place]
        open_ = np.flatnonzero(place < 0)
        cut = np.searchsorted(open_, offsets)
        for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            known = dict(maps[i].as_py() or ())
            if known:
                own = open_[cut[i] : cut[i + 1]]
                ids[own] = [known.get(w, unk_id) for w in flat.take(pa.array(own)).to_pylist()]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pc.is_null(rows))

    return run(tokens, mapping)


def _flat(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of all lists, and where those of each row begin; a null row has none."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return rows.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
