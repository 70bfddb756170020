"""Conflict-constrained best-fit packing of documents into bins of a token capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import count_words, digest_long, lower_ascii, split_words, text_or_empty
from corpusloom.session import checkpointed

CAPACITY = 2048
SHARD_DOCS = 2000


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of every item, in the order given; items no longer than ``capacity``.

    Open bins are kept in order of residual capacity, each with a bitmap of the sources and one of the duplicate
    clusters it holds. The search starts at the tightest bin that is large enough and goes on to its successors
    until it meets one that shares neither; else a bin is opened. A null source or cluster conflicts with nothing.
    """
    bit: dict = {}

    def mask(kind: str, value) -> int:
        return 0 if value is None else 1 << bit.setdefault((kind, value), len(bit))

    open_bins: list[tuple[int, int, int]] = []  # residual, bin, bitmap
    out, made = [], 0
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        wanted = mask("source", source) | mask("cluster", cluster)
        at = bisect_left(open_bins, (length, -1, 0))
        while at < len(open_bins) and open_bins[at][2] & wanted:
            at += 1
        if at < len(open_bins):
            residual, number, held = open_bins.pop(at)
        else:
            residual, number, held = capacity, made, 0
            made += 1
        out.append((number, capacity - residual))
        if residual > length:
            insort(open_bins, (residual - length, number, held | wanted))
    return out


def pack(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cluster_col: str | None = None, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """Where every piece of every document goes: ``id, piece, start, length, shard, bin, offset``.

    Lengths are words. A document longer than ``capacity`` gives full pieces, each a bin of its own, and a rest; rests
    and shorter documents are packed longest first, ties by id. No bin holds two documents of one source or of one
    duplicate cluster (``cluster_col``; else equal word sequences, letter case aside). Documents are dealt to shards
    of about ``shard_docs`` by digest and packed shard by shard, so nothing grows with the table. Null and empty
    texts have no words and give no row; null ids, repeated rows and repeated ids are documents of their own; a null
    source conflicts with none.
    """
    cluster = F.xxhash64(lower_ascii(F.array_join(split_words(F.col(text_col)), " "))) if cluster_col is None else F.col(cluster_col)
    sized = checkpointed(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), cluster.cast("string").alias("cluster"),
        count_words(F.col(text_col)).alias("size"), digest_long(F.col(id_col), F.md5(text_or_empty(text_col))).alias("_h"),
    ).where("size > 0"))
    shards = -(-sized.count() // shard_docs) or 1
    kind = sized.schema["_id"].dataType.simpleString()

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_h", "size", "cluster", "source"], kind="stable", na_position="last").reset_index(drop=True)
        return pd.concat(list(_pieces(rows, capacity)), ignore_index=True)

    return (
        sized.withColumn("shard", F.pmod("_h", F.lit(shards)).cast("int")).groupBy("shard")
        .applyInPandas(place, f"_id {kind}, piece int, start long, length int, shard int, bin int, offset int")
        .withColumnRenamed("_id", id_col)
    )


def _pieces(rows: pd.DataFrame, capacity: int) -> Iterator[pd.DataFrame]:
    full, rest = rows["size"] // capacity, rows["size"] % capacity
    tail = rows.index[rest > 0]
    tail = tail[(-rest[tail]).argsort(kind="stable")]
    known = lambda c: [None if pd.isna(v) else v for v in rows.loc[tail, c]]
    placed = best_fit(rest[tail].tolist(), known("source"), known("cluster"), capacity)
    shard = int(rows["shard"].iloc[0])
    if len(tail):
        yield pd.DataFrame({
            "_id": rows.loc[tail, "_id"], "piece": full[tail], "start": full[tail] * capacity, "length": rest[tail], "shard": shard,
            "bin": [b for b, _ in placed], "offset": [o for _, o in placed],
        })
    made = max((b for b, _ in placed), default=-1) + 1
    long = rows.index.repeat(full)
    if len(long):
        piece = pd.Series(range(len(long))) - (full.cumsum() - full).loc[long].reset_index(drop=True)
        yield pd.DataFrame({
            "_id": rows.loc[long, "_id"].reset_index(drop=True), "piece": piece, "start": piece * capacity, "length": capacity, "shard": shard,
            "bin": range(made, made + len(long)), "offset": 0,
        })
