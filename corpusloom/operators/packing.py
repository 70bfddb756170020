"""Greedy packing of token streams, token indexes and sequence access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordered import int_div, prefix_sum, scan, span_bucket

DOCUMENT_BITS = 8  # documents are wide rows: 256 share a bucket


def pack(
    df: DataFrame,
    order: str,
    ids: str,
    max_length: int,
    dev_num: int = 0,
    train_num: int = -1,
    cap: str = "chunk",
    size: Column | None = None,
) -> DataFrame:
    """Concatenate ``ids`` in ``order`` and cut every ``max_length`` tokens; the tail is dropped.

    Chunks below ``dev_num`` are ``valid``, the rest ``train``, at most ``train_num`` of
    those (-1: all). ``cap='document'`` finishes the document that reaches the cap, as a
    sequential packer that checks after each document does.

    ``size`` gives the token count without the tokens (a stored column, or a cheaper
    expression), so the offset pass need not tokenize; an expensive encoder's output is
    best written as a token dataset first. Token offsets come from a bucketed prefix sum. A document is cut into its chunk pieces
    as one array before the explode, so cost is linear in its length, and a chunk gathers
    at most ``max_length`` tokens.
    """
    tokens = F.col(ids)
    if size is not None:
        kind = df.schema[ids].dataType.simpleString()
        wrong = F.raise_error(F.concat(F.lit("size is not the number of ids at "), F.col(order).cast("string"))).cast(kind)
        tokens = F.when(F.size(ids) == size, tokens).otherwise(wrong)
    size = F.size(ids) if size is None else size
    docs = df.select(F.col(order).alias("_o"), tokens.alias("_ids"), size.cast("long").alias("_n"))
    where = span_bucket("_o", DOCUMENT_BITS)
    placed = prefix_sum(docs, "_o", F.col("_n"), "_start", bucket=where, levels=2)
    last_chunk = None
    if train_num >= 0:
        budget = (dev_num + train_num) * max_length
        if cap == "document":
            # The check follows each document, so the first one is always taken whole.
            taken = placed.where((F.col("_start") < budget) | (F.col("_start") == 0))
            placed = taken
        else:
            placed = placed.where(F.col("_start") < budget)
            last_chunk = dev_num + train_num
    start, size = F.col("_start"), F.col("_n")
    first, final = int_div(start, max_length), int_div(start + size - 1, max_length)

    def piece(chunk: Column) -> Column:
        begin = F.greatest(chunk * max_length - start, F.lit(0))
        end = F.least((chunk + 1) * max_length - start, size)
        return F.struct(
            chunk.alias("chunk"),
            (start + begin).alias("at"),
            F.slice(F.col("_ids"), (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"),
        )

    pieces = placed.select(F.explode(F.when(size > 0, F.transform(F.sequence(first, final), piece))).alias("p")).select("p.*")
    gathered = pieces.groupBy("chunk").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
        ).alias("ids")
    )
    full = gathered.where(F.size("ids") == max_length)
    if last_chunk is not None:
        full = full.where(F.col("chunk") < last_chunk)
    split = F.when(F.col("chunk") < dev_num, "valid").otherwise("train")
    return full.select("chunk", split.alias("split"), "ids")


def token_index(df: DataFrame, ids: str, itemsize: int, seq_id: str = "seq_id") -> DataFrame:
    """Size and exclusive byte pointer of each sequence."""
    sized = df.select(seq_id, F.size(ids).alias("size"))
    placed = prefix_sum(sized, seq_id, F.col("size").cast("long") * itemsize, "pointer")
    return placed.select(seq_id, "size", "pointer")


def index_in_order(df: DataFrame, order: str, size: Column, itemsize: int) -> DataFrame:
    """Number, size and byte pointer of each sequence in the order of an integer column: one pass, sizes worked out once."""
    sized = df.select(order, size.cast("long").alias("size"))
    layers = [lambda w: {"_n": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))}]
    state = F.struct(F.col("_n").alias("n"), F.col("_total").alias("total"))
    add = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["total"] + b["total"]).alias("total"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    placed = scan(sized, order, layers, state, add, none, "_up")
    return placed.select((F.col("_up.n") - 1).alias("seq_id"), "size", ((F.col("_up.total") - F.col("size")) * itemsize).alias("pointer"))


def document_index(df: DataFrame, ids: str, seq_id: str = "seq_id") -> DataFrame:
    """Document boundaries: 0, and the number after every zero-size sequence."""
    ends = df.where(F.size(ids) == 0).select((F.col(seq_id) + 1).alias("doc_start"))
    zero = df.sparkSession.range(1).select(F.col("id").alias("doc_start"))
    return zero.unionByName(ends)


def merge_token_datasets(first: DataFrame, second: DataFrame, seq_id: str = "seq_id") -> DataFrame:
    """Append the second dataset after the first, ids re-based on the first one's count."""
    if dict(first.dtypes) != dict(second.dtypes):
        raise ValueError("datasets to merge must have the same column types")
    shift = first.agg(F.coalesce(F.max(seq_id) + 1, F.lit(0)).alias("n")).select("n").scalar()
    moved = second.withColumn(seq_id, F.col(seq_id) + shift)
    return first.unionByName(moved)


def take_sequences(df: DataFrame, lo: int, hi: int, seq_id: str = "seq_id") -> DataFrame:
    """Sequences ``lo <= id < hi``: a range predicate the sorted Parquet scan prunes on."""
    return df.where((F.col(seq_id) >= lo) & (F.col(seq_id) < hi))


def take_ids(df: DataFrame, wanted: DataFrame, seq_id: str = "seq_id") -> DataFrame:
    """Sequences whose id is listed; repeated ids collapse."""
    return df.join(wanted.select(seq_id), seq_id, "left_semi")


def slice_ids(ids: Column, offset: int, length: int | None = None) -> Column:
    """Sub-range of one sequence, counted from 0."""
    room = F.size(ids) - offset if length is None else F.lit(length)
    return F.slice(ids, F.lit(offset + 1), F.greatest(room, F.lit(0)).cast("int"))


def shard_history(df: DataFrame, shard: str) -> DataFrame:
    """Cumulative ``[start, end)`` sequence range of each shard."""
    sizes = df.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))
    ranges = prefix_sum(sizes, shard, F.col("n"), "start")
    return ranges.select(shard, "start", (F.col("start") + F.col("n")).alias("end"))

