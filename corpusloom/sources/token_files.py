"""Import of indexed token shards (``{split}_{k}.bin`` with ``{split}_{k}.idx``).

Spark lists the shards and tasks read their headers. Ranges of sequences become rows, and
tasks read their own slice of index and data, so a shard of any size is spread out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpointed

# --- fixed values: the on-disk layout --------------------------------------------------
MAGIC = b"MMIDIDX\x00\x00"
HEADER = struct.Struct("<9sQBQQ")  # magic, version, dtype code, sequences, documents
DTYPES = {1: "u1", 2: "i1", 3: "<i2", 4: "<i4", 5: "<i8", 6: "<f4", 7: "<f8", 8: "<u2", 9: "<u4"}
# ---------------------------------------------------------------------------------------
RANGE_SEQUENCES = 1 << 14
RANGE_BYTES = 1 << 26
PART_BYTES = 1 << 24


def _locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), uri[len("file:") :].replace("///", "/", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _open(uri: str):
    system, path = _locate(uri)
    return system.open_input_file(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; without one it lies in the default file system, as for Spark's own readers."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def shard_table(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """``shard, base, code, count, start, bytes`` of shards 0, 1, 2 ... until one is missing.

    Spark lists the folder and tasks read the headers, so many shards take no longer on the driver than few.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{split}_*").load(folder).select("path", "length")
    shard = F.regexp_extract("path", r"_(\d+)\.(idx|bin)$", 1).try_cast("long")
    named = files.withColumn("shard", shard).withColumn("base", F.regexp_replace("path", r"\.(idx|bin)$", ""))
    named = named.where(F.endswith("base", F.concat(F.lit(f"/{split}_"), F.col("shard").cast("string"))))
    size = lambda kind: F.max(F.when(F.endswith("path", F.lit(kind)), F.col("length")))
    both = named.groupBy("shard", "base").agg(size(".idx").alias("index"), size(".bin").alias("bytes")).where("index is not null and bytes is not null")
    order = Window.partitionBy(F.lit(0)).orderBy("shard")
    whole = both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") - 1 == F.col("shard")).select("shard", "base", "bytes")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_header(base) for base in batch["base"]]
            yield batch.assign(code=[c for c, _ in found], count=[n for _, n in found])

    read = whole.repartition("shard").mapInPandas(headers, "shard long, base string, bytes long, code long, count long")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return read.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))


def _header(base: str) -> tuple[int, int]:
    with _open(base + ".idx") as f:
        magic, version, code, count, _ = HEADER.unpack(f.read(HEADER.size))
    if magic != MAGIC or version != 1:
        raise ValueError(f"{base}.idx is not an indexed token file")
    return code, count


def read_token_dataset(spark: SparkSession, folder: str, split: str, sentinel: int | None = None) -> DataFrame:
    """``(seq_id, shard, ids)`` over all shards; stored ids are widened to ``long``.

    ``sentinel`` names the stored separator of prompt and response and is returned as -1. A range is cut to about
    ``RANGE_BYTES``, and read in parts of ``PART_BYTES``.
    """
    shards = checkpointed(shard_table(spark, folder, split))
    if shards.isEmpty():
        raise FileNotFoundError(f"no shard {folder}/{split}_0")
    step = F.least(F.lit(RANGE_SEQUENCES), F.greatest(F.lit(1), F.floor(F.col("count") * F.lit(RANGE_BYTES) / F.greatest("bytes", F.lit(1))))).cast("long")
    ranges = shards.where(F.col("count") > 0).withColumn("_step", step).withColumn(
        "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.col("_step")))
    )
    spread = ranges.withColumn("hi", F.least(F.col("lo") + F.col("_step"), F.col("count"))).drop("_step").repartition("shard", "lo")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield from _read_range(row, sentinel)

    return spread.mapInPandas(decode, "seq_id long, shard long, ids array<bigint>")


def _read_range(row, sentinel: int | None) -> Iterator[pd.DataFrame]:
    lo, hi, count = int(row.lo), int(row.hi), int(row.count)
    dtype = np.dtype(DTYPES[int(row.code)])
    with _open(row.base + ".idx") as f:
        f.seek(HEADER.size + 4 * lo)
        sizes = np.frombuffer(f.read(4 * (hi - lo)), dtype="<i4")
        f.seek(HEADER.size + 4 * count + 8 * lo)
        pointers = np.frombuffer(f.read(8 * (hi - lo)), dtype="<i8")
    part = np.cumsum(sizes.astype(np.int64) * dtype.itemsize) // PART_BYTES
    with _open(row.base + ".bin") as f:
        for number in np.unique(part):
            at = np.flatnonzero(part == number)
            begin, end = int(pointers[at[0]]), int(pointers[at[-1]]) + int(sizes[at[-1]]) * dtype.itemsize
            f.seek(begin)
            data = np.frombuffer(f.read(end - begin), dtype=dtype)
            starts = (pointers[at] - begin) // dtype.itemsize
            ids = [data[s : s + n].astype(np.int64) for s, n in zip(starts, sizes[at], strict=True)]
            if sentinel is not None:
                ids = [np.where(a == sentinel, -1, a) for a in ids]
            yield pd.DataFrame({"seq_id": int(row.start) + lo + at, "shard": int(row.shard), "ids": ids})


def write_shard(base: str, code: int, batches: Iterator[pd.DataFrame]) -> int:
    """Stream one shard's ids to ``base.bin``, then its index to ``base.idx``."""
    system, path = _locate(base)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    dtype, sizes = np.dtype(DTYPES[code]), []
    with system.open_output_stream(path + ".bin") as data:
        for pdf in batches:
            for ids in pdf["ids"]:
                sizes.append(len(ids))
                # Separators are -1: an unsigned type stores its largest value.
                data.write(np.asarray(ids, dtype=np.int64).astype(dtype).tobytes())
    lengths = np.array(sizes, dtype="<i4")
    pointers = np.zeros(len(sizes), dtype="<i8")
    pointers[1:] = np.cumsum(lengths[:-1], dtype=np.int64)
    with system.open_output_stream(path + ".idx") as index:
        index.write(HEADER.pack(MAGIC, 1, code, len(sizes), 1))
        index.write(lengths.tobytes() + (pointers * dtype.itemsize).astype("<i8").tobytes() + np.zeros(1, "<i8").tobytes())
    return len(sizes)
