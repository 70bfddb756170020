"""Readers: line files with stable row numbers, JSON lines, run states."""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions.text import expand_newlines, strip, unescape_newlines
from corpusloom.operators.ordered import prefix_sums
from corpusloom.operators.prepare import cap
from corpusloom.session import checkpointed
from corpusloom.sources.token_files import _locate, qualified

LISTED_NAMES = 1 << 14  # handed on at a time
READ_BYTES = 1 << 20
FILES_A_TASK = 1 << 12
BROADCAST_BLOCKS = 1 << 17  # files of 128 MB: up to 16 TB of text


def read_lines(spark: SparkSession, path: str, line_sep: str = "\n") -> DataFrame:
    """Lines with their place: file, block start, and order inside the block.

    A block is read by one task front to back, so the order inside it is the file's; the
    numbers of all blocks are then joined up by a prefix sum over block totals.
    """
    raw = spark.read.option("lineSep", line_sep).text(path)
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _block() -> Column:
    """Order of blocks: part files by their number, however many digits it has, then by path, then by place in the file."""
    part = F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    return F.struct(F.regexp_replace("_file", r"[^/]*$", "").alias("folder"), part.alias("part"), F.col("_file"), F.col("_start"))


def number_lines(lines: DataFrame, name: str = "row_id") -> DataFrame:
    """0-based line number over all files.

    The rows of a block lie together in order, so a line's number is its place in the block plus the block's offset.
    Only the table of blocks is shuffled, not the text; it is broadcast if it has at most ``BROADCAST_BLOCKS`` rows.
    """
    counted = lines.groupBy(_block().alias("_k")).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    blocks = checkpointed(counted)
    before = Window.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(F.col("_k").alias("_block"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    if blocks.count() <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    joined = lines.withColumn("_k", _block()).join(offsets, F.col("_k") == F.col("_block"))
    return joined.select(*lines.columns, (F.col("_seq") + F.col("_shift")).alias(name))


def read_corpus(spark: SparkSession, path: str, max_docs: int = -1) -> DataFrame:
    """Sentinel-escaped corpus, one document per line, un-escaped; optionally its first documents."""
    docs = number_lines(read_lines(spark, path), "doc_id")
    return cap(docs, max_docs, "doc_id").select("doc_id", unescape_newlines(F.col("value")).alias("text"))


def read_prompts_txt(spark: SparkSession, path: str) -> DataFrame:
    lines = number_lines(read_lines(spark, path), "idx")
    return lines.select("idx", expand_newlines(strip(F.col("value"))).alias("prompt"))


def _from_json(lines: DataFrame, schema, keep: list[str]) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    return lines.select(*keep, F.from_json("value", schema, options).alias("j")).select(*keep, "j.*")


def read_instructions(spark: SparkSession, path: str, limit: int = -1, upstream: bool = False) -> DataFrame:
    """Instruction JSON lines in file order; the limit counts source rows, valid or not."""
    lines = cap(number_lines(read_lines(spark, path)), limit)
    return _from_json(lines, schemas.UPSTREAM if upstream else schemas.INSTRUCTION, ["row_id"])


def read_eval(spark: SparkSession, folder: str, split: str, family: str | None = None) -> DataFrame:
    """Prompts and reference lists; the family's own file is preferred to the generic one.

    Rows without an answer keep a null list, to be counted or dropped by the caller.
    """
    generic = f"{folder}/{split}.jsonl"
    lines = None
    if family:
        try:
            lines = read_lines(spark, f"{folder}/{split}_{family}.jsonl")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if lines is None:
        lines = read_lines(spark, generic)
    rows = number_lines(lines, "idx")
    # Whether the top-level value is a list is told by its elements, as a path into a string finds none.
    value = F.get_json_object("value", "$.output")
    listed = F.from_json("value", "output array<string>")["output"]
    is_list = F.get_json_object("value", "$.output[0]").isNotNull() | (value == "[]")
    answers = F.when(is_list, listed).when(value.isNotNull(), F.array(value))
    return rows.select(
        "idx",
        expand_newlines(F.get_json_object("value", "$.prompt")).alias("prompt"),
        answers.alias("references"),
    )


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with run (file path), line number and byte offset; line ends are one byte."""
    sums = {"line_no": F.lit(1).cast("long"), "byte_offset": F.octet_length("value").cast("long") + 1}
    placed = prefix_sums(read_lines(spark, path), "_seq", sums, by=["_file"], bucket=_block())
    return placed.select(F.col("_file").alias("run_id"), "line_no", "byte_offset", F.col("value").alias("raw"))


def parse_events(df: DataFrame, raw: str, keep: list[str] | None = None) -> DataFrame:
    """JSON event lines: time stamp, source, event, and every other key as text."""
    keep = keep or []
    parsed = df.select(*keep, F.from_json(raw, "map<string,string>").alias("m"))
    rest = F.map_filter("m", lambda k, _: ~k.isin(*schemas.EVENT_CORE))
    item = lambda k: F.try_element_at("m", F.lit(k))
    return parsed.where(F.col("m").isNotNull()).select(
        *keep,
        F.try_to_timestamp(item("ts"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        item("source").alias("source"),
        item("event").alias("event"),
        rest.alias("fields"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path), "value")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The folders a path, maybe a glob, stands for."""
    where = spark._jvm.org.apache.hadoop.fs.Path(qualified(spark, path))
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [s.getPath().toString() for s in found or [] if s.isDirectory()]


def _in_tasks(folders: list[str]) -> bool:
    """Whether tasks can open the folders themselves, without Spark's readers."""
    try:
        return all(_locate(f) for f in folders)
    except (OSError, ValueError, NotImplementedError):
        return False


def _names(folder: str) -> Iterator[str]:
    """Names in a folder, a local one listed bit by bit. A name that is not text is left out, as by Spark's own listing."""
    system, path = _locate(folder)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as entries:
            yield from (e.name for e in entries if e.name == e.name.encode(errors="ignore").decode())
    else:
        yield from (i.base_name for i in system.get_file_info(fs.FileSelector(path)))


def _listed(spark: SparkSession, folders: list[str], suffix: str = "") -> DataFrame:
    """``folder, name`` of all that lies in the folders, listed by tasks: the driver holds no name.

    A row is a name, the work behind it a file: rows are dealt to tasks that grow in number with them, and checkpointed so, as their few
    bytes would else pass for the size of the files where a join picks the table to broadcast.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                for names in itertools.batched((n for n in _names(folder) if n.endswith(suffix)), LISTED_NAMES):
                    yield pd.DataFrame({"folder": folder, "name": names})

    found = checkpointed(spark.createDataFrame([(f,) for f in folders], "folder string").mapInPandas(entries, "folder string, name string"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-found.count() // FILES_A_TASK))
    return checkpointed(found.repartition(tasks, "folder", "name"))


def _stored(system: fs.FileSystem, path: str) -> Iterator[tuple[str, fs.FileInfo]]:
    """The file at a path, or those of the folder there, with what their names add to it; none that Spark's readers skip."""
    found = system.get_file_info(path)
    inner = found.type == fs.FileType.Directory
    for i in system.get_file_info(fs.FileSelector(path)) if inner else [found]:
        hidden = i.base_name.startswith(".") or (i.base_name.startswith("_") and "=" not in i.base_name) or i.base_name.endswith("._COPYING_")
        if i.type == fs.FileType.File and i.size != 0 and not hidden:
            yield f"/{i.base_name}" if inner else "", i


def _escaped(path: str) -> str:
    """A path as Spark's readers show it: what a URI can't hold is escaped."""
    return re.sub(r"[^\w.\-!~'()*,;:$&+=/@]", lambda c: c[0] if c[0] > "\x9f" and unicodedata.category(c[0])[0] != "Z" else quote(c[0]), path)


def _contents(listed: DataFrame, inner: str = "") -> DataFrame:
    """Path, time and text of the files listed, or of the file ``inner`` of the folders listed, where there is one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        located = functools.cache(_locate)
        for batch in batches:
            rows, held = [], 0
            for folder, name in zip(batch["folder"], batch["name"], strict=True):
                system, base = located(folder)
                for added, info in _stored(system, f"{base}/{name}{inner}"):
                    with system.open_input_stream(info.path) as f:
                        value = f.read()
                    rows.append((_escaped(f"{folder}/{name}{inner}{added}"), None if info.mtime_ns is None else info.mtime_ns // 1000000, value))
                    held += len(value)
                    if held >= READ_BYTES:
                        yield pd.DataFrame(rows, columns=["file_path", "ms", "value"])
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["file_path", "ms", "value"])

    found = listed.mapInPandas(read, "file_path string, ms long, value binary")
    return found.select(F.col("value").cast("string").alias("value"), "file_path", F.timestamp_millis("ms").alias("file_time"))


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's own listing, which the driver holds, for file systems that only Spark's readers can open. None found: no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string, file_path string, file_time timestamp")
    return raw.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("file_time"))


def _state_files(texts: DataFrame, schema) -> DataFrame:
    """One row per JSON file."""
    run_dir = F.element_at(F.split("file_path", "/"), -2)
    return _from_json(texts.withColumn("run_dir", run_dir), schema, ["run_dir", "file_path", "file_time"])


def read_run_states(spark: SparkSession, queue: str, runs: str) -> dict[str, DataFrame]:
    """Queue, run copies, statuses and load-failure events.

    ``queue`` and ``runs`` are folders. Malformed files and rows without an id are left out
    and listed under ``failures``; status and attempt get their defaults. Tasks list the folders
    and read the files, so many files take no more of the driver than few.
    """
    queues, homes = _folders(spark, queue), _folders(spark, runs)
    if _in_tasks(queues + homes):
        listed = _listed(spark, homes)
        texts = _contents(_listed(spark, queues, ".json")), _contents(listed, "/exp.json"), _contents(listed, "/status.json")
    else:
        texts = [_whole_texts(spark, f"{path}.json") for path in (f"{queue}/*", f"{runs}/*/exp", f"{runs}/*/status")]
    q, r, s = (_state_files(t, schema) for t, schema in zip(texts, (schemas.QUEUE, schemas.QUEUE, schemas.STATUS), strict=True))
    sound = lambda df: df.where(F.col(schemas.CORRUPT).isNull()).drop(schemas.CORRUPT, "file_path")
    defaulted = lambda df: df.withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn(
        "attempt", F.coalesce("attempt", F.lit(0))
    )
    broken = [df.where(F.col(schemas.CORRUPT).isNotNull()).select(
        F.lit("load_exp_failed").alias("event"), F.col("file_path").alias("path")) for df in (q, r, s)]
    return {
        "queue": defaulted(sound(q)).where(F.coalesce("exp_id", F.lit("")) != ""),
        "runs": defaulted(sound(r)),
        "status": sound(s),
        "failures": broken[0].unionByName(broken[1]).unionByName(broken[2]),
    }
