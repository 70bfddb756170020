"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from corpusloom.functions.text import unescape_newlines
from corpusloom.operators.prepare import cap, prepare_corpus
from corpusloom.operators.runlogs import LINE_ENDS, NEAR_ANCHOR, NEAR_DISTANCE, is_noise, near_bit, phrase_mask, verdict
from corpusloom.operators.runlogs import near as near_phrases
from corpusloom.operators.runstate import status_summary
from corpusloom.session import checkpoint_root
from corpusloom.sources.readers import number_lines

# The stateful processors below also run in a Python process of the driver that does not get
# the files sent to executors, so they travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of a Parquet table stored as ``name`` inside ``folder``, a file or a folder of files; the schema is read, not inferred per batch."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A plain path must be a folder for a stream; a pattern that only this name matches may be either.
    return reader.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def stream_corpus_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of documents from text files, one per line."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return raw.withColumnRenamed("value", "text")


def stream_capped_corpus(spark: SparkSession, path: str, max_docs: int = -1, files_per_trigger: int = 1000) -> DataFrame:
    """The first documents of a corpus that arrives file by file: ``doc_id, text``, at most ``max_docs`` (all, if not positive).

    Documents are numbered in the order of arrival, those of one trigger as ``read_corpus`` numbers them. What earlier triggers
    kept says where the next begins, so the cap holds across triggers and restarts, and a trigger that is run again replaces
    its own rows. Once the cap is reached later files are not read.
    """
    out = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("lineSep", "\n").text(path)
    placed = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    shape = "doc_id long, text string"

    def keep(batch: DataFrame, number: int) -> None:
        reader = batch.sparkSession.read.schema(shape)
        earlier = [f"{out}/docs/_b={n}" for n in range(number)]
        first = reader.parquet(*earlier).count() if earlier else 0  # from the footers
        if 0 < max_docs <= first:
            rows = batch.sparkSession.createDataFrame([], shape)
        else:
            rows = cap(number_lines(batch.withColumn("_seq", F.monotonically_increasing_id()), "doc_id"), max_docs - first if max_docs > 0 else max_docs, "doc_id")
            rows = rows.select((F.col("doc_id") + first).alias("doc_id"), unescape_newlines(F.col("value")).alias("text"))
        rows.write.mode("overwrite").parquet(f"{out}/docs/_b={number}")

    query = placed.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/ckpt").foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(f"{out}/docs")


def stream_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """Drop empty documents and put each on one line: stateless, so it runs on a stream as it is."""
    return prepare_corpus(docs, text)


def stream_status(
    events: DataFrame, ts: str, status: str, window: str, late: str = "1 hour", size: Column | None = None
) -> DataFrame:
    """Status counts (and bytes, given ``size``) per tumbling window.

    Combined before the shuffle, so one busy status costs a row per task.
    """
    span = F.window(F.col(ts), window)
    wanted = [F.count(F.lit(1)).alias("n")]
    if size is not None:
        wanted.append(F.sum(size).alias("bytes"))
    counted = events.withWatermark(ts, late).groupBy(span.alias("w"), F.col(status)).agg(*wanted)
    return counted.select(F.col("w.start").alias("window_start"), status, *[c for c in counted.columns if c in ("n", "bytes")])


def stream_status_report(events: DataFrame, ts: str, status: str, window: str, late: str = "1 hour") -> DataFrame:
    """The run-status summary per tumbling window."""
    windowed = events.withWatermark(ts, late).withColumn("w", F.window(F.col(ts), window))
    return status_summary(windowed, by=("w",), status=status)


def stream_hang(samples: DataFrame, key: str, ts: str, timeout_seconds: int, late: str = "1 hour") -> DataFrame:
    """Every silence of more than ``timeout_seconds`` of event time, as its key and the event before it.

    Events at most the timeout apart, in whole milliseconds, form a session, and a session ends where a silence begins: state is
    a row a session, merged before the shuffle. A silence is reported once the watermark, ``late`` behind the newest event, has
    passed its timeout. Rows that come later than that are left out, once their own timeout has passed too.
    """
    marked = samples.select(F.col(key), F.timestamp_millis(F.unix_millis(ts)).alias("_at")).withWatermark("_at", late)
    sessions = marked.groupBy(key, F.session_window("_at", f"{timeout_seconds} seconds")).agg(F.max(F.unix_millis("_at")).alias("last_ms"))
    return sessions.select(F.col(key).cast("string").alias("key"), "last_ms")


class ReplayBuffer(StatefulProcessor):
    """Per key: the newest ``capacity`` arrivals as a bounded list."""

    def __init__(self, capacity: int):
        self._capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._items = handle.getListState(
            "items", StructType([StructField("seq", LongType()), StructField("payload", StringType())])
        )

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(r) for r in self._items.get()]
        for pdf in rows:  # each chunk is trimmed at once, so memory stays at capacity + chunk
            held += list(zip(pdf["arrival_seq"].tolist(), pdf["body"].tolist()))
            held = sorted(held, key=lambda r: r[0])[-self._capacity :]
        self._items.put(held)
        yield pd.DataFrame(
            {"key": [str(key[0])] * len(held), "seq": [r[0] for r in held], "payload": [r[1] for r in held]}
        )

    def close(self) -> None:
        pass


def stream_replay(examples: DataFrame, key: str, arrival: str, payload: str, capacity: int) -> DataFrame:
    """Buffer contents of each key after every trigger; sample them with ``draw_replay``."""
    shaped = examples.select(key, F.col(arrival).cast("long").alias("arrival_seq"), F.col(payload).cast("string").alias("body"))
    return shaped.groupBy(key).transformWithStateInPandas(
        ReplayBuffer(capacity), "key string, seq long, payload string", "update", "None"
    )


def stream_phrases(lines: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Running phrase mask of each attempt; ``verdict`` over it is the class so far, but for the proximity rules.

    Screen lines inside a file line are told apart, and an attempt of noise alone has an empty mask.
    """
    pieces = lines.select(*keys, F.explode(F.split(F.col(raw), LINE_ENDS)).alias("text"))
    kept = pieces.withColumn("text", F.when(~is_noise(F.col("text")), F.lower("text")))
    return kept.groupBy(*keys).agg(F.coalesce(F.bit_or(phrase_mask("text")), F.lit(0)).alias("mask"))


SEGMENT_BITS = 12  # line numbers a state holds, as a power of two
NEAR_PHRASES = (NEAR_ANCHOR, "cuda", "killed")


SUMMARY = ("mask", "n", "first", "last", "near")


def _line_summary(name: str, distance: int) -> Column:
    """Phrases of a kept line (null: noise), its length with the line end, first and last start of each near phrase (-1: none), and
    the bits of phrases near the first."""
    text, starts, ends, near = F.col(name), [], [], F.lit(0).cast("long")
    for k, phrase in enumerate(NEAR_PHRASES):
        at, back = F.instr(text, phrase), F.instr(F.reverse(text), phrase[::-1])
        starts.append(F.coalesce(at - 1, F.lit(-1)).cast("long"))
        ends.append(F.when(at > 0, F.length(text) - back - len(phrase) + 1).otherwise(F.lit(-1)).cast("long"))
        if k:
            met = (at > 0) & F.contains(text, F.lit(NEAR_PHRASES[0])) & near_phrases(text, NEAR_PHRASES[0], phrase, distance)
            near = near.bitwiseOR(F.when(met, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    parts = (F.coalesce(phrase_mask(name), F.lit(0)).cast("long"), F.coalesce(F.length(text) + 1, F.lit(0)).cast("long"), F.array(*starts), F.array(*ends), near)
    return F.struct(*[c.alias(n) for c, n in zip(parts, SUMMARY, strict=True)])


def _after(distance: int) -> Callable[[Column, Column], Column]:
    """Summary of a stretch of a log followed by another."""

    def after(a: Column, b: Column) -> Column:
        near = a["near"].bitwiseOR(b["near"])
        for k in range(1, len(NEAR_PHRASES)):
            for x, y in ((0, k), (k, 0)):
                met = (a["last"][x] >= 0) & (b["first"][y] >= 0) & (a["n"] + b["first"][y] - a["last"][x] <= distance)
                near = near.bitwiseOR(F.when(met, F.lit(1 << k)).otherwise(F.lit(0)))
        first = F.zip_with(a["first"], b["first"], lambda f, g: F.when(f >= 0, f).when(g >= 0, a["n"] + g).otherwise(F.lit(-1)))
        last = F.zip_with(a["last"], b["last"], lambda f, g: F.when(g >= 0, a["n"] + g).otherwise(f))
        parts = (a["mask"].bitwiseOR(b["mask"]), a["n"] + b["n"], first, last, near)
        return F.struct(*[p.alias(n) for p, n in zip(parts, SUMMARY, strict=True)])

    return after


def _nothing() -> Column:
    none, zero = F.array(*[F.lit(-1).cast("long")] * len(NEAR_PHRASES)), F.lit(0).cast("long")
    return F.struct(*[c.alias(n) for c, n in zip((zero, zero, none, none, zero), SUMMARY, strict=True)])


def log_segments(lines: DataFrame, keys: list[str], order: str = "line_no", raw: str = "raw", distance: int = NEAR_DISTANCE) -> DataFrame:
    """Stream of the summaries (keys, segment, mask, n, first, last, near) of the segments that new lines belong to.

    State per attempt and segment of its lines is one summary a line, so lines may come in any order and again: a line is its
    latest copy. A segment holds ``2**SEGMENT_BITS`` lines at most (and copies of them), so a long log is many states.
    """
    pieces = F.filter(F.split(F.col(raw), LINE_ENDS), lambda p: ~is_noise(p))
    text = F.when(F.size(pieces) > 0, F.lower(F.array_join(pieces, "\n")))
    # Within a query all rows of a trigger have one time, a later one than those before.
    rows = lines.select(*keys, F.shiftright(F.col(order).cast("long"), SEGMENT_BITS).alias("segment"), F.col(order).cast("long").alias("line"),
                        F.current_timestamp().alias("seen"), text.alias("text"))
    rows = rows.select(*keys, "segment", F.struct("line", "seen", _line_summary("text", distance).alias("v")).alias("x"))
    # Bounded group: copies of a line within a trigger are the same line.
    held = rows.groupBy(*keys, "segment").agg(F.collect_list("x").alias("a")).withColumn("a", F.array_sort("a"))
    latest = F.filter("a", lambda x, i: ~x["line"].eqNullSafe(F.get(F.col("a"), i + 1)["line"]))
    every = F.aggregate("a", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x["v"]["mask"]))
    found = held.select(*keys, "segment", every.alias("mask"), F.aggregate(F.transform(latest, lambda x: x["v"]), _nothing(), _after(distance)).alias("v"))
    return found.select(*keys, "segment", "mask", *[F.col("v")[n].alias(n) for n in SUMMARY[1:]])


def segment_verdicts(segments: DataFrame, keys: list[str], top: int, distance: int = NEAR_DISTANCE) -> DataFrame:
    """Failure class of each attempt from the latest summary of each of its segments (numbers up to ``top``), joined in order, some at a time."""
    rows = segments.select(*keys, "segment", F.struct(*SUMMARY).alias("v"))
    while True:  # 2**12 at a time, until every line number has one segment
        listed = F.array_sort(F.collect_list(F.struct("segment", "v")))
        grouped = rows.groupBy(*keys, F.shiftright("segment", 12).alias("up")).agg(listed.alias("a"))
        rows = grouped.select(*keys, F.col("up").alias("segment"), F.aggregate(F.transform("a", lambda x: x["v"]), _nothing(), _after(distance)).alias("v"))
        top >>= 12
        if top <= 0:
            break
    near = sum((F.when(F.col("v.near").bitwiseAND(F.lit(1 << k)) != 0, F.lit(near_bit(p))).otherwise(0) for k, p in enumerate(NEAR_PHRASES) if k), F.lit(0))
    return rows.select(*keys, F.col("v.mask").bitwiseOR(near).alias("mask")).select(*keys, verdict("mask").alias("reason"))


def stream_classify(lines: DataFrame, keys: list[str], order: str = "line_no", raw: str = "raw", history: bool = False) -> DataFrame:
    """Failure class of each attempt after the last trigger; with ``history``, after every trigger that read lines of it (``trigger``).

    Each trigger updates the segments of its lines in state, keeps their new summaries, and judges the attempts they belong
    to from the latest summaries: lines are read once and not kept. The class so far is that of a log of the lines so far, the last
    one that of the whole log, however lines are cut into triggers.
    """
    segments = log_segments(lines, keys, order, raw)

    def judged(batch: DataFrame, number: int, kept: str) -> DataFrame:
        known = batch.sparkSession.read.schema(StructType([*segments.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{kept}/*")
        mine = batch.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
        latest = newest_per_key(*keys, "segment")(known.where(F.col("_batch") <= number).join(mine, same, "left_semi"))
        top = known.agg(F.max("segment").alias("n")).first().n or 0
        return segment_verdicts(latest, keys, top).withColumn("trigger", F.lit(number))

    shape = StructType([*[segments.schema[k] for k in keys], StructField("reason", StringType()), StructField("trigger", IntegerType())])
    found = run_to_table(segments, "update", after=judged, after_schema=shape)
    if history:
        return found
    return found.groupBy(*keys).agg(F.max_by("reason", "trigger").alias("reason"))


def stream_latest(generations: DataFrame, key: str, text: str, seq: str, name: str = "gen_answer") -> DataFrame:
    """Latest generation of each id."""
    return generations.groupBy(key).agg(F.max_by(text, seq).alias(name), F.max(seq).alias(seq))


def stream_distinct(generations: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose ``keys`` have not come before: an exact repeat is dropped if its time is within ``late`` of the first one's.

    State holds a key until the watermark has passed its time by ``late``. Null keys are equal to each other. Which of several
    equal rows stays depends on their arrival, so only the keys are returned.
    """
    return generations.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys).select(*keys)


def run_to_table(
    stream: DataFrame, mode: str, merge: Callable[[DataFrame], DataFrame] | None = None,
    after: Callable[[DataFrame, int, str], DataFrame] | None = None, after_schema: StructType | None = None,
) -> DataFrame:
    """Run a stream over what is there now and read back what it wrote.

    Results go to Parquet in the shared checkpoint folder. In ``update`` and ``complete``
    mode each batch is kept under its number and ``merge`` reduces the batches to the final
    rows; a batch written twice after a failure replaces itself. With ``after`` the result is instead what it gives for the rows of each
    trigger, the trigger's number and the folder of all rows kept so far, as rows of ``after_schema``.
    """
    spark = stream.sparkSession
    root = checkpoint_root(spark)
    base = f"{root}/stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/ckpt")
        if mode == "append":
            query = writer.format("parquet").option("path", f"{base}/out").start()
        else:

            def keep(df: DataFrame, n: int) -> None:
                df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/_b={n}")
                if after is not None:
                    kept = df.sparkSession.read.schema(df.schema).parquet(f"{base}/out/_b={n}")
                    after(kept, n, f"{base}/out").write.mode("overwrite").parquet(f"{base}/after/_b={n}")

            query = writer.foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    if after is not None:
        return spark.read.schema(after_schema).parquet(f"{base}/after/*")
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    reader = spark.read.schema(schema)
    rows = reader.parquet(f"{base}/out") if mode == "append" else reader.parquet(f"{base}/out/*")
    return merge(rows) if merge else rows.drop("_batch")


def latest_batch(rows: DataFrame) -> DataFrame:
    """Merge for complete mode: the last batch holds everything."""
    last = rows.agg(F.max("_batch")).scalar()
    return rows.where(F.col("_batch") == last).drop("_batch")


def newest_per_key(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge for update mode: each key's row from the latest batch that changed it."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys and c != "_batch"]
        packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
        return packed.select(*keys, "_r.*")

    return merge
