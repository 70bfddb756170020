"""Streams in several batches must end where one batch over everything does."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ordered
from corpusloom.operators.runlogs import classify_failures, verdict
from corpusloom.operators.runstate import status_summary
from corpusloom.streaming import jobs


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Event table in six files, read one file per trigger."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(600).select(
        "id", F.pmod("id", F.lit(7)).alias("key"), (F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"),
        F.when(F.pmod("id", F.lit(5)) == 0, "failed").otherwise("running").alias("status"),
        F.element_at(F.array(F.lit("ok"), F.lit("WARNING slow"), F.lit("Received SIGTERM"), F.lit("loss is nan"), F.lit("no space left on device")),
                     (F.pmod(F.col("id") * 3 + F.shiftright("id", 5), F.lit(5)) + 1).cast("int")).alias("raw"))
    for part in range(6):  # one after another, so that file times give the order of events
        rows.where(ordered.int_div(F.col("id"), 100) == part).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder), folder


def stream(spark, table):
    df, folder = table
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_status_windows(spark, table):
    counted = jobs.stream_status_report(stream(spark, table), "ts", "status", "2 hours")
    found = jobs.run_to_table(counted, "complete", jobs.latest_batch)
    batch = status_summary(table[0].withColumn("w", F.window("ts", "2 hours")), by=("w",))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in batch.collect()}


def test_latest(spark, table):
    found = jobs.run_to_table(jobs.stream_latest(stream(spark, table), "key", "raw", "id"), "update", jobs.newest_per_key("key"))
    assert {(r.key, r.id) for r in found.collect()} == {(k, max(i for i in range(600) if i % 7 == k)) for k in range(7)}


def test_replay_buffer_across_batches(spark, table):
    kept = jobs.stream_replay(stream(spark, table), "key", "id", "raw", 4)
    rows = jobs.run_to_table(kept, "update", lambda r: r.join(r.groupBy("key").agg(F.max("_batch").alias("_last")), "key").where("_batch = _last"))
    found = {}
    for r in rows.collect():
        found.setdefault(int(r.key), []).append(r.seq)
    assert {k: sorted(v) for k, v in found.items()} == {k: [i for i in range(600) if i % 7 == k][-4:] for k in range(7)}


@pytest.mark.parametrize("files", [1, 2, 5])
def test_silence_whatever_the_cut(spark, tmp_path, files):
    # Out of order by less than the lateness; a silence may begin and end inside one batch.
    import random

    draw = random.Random(files)
    times = sorted({("a" if draw.random() < 0.5 else "b", draw.randrange(0, 40_000)) for _ in range(40)}, key=lambda x: x[1])
    mixed = sorted(times, key=lambda x: x[1] + draw.randrange(0, 1500))
    step = -(-len(mixed) // files)
    folder = str(tmp_path / "in")
    schema = "key string, s long"
    for at in range(0, len(mixed), step):
        rows = spark.createDataFrame(mixed[at : at + step], schema).coalesce(1)
        rows.select("key", (F.lit(1_700_000_000) + F.col("s")).cast("timestamp").alias("ts")).write.mode("append").parquet(folder)
    stored = spark.read.parquet(folder)
    live = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = {(r.key, r.last_ms // 1000 - 1_700_000_000) for r in jobs.run_to_table(jobs.stream_hang(live, "key", "ts", 2000, "1 hour"), "append").collect()}
    newest, want = max(t for _, t in times), set()
    for key in "ab":
        own = [t for k, t in times if k == key]
        want |= {(key, t) for t in own if not any(t < x <= t + 2000 for x in own) and t + 2000 <= newest - 3600}
    assert found == want and want


def test_silence(spark, table):
    # Keys 0..6 take turns each minute; only the last events are followed by silence.
    silent = jobs.stream_hang(stream(spark, table).where("key <> 3 OR id < 300"), "key", "ts", 1800)
    found = {int(r.key): r.last_ms for r in jobs.run_to_table(silent, "append").collect()}
    last = max(i for i in range(300) if i % 7 == 3)
    assert found == {3: (1_700_000_000 + last * 60) * 1000}


def test_phrases_so_far(spark, table):
    lines = lambda df: df.select(F.col("key").alias("run_id"), F.lit(1).alias("attempt"), F.col("id").alias("line_no"), "raw")
    flags = jobs.stream_phrases(lines(stream(spark, table)), ["run_id", "attempt"])
    found = jobs.run_to_table(flags, "update", jobs.newest_per_key("run_id", "attempt")).select("run_id", verdict("mask").alias("reason"))
    batch = classify_failures(lines(table[0]), ["run_id", "attempt"]).select("run_id", "reason")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in batch.collect()}


@pytest.mark.parametrize("files", [1, 3])
def test_classification_whatever_the_cut(spark, tmp_path, files):
    far = "x" * 600
    logs = {
        "near": ["cuda driver", "step", "Out of memory"], "far": ["cuda driver", far, "out of memory"], "noise": ["WARNING: slow", "INFO fine"],
        "screen": ["10%\r20%\rloss is nan", "ok"], "killed": ["kernel: out of memory", "process was killed"], "plain": ["ok"],
    }
    rows = [(run, n, raw) for run, lines in logs.items() for n, raw in enumerate(lines)]
    folder = str(tmp_path / "in")
    for part in range(files):
        spark.createDataFrame(rows[part::files], "run_id string, line_no long, raw string").coalesce(1).write.mode("append").parquet(folder)
    stored = spark.read.parquet(folder)
    live = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = {tuple(r) for r in jobs.stream_classify(live, ["run_id"]).collect()}
    assert found == {("near", "oom"), ("far", "other"), ("noise", "other"), ("screen", "nan"), ("killed", "oom"), ("plain", "other")}
    assert found == {tuple(r) for r in classify_failures(stored, ["run_id"]).collect()}


@pytest.mark.parametrize("files", [1, 2, 5])
def test_verdict_after_every_trigger(spark, tmp_path, monkeypatch, files):
    """Lines out of order, phrases around the edges of lines and segments: after each trigger the class of the lines so far."""
    import random

    draw = random.Random(files)
    parts = ["cuda", "killed", "out of memory", "x" * 240, "x" * 470, "WARNING y", "ok", "cuda\rout of memory", "a killed b killed", "loss is nan", "Connection reset by peer"]
    rows = [(run, n * (1 + 4095 * (run % 3)), f"{draw.choice(parts)} {draw.choice(parts)}") for run in range(24) for n in range(draw.randrange(1, 7))]
    rows += [(None, 5, "cuda"), (None, 6, "out of memory")]
    draw.shuffle(rows)
    folder = str(tmp_path / "in")
    schema = "run_id int, line_no long, raw string"
    for part in range(files):
        spark.createDataFrame(rows[part::files], schema).coalesce(1).write.mode("append").parquet(folder)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = {}
    for r in jobs.stream_classify(live, ["run_id"], history=True).collect():
        found[r.trigger, r.run_id] = r.reason
    assert sorted({t for t, _ in found}) == list(range(files))
    for part in range(files):
        read = [r for k in range(part + 1) for r in rows[k::files]]
        want = {r.run_id: r.reason for r in classify_failures(spark.createDataFrame(read, schema), ["run_id"]).collect()}
        assert {k: max((t, x) for (t, i), x in found.items() if i == k and t <= part)[1] for k in want} == want
    assert len(set(found.values())) >= 4


def test_corpus_is_stateless(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo\n")
    docs = jobs.stream_corpus_lines(spark, str(tmp_path / "in"))
    assert sorted(r.text for r in jobs.run_to_table(jobs.stream_corpus(docs), "append").collect()) == ["one", "two"]


@pytest.mark.parametrize("files", [1, 2, 5])
def test_cap_holds_across_triggers(spark, tmp_path, files):
    from corpusloom.sources.readers import read_corpus

    for part in range(5):  # names and times give the same order; one file is empty
        lines = "" if part == 3 else "".join(f"{part} line {n}<@x(x!>rest\n" if n % 3 else "\n" for n in range(4 + part))
        (tmp_path / f"part-0000{part}.txt").write_text(lines)
        os.utime(tmp_path / f"part-0000{part}.txt", (1_700_000_000 + part, 1_700_000_000 + part))
    for cap in (-1, 0, 6, 11, 1000):
        live = jobs.stream_capped_corpus(spark, str(tmp_path), cap, files)
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, read_corpus(spark, str(tmp_path), cap).collect())), cap


@pytest.mark.parametrize("files", [1, 2, 5])
def test_exact_repeats_whatever_the_cut(spark, tmp_path, files):
    rows = [(n % 7 if n % 5 else None, "text" if n % 2 else None, n) for n in range(100)]
    schema = "idx int, text string, at long"
    for part in range(files):
        spark.createDataFrame(rows[part::files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("at"))
    found = jobs.run_to_table(jobs.stream_distinct(live, ["idx", "text"], "ts", "1 hour"), "append")
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, {r[:2] for r in rows}))


@pytest.mark.parametrize("files", [0, 1, 3])
def test_latest_of_a_table_of_any_layout(spark, tmp_path, files):
    """A table is one file (0) or a folder of files; a neighbour with a longer name is not read."""
    rows = [(c, t, f"{c}.{t}") for c in range(4) for t in range(3)]
    _stored(spark.createDataFrame(rows, "conv_id long, turn long, text string"), tmp_path, "conversations.parquet", files)
    _stored(spark.createDataFrame([(9, 9, "other")], "conv_id long, turn long, text string"), tmp_path, "conversations.parquet2", 1)
    turns = jobs.stream_table(spark, str(tmp_path), "conversations.parquet", 1)
    found = jobs.run_to_table(jobs.stream_latest(turns, "conv_id", "text", "turn"), "update", jobs.newest_per_key("conv_id"))
    assert sorted(tuple(r) for r in found.collect()) == [(c, f"{c}.2", 2) for c in range(4)]


def _stored(df, folder, name, files):
    if files:
        df.repartition(files).write.parquet(str(folder / name))
    else:
        df.toPandas().to_parquet(folder / name)


@pytest.mark.parametrize("files", [0, 2])
def test_corpus_of_a_table_of_any_layout(spark, tmp_path, files):
    _stored(spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, "c")], "doc_id long, text string"), tmp_path, "documents.parquet", files)
    docs = jobs.stream_table(spark, str(tmp_path), "documents.parquet")
    found = jobs.run_to_table(jobs.stream_corpus(docs), "append").collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, "a<@x(x!>b"), (3, "c")]


def test_silence_to_the_millisecond_without_a_row_a_timer(spark, tmp_path):
    # An event exactly the timeout later ends no silence, one a millisecond more does; so does the watermark at that very time.
    rows = [("a", 0), ("a", 1_800_000), ("b", 0), ("b", 1_800_001), ("c", 400_000), ("d", 400_001), (None, 0), ("z", 5_800_000)]
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("ms"))
    spark.createDataFrame(rows, "key string, ms long").select("key", at.alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    silent = jobs.stream_hang(live, "key", "ts", 1800)
    assert "transformwith" not in silent._jdf.queryExecution().logical().toString().lower()
    found = {(r.key, r.last_ms - 1_700_000_000_000) for r in jobs.run_to_table(silent, "append").collect()}
    assert found == {("b", 0), ("c", 400_000), (None, 0)}
