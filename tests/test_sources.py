import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.session import spread
from corpusloom.sources import readers, token_files, writers


def shard_file(folder, name, dtype, code, rows):
    """The on-disk layout, written byte by byte."""
    itemsize = np.dtype(dtype).itemsize
    sizes = [len(r) for r in rows]
    pointers = [sum(sizes[:i]) * itemsize for i in range(len(rows))]
    with open(os.path.join(folder, name + ".bin"), "wb") as f:
        f.write(b"".join(np.array(r, dtype="int64").astype(dtype).tobytes() for r in rows))
    with open(os.path.join(folder, name + ".idx"), "wb") as f:
        f.write(b"MMIDIDX\x00\x00" + struct.pack("<Q", 1) + struct.pack("<B", code) + struct.pack("<Q", len(rows)) + struct.pack("<Q", 1))
        f.write(np.array(sizes, "<i4").tobytes() + np.array(pointers, "<i8").tobytes() + np.zeros(1, "<i8").tobytes())


@pytest.mark.parametrize("dtype,code,stored", [("<u2", 8, 65535), ("<u4", 9, 4294967295)])
def test_import_shards(spark, tmp_path, monkeypatch, dtype, code, stored):
    monkeypatch.setattr(token_files, "RANGE_SEQUENCES", 3)
    first = [[1, 2, -1, 3], [], [7] * 5, [9], [4, 5], [6], []]
    second = [[11], [12, -1]]
    shard_file(tmp_path, "train_0", dtype, code, first)
    shard_file(tmp_path, "train_1", dtype, code, second)
    shard_file(tmp_path, "train_3", dtype, code, [[99]])  # probing stops at the gap
    found = {r.seq_id: (r.shard, r.ids) for r in token_files.read_token_dataset(spark, str(tmp_path), "train", sentinel=stored).collect()}
    assert found == {i: (0 if i < 7 else 1, ids) for i, ids in enumerate(first + second)}
    with pytest.raises(FileNotFoundError):
        token_files.read_token_dataset(spark, str(tmp_path), "valid")


def test_shard_round_trip_keeps_order(spark, tmp_path):
    df = spark.createDataFrame([(i, list(range(i % 6))) for i in range(200)], "seq_id long, ids array<int>").repartition(5)
    assert writers.write_token_shards(df, str(tmp_path / "d"), "train", dtype_code=8, shards=4) == 4
    found = {r.seq_id: r.ids for r in token_files.read_token_dataset(spark, str(tmp_path / "d"), "train").collect()}
    assert found == {i: list(range(i % 6)) for i in range(200)}


def test_line_numbers_over_blocks_and_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    texts = {}
    for name in ("a.log", "b.log"):
        texts[name] = [f"{name} ligne é {'x' * (i % 50)} {i}" for i in range(6000)]
        (folder / name).write_text("\n".join(texts[name]) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 * 1024))
    try:
        rows = readers.read_run_logs(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 12000
    for r in rows:
        lines = texts[os.path.basename(r.run_id)]
        assert lines[r.line_no] == r.raw
        assert (folder / os.path.basename(r.run_id)).read_bytes()[r.byte_offset :].startswith(r.raw.encode())


def test_instructions_keep_corrupt_rows_apart(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    path.write_text('{"instruction": "a", "output": "x"}\n{broken\n{"instruction": "b", "input": "", "output": null}\n')
    rows = readers.read_instructions(spark, str(path)).orderBy("row_id").collect()
    assert [(r.row_id, r.instruction, r.output) for r in rows] == [(0, "a", "x"), (1, None, None), (2, "b", None)]
    assert rows[1]._corrupt == "{broken"
    assert readers.read_instructions(spark, str(path), limit=2).count() == 2


def test_eval_answers(spark, tmp_path):
    lines = [{"prompt": "p<n>q", "output": "one"}, {"prompt": "p", "output": ["a", "b"]}, {"prompt": 'say "output": [', "output": "[not a list]"}, {"prompt": "none"}]
    (tmp_path / "valid.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    rows = readers.read_eval(spark, str(tmp_path), "valid", family="absent").orderBy("idx").collect()
    assert [r.references for r in rows] == [["one"], ["a", "b"], ["[not a list]"], None]
    assert rows[0].prompt == "p\nq"


def test_run_states(spark, tmp_path):
    queue, runs = tmp_path / "queue", tmp_path / "runs"
    (runs / "e1").mkdir(parents=True)
    (runs / "e2").mkdir()
    queue.mkdir()
    (queue / "e1.json").write_text(json.dumps({"exp_id": "e1", "max_retries": 2}, indent=2))
    (queue / "e2.json").write_text('{"exp_id": "e2", "status": "failed"')
    (queue / "e3.json").write_text('{"key": "no id"}')
    (runs / "e1" / "exp.json").write_text('{"exp_id": "e1", "status": "running", "attempt": 2, "train_opts": {"lr": 0.1}}')
    (runs / "e1" / "status.json").write_text('{"status": "success", "exit_code": 0}')
    found = readers.read_run_states(spark, str(queue), str(runs))
    assert [(r.exp_id, r.status, r.attempt) for r in found["queue"].collect()] == [("e1", "pending", 0)]
    run = found["runs"].first()
    assert (run.run_dir, run.status, run.train_opts) == ("e1", "running", {"lr": "0.1"})
    assert [os.path.basename(r.path) for r in found["failures"].collect()] == ["e2.json"]


def test_events_keep_other_keys(spark):
    df = spark.createDataFrame([('{"ts": "2024-01-02 03:04:05", "event": "x", "source": "s", "n": 3}',), ("oops",)], "raw string")
    rows = [r for r in readers.parse_events(df, "raw").collect() if r.event]
    assert len(rows) == 1 and rows[0].fields == {"n": "3"} and rows[0].ts.second == 5


def test_corpus_round_trip(spark, tmp_path):
    texts = ["one\n\n\ntwo", "", None, "three\n", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    writers.write_corpus(df, str(tmp_path / "c"), order="doc_id")
    rows = readers.read_corpus(spark, str(tmp_path / "c")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(0, "one\ntwo"), (1, "three\n"), (2, "x")]
    assert spark.read.text(str(tmp_path / "c")).where(F.col("value").contains("<@x(x!>")).count() == 2


def test_part_files_beyond_five_digits_keep_their_order(spark, tmp_path):
    for name, text in (("part-99999-x.txt", "a\nb\n"), ("part-100000-x.txt", "c\n"), ("part-100001-x.txt", "d\n")):
        (tmp_path / name).write_text(text)
    rows = readers.number_lines(readers.read_lines(spark, str(tmp_path))).orderBy("row_id").collect()
    assert [(r.row_id, r.value) for r in rows] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_nested_key_called_output(spark, tmp_path):
    (tmp_path / "valid.jsonl").write_text('{"prompt":"p","output":"ans","meta":{"output":["x"]}}\n{"prompt":"p","output":["a","b"]}\n{"prompt":"p","output":[]}\n{"prompt":"p"}\n')
    rows = readers.read_eval(spark, str(tmp_path), "valid", family="none").orderBy("idx").collect()
    assert [r.references for r in rows] == [["ans"], ["a", "b"], [], None]


def test_queue_without_any_run(spark, tmp_path):
    (tmp_path / "queue").mkdir()
    (tmp_path / "queue" / "a.json").write_text('{"exp_id": "a"}')
    found = readers.read_run_states(spark, str(tmp_path / "queue"), str(tmp_path / "runs"))
    assert [r.exp_id for r in found["queue"].collect()] == ["a"]
    assert found["runs"].collect() == found["status"].collect() == found["failures"].collect() == []


def test_state_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "FILES_A_TASK", 5)
    (tmp_path / "queue").mkdir()
    for i in range(300):
        (tmp_path / "queue" / f"e{i}.json").write_text(json.dumps({"exp_id": f"e{i}"}))
        (tmp_path / "runs" / f"e{i}").mkdir(parents=True)
        (tmp_path / "runs" / f"e{i}" / "exp.json").write_text(json.dumps({"exp_id": f"e{i}", "attempt": i})[: -1 if i % 13 == 0 else None])
        if i % 2:
            (tmp_path / "runs" / f"e{i}" / "status.json").write_text('{"status": "failed"}')
    found = readers.read_run_states(spark, str(tmp_path / "queue"), str(tmp_path / "runs"))
    # The driver holds no file, tasks grow in number with the files, and no size is made up that would send a table to all tasks.
    assert [found[k].inputFiles() for k in found] == [[]] * 4
    assert [found[k].rdd.getNumPartitions() for k in ("queue", "runs", "status")] == [60] * 3
    assert "BroadcastHashJoin" not in found["queue"].join(found["status"], F.col("exp_id") == found["status"]["run_dir"])._jdf.queryExecution().sparkPlan().toString()
    assert {r.exp_id for r in found["queue"].collect()} == {f"e{i}" for i in range(300)}
    assert {(r.run_dir, r.exp_id, r.attempt) for r in found["runs"].collect()} == {(f"e{i}", f"e{i}", i) for i in range(300) if i % 13}
    assert {(r.run_dir, r.status) for r in found["status"].collect()} == {(f"e{i}", "failed") for i in range(1, 300, 2)}
    assert sorted(r.path for r in found["failures"].collect()) == sorted(f"file:{tmp_path}/runs/e{i}/exp.json" for i in range(0, 300, 13))


def test_long_state_files_are_not_broadcast_for_their_short_names(spark, tmp_path):
    (tmp_path / "queue").mkdir()
    for i in range(40):
        (tmp_path / "queue" / f"e{i}.json").write_text(json.dumps({"exp_id": f"e{i}", "cmd": "x" * 50000}))
        (tmp_path / "runs" / f"e{i}").mkdir(parents=True)
        (tmp_path / "runs" / f"e{i}" / "status.json").write_text('{"status": "failed"}')
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        found = readers.read_run_states(spark, str(tmp_path / "queue"), str(tmp_path / "runs"))
        queue = found["queue"].select("exp_id", "cmd")
        both = found["status"].select("run_dir").join(queue, F.col("run_dir") == F.col("exp_id"), "left")
        assert sum(len(r.cmd) for r in both.collect()) == 2000000
        assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_state_files_are_those_of_sparks_own_listing(spark, tmp_path, monkeypatch):
    queue, runs = tmp_path / "queue", tmp_path / "runs"
    queue.mkdir()
    odd = ["a b", "x%20y", "\u00e9", "a+b&c=d", "q#1", "h?x", "[z]", "{k}", "t~!'()*", 'qu"ote', "nb\u00a0sp", "c\x01", "_hid", "_h=1", ".dot", "a|^`<>", "at@;,$", "nel\x85", "\u200b", "\U0001f600"]
    for n, name in enumerate(odd):
        (queue / f"{name}.json").write_text('{"exp_id": "e%d"}' % n)
        (runs / name).mkdir(parents=True)
        (runs / name / "exp.json").write_text('{"exp_id": "e%d"' % n)
        (runs / name / "status.json").write_text('{"attempt":\r\n %d}' % n)
    for name, data in {"empty.json": b"", "bad.json": b'{"exp_id": "\xff"}', "bom.json": b"\xef\xbb\xbf{}", "list.json": b"[{}]", "blank.json": b" \n", "other.txt": b"x", "up.JSON": b"{}"}.items():
        (queue / name).write_bytes(data)
    with open(os.fsencode(queue) + b"/\xff.json", "w") as f:
        f.write("{}")
    (queue / "link.json").symlink_to("a b.json")
    (queue / "lost.json").symlink_to("nowhere")
    (queue / "folder.json" / "deeper").mkdir(parents=True)
    for name in ("in", "_SUCCESS", "deeper/x"):
        (queue / "folder.json" / name).write_text('{"exp_id": "in"}')
    (runs / "file").write_text("x")
    (runs / "none").mkdir()
    (runs / "linked").symlink_to(runs / "a b")
    places = [(str(queue), str(runs)), (f"{tmp_path}/que*/", f"file:{tmp_path}/{{runs,absent}}"), (str(runs / "file"), str(queue / "empty.json"))]
    read = lambda: [{k: sorted(map(ascii, df.collect())) for k, df in readers.read_run_states(spark, *p).items()} for p in places]
    found = read()
    monkeypatch.setattr(readers, "_in_tasks", lambda folders: False)
    assert found == read()
    assert len(found[0]["failures"]) > len(odd) and found[0]["queue"] and found[0]["status"] and not found[2]["queue"]


def test_state_files_that_only_sparks_readers_can_open(spark, tmp_path):
    (tmp_path / "queue").mkdir()
    (tmp_path / "queue" / "a.json").write_text('{"exp_id": "a"}')
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.states.link./in", f"file://{tmp_path}")
    found = readers.read_run_states(spark, "viewfs://states/in/queue", "viewfs://states/in/runs")
    assert [r.exp_id for r in found["queue"].collect()] == ["a"]
    assert found["runs"].collect() == found["failures"].collect() == []


def test_logits_in_equal_buckets_join_without_a_shuffle(spark, tmp_path):
    from corpusloom.operators.distance import pair_logits

    # One long example beside short ones; pairs that only one side has.
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("example_id"), F.col("id").cast("int").alias("pos"),
                                    F.array(F.col("id") * 0.5).alias("logits"))
    names = [f"logits_{side}_{os.getpid()}" for side in "st"]
    student = writers.write_logits(rows.where("pos % 5 > 0"), names[0], str(tmp_path / "s"), 4)
    teacher = writers.write_logits(rows.where("pos % 7 > 0"), names[1], str(tmp_path / "t"), 4)
    both = pair_logits(student.hint("merge"), teacher)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {r.pos for r in both.collect()} == {n for n in range(3000) if n % 5 and n % 7}
    assert len([f for f in os.listdir(tmp_path / "s") if f.endswith(".parquet")]) == 4
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_shards_grow_in_number_not_in_size(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("seq_id"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda x: x + F.col("id")).cast("array<int>").alias("ids"))
    made = writers.write_token_shards(rows, str(tmp_path / "d"), "train", dtype_code=4, shards=3, shard_bytes=1000)
    assert made == 12
    found = token_files.read_token_dataset(spark, str(tmp_path / "d"), "train").collect()
    assert {r.seq_id: list(r.ids) for r in found} == {i: [i + x for x in range(1, 11)] for i in range(300)}
    assert max(f.stat().st_size for f in (tmp_path / "d").glob("*.bin")) < 3000


@pytest.mark.parametrize("found", [1, 3])
def test_each_partition_of_a_short_scan_is_dealt_to_all_cores(spark, found):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, found)).rdd.getNumPartitions() == cores * found
    assert spread(spark.range(0, 100, 1, cores)).rdd.getNumPartitions() == cores
