"""Failure classes, noise, proximity, regions, fingerprints and run-state reports."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.runpath import parse_run_path, run_path
from corpusloom.operators import runlogs, runstate

KEYS = ["run_id", "attempt"]
LINES = "run_id string, attempt int, line_no long, byte_offset long, raw string"

# (name, log, class): one per class, rule order, and lines that must not mislead.
CASES = [
    ("oom", "RuntimeError: CUDA out of memory. Tried to allocate", "oom"),
    ("oom near", "torch.cuda: device 0\nerror: out of memory", "oom"),
    ("oom far", "cuda init\n" + "x" * 600 + "\nout of memory", "other"),
    ("kernel", "Out of memory: Killed process 12345 (python)", "oom"),
    ("killed far", "out of memory" + "." * 700 + "process killed", "killed"),
    ("scale", "Current loss scale already at minimum - cannot decrease", "loss_scale"),
    ("scale before oom", "loss scale minimum reached\nCUDA out of memory", "loss_scale"),
    ("nan", "loss is nan at step 3", "nan"),
    ("nan word", "nanometer loss", "other"),
    ("nan before assert", "AssertionError: tensor has nan", "nan"),
    ("disk", "OSError: No space left on device", "disk_full"),
    ("disk writer", "inline_container.cc failed", "disk_full"),
    ("hub", "huggingface.co connection timed out", "hf"),
    ("net", "Connection reset by peer", "net"),
    ("dns", "Temporary failure in name resolution", "net"),
    ("import", "ModuleNotFoundError: No module named x", "import"),
    ("port", "RuntimeError: Address already in use", "port"),
    ("nccl", "NCCL WARN unhandled system error", "nccl"),
    ("path", "FileNotFoundError: x.txt", "path"),
    ("json", "json.decoder.JSONDecodeError", "data"),
    ("key", "KeyError: 'data'", "data"),
    ("key alone", "KeyError: 'x'", "other"),
    ("ckpt", "Missing key(s) in checkpoint", "ckpt"),
    ("ckpt before shape", "checkpoint size mismatch", "ckpt"),
    ("shape", "mat1 and mat2 shapes cannot be multiplied", "shape"),
    ("assert", "AssertionError", "assert"),
    ("assertion", "Assertion `x` failed", "assert"),
    ("term", "Received SIGTERM", "killed"),
    ("interrupt", "KeyboardInterrupt", "killed"),
    ("process", "process killed", "killed"),
    ("other", "everything is fine", "other"),
    ("noise", "WARNING: nccl is slow, unhandled case", "other"),
    ("rank noise", "[rank0] INFO: checkpoint missing", "other"),
    ("kept warning", "WARNING: CUDA out of memory", "oom"),
    ("screen lines", "10%\rWARNING: checkpoint missing\r20%", "other"),
]


def as_lines(spark, logs, sep="\n"):
    rows = []
    for run, text in logs:
        at = 0
        for n, line in enumerate(text.split(sep)):
            rows.append((run, 1, n, at, line))
            at += len(line.encode()) + 1
    return spark.createDataFrame(rows, LINES).repartition(4)


@pytest.mark.parametrize("mode", ["full", "sampled"])
def test_classes(spark, mode):
    lines = as_lines(spark, [(n, t) for n, t, _ in CASES])
    found = {r.run_id: r.reason for r in runlogs.classify_failures(lines, KEYS, mode=mode).collect()}
    assert found == {n: c for n, _, c in CASES}


def filler(size):
    line = "step ok " + "." * 91
    return "\n".join([line] * (size // 100))


@pytest.mark.parametrize("share,sampled", [(0.26, "port"), (0.5, "other"), (0.66, "port"), (0.99, "port"), (0.05, "other")])
def test_large_logs(spark, share, sampled):
    size = 1_500_000
    text = filler(int(size * share)) + "\nRuntimeError: Address already in use\n" + filler(int(size * (1 - share)))
    lines = as_lines(spark, [("big", text)])
    assert runlogs.classify_failures(lines, KEYS, mode="full").first().reason == "port"
    assert runlogs.classify_failures(lines, KEYS, mode="sampled").first().reason == sampled


def test_region_text_is_the_byte_window(spark):
    rng = random.Random(1)
    text = "\n".join("é" * rng.randint(0, 60) + str(i) for i in range(16_000))
    data = text.encode()
    assert len(data) > runlogs.LARGE_BYTES
    lines = as_lines(spark, [("big", text)])
    parts = {}
    for r in runlogs.log_regions(lines, KEYS).orderBy("region", "line_no").collect():
        parts.setdefault(r.region, []).append(r.raw)
    total = len(data) + 1  # every line counts its line end
    for region, start in ((0, total - runlogs.TAIL_BYTES), (1, int(total * 0.65)), (2, int(total * 0.25))):
        want = data[start : start + runlogs.TAIL_BYTES].decode(errors="replace")
        got = "\n".join(parts[region])
        assert got.strip("�\n") == want.strip("�\n")


def test_region_bytes_are_those_of_the_log(spark):
    text = "x" + "\n".join("é" * 50 + str(i) for i in range(8_000))  # an edge inside a character
    data = text.encode()
    total = len(data) + 1
    edges = [(0, total - runlogs.TAIL_BYTES), (1, int(total * 0.65)), (2, int(total * 0.25))]
    assert len(data) > runlogs.LARGE_BYTES and any(data[at] & 0xC0 == 0x80 for _, at in edges)
    found = runlogs.log_regions(as_lines(spark, [("big", text)]), KEYS).groupBy("region").agg(F.sum("bytes"), F.count("*")).collect()
    for region, size, lines in found:
        begin = dict(edges)[region]
        window = data[begin : min(begin + runlogs.TAIL_BYTES, total)] + (b"\n" if begin + runlogs.TAIL_BYTES >= total else b"")
        assert size == len(window) - window.count(b"\n") and lines >= 1


@pytest.mark.parametrize("gap,expected", [(493, True), (494, True), (500, False)])
def test_near_boundary(spark, gap, expected):
    text = "killed" + "." * gap + "out of memory"  # the second phrase starts gap + 6 later
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(runlogs.near(F.col("t"), "killed", "out of memory").alias("x")).first().x is expected


@pytest.mark.parametrize("distance", [5, 40])
def test_near_in_log_against_all_positions(spark, distance):
    rng = random.Random(distance)
    logs = [(f"r{i}", "\n".join("".join(rng.choice(["ab", "cd", "..", "x" * 9]) for _ in range(rng.randint(0, 4))) for _ in range(30))) for i in range(60)]
    lines = as_lines(spark, logs).withColumn("o", F.shiftleft("line_no", runlogs.PIECE_BITS))
    found = {r.run_id: r["near:cd"] for r in runlogs.near_in_log(lines, KEYS, "o", "raw", "ab", ["cd"], distance).collect()}
    for run, text in logs:
        a, b = ([m.start() for m in re.finditer(p, text)] for p in ("ab", "cd"))
        assert found.get(run, False) == any(abs(x - y) <= distance for x in a for y in b)


def test_noise_words_are_whole_and_unicode(spark):
    texts = [("info: x", True), ("information", False), ("éinfo", False), ("WARNING error", False), ("warning nancy", True), ("INFO (oom)", False), ("", False)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r.n for r in df.select(runlogs.is_noise(F.col("t")).alias("n")).collect()] == [e for _, e in texts]


def test_fingerprints(spark):
    logs = [
        ("a", "[rank0]: ValueError: bad\nTraceback (most recent)"), ("b", "[rank3] ValueError: bad\n  Traceback (most recent)"),
        ("c", "ValueError: worse\nTraceback (most recent)"), ("boiler", "error_file: <N/A>\nChildFailedError"), ("clean", "all good"),
        ("long", "\n".join(f"error {i}" for i in range(50))), ("short", "\n".join(f"error {i}" for i in range(30, 50))),
    ]
    found = {r.run_id: r.error_hash for r in runlogs.error_fingerprint(as_lines(spark, logs), KEYS).collect()}
    assert found["a"] == found["b"] != found["c"]
    assert "boiler" not in found and "clean" not in found
    assert found["long"] == found["short"]


def test_outcomes(spark):
    df = spark.createDataFrame([(c,) for c in (0, 130, 124, -9, 1)], "c int")
    assert [r.x for r in df.select(runlogs.outcome_reason(F.col("c"), F.lit("nan")).alias("x")).collect()] == ["success", "interrupted", "timeout", "killed", "nan"]


def test_log_formats(spark):
    rows = [
        "train | epoch   3 | Iter:     12/   400 | global iter:      6/   200 | loss: 1.2500 | ds_loss: 0.5000 | lr: 5.0000e-05 | scale:  1024.0000 | micro time: 0.250 | step time: 0.500",
        "dev | avg_loss: 2.5 | {'exact_match': 1.25, 'rougeL': 26.67} | threshold: 0.3",
        "test | name: dolly | {'exact_match': 1.0, 'rougeL': 13.51} | lm_loss 3.25 | avg. gen lenth: 88.5",
        "eval | rougeL: 1.500 | exact_match: 0.250 | rev_kl: 2.000 | lens: 9.000 | pt_loss: 1.000 | lm_loss: 3.000 | kd_loss: 0.500 ",
        "gen | avg. lens: 77.5", "hello | world",
    ]
    found = runlogs.parse_train_log(spark.createDataFrame([(r,) for r in rows], "raw string")).collect()
    train, dev, bench, final, gen = found
    assert (train.epoch, train.iter, train.global_step, train.total_steps, train.loss, train.lr) == (3, 12, 6, 200, 1.25, 5e-05)
    assert (dev.split, dev.avg_loss, dev.rougeL, dev.threshold) == ("dev", 2.5, 26.67, 0.3)
    assert (bench.name, bench.rougeL, bench.lm_loss, bench.mean_length) == ("dolly", 13.51, 3.25, 88.5)
    assert (final.rougeL, final.exact_match, final.lm_loss) == (1.5, 0.25, 3.0)
    assert (gen.kind, gen.mean_length) == ("generation", 77.5)


VIEW = "exp_id string, status string, status_status string, lock_present boolean, pid_alive boolean, artifact_age_s double, consecutive_failures int"


@pytest.mark.parametrize("st,lock,alive,age,case", [
    ("success", True, True, 1.0, "terminal_status"), ("failed", False, None, None, "terminal_status"),
    ("running", False, None, 5.0, "running_without_lock"), ("running", True, False, 5.0, "running_without_lock"),
    ("running", True, True, 9999.0, "healthy"), (None, False, None, 301.0, "no_status_after_grace"), (None, False, None, 299.0, "healthy"),
    (None, True, False, 600.0, "no_status_after_grace"), (None, True, None, 600.0, "healthy"), ("pending", False, None, 400.0, "no_status_after_grace"),
    (None, False, None, None, "healthy"),
])
def test_stale_cases(spark, st, lock, alive, age, case):
    df = spark.createDataFrame([("e", "running", st, lock, alive, age, 2)], VIEW)
    row = runstate.stale_report(df).first()
    assert row.stale_case == case
    assert row.new_streak == {"running_without_lock": 3, "no_status_after_grace": 3}.get(case, 0 if st == "success" else 2)


def test_retry_report(spark):
    df = spark.createDataFrame([("a", 1, 60, 1, "1000", 2), ("b", 3, 60, 9, "0", 2), ("c", 1, 60, 40, "500", 2), ("d", 0, None, None, "", None)],
                               "e string, attempt int, retry_sleep int, consecutive_failures int, last_failed_at string, max_retries int")
    found = {r.e: (r.wait_seconds, r.retry_state) for r in runstate.retry_report(df, F.lit(1100.0)).collect()}
    assert found == {"a": (120.0, "cooling_down"), "b": (900.0, "exhausted"), "c": (900.0, "cooling_down"), "d": (60.0, "ready")}


def test_hang_clock(spark):
    sizes = [(0, 5), (100, 5), (200, 6), (250, None), (300, 6), (420, 6), (500, 6)]
    df = spark.createDataFrame([("r", t, s) for t, s in sizes], "run string, ts long, size long")
    found = {r.ts: r.silent_seconds for r in runstate.hang_report(df, "run", "ts", "size", 99).collect()}
    assert found == {100: 100, 420: 170, 500: 250}


def test_repeats_and_hard_failures(spark):
    hashes = ["a", "a", "b", "a", "a", None, "a", "a"]
    ok = [False, False, False, False, False, True, False, False]
    df = spark.createDataFrame([("r", i, h, o) for i, (h, o) in enumerate(zip(hashes, ok))], "run string, n long, h string, ok boolean")
    found = {r.n: (r.repeats, r.hard_failure) for r in runstate.repeat_failures(df, "run", "n", "h", 3, success="ok").collect()}
    assert [found[i] for i in (0, 1, 2, 3, 4, 6, 7)] == [(1, False), (2, False), (1, False), (3, False), (4, True), (5, False), (6, True)]


def test_failure_streak_of_one_hot_run(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.9 else "cold", i, rng.random() < 0.7) for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, n long, failed boolean")
    found = {r.n: r.streak for r in runstate.failure_streak(df, "run", "n", F.col("failed")).collect()}
    streak = {}
    for run, n, failed in rows:
        streak[run] = streak.get(run, 0) + 1 if failed else 0
        assert found[n] == streak[run]


def test_run_paths(spark):
    lit = {k: F.lit(v) for k, v in dict(save="s", ckpt_name="a/b/12", peft_name="p", batch_size=8, lr="5e-05", accumulation=1, gpus=4, nodes=1,
                                        epochs=3, seed=10, data_names="dolly", max_length=512, temperature="1.0", ppo_epochs=4, reward_scaling="0.5",
                                        num_rollouts=256, lm_coef="1", teacher_mix="0.2", kd_ratio="0.5").items()}
    bare = {k: v for k, v in lit.items() if k != "peft_name"}
    policy = {**bare, "length_norm": F.lit(True), "teacher_ckpt_name": F.lit("t"), "teacher_peft_name": F.lit("tp")}
    row = spark.range(1).select(
        run_path("lm", lit).alias("lm"), run_path("lm", bare).alias("bare"), run_path("kd", bare).alias("kd"), run_path("gen", bare).alias("gen"),
        run_path("eval", bare).alias("ev"), run_path("policy", policy).alias("po")).first()
    assert row.lm == "s/a/b/12-p/e3-bs8-lr5e-05-G1-N4-NN1"
    assert row.bare == "s/e3-bs8-lr5e-05-G1-N4-NN1" and row.kd.endswith("-NN1-kd0.5")
    assert row.gen == "s/a/b/12/t1.0-l512" and row.ev == "s/dolly-512/a_b/12/10"
    assert row.po == "s/-t-tp/bs8-lr5e-05-G1-N4-NN1-lm1-len512/pe4_rs0.5_nr256_ln_tm0.2"
    parsed = spark.createDataFrame([(row.lm,), (row.po,), (row.ev,), (row.gen,)], "p string").select(parse_run_path(F.col("p")).alias("x")).collect()
    lm, po, ev, gen = (r.x for r in parsed)
    assert (lm.epochs, lm.batch_size, lm.lr, lm.gpus, lm.nodes) == (3, 8, 5e-05, 4, 1)
    assert (po.ppo_epochs, po.num_rollouts, po.teacher_mix, po.length_norm, po.single_step_reg, po.max_length) == (4, 256, 0.2, True, False, 512)
    assert (ev.data_names, ev.eval_max_length, ev.checkpoint, ev.seed) == ("dolly", 512, "a_b/12", 10)
    assert (gen.temperature, gen.gen_max_length) == (1.0, 512)
