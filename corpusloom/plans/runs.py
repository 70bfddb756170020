"""Run-log and run-state queries over event streams read as runs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.runpath import parse_run_path, run_path
from corpusloom.operators import ordered, runlogs, runstate
from corpusloom.plans.binding import (
    ATTEMPTS_SQL,
    DOCUMENT_LINES,
    LOG_SQL,
    attempts,
    document_lines,
    event_seconds,
    log_lines,
    rounded,
    scratch,
    table,
)
from corpusloom.sources import readers
from corpusloom.sources.token_files import _locate

KEYS = ["run_id", "attempt"]
NOW = 1706745600  # end of the stored month, epoch seconds
HANG_SECONDS = 6 * 3600


# --- logs -----------------------------------------------------------------------------


def _read_logs(spark, folder):
    path = scratch(spark, "logs")
    lines = document_lines(spark, folder).withColumn("run", ordered.int_div(F.col("doc_id"), 20))
    rows = lines.repartition("run").sortWithinPartitions("run", "line_no")
    # Files are put in place by the tasks that wrote them, not one by one at the end.
    rows.select("run", F.col("raw").alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("run").text(path)
    found = readers.read_run_logs(spark, path)  # the folders are listed in parallel, those of a pattern one by one
    run = F.regexp_extract("run_id", r"run=(\d+)", 1).cast("long")
    return found.select(run.alias("run"), "line_no", "byte_offset", F.md5("raw").alias("raw_md5"))


def event_lines(spark, folder) -> DataFrame:
    """Events as JSON lines with a time stamp, a source and further keys."""
    stamped = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit("scheduler").alias("source"),
                                 F.col("event_type").alias("event"), F.get_json_object("props", "$.k").alias("k")))
    whole = table(spark, folder, "events").select("event_id", stamped.alias("raw"))
    # A line cut short is added behind each.
    return whole.unionByName(whole.select("event_id", F.expr("left(raw, length(raw) - 7)").alias("raw")))


def _events(spark, folder):
    found = readers.parse_events(event_lines(spark, folder), "raw", ["event_id"])
    second = F.unix_timestamp("ts")
    return found.where("event IS NOT NULL").select("event_id", second.alias("second"), "source", "event", F.col("fields")["k"].alias("k"))


def _noise(spark, folder):
    lines = log_lines(spark, folder).select("run_id", "raw")
    extra = document_lines(spark, folder).select(F.pmod("doc_id", F.lit(7)).alias("run_id"), "raw")
    return runlogs.noise_report(lines.unionByName(extra), by=("run_id",))


def _noise_kept(spark, folder):
    return runlogs.filter_noise(log_lines(spark, folder)).select("line_no", "raw")


def _near(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", runlogs.near(F.col("text"), "tion", "the ", 60).alias("close"),
                       runlogs.near(F.col("text"), "ment", "que", 500).alias("far"))


def _near_log(spark, folder):
    lines = log_lines(spark, folder).withColumn("raw", F.lower("raw"))
    order = F.shiftleft("line_no", runlogs.PIECE_BITS)
    found = runlogs.near_in_log(lines.withColumn("o", order), KEYS, "o", "raw", "memory", ["loss", "nan"])
    return found.select("run_id", F.col("attempt").cast("long").alias("attempt"), F.col("`near:loss`").alias("near_loss"), F.col("`near:nan`").alias("near_nan"))


def region_lines(spark, folder) -> DataFrame:
    lines = document_lines(spark, folder).withColumn("run_id", F.pmod("doc_id", F.lit(2)))
    size = F.octet_length("raw").cast("long") + 1
    return ordered.prefix_sum(lines, "line_no", size, "byte_offset", by="run_id", bucket=ordered.span_bucket("line_no", 28), levels=2)


def _regions(spark, folder):
    found = runlogs.log_regions(region_lines(spark, folder), ["run_id"])
    return found.groupBy("run_id", "region").agg(
        F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first"), F.max("line_no").alias("last"),
        F.sum("bytes").alias("bytes"))


def _classify(spark, folder):
    found = runlogs.classify_failures(log_lines(spark, folder), KEYS)
    return found.select("run_id", F.col("attempt").cast("long").alias("attempt"), "reason")


def _classify_sampled(spark, folder):
    lines = log_lines(spark, folder)
    placed = ordered.prefix_sum(lines, "line_no", F.octet_length("raw").cast("long") + 1, "byte_offset", by=KEYS)
    found = runlogs.classify_failures(placed, KEYS, mode="sampled")
    return found.select("run_id", F.col("attempt").cast("long").alias("attempt"), "reason")


def _outcome(spark, folder):
    found = runlogs.classify_failures(log_lines(spark, folder), KEYS)
    codes = F.element_at(F.array(*[F.lit(c) for c in (0, 130, 124, -9, 1, 2)]), (F.pmod(F.col("run_id") + F.col("attempt"), F.lit(6)) + 1).cast("int"))
    return found.select("run_id", F.col("attempt").cast("long").alias("attempt"), runlogs.outcome_reason(codes, F.col("reason")).alias("reason"))


def _fingerprint(spark, folder):
    found = runlogs.error_fingerprint(log_lines(spark, folder), KEYS)
    return found.select("run_id", F.col("attempt").cast("long").alias("attempt"), "error_hash", "error_lines")


def _extract(spark, folder):
    value = F.col("value").cast("string")
    raw = F.concat(F.lit("test | name: a | {'exact_match': 1.5, 'rougeL': "), value, F.lit("} | lm_loss 1"))
    return table(spark, folder, "events").select("event_id", runlogs.extract_metric(raw, "rougeL").alias("rougeL"))


def training_log(spark, folder) -> DataFrame:
    """Log lines in the five published layouts, filled from events."""
    n, v = F.col("event_id"), F.col("value")
    train = F.format_string(
        "train | epoch %3d | Iter: %6d/%6d | global iter: %6d/%6d | loss: %.4f | ds_loss: %.4f | lr: %.4e | scale: %10.4f | micro time: %.3f | step time: %.3f",
        F.pmod(n, F.lit(20)), n, n + 100, ordered.int_div(n, 4), n + 25, v, v / 2, F.lit(5e-5), F.lit(1024.0), F.lit(0.25), v / 10)
    dev = F.format_string("dev | avg_loss: %.6f | {'exact_match': 2.5, 'rougeL': %.4f} | threshold: 0.3", v, v / 10)
    bench = F.format_string("test | name: dolly | {'exact_match': 1.0, 'rougeL': %.4f} | lm_loss %.4f | avg. gen lenth: %.2f", v / 10, v / 7, v)
    policy = F.format_string(
        "train | data_epochs %2d/%2d | inner iter: %3d/%3d | ppo epoch: %2d/%2d | global iter: %6d/%6d| tot_loss: %.4f | reward: %.4f | rev_kl: %.4f | lr: 5.0000e-06 | scale: %6.2f | time: 1.000 | step time: %.3f",
        F.lit(1), F.lit(10), F.pmod(n, F.lit(50)), F.lit(50), F.lit(0), F.lit(4), n, n + 7, v, -v, v / 3, F.lit(64.0), v / 10)
    final = F.format_string("eval | rougeL: %.3f | exact_match: %.3f | rev_kl: %.3f | lens: 12.000 | pt_loss: 1.000 | lm_loss: %.3f | kd_loss: 0.500 ", v, v / 2, v / 3, v / 7)
    other = F.lit("loading | something: else")
    kind = F.pmod(n, F.lit(6))
    raw = F.when(kind == 0, train).when(kind == 1, dev).when(kind == 2, bench).when(kind == 3, policy).when(kind == 4, final).otherwise(other)
    return table(spark, folder, "events").select("event_id", raw.alias("raw"))


def _parse(spark, folder):
    found = runlogs.parse_train_log(training_log(spark, folder))
    shown = ("loss", "ds_loss", "avg_loss", "lr", "scale", "step_time", "threshold", "reward", "rev_kl", "lm_loss", "rougeL", "exact_match", "mean_length")
    return found.select("event_id", "kind", "split", "epoch", "global_step", "total_steps", "iter", "name", *[rounded(F.col(c), 3).alias(c) for c in shown])


MARKS = [
    "user_id AS run_id",
    "event_id AS line_no",
    "CASE event_id % 5 WHEN 0 THEN concat('==== ', {stamp}, ' COMMAND: python train.py') WHEN 3 THEN concat('==== ', {stamp}, ' TIMEOUT after 60s') ELSE 'step' END AS raw",
    "ts",
]


def _timeline(spark, folder):
    stamp = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
    lines = table(spark, folder, "events").selectExpr(*[m.format(stamp=stamp) for m in MARKS]).drop("ts")
    found = runstate.attempt_timeline(lines)
    second = lambda c: F.unix_timestamp(c)
    return found.select("run_id", "line_no", second("started_at").alias("started"), second("next_start").alias("next"),
                        "ended_by", second("ended_at").alias("ended"))


# --- run states -----------------------------------------------------------------------


def run_states(spark, folder) -> DataFrame:
    """One row per user as a run: counters, last failure, and a stored status."""
    e = event_seconds(spark, folder)
    failed = F.col("event_type") == "error"
    return e.groupBy("user_id").agg(
        F.count_if(failed).alias("errors"), F.count(F.lit(1)).alias("events"),
        F.max(F.when(failed, F.col("second"))).alias("last_failed"), F.max("second").alias("last_seen"),
    ).select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("exp_id"), "user_id",
        F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.pmod("user_id", F.lit(7)) + 1).cast("int")).alias("status"),
        F.pmod("errors", F.lit(5)).cast("int").alias("attempt"), F.pmod("events", F.lit(6)).cast("int").alias("consecutive_failures"),
        F.col("last_failed").alias("last_failed_at"), "last_seen",
    )


STATES = ("pending", "running", "failed", "success", "hard_failure", "aborted", "running")
RUNS_SQL = """states AS (SELECT concat('run', user_id) AS exp_id, user_id, ['pending', 'running', 'failed', 'success', 'hard_failure', 'aborted', 'running'][user_id % 7 + 1] AS status,
    CAST(count_if(event_type = 'error') % 5 AS INTEGER) AS attempt, CAST(count(*) % 6 AS INTEGER) AS consecutive_failures,
    max(CAST(floor(epoch(ts)) AS BIGINT)) FILTER (WHERE event_type = 'error') AS last_failed_at, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_seen
    FROM events GROUP BY user_id)"""


def state_tables(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queue definitions, run copies (some with a wrong id) and statuses. ``new`` ids have no status, ``idle`` ones no run either."""
    rows = run_states(spark, folder)
    named = lambda prefix: rows.withColumn("exp_id", F.concat(F.lit(prefix), "exp_id"))
    started = rows.unionByName(named("new"))
    queue = started.unionByName(named("idle")).select("exp_id", F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(3).alias("max_retries"))
    own = F.when(F.pmod("user_id", F.lit(11)) == 0, F.lit("other")).otherwise(F.col("exp_id"))
    runs = started.select(F.col("exp_id").alias("run_dir"), own.alias("exp_id"), "status", "attempt", "consecutive_failures")
    status = rows.select(F.col("exp_id").alias("run_dir"), "status", "attempt")
    return queue, runs, status


def _view(spark, folder):
    found = runstate.run_view(*state_tables(spark, folder))
    return found.select("exp_id", "status", "attempt", "max_retries", "consecutive_failures", "has_run", "status_status", "status_attempt")


def _summary(spark, folder):
    rows = run_states(spark, folder).withColumn("grp", F.pmod("user_id", F.lit(4)))
    return runstate.status_summary(rows, by=("grp",))


def _streak(spark, folder):
    return runstate.failure_streak(attempts(spark, folder).select("run_id", "attempt_no", "failed"), "run_id", "attempt_no", F.col("failed"))


def _repeats(spark, folder):
    rows = attempts(spark, folder).withColumn("ok", ~F.col("failed"))
    found = runstate.repeat_failures(rows, "run_id", "attempt_no", "error_hash", threshold=2, success="ok")
    return found.where("failed").select("run_id", "attempt_no", "error_hash", "repeats", "hard_failure")


def _retry(spark, folder):
    rows = run_states(spark, folder).withColumn("retry_sleep", F.lit(200)).withColumn("max_retries", F.lit(2))
    found = runstate.retry_report(rows, F.col("last_seen") + 700)
    return found.select("exp_id", F.col("wait_seconds"), "retry_state")


def _stale(spark, folder):
    queue, runs, status = state_tables(spark, folder)
    # The status files lag behind: a third of the running runs still show their last outcome.
    lagging = status.withColumn("status", F.when(F.length("run_dir") % 3 == 0, F.lit("success")).otherwise(F.col("status")))
    view = runstate.run_view(queue, runs, lagging)
    n = F.regexp_extract("exp_id", r"\d+", 0).cast("int")
    live = view.withColumn("lock_present", F.pmod(n, F.lit(2)) == 0).withColumn(
        "pid_alive", F.when(F.pmod(n, F.lit(4)) == 0, F.pmod(n, F.lit(8)) == 0)
    ).withColumn("artifact_age_s", F.when(F.pmod(n, F.lit(3)) != 1, (F.pmod(n, F.lit(5)) * 100 + 1).cast("double")))
    found = runstate.stale_report(live)
    return found.select("exp_id", "stale_case", "orphan_lock", "new_status", F.col("new_streak").cast("int").alias("new_streak"))


def _hang(spark, folder):
    size = F.when(F.col("event_type") != "view", F.floor(F.col("value") / 15)).cast("long")
    samples = event_seconds(spark, folder).select("user_id", "event_id", "second", size.alias("size"))
    found = runstate.hang_report(samples, "user_id", "second", "size", HANG_SECONDS, order="event_id")
    return found.select("user_id", "event_id", "silent_seconds")


def write_state_files(rows: DataFrame, path: str) -> None:
    """Queue, run copy and status files of each run; every thirteenth run copy is cut short."""

    def export(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                definition = {"exp_id": r.exp_id, "max_retries": 3, "train_opts": {"lr": "1e-4"}, "oom_batch_candidates": [8, 4]}
                copy = json.dumps({**definition, "status": r.status, "attempt": int(r.attempt)})
                _put(f"{path}/queue/{r.exp_id}.json", json.dumps(definition, indent=2))
                _put(f"{path}/runs/{r.exp_id}/exp.json", copy[:-9] if r.user_id % 13 == 0 else copy)
                _put(f"{path}/runs/{r.exp_id}/status.json", json.dumps({"status": r.status, "attempt": int(r.attempt)}))
            yield pd.DataFrame({"n": [len(pdf)]})

    # Three files a row: the rows are few bytes, which would otherwise all lie in one task.
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    rows.select("exp_id", "user_id", "status", "attempt").repartition(tasks, "exp_id").mapInPandas(export, "n long").agg(F.sum("n")).collect()


def _put(uri: str, text: str) -> None:
    system, path = _locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(text.encode())


def _read_states(spark, folder):
    path = scratch(spark, "states")
    write_state_files(run_states(spark, folder), path)
    found = readers.read_run_states(spark, f"{path}/queue", f"{path}/runs")
    view = runstate.run_view(found["queue"].drop("file_time", "run_dir"), found["runs"].drop("file_time"), found["status"].drop("file_time"))
    return view.select("exp_id", "status", "attempt", F.col("train_opts")["lr"].alias("lr"), F.size("oom_batch_candidates").alias("batches"), "has_run", "status_status")


def _read_failures(spark, folder):
    path = scratch(spark, "states")
    write_state_files(run_states(spark, folder), path)
    found = readers.read_run_states(spark, f"{path}/queue", f"{path}/runs")["failures"]
    return found.select("event", F.element_at(F.split("path", "/"), -2).alias("exp_id"))


# --- run paths ------------------------------------------------------------------------


def path_parameters(spark, folder) -> DataFrame:
    n = F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id", (F.pmod(n, F.lit(20)) + 1).alias("epochs"), F.pow(F.lit(2), F.pmod(n, F.lit(5))).cast("int").alias("batch_size"),
        F.element_at(F.array(F.lit("5e-05"), F.lit("0.0005"), F.lit("1e-5")), (F.pmod(n, F.lit(3)) + 1).cast("int")).alias("lr"),
        F.when(F.pmod(n, F.lit(4)) == 0, F.lit("adapter")).alias("peft_name"), F.when(F.pmod(n, F.lit(6)) == 0, F.lit(16)).alias("lora_r"))


def _paths(spark, folder):
    rows = path_parameters(spark, folder)
    fixed = {"save": F.lit("out"), "ckpt_name": F.lit("base/7"), "accumulation": F.lit(2), "gpus": F.lit(4), "nodes": F.lit(1),
             "lora_alpha": F.lit(64), "lora_dropout": F.lit("0.1"), "kd_ratio": F.lit("0.5"), "data_names": F.lit("dolly"),
             "max_length": F.lit(512), "seed": F.lit(10)}
    given = {**fixed, **{c: F.col(c) for c in rows.columns if c != "event_id"}}
    built = rows.withColumn("path", run_path("kd", given))
    shown = built.withColumn("p", parse_run_path(F.col("path")))
    evaluated = {**fixed, "peft_name": F.lit(None).cast("string")}
    return shown.select("event_id", "path", run_path("eval", evaluated).alias("eval_path"), "p.epochs", "p.batch_size", "p.lr", "p.kd_ratio", "p.lora_r")


QUERIES = {
    "src8_read_run_logs": _read_logs,
    "src9_read_events": _events,
    "src10_read_run_states": _read_states,
    "src10_load_failures": _read_failures,
    "prj20_run_path": _paths,
    "jon5_run_view": _view,
    "agg31_status_summary": _summary,
    "agg32_classify_failures": _classify,
    "agg32_classify_failures_sampled": _classify_sampled,
    "agg33_outcome_reason": _outcome,
    "agg34_error_fingerprint": _fingerprint,
    "agg35_repeat_failures": _repeats,
    "win7_failure_streak": _streak,
    "win8_retry_report": _retry,
    "win10_stale_report": _stale,
    "win12_hang_report": _hang,
    "nrm1_noise_report": _noise,
    "nrm1_filter_noise": _noise_kept,
    "prx1_near": _near,
    "prx1_near_in_log": _near_log,
    "rgn1_log_regions": _regions,
    "log1_parse_train_log": _parse,
    "log2_extract_metric": _extract,
    "log3_attempt_timeline": _timeline,
}

_EDGE = r"[^\p{L}\p{N}_]"
_HAS = "regexp_matches(lower(raw), '(^|{e})({w})($|{e})')"
_NOISY = _HAS.format(e=_EDGE, w=runlogs.NOISE_WORDS)
_SAVED = _HAS.format(e=_EDGE, w=runlogs.KEEP_WORDS)
_NOISE = f"({_NOISY} AND NOT {_SAVED})"


def _near_sql(text: str, a: str, b: str, n: int = 500) -> str:
    return f"regexp_matches({text}, '(?s){a}.{{0,{n - len(a)}}}{b}|{b}.{{0,{n - len(b)}}}{a}')"


def _case() -> str:
    """The rules as SQL conditions over the joined text ``x``."""

    def has(phrase: str) -> str:
        if phrase.startswith("near:"):
            return _near_sql("x", runlogs.NEAR_ANCHOR, phrase[5:])
        if phrase.startswith("word:"):
            return f"regexp_matches(x, '(^|{_EDGE}){phrase[5:]}($|{_EDGE})')"
        return f"contains(x, '{phrase}')"

    whens = []
    for name, groups in runlogs.RULES:
        test = " OR ".join("(" + " AND ".join("(" + " OR ".join(has(p) for p in entry) + ")" for entry in group) + ")" for group in groups)
        whens.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(whens) + " ELSE 'other' END"


_VERDICTS = f"""WITH {LOG_SQL}, every AS (SELECT DISTINCT run_id, attempt FROM log),
    texts AS (SELECT run_id, attempt, string_agg(lower(raw), chr(10) ORDER BY line_no) AS x FROM log WHERE NOT {_NOISE} GROUP BY 1, 2),
    verdicts AS (SELECT run_id, CAST(attempt AS BIGINT) AS attempt, coalesce({_case()}, 'other') AS reason FROM every LEFT JOIN texts USING (run_id, attempt))"""
_STATE_TABLES = f"""{RUNS_SQL},
    started AS (SELECT * FROM states UNION ALL SELECT * REPLACE (concat('new', exp_id) AS exp_id) FROM states),
    queue AS (SELECT exp_id, 'pending' AS status, 0 AS attempt, 3 AS max_retries FROM started
      UNION ALL SELECT concat('idle', exp_id), 'pending', 0, 3 FROM states),
    runs AS (SELECT * FROM started WHERE user_id % 11 <> 0),
    stat AS (SELECT * FROM states)"""
_REGION = f"""WITH {DOCUMENT_LINES}, b AS (SELECT doc_id % 2 AS run_id, line_no, raw, strlen(raw) AS n,
    sum(strlen(raw) + 1) OVER (PARTITION BY doc_id % 2 ORDER BY line_no) - strlen(raw) - 1 AS lo FROM lines),
    t AS (SELECT run_id, sum(n + 1) AS total FROM b GROUP BY 1),
    w AS (SELECT run_id, 0 AS region, greatest(total - 262144, 0) AS s, total FROM t
      UNION ALL SELECT run_id, 1, floor(total * CAST(0.65 AS DOUBLE)), total FROM t WHERE total > 524288
      UNION ALL SELECT run_id, 2, floor(total * CAST(0.25 AS DOUBLE)), total FROM t WHERE total > 524288),
    z AS (SELECT run_id, region, s, least(s + 262144, total) AS e FROM w)"""

ORACLES = {
    "src8_read_run_logs": f"""WITH {DOCUMENT_LINES}, r AS (SELECT doc_id // 20 AS run, line_no AS o, raw FROM lines)
        SELECT run, row_number() OVER w - 1 AS line_no, CAST(sum(strlen(raw) + 1) OVER w - strlen(raw) - 1 AS BIGINT) AS byte_offset, md5(raw) AS raw_md5
        FROM r WINDOW w AS (PARTITION BY run ORDER BY o)""",
    "src9_read_events": """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, 'scheduler' AS source, event_type AS event,
        props->>'$.k' AS k FROM events""",
    "src10_read_run_states": f"""WITH {RUNS_SQL} SELECT exp_id, CASE WHEN user_id % 13 = 0 THEN 'pending' ELSE status END AS status,
        CASE WHEN user_id % 13 = 0 THEN 0 ELSE attempt END AS attempt, '1e-4' AS lr, 2 AS batches, user_id % 13 <> 0 AS has_run, status AS status_status FROM states""",
    "src10_load_failures": f"WITH {RUNS_SQL} SELECT 'load_exp_failed' AS event, exp_id FROM states WHERE user_id % 13 = 0",
    "prj20_run_path": """WITH p AS (SELECT event_id AS n, event_id % 20 + 1 AS e, CAST(pow(2, event_id % 5) AS INTEGER) AS b, ['5e-05', '0.0005', '1e-5'][event_id % 3 + 1] AS lr FROM events)
        SELECT n AS event_id, concat('out/', CASE WHEN n % 4 = 0 THEN 'base/7-adapter/' ELSE '' END, 'e', e, '-bs', b, '-lr', lr, '-G2-N4-NN1-kd0.5',
          CASE WHEN n % 6 = 0 THEN '-lora-16-64-0.1' ELSE '' END) AS path, 'out/dolly-512/base/7/10' AS eval_path,
          CAST(e AS INTEGER) AS epochs, b AS batch_size, CAST(lr AS DOUBLE) AS lr, CAST(0.5 AS DOUBLE) AS kd_ratio, CASE WHEN n % 6 = 0 THEN 16 END AS lora_r FROM p""",
    "jon5_run_view": f"""WITH {_STATE_TABLES} SELECT q.exp_id, coalesce(r.status, q.status) AS status, coalesce(r.attempt, q.attempt) AS attempt, q.max_retries,
        r.consecutive_failures, r.exp_id IS NOT NULL AS has_run, s.status AS status_status, s.attempt AS status_attempt
        FROM queue q LEFT JOIN runs r USING (exp_id) LEFT JOIN stat s ON s.exp_id = q.exp_id""",
    "agg31_status_summary": f"""WITH {RUNS_SQL} SELECT user_id % 4 AS grp, count_if(status = 'running')::BIGINT AS running, count_if(status IN ('success', 'hard_failure'))::BIGINT AS done,
        count_if(status IN ('pending', 'failed'))::BIGINT AS pending, count_if(status = 'aborted')::BIGINT AS other, count(*) AS total FROM states GROUP BY 1""",
    "agg32_classify_failures": f"{_VERDICTS} SELECT * FROM verdicts",
    "agg32_classify_failures_sampled": f"{_VERDICTS} SELECT * FROM verdicts",
    "agg33_outcome_reason": f"""{_VERDICTS} SELECT run_id, attempt, CASE (run_id + attempt) % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'interrupted'
        WHEN 2 THEN 'timeout' WHEN 3 THEN 'killed' ELSE reason END AS reason FROM verdicts""",
    "agg34_error_fingerprint": f"""WITH {LOG_SQL}, e AS (SELECT run_id, attempt, line_no, regexp_replace(trim(lower(raw)), '^\\s*\\[rank\\d+\\]\\s*:?\\s*', '') AS x FROM log
          WHERE NOT {_NOISE} AND regexp_matches(lower(raw), 'error|traceback|exitcode') AND NOT regexp_matches(lower(raw), 'error_file|childfailederror')),
        n AS (SELECT *, row_number() OVER (PARTITION BY run_id, attempt ORDER BY line_no DESC) AS k FROM e)
        SELECT run_id, CAST(attempt AS BIGINT) AS attempt, md5(string_agg(x, chr(10) ORDER BY line_no)) AS error_hash, count(*) AS error_lines FROM n WHERE k <= 20 GROUP BY 1, 2""",
    "agg35_repeat_failures": f"""WITH {ATTEMPTS_SQL}, a AS (SELECT *, lag(coalesce(error_hash, '')) OVER (PARTITION BY run_id ORDER BY attempt_no) AS prior,
          row_number() OVER (PARTITION BY run_id, error_hash ORDER BY attempt_no) AS repeats FROM attempts)
        SELECT run_id, attempt_no, error_hash, repeats, coalesce(error_hash = prior AND repeats >= 2, false) AS hard_failure FROM a WHERE failed""",
    "win7_failure_streak": f"""WITH {ATTEMPTS_SQL}, i AS (SELECT run_id, attempt_no, failed, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY attempt_no) AS island FROM attempts)
        SELECT run_id, attempt_no, failed, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY attempt_no) AS BIGINT) AS streak FROM i""",
    "win8_retry_report": f"""WITH {RUNS_SQL}, w AS (SELECT *, least(200.0 * pow(2, consecutive_failures), 900.0) AS wait FROM states)
        SELECT exp_id, CAST(wait AS DOUBLE) AS wait_seconds, CASE WHEN coalesce(last_seen + 700 - last_failed_at < wait, false) THEN 'cooling_down'
          WHEN attempt > 2 THEN 'exhausted' ELSE 'ready' END AS retry_state FROM w""",
    "win10_stale_report": f"""WITH {_STATE_TABLES}, v AS (SELECT r.exp_id, r.user_id AS n, r.consecutive_failures AS f,
          CASE WHEN s.exp_id IS NULL THEN NULL WHEN length(s.exp_id) % 3 = 0 THEN 'success' ELSE s.status END AS st
          FROM queue q JOIN runs r USING (exp_id) LEFT JOIN stat s ON s.exp_id = q.exp_id WHERE r.status = 'running'),
        l AS (SELECT *, n % 2 = 0 AND n % 4 = 0 AND n % 8 <> 0 AS dead, n % 2 = 0 AND NOT (n % 4 = 0 AND n % 8 <> 0) AS locked,
          CASE WHEN n % 3 <> 1 THEN n % 5 * 100 + 1 ELSE 0 END AS age FROM v),
        c AS (SELECT *, CASE WHEN coalesce(st IN ('failed', 'success', 'hard_failure'), false) THEN 'terminal_status' WHEN coalesce(st = 'running', false) AND NOT locked THEN 'running_without_lock'
          WHEN NOT locked AND age > 300 THEN 'no_status_after_grace' ELSE 'healthy' END AS k FROM l)
        SELECT exp_id, k AS stale_case, dead AS orphan_lock, CASE k WHEN 'terminal_status' THEN st WHEN 'healthy' THEN 'running' ELSE 'failed' END AS new_status,
          CAST(CASE WHEN k = 'terminal_status' AND st = 'success' THEN 0 WHEN k IN ('running_without_lock', 'no_status_after_grace') THEN f + 1 ELSE f END AS INTEGER) AS new_streak FROM c""",
    "win12_hang_report": f"""WITH s AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CASE WHEN event_type <> 'view' THEN CAST(floor(value / 15) AS BIGINT) END AS size FROM events),
        p AS (SELECT *, last_value(size IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
        r AS (SELECT *, last_value(CASE WHEN size IS NULL OR prev IS NULL OR size <> prev THEN sec END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM p)
        SELECT user_id, event_id, sec - since AS silent_seconds FROM r WHERE size IS NOT NULL AND sec - since > {HANG_SECONDS}""",
    "nrm1_noise_report": f"""WITH {DOCUMENT_LINES}, {LOG_SQL}, u AS (SELECT run_id, raw FROM log UNION ALL SELECT doc_id % 7, raw FROM lines)
        SELECT run_id, count_if({_NOISE})::BIGINT AS dropped, count_if({_NOISY} AND {_SAVED})::BIGINT AS rescued, count_if(NOT {_NOISY})::BIGINT AS plain FROM u GROUP BY 1""",
    "nrm1_filter_noise": f"WITH {LOG_SQL} SELECT line_no, raw FROM log WHERE NOT {_NOISE}",
    "prx1_near": f"SELECT doc_id, {_near_sql('text', 'tion', 'the ', 60)} AS close, {_near_sql('text', 'ment', 'que', 500)} AS far FROM documents",
    "prx1_near_in_log": f"""WITH {LOG_SQL}, x AS (SELECT run_id, attempt, string_agg(lower(raw), chr(10) ORDER BY line_no) AS x FROM log GROUP BY 1, 2)
        SELECT run_id, CAST(attempt AS BIGINT) AS attempt, {_near_sql('x', 'memory', 'loss')} AS near_loss, {_near_sql('x', 'memory', 'nan')} AS near_nan
        FROM x WHERE contains(x, 'memory') OR contains(x, 'loss') OR contains(x, 'nan')""",
    "rgn1_log_regions": f"""{_REGION} SELECT b.run_id, region, count(*) AS lines, min(line_no) AS first, max(line_no) AS last,
        CAST(sum(least(lo + n, e) - greatest(lo, s)) AS BIGINT) AS bytes FROM b JOIN z ON b.run_id = z.run_id AND lo < e AND lo + n >= s GROUP BY 1, 2""",
    "log2_extract_metric": """SELECT event_id, CAST(value AS DOUBLE) AS "rougeL" FROM events""",
    "log3_attempt_timeline": """WITH m AS (SELECT user_id AS run_id, event_id AS line_no, CAST(floor(epoch(ts)) AS BIGINT) AS s, CASE event_id % 5 WHEN 0 THEN 'start' ELSE 'timeout' END AS k
          FROM events WHERE event_id % 5 IN (0, 3)),
        o AS (SELECT *, last_value(CASE WHEN k = 'start' THEN line_no END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY line_no) AS own FROM m),
        e AS (SELECT run_id, own, min_by(k, line_no) AS ended_by, min_by(s, line_no) AS ended FROM o WHERE k <> 'start' AND own IS NOT NULL GROUP BY 1, 2),
        st AS (SELECT run_id, line_no, s AS started, lead(s) OVER (PARTITION BY run_id ORDER BY line_no) AS next FROM m WHERE k = 'start')
        SELECT st.run_id, st.line_no, started, next, ended_by, ended FROM st LEFT JOIN e ON e.run_id = st.run_id AND e.own = st.line_no""",
    "log1_parse_train_log": """WITH e AS (SELECT event_id, event_id % 6 AS k, value AS v FROM events WHERE event_id % 6 < 5),
        f AS (SELECT *, round(CAST(printf('%.4f', v) AS DOUBLE), 3) AS v4 FROM e)
        SELECT event_id, ['train', 'evaluation', 'benchmark', 'policy_train', 'policy_eval'][k + 1] AS kind, ['train', 'dev', 'test', 'train', 'eval'][k + 1] AS split,
          CASE k WHEN 0 THEN event_id % 20 END AS epoch, CASE k WHEN 0 THEN event_id // 4 WHEN 3 THEN event_id END AS global_step,
          CASE k WHEN 0 THEN event_id + 25 WHEN 3 THEN event_id + 7 END AS total_steps, CASE k WHEN 0 THEN event_id WHEN 3 THEN event_id % 50 END AS iter,
          CASE k WHEN 2 THEN 'dolly' END AS name, CASE WHEN k IN (0, 3) THEN v4 END AS loss,
          CASE k WHEN 0 THEN round(CAST(printf('%.4f', v / 2) AS DOUBLE), 3) END AS ds_loss, CASE k WHEN 1 THEN v4 END AS avg_loss,
          CASE WHEN k IN (0, 3) THEN CAST(0 AS DOUBLE) END AS lr, CAST(CASE k WHEN 0 THEN 1024 WHEN 3 THEN 64 END AS DOUBLE) AS scale,
          CASE WHEN k IN (0, 3) THEN CAST(printf('%.3f', v / 10) AS DOUBLE) END AS step_time, CAST(CASE k WHEN 1 THEN 0.3 END AS DOUBLE) AS threshold,
          CASE k WHEN 3 THEN 0.0 - v4 END AS reward, CASE k WHEN 3 THEN round(CAST(printf('%.4f', v / 3) AS DOUBLE), 3) WHEN 4 THEN CAST(printf('%.3f', v / 3) AS DOUBLE) END AS rev_kl,
          CASE k WHEN 2 THEN round(CAST(printf('%.4f', v / 7) AS DOUBLE), 3) WHEN 4 THEN CAST(printf('%.3f', v / 7) AS DOUBLE) END AS lm_loss,
          CASE WHEN k IN (1, 2) THEN round(CAST(printf('%.4f', v / 10) AS DOUBLE), 3) WHEN k = 4 THEN CAST(printf('%.3f', v) AS DOUBLE) END AS "rougeL",
          CASE k WHEN 1 THEN 2.5 WHEN 2 THEN 1.0 WHEN 4 THEN CAST(printf('%.3f', v / 2) AS DOUBLE) END AS exact_match,
          CASE k WHEN 2 THEN CAST(printf('%.2f', v) AS DOUBLE) END AS mean_length FROM f""",
}
