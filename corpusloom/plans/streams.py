"""Streaming queries: each runs over the stored tables as a stream and is compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import NEWLINE_SENTINEL
from corpusloom.operators.batching import shuffle_key
from corpusloom.plans.corpus import _NUMBERED, _ONE
from corpusloom.plans.binding import LOG_LINES, documents, scratch
from corpusloom.plans.runs import _VERDICTS
from corpusloom.sources import writers
from corpusloom.streaming import jobs

CAPACITY, DRAW = 5, 3
HOUR = 3600
CORPUS_CAP = 150  # documents


def _events(spark, folder):
    events = jobs.stream_table(spark, folder, "events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _corpus(spark, folder):
    docs = jobs.stream_table(spark, folder, "documents.parquet").select("doc_id", "text")
    cleaned = jobs.stream_corpus(docs).select("doc_id", F.md5("text").alias("line_md5"))
    return jobs.run_to_table(cleaned, "append")


def _status(spark, folder):
    counted = jobs.stream_status(_events(spark, folder), "ts", "event_type", "1 day", size=F.octet_length("props"))
    shown = counted.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "bytes")
    return jobs.run_to_table(shown, "complete", jobs.latest_batch)


def _status_report(spark, folder):
    renamed = _events(spark, folder).withColumn(
        "status", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "success").otherwise("running"))
    counted = jobs.stream_status_report(renamed, "ts", "status", "1 day")
    shown = counted.select(F.unix_timestamp("w.start").alias("window_start"), "running", "done", "pending", "other", "total")
    return jobs.run_to_table(shown, "complete", jobs.latest_batch)


def _hang(spark, folder):
    silent = jobs.stream_hang(_events(spark, folder), "user_id", "ts", HOUR)
    found = jobs.run_to_table(silent, "append")
    return found.select(F.col("key").cast("long").alias("user_id"), F.col("last_ms").alias("last_ms"))


def _replay(spark, folder):
    kept = jobs.stream_replay(_events(spark, folder), "user_id", "event_id", "event_type", CAPACITY)
    newest = lambda rows: rows.join(
        rows.groupBy("key").agg(F.max("_batch").alias("_last")), "key").where("_batch = _last").drop("_batch", "_last")
    return jobs.run_to_table(kept, "update", newest).select(F.col("key").cast("long").alias("user_id"), F.col("seq").alias("event_id"), "payload")


def _draw(spark, folder):
    """A seeded sample of each buffer."""
    held = _replay(spark, folder)
    # A buffer holds at most ``CAPACITY`` rows.
    picked = held.groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(shuffle_key(F.col("event_id"), 3).alias("k"), "event_id"))), 1, DRAW).alias("s"))
    return picked.select("user_id", F.explode("s.event_id").alias("event_id"))


def _classify(spark, folder):
    lines = jobs.stream_table(spark, folder, "events.parquet").selectExpr(*LOG_LINES)
    return jobs.stream_classify(lines, ["run_id", "attempt"]).select("run_id", F.col("attempt").cast("long").alias("attempt"), "reason")


def _latest(spark, folder):
    turns = jobs.stream_table(spark, folder, "conversations.parquet")
    found = jobs.run_to_table(jobs.stream_latest(turns, "conv_id", "text", "turn"), "update", jobs.newest_per_key("conv_id"))
    return found.select("conv_id", F.md5("gen_answer").alias("gen_md5"), "turn")


def _distinct(spark, folder):
    """Different (user, kind, payload) among all events; the span of lateness is longer than the stored events."""
    repeats = _events(spark, folder).select("user_id", "event_type", F.md5("props").alias("props_md5"), "ts")
    return jobs.run_to_table(jobs.stream_distinct(repeats, ["user_id", "event_type", "props_md5"], "ts", "3650 days"), "append")


def _capped(spark, folder):
    path = scratch(spark, "stream-corpus")
    writers.write_corpus(documents(spark, folder), path, order="doc_id")
    found = jobs.stream_capped_corpus(spark, path, CORPUS_CAP)
    return found.select("doc_id", F.md5("text").alias("text_md5"))


QUERIES = {
    "src5_stream_capped_corpus": _capped,
    "str1_stream_corpus": _corpus,
    "str2_stream_status": _status,
    "str2_stream_status_report": _status_report,
    "str3_stream_hang": _hang,
    "str4_stream_replay": _replay,
    "str4_stream_replay_sample": _draw,
    "str5_stream_classify": _classify,
    "str6_stream_latest": _latest,
    "str6_stream_distinct": _distinct,
}

_DAY = "CAST(epoch(date_trunc('day', ts)) AS BIGINT)"
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)"

ORACLES = {
    "src5_stream_capped_corpus": f"SELECT doc_id, md5({_ONE}) AS text_md5 FROM ({_NUMBERED}) WHERE doc_id < {CORPUS_CAP}",
    "str1_stream_corpus": f"SELECT doc_id, md5(regexp_replace(text, '\\n+', '{NEWLINE_SENTINEL}', 'g')) AS line_md5 FROM documents WHERE text <> ''",
    "str2_stream_status": f"SELECT {_DAY} AS window_start, event_type, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2",
    "str2_stream_status_report": f"""SELECT {_DAY} AS window_start, count_if(event_type NOT IN ('error', 'signup'))::BIGINT AS running, count_if(event_type = 'signup')::BIGINT AS done,
        count_if(event_type = 'error')::BIGINT AS pending, CAST(0 AS BIGINT) AS other, count(*) AS total FROM events GROUP BY 1""",
    "str3_stream_hang": f"""WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS ms FROM events),
        n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS following, max(ms) OVER () AS newest FROM t)
        SELECT user_id, ms AS last_ms FROM n WHERE coalesce(following > ms + {HOUR * 1000}, true) AND ms + {2 * HOUR * 1000} <= newest""",
    "str4_stream_replay": f"WITH {_RANKED} SELECT user_id, event_id, event_type AS payload FROM r WHERE n <= {CAPACITY}",
    "str4_stream_replay_sample": f"""WITH {_RANKED}, k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat(event_id, '|3|0'))) AS m FROM r WHERE n <= {CAPACITY})
        SELECT user_id, event_id FROM k WHERE m <= {DRAW}""",
    "str5_stream_classify": f"{_VERDICTS} SELECT * FROM verdicts",
    "str6_stream_distinct": "SELECT DISTINCT user_id, event_type, md5(props) AS props_md5 FROM events",
    "str6_stream_latest": "SELECT conv_id, md5(max_by(text, turn)) AS gen_md5, max(turn) AS turn FROM conversations GROUP BY 1",
}
