"""Evaluation queries: cleaning, alignment, scores, reports, picks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rouge import rouge_l
from corpusloom.functions.text import END_MARKER, clean_generation, normalize_answer
from corpusloom.operators import metrics, select
from corpusloom.plans.binding import (
    LOG_SQL,
    PAIRS,
    REPLIES,
    documents,
    log_lines,
    normalized,
    pairs,
    counted_replies,
    replies,
    reply_pairs,
    rounded,
    scratch,
    table,
)
from corpusloom.sources import writers

LANGS = ["de", "en", "es", "fr"]
FOREIGN = 1 << 50  # ids beyond those of the tables


def _generated(spark, folder) -> DataFrame:
    """Replies as a model would emit them: an end marker, inline newlines, stray blanks."""
    rows = replies(spark, folder).select("idx", "text")
    raw = F.when(F.pmod("idx", F.lit(3)) == 0, F.concat("text", F.lit(END_MARKER), F.lit("rest"), F.lit(END_MARKER)))
    raw = raw.when(F.pmod("idx", F.lit(3)) == 1, F.concat(F.lit(" \n<n>"), "text", F.lit("<n> ")))
    return rows.select("idx", F.lit("q\n1").alias("query"), raw.otherwise(F.col("text")).alias("response"))


GENERATED = f"""{REPLIES}, gen AS (SELECT idx, concat('q', chr(10), '1') AS query, CASE idx % 3 WHEN 0 THEN concat(text, '{END_MARKER}rest{END_MARKER}')
    WHEN 1 THEN concat(' ', chr(10), '<n>', text, '<n> ') ELSE text END AS response FROM replies),
cleaned AS (SELECT idx, query, response, regexp_replace(replace(split_part(response, '{END_MARKER}', 1), '<n>', chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM gen)"""


def _clean(spark, folder):
    return _generated(spark, folder).select("idx", F.md5(clean_generation(F.col("response"))).alias("text_md5"))


def _write_predictions(spark, folder):
    path = scratch(spark, "preds")
    writers.write_predictions(_generated(spark, folder), path)
    lines = spark.read.option("lineSep", "\n").text(f"{path}/preds").select(F.lit("preds").alias("part"), F.md5("value").alias("line_md5"))
    texts = spark.read.schema("text string").json(f"{path}/answers").select(F.lit("answers").alias("part"), F.md5("text").alias("line_md5"))
    return lines.unionByName(texts).groupBy("part", "line_md5").agg(F.count(F.lit(1)).alias("n"))


def _normalize(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(normalize_answer(F.col("text"))).alias("text_md5"))


def _align(spark, folder):
    rows = counted_replies(spark, folder)
    # Both sides have ids of their own besides, as real files do.
    predictions = rows.select("idx", "text").unionByName(rows.select((-1 - F.col("idx")).alias("idx"), "text"))
    counted = rows.select("idx", "n")
    references = counted.unionByName(counted.select((F.col("idx") + FOREIGN).alias("idx"), "n"))
    return metrics.align(predictions, references).select("idx", F.md5("text").alias("text_md5"), "n")


def _audit(spark, folder):
    rows = replies(spark, folder).select("idx")
    unmatched = rows.select((F.col("idx") + FOREIGN).alias("idx")).where("idx % 2 = 0")
    return metrics.alignment_audit(rows.unionByName(rows.select((-1 - F.col("idx")).alias("idx"))), rows.unionByName(unmatched))


def _attach(spark, folder):
    origin = pairs(spark, folder).select("pair_id", "conv_id")
    # Rows of conversations that were never generated for are added and must not appear.
    origin = origin.unionByName(origin.select("pair_id", (-1 - F.col("conv_id")).alias("conv_id")))
    generated = table(spark, folder, "conversations")
    found = metrics.attach_generations(origin, generated, "conv_id", "text", "turn")
    return found.select("pair_id", F.md5("gen_answer").alias("gen_md5"))


def scored(spark, folder) -> DataFrame:
    best = metrics.max_over_peers(replies(spark, folder), "conv_id", "turn", "text", stem=False)
    return best.withColumn("idx", F.col("conv_id") * 10000 + F.col("turn")).withColumn("grp", F.pmod("conv_id", F.lit(5)))


def _pair_scores(spark, folder, stem: bool):
    pairs_ = reply_pairs(spark, folder)
    return pairs_.select("idx", F.col("ref").cast("long").alias("ref"), rounded(rouge_l(F.col("text"), F.col("reference"), stem)).alias("rougeL"))


def _exact(spark, folder):
    rows = pairs(spark, folder)
    other = F.when(F.pmod("pair_id", F.lit(3)) == 0, F.concat(F.lit(" "), F.replace("output", F.lit("e"), F.lit("E")), F.lit(" !?"))).otherwise(F.col("instruction"))
    return rows.select("pair_id", metrics.exact_match(F.col("output"), other).alias("exact_match"))


def _max_refs(spark, folder):
    best = scored(spark, folder)
    return best.select("idx", "exact_match", rounded(F.col("rougeL")).alias("rougeL"))


def _score(spark, folder):
    return metrics.score(scored(spark, folder)).select(
        rounded(F.col("exact_match")).alias("exact_match"), rounded(F.col("rougeL")).alias("rougeL"), "rows")


def _score_by(spark, folder):
    return metrics.score_by(scored(spark, folder), "grp").select("grp", "metric", rounded(F.col("value")).alias("value"))


def _score_names(spark, folder):
    tidy = metrics.score_by(scored(spark, folder), "grp")
    return metrics.named_by_group(tidy, "grp").select("name", rounded(F.col("value")).alias("value"))


def _stemmed(spark, folder):
    return _pair_scores(spark, folder, True)


# --- scoreboards ----------------------------------------------------------------------


def board(spark, folder) -> DataFrame:
    """Scores by run (source), benchmark (language) and seed."""
    docs = table(spark, folder, "documents")
    seeded = docs.groupBy(F.col("source").alias("run"), F.col("lang").alias("benchmark"), F.pmod("doc_id", F.lit(5)).alias("seed"))
    return seeded.agg((F.avg(F.pmod("n_chars", F.lit(1000))) / 10).alias("rougeL"))


BOARD = """board AS (SELECT source AS run, lang AS benchmark, doc_id % 5 AS seed, avg(n_chars % 1000) / 10 AS rougeL
    FROM documents GROUP BY ALL)"""


def _seeds(spark, folder, ddof):
    found = metrics.seed_summary(board(spark, folder), "rougeL", ("run", "benchmark"), ddof)
    return found.select("run", "benchmark", "seeds", rounded(F.col("mean")).alias("mean"), rounded(F.col("deviation")).alias("deviation"))


def _matrix(spark, folder):
    wide = metrics.benchmark_matrix(board(spark, folder), "run", "benchmark", "rougeL", LANGS)
    return wide.select("run", *[rounded(F.col(c)).alias(c) for c in LANGS])


def _compare(spark, folder):
    scores = board(spark, folder)
    side = lambda bs: scores.where(F.col("benchmark").isin(bs)).groupBy("run").agg(F.avg("rougeL").alias("rougeL"))
    alone = scores.select(F.lit("only second").alias("run"), F.lit(1.0).alias("rougeL")).distinct()
    found = metrics.compare_runs(side(["fr", "de"]), side(["es", "en"]).unionByName(alone), key="run")
    return found.select("run", *[rounded(F.col(c)).alias(c) for c in ("first", "second", "ratio", "delta")])


# --- picks ----------------------------------------------------------------------------

CHECKPOINTS = [
    "user_id AS run",
    "CASE event_id % 9 WHEN 0 THEN 'eval' WHEN 1 THEN concat('tmp', CAST(event_id AS STRING)) ELSE CAST(event_id AS STRING) END AS step",
    "CAST(floor(value * 1e7) AS BIGINT) AS size_bytes",
    "ts AS mtime",
    "event_id % 3 <> 0 AS has_config",
]
CHECKPOINTS_SQL = "ck AS (SELECT {} FROM events)".format(", ".join(CHECKPOINTS).replace("AS STRING", "AS VARCHAR"))


def checkpoints(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*CHECKPOINTS)


def _best(spark, folder, largest):
    value = F.when(F.col("event_id") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), value.alias("value"))
    return select.best_checkpoint(rows, "value", largest)


def _last_line(spark, folder):
    return select.last_line(log_lines(spark, folder), "Error|loss").select("run_id", "line_no", "raw")


QUERIES = {
    "snk6_write_predictions": _write_predictions,
    "prj16_clean_generation": _clean,
    "prj18_normalize_answer": _normalize,
    "jon1_align": _align,
    "jon1_alignment_audit": _audit,
    "jon2_attach_generations": _attach,
    "jon7_compare_runs": _compare,
    "agg1_exact_match": _exact,
    "agg2_rouge_l": partial(_pair_scores, stem=False),
    "agg2_rouge_l_stemmed": _stemmed,
    "agg3_max_over_references": _max_refs,
    "agg4_score": _score,
    "agg5_score_by": _score_by,
    "agg5_score_names": _score_names,
    "agg29_seed_summary": partial(_seeds, ddof=1),
    "agg29_seed_summary_population": partial(_seeds, ddof=0),
    "agg30_benchmark_matrix": _matrix,
    "top1_latest_checkpoint": lambda s, d: select.latest_checkpoint(checkpoints(s, d)),
    "top2_best_checkpoint": partial(_best, largest=True),
    "top2_best_checkpoint_loss": partial(_best, largest=False),
    "top3_eligible_runs": lambda s, d: select.eligible_runs(checkpoints(s, d)),
    "top4_last_line": _last_line,
}

# Longest common subsequence row by row: a row is the running maximum of the two ways to extend.
LCS = f"""{REPLIES}, toks AS (SELECT idx, grp, ref, text, reference, regexp_extract_all(lower(text), '[a-z0-9]+') AS p,
    regexp_extract_all(lower(reference), '[a-z0-9]+') AS r FROM (
    SELECT idx, grp, text, unnest(refs) AS reference, generate_subscripts(refs, 1) - 1 AS ref FROM replies)),
rt AS (SELECT idx, ref, unnest(r) AS word, generate_subscripts(r, 1) AS j FROM toks),
pt AS (SELECT idx, ref, unnest(p) AS word, generate_subscripts(p, 1) AS i FROM toks),
dp AS (SELECT idx, ref, CAST(0 AS BIGINT) AS i, j, CAST(0 AS BIGINT) AS v FROM rt
  UNION ALL
  SELECT idx, ref, i, j, max(reach) OVER (PARTITION BY idx, ref ORDER BY j) FROM (
    SELECT dp.idx, dp.ref, dp.i + 1 AS i, dp.j, greatest(dp.v, CASE WHEN rt.word = pt.word
        THEN coalesce(lag(dp.v) OVER (PARTITION BY dp.idx, dp.ref ORDER BY dp.j), 0) + 1 ELSE 0 END) AS reach
    FROM dp JOIN pt ON pt.idx = dp.idx AND pt.ref = dp.ref AND pt.i = dp.i + 1
    JOIN rt ON rt.idx = dp.idx AND rt.ref = dp.ref AND rt.j = dp.j)),
lcs AS (SELECT idx, ref, max(v) AS n FROM dp GROUP BY ALL),
pair_scores AS (SELECT t.idx, t.grp, t.ref, CASE WHEN {normalized('text')} = {normalized('reference')} THEN 1.0 ELSE 0.0 END AS em,
    CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * (CAST(n AS DOUBLE) / len(p)) * (CAST(n AS DOUBLE) / len(r)) / (CAST(n AS DOUBLE) / len(p) + CAST(n AS DOUBLE) / len(r)) END AS f
    FROM toks t JOIN lcs l ON t.idx = l.idx AND t.ref = l.ref),
best AS (SELECT idx, grp, max(CAST(em AS DOUBLE)) AS em, max(CAST(f AS DOUBLE)) AS f FROM pair_scores GROUP BY ALL)"""

ORACLES = {
    "snk6_write_predictions": f"""WITH {GENERATED} SELECT part, line_md5, count(*) AS n FROM (
        SELECT 'preds' AS part, md5(concat(replace(query, chr(10), '<n>'), chr(9), chr(9), replace(response, chr(10), '<n>'))) AS line_md5 FROM gen
        UNION ALL SELECT 'answers', md5(text) FROM cleaned) GROUP BY ALL""",
    "prj16_clean_generation": f"WITH {GENERATED} SELECT idx, md5(text) AS text_md5 FROM cleaned",
    "prj18_normalize_answer": f"SELECT doc_id, md5({normalized('text')}) AS text_md5 FROM documents",
    "jon1_align": f"WITH {REPLIES} SELECT idx, md5(text) AS text_md5, len(refs) AS n FROM replies",
    "jon1_alignment_audit": f"""WITH {REPLIES} SELECT count(*) AS matched, count(*) AS only_prediction, count_if(idx % 2 = 0)::BIGINT AS only_reference FROM replies""",
    "jon2_attach_generations": f"""WITH {PAIRS}, g AS (SELECT conv_id, max_by(text, turn) AS t FROM conversations GROUP BY 1)
        SELECT pair_id, md5(t) AS gen_md5 FROM pairs JOIN g USING (conv_id)""",
    "jon7_compare_runs": f"""WITH {BOARD}, a AS (SELECT run, avg(rougeL) AS v FROM board WHERE benchmark IN ('fr', 'de') GROUP BY 1),
        b AS (SELECT run, avg(rougeL) AS v FROM board WHERE benchmark IN ('es', 'en') GROUP BY 1 UNION ALL SELECT 'only second', 1.0)
        SELECT coalesce(a.run, b.run) AS run, round(a.v, 6) AS first, round(b.v, 6) AS second, round(a.v / nullif(b.v, 0), 6) AS ratio,
        round(a.v - b.v, 6) + 0.0 AS delta FROM a FULL JOIN b ON a.run = b.run""",
    "agg1_exact_match": f"""WITH {PAIRS}, o AS (SELECT pair_id, output, CASE WHEN pair_id % 3 = 0 THEN concat(' ', replace(output, 'e', 'E'), ' !?') ELSE instruction END AS other FROM pairs)
        SELECT pair_id, CAST(CASE WHEN {normalized('output')} = {normalized('other')} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS exact_match FROM o""",
    "agg2_rouge_l": f"WITH RECURSIVE {LCS} SELECT idx, ref, round(CAST(f AS DOUBLE), 6) AS \"rougeL\" FROM pair_scores",
    "agg3_max_over_references": f"WITH RECURSIVE {LCS} SELECT idx, em AS exact_match, round(f, 6) AS \"rougeL\" FROM best",
    "agg4_score": f"WITH RECURSIVE {LCS} SELECT round(100 * avg(em), 6) AS exact_match, round(100 * avg(f), 6) AS \"rougeL\", count(*) AS rows FROM best",
    "agg5_score_by": f"""WITH RECURSIVE {LCS} SELECT grp, 'exact_match' AS metric, round(100 * avg(em), 6) AS value FROM best GROUP BY 1
        UNION ALL SELECT grp, 'rougeL', round(100 * avg(f), 6) FROM best GROUP BY 1""",
    "agg5_score_names": f"""WITH RECURSIVE {LCS} SELECT concat('exact_match_for_', grp) AS name, round(100 * avg(em), 6) AS value FROM best GROUP BY grp
        UNION ALL SELECT concat('rougeL_for_', grp), round(100 * avg(f), 6) FROM best GROUP BY grp""",
    "agg29_seed_summary": f"""WITH {BOARD} SELECT run, benchmark, count(rougeL) AS seeds, round(avg(rougeL), 6) AS mean,
        round(stddev_samp(rougeL), 6) + 0.0 AS deviation FROM board GROUP BY 1, 2""",
    "agg29_seed_summary_population": f"""WITH {BOARD} SELECT run, benchmark, count(rougeL) AS seeds, round(avg(rougeL), 6) AS mean,
        round(stddev_pop(rougeL), 6) + 0.0 AS deviation FROM board GROUP BY 1, 2""",
    "agg30_benchmark_matrix": f"""WITH {BOARD} SELECT run, {', '.join(f"round(max(rougeL) FILTER (WHERE benchmark = '{b}'), 6) AS {b}" for b in LANGS)}
        FROM board GROUP BY 1""",
    "top1_latest_checkpoint": f"""WITH {CHECKPOINTS_SQL} SELECT run, arg_max(step, TRY_CAST(step AS BIGINT)) AS step,
        arg_max(size_bytes, TRY_CAST(step AS BIGINT)) AS size_bytes, arg_max(mtime, TRY_CAST(step AS BIGINT)) AS mtime,
        arg_max(has_config, TRY_CAST(step AS BIGINT)) AS has_config FROM ck
        WHERE regexp_full_match(step, '\\d+') AND size_bytes > 100000000 GROUP BY 1""",
    "top2_best_checkpoint": """SELECT run, step, value FROM (SELECT user_id AS run, event_id AS step, value,
        row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE event_id % 10 <> 3) WHERE n = 1""",
    "top2_best_checkpoint_loss": """SELECT run, step, value FROM (SELECT user_id AS run, event_id AS step, value,
        row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events WHERE event_id % 10 <> 3) WHERE n = 1""",
    "top3_eligible_runs": f"""WITH {CHECKPOINTS_SQL} SELECT run, step, size_bytes, mtime, has_config FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY mtime DESC, step DESC) AS n FROM ck WHERE step <> 'eval' AND has_config) WHERE n = 1""",
    "top4_last_line": f"""WITH {LOG_SQL} SELECT run_id, max(line_no) AS line_no, max_by(raw, line_no) AS raw FROM log
        WHERE regexp_matches(raw, 'Error|loss') GROUP BY 1""",
}
