"""Rollout queries over event sequences."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rewards as rw
from corpusloom.functions.arrays import remaining_length, total
from corpusloom.operators import distance, examples, ordered, rollouts as ro
from corpusloom.plans.binding import ROLLOUT_SQL, joined_ids, rollout_tokens, rollouts, rounded, scratch, table
from corpusloom.sources import writers

ALPHA, SCALE, CLIP = 0.2, 0.5, 1.0
INTERVAL, ACCUMULATION = 3, 2
EPS = 0.1
NUDGE = 1.3e-8


def long_form(df: DataFrame, column: str, name: str, digits: int = 9) -> DataFrame:
    return df.select("rollout_id", F.posexplode(column).alias("t", "x")).select(
        "rollout_id", (F.col("t") + 1).cast("long").alias("t"), rounded(F.col("x"), digits).alias(name))


def with_rewards(spark, folder) -> DataFrame:
    shaped = rw.shape_rewards(F.col("t_rewards"), F.col("logprobs"), SCALE, CLIP)
    return rollouts(spark, folder).withColumn("rewards", shaped)


def with_advantages(spark, folder) -> DataFrame:
    return ro.advantages(with_rewards(spark, folder))


def _rev_kl(spark, folder):
    kl = rw.rev_kl(F.col("t_rewards"), F.col("logprobs"), F.col("mask"))
    rows = rollouts(spark, folder).withColumn("kl", kl).withColumn("lens", F.aggregate("mask", F.lit(0), lambda a, m: a + m))
    return rows.select("rollout_id", rounded(total(F.col("kl"))).alias("rev_kl"),
                       rounded(F.try_divide(total(F.col("kl")), F.col("lens").cast("double"))).alias("rev_kl_per_token"))


def _weights(spark, folder):
    w = rw.importance_weight(F.col("logprobs"), F.col("rollout_logprobs"), F.col("t_rewards"), ALPHA)
    return long_form(rollouts(spark, folder).withColumn("w", w), "w", "w")


def _objective(spark, folder):
    rows = with_advantages(spark, folder)
    w = rw.importance_weight(F.col("logprobs"), F.col("rollout_logprobs"), F.col("t_rewards"), ALPHA)
    rows = rows.withColumn("w", w).withColumnRenamed("rollout_logprobs", "old_logprobs")
    found = ro.pg_objective(rows)
    return found.select(rounded(F.col("pg_loss")).alias("pg_loss"), "adv_inf", "ratio_inf", "adv_nan", "ratio_nan")


def _whiten(spark, folder, shift, ddof):
    events = table(spark, folder, "events").select("event_id", "value")
    return ro.whiten(events, "value", shift, ddof).select("event_id", rounded(F.col("value")).alias("value"))


def _returns(spark, folder):
    rows = with_rewards(spark, folder).withColumn("lens", F.size("rewards"))
    # Short decimals can sit on a rounding tie; a small shift takes them off it in both engines.
    shown = lambda c: rounded(c + NUDGE)
    return rows.select("rollout_id", shown(rw.discounted_return(F.col("rewards"))).alias("ret"),
                       shown(rw.discounted_return(F.col("rewards"), length=F.col("lens"))).alias("ret_per_token"))


def _macro(spark, folder):
    events = table(spark, folder, "events").select(ordered.int_div(F.col("event_id"), 64).alias("batch"), "value")
    found = distance.macro_loss(events, "batch", "value")
    return found.select(rounded(F.col("macro_mean")).alias("macro_mean"), rounded(F.col("row_mean")).alias("row_mean"), "batches")


def _remaining(spark, folder):
    return long_form(rollouts(spark, folder).withColumn("n", remaining_length(F.col("mask")).cast("array<double>")), "n", "remaining")


def micro_steps(spark, folder) -> DataFrame:
    """Micro-steps of a run: a user's events numbered from 1."""
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return ordered.number_rows(events, "event_id", "_n", by="user_id").select("user_id", (F.col("_n") + 1).alias("step"), "value")


def _intervals(spark, folder, accumulation, exact=False):
    found = ro.log_intervals(micro_steps(spark, folder), "step", ["value"], INTERVAL, accumulation, ("user_id",), exact)
    return found.select("user_id", "global_step", "micro_steps", rounded(F.col("value")).alias("value"))


def _global_step(spark, folder):
    return micro_steps(spark, folder).select("user_id", "step", ro.global_step(F.col("step"), 1).alias("plain"),
                                             ro.global_step(F.col("step"), 4).alias("accumulated"))


def _threshold(spark, folder):
    loss = F.when(F.col("event_id") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("value") / 100)
    evaluations = table(spark, folder, "events").select("user_id", "event_id", loss.alias("loss"))
    found = ro.adaptive_threshold(evaluations, "user_id", "event_id", "loss", EPS)
    return found.select("user_id", "event_id", rounded(F.col("threshold")).alias("threshold"), rounded(F.col("reference_loss")).alias("reference_loss"))


def _pad(spark, folder):
    rows = rollouts(spark, folder).withColumn("grp", F.pmod("rollout_id", F.lit(16)))
    rows = rows.withColumn("query", F.slice("response", 1, 3))
    padded = examples.pad_to_group_max(rows, "grp", left={"query": 0}, right={"response": 0, "mask": 0})
    return padded.select("rollout_id", joined_ids("query").alias("query"), joined_ids("response").alias("response"), joined_ids("mask").alias("mask"))


def _export(spark, folder):
    path = scratch(spark, "rollouts")
    writers.write_rollouts(rollouts(spark, folder), path)
    schema = "rollout_id long, response array<int>, mask array<int>, t_rewards array<double>, logprobs array<double>"
    back = spark.read.schema(schema).json(path)
    return back.select("rollout_id", joined_ids("response").alias("response"), joined_ids("mask").alias("mask"),
                       rounded(total(F.col("t_rewards"))).alias("t_sum"))


def _shape(spark, folder):
    return long_form(with_rewards(spark, folder), "rewards", "reward")


def _advantages(spark, folder):
    return long_form(with_advantages(spark, folder), "advantages", "advantage", 6)


QUERIES = {
    "snk7_write_rollouts": _export,
    "prj24_pad_to_group_max": _pad,
    "agg21_rev_kl": _rev_kl,
    "agg23_shape_rewards": _shape,
    "agg24_importance_weight": _weights,
    "agg25_pg_objective": _objective,
    "agg26_whiten": partial(_whiten, shift=True, ddof=0),
    "agg26_whiten_sample": partial(_whiten, shift=False, ddof=1),
    "agg27_discounted_return": _returns,
    "agg28_macro_loss": _macro,
    "win1_advantages": _advantages,
    "win2_remaining": _remaining,
    "win3_log_intervals": partial(_intervals, accumulation=ACCUMULATION),
    "win3_log_intervals_exact": partial(_intervals, accumulation=ACCUMULATION, exact=True),
    "win3_log_intervals_plain": partial(_intervals, accumulation=1),
    "win4_global_step": _global_step,
    "win6_adaptive_threshold": _threshold,
}

TOKENS = "WITH " + ROLLOUT_SQL
REWARDED = TOKENS + """, rewarded AS (SELECT *, least(greatest((t_lp - s_lp) / 0.5, -1.0), 1.0) AS r,
    count(*) OVER (PARTITION BY rollout_id) AS n FROM tokens)"""
ADVANTAGED = REWARDED + """, rest AS (SELECT *, greatest(sum(m) OVER (PARTITION BY rollout_id ORDER BY t DESC), 1) AS left_over FROM rewarded),
g AS (SELECT a.rollout_id, a.t, a.event_id, sum(pow(0.95, b.t - a.t) * b.r) AS g FROM rewarded a
    JOIN rewarded b ON a.rollout_id = b.rollout_id AND b.t >= a.t GROUP BY ALL),
raw AS (SELECT g.rollout_id, g.t, m, t_lp, s_lp, r_lp, g / left_over AS x FROM g JOIN rest USING (rollout_id, t)),
adv AS (SELECT *, (x - avg(x) OVER ()) / sqrt(var_pop(x) OVER () + 1e-8) AS a FROM raw)"""
STEPS = """WITH steps AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)"""


def _interval_sql(ga: int, divisor: str) -> str:
    gs = "step" if ga == 1 else f"(step // {ga} + 1)"
    return f"""{STEPS}, c AS (SELECT *, {gs} AS gs, CASE WHEN step % {ga} = 0 AND {gs} % {INTERVAL} = 0 THEN 1 ELSE 0 END AS closes FROM steps),
        b AS (SELECT *, sum(closes) OVER (PARTITION BY user_id ORDER BY step) - closes AS block FROM c)
        SELECT user_id, max(gs) FILTER (WHERE closes = 1) AS global_step, count(*) AS micro_steps,
        round(sum(value) / {divisor}, 6) AS value FROM b GROUP BY user_id, block HAVING sum(closes) = 1"""


ORACLES = {
    "snk7_write_rollouts": TOKENS + """ SELECT rollout_id, md5(string_agg(token::VARCHAR, ',' ORDER BY t)) AS response,
        md5(string_agg(m::VARCHAR, ',' ORDER BY t)) AS mask, round(sum(t_lp), 6) AS t_sum FROM tokens GROUP BY 1""",
    "prj24_pad_to_group_max": TOKENS + """, r AS (SELECT rollout_id, rollout_id % 16 AS grp, list(token ORDER BY t) AS x, list(m ORDER BY t) AS m FROM tokens GROUP BY 1),
        w AS (SELECT *, x[1:3] AS q, max(len(x)) OVER (PARTITION BY grp) AS wide, max(len(x[1:3])) OVER (PARTITION BY grp) AS wide_q FROM r)
        SELECT rollout_id, md5(array_to_string(list_concat(list_transform(range(wide_q - len(q)), lambda i: 0), q), ',')) AS query,
          md5(array_to_string(list_concat(x, list_transform(range(wide - len(x)), lambda i: 0)), ',')) AS response,
          md5(array_to_string(list_concat(m, list_transform(range(wide - len(x)), lambda i: 0)), ',')) AS mask FROM w""",
    "agg21_rev_kl": TOKENS + """ SELECT rollout_id, round(sum(exp((t_lp - s_lp) * m) - 1 - (t_lp - s_lp) * m), 6) + 0.0 AS rev_kl,
        round(CASE WHEN sum(m) > 0 THEN sum(exp((t_lp - s_lp) * m) - 1 - (t_lp - s_lp) * m) / sum(m) END, 6) + 0.0 AS rev_kl_per_token FROM tokens GROUP BY 1""",
    "agg23_shape_rewards": REWARDED + " SELECT rollout_id, t, round(r, 9) + 0.0 AS reward FROM rewarded",
    "agg24_importance_weight": TOKENS + " SELECT rollout_id, t, round(exp(s_lp - ln(0.8 * exp(r_lp) + 0.2 * exp(t_lp))), 9) AS w FROM tokens",
    "agg25_pg_objective": ADVANTAGED + """, z AS (SELECT a, m, exp((s_lp - r_lp) * m) * exp(s_lp - ln(0.8 * exp(r_lp) + 0.2 * exp(t_lp))) AS ratio FROM adv)
        SELECT round(sum(greatest(-a * ratio, -a * least(greatest(ratio, 0.8), 1.2)) * m) / sum(m), 6) AS pg_loss,
        count_if(isinf(a))::BIGINT AS adv_inf, count_if(isinf(ratio))::BIGINT AS ratio_inf,
        count_if(isnan(a))::BIGINT AS adv_nan, count_if(isnan(ratio))::BIGINT AS ratio_nan FROM z""",
    "agg26_whiten": """SELECT event_id, round((value - avg(value) OVER ()) / sqrt(var_pop(value) OVER () + 1e-8), 6) + 0.0 AS value FROM events""",
    "agg26_whiten_sample": """SELECT event_id, round((value - avg(value) OVER ()) / sqrt(var_samp(value) OVER () + 1e-8) + avg(value) OVER (), 6) + 0.0 AS value FROM events""",
    "agg27_discounted_return": REWARDED + """ SELECT rollout_id, round(sum(pow(0.95, t - 1) * r) + 1.3e-8, 6) + 0.0 AS ret,
        round(sum(pow(0.95, t - 1) * r) / count(*) + 1.3e-8, 6) + 0.0 AS ret_per_token FROM rewarded GROUP BY 1""",
    "agg28_macro_loss": """WITH b AS (SELECT event_id // 64 AS b, avg(value) AS m, sum(value) AS s, count(value) AS n FROM events GROUP BY 1)
        SELECT round(avg(m), 6) AS macro_mean, round(sum(s) / sum(n), 6) AS row_mean, count(*) AS batches FROM b""",
    "win1_advantages": ADVANTAGED + " SELECT rollout_id, t, round(a, 6) + 0.0 AS advantage FROM adv",
    "win2_remaining": TOKENS + " SELECT rollout_id, t, CAST(sum(m) OVER (PARTITION BY rollout_id ORDER BY t DESC) AS DOUBLE) AS remaining FROM tokens",
    "win3_log_intervals": _interval_sql(ACCUMULATION, str(float(INTERVAL * ACCUMULATION))),
    "win3_log_intervals_exact": _interval_sql(ACCUMULATION, "count(*)"),
    "win3_log_intervals_plain": _interval_sql(1, str(float(INTERVAL))),
    "win4_global_step": STEPS + " SELECT user_id, step, step AS plain, step // 4 + 1 AS accumulated FROM steps",
    "win6_adaptive_threshold": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 10 <> 3 THEN value / 100 END AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
          FROM events),
        s AS (SELECT user_id, event_id, n, CAST(0.0 AS DOUBLE) AS th, loss AS prev FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.loss >= s.prev + {EPS} THEN least(s.th + CAST(0.1 AS DOUBLE), 1.0) ELSE s.th END,
            CASE WHEN e.loss >= s.prev + {EPS} THEN e.loss ELSE s.prev END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
        SELECT user_id, event_id, round(th, 6) AS threshold, round(prev, 6) AS reference_loss FROM s""",
}
