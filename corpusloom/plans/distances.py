"""Teacher/student queries over stored vectors read as logits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import logits as lg
from corpusloom.operators import distance
from corpusloom.plans.binding import LOGITS, logit_tables, rounded, scratch
from corpusloom.sources import writers

RATIO, COEF = 0.5, 0.1
RUN_TYPES = ("sfkl", "adaptive-srkl", "jsd", "tvd", "fkl", "kd", "rkl")


def paired(spark, folder) -> DataFrame:
    student, teacher = logit_tables(spark, folder)
    return distance.pair_logits(student, teacher)


def _pair(spark, folder):
    rows = paired(spark, folder)
    return rows.select("example_id", "pos", "label", rounded(F.array_max("student")).alias("student_max"),
                       rounded(F.array_max("teacher")).alias("teacher_max"))


def _pair_stored(spark, folder):
    """The same from tables stored in equal buckets: the join shuffles neither."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = []
    for side, rows in zip(("student", "teacher"), logit_tables(spark, folder), strict=True):
        path = scratch(spark, f"logits-{side}")
        tables.append(writers.write_logits(rows, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets))
    rows = distance.pair_logits(*(t.hint("merge") for t in tables))
    return rows.select("example_id", "pos", "label", rounded(F.array_max("student")).alias("student_max"),
                       rounded(F.array_max("teacher")).alias("teacher_max"))


def _gather(spark, folder):
    rows = paired(spark, folder)
    return rows.select("example_id", "pos", rounded(lg.gather_token(F.col("student"), F.col("label"))).alias("logit"),
                       rounded(lg.token_logprob(F.col("teacher"), F.col("label"))).alias("logprob"))


def _lm_loss(spark, folder):
    found = distance.lm_loss(paired(spark, folder).withColumnRenamed("student", "logits"))
    return found.select(rounded(F.col("token_mean")).alias("token_mean"), rounded(F.col("row_mean")).alias("row_mean"))


def _one(name: str):
    def run(spark, folder):
        value = lg.divergence(name, F.col("student"), F.col("teacher"))
        return paired(spark, folder).agg(rounded(lg.masked_mean(value, F.col("label")), 9).alias(name))

    return run


def _report(spark, folder):
    rows = paired(spark, folder).withColumn("grp", F.pmod("example_id", F.lit(4)))
    found = distance.divergence_report(rows, by=("grp",))
    return found.select("grp", "positions", *[rounded(F.col(n), 9).alias(n) for n in lg.ALL])


def _arrow(spark, folder):
    rows = paired(spark, folder).withColumn("grp", F.pmod("example_id", F.lit(4)))
    found = distance.divergence_report(rows, by=("grp",))
    return found.select("grp", "positions", *[rounded(F.col(n), 9).alias(n) for n in lg.ALL])


def _dispatch(spark, folder):
    values = [
        rounded(lg.masked_mean(lg.divergence(t, F.col("student"), F.col("teacher")), F.col("label")), 9).alias(t.replace("-", "_"))
        for t in RUN_TYPES
    ]
    return paired(spark, folder).agg(*values)


def _combined(spark, folder):
    rows = paired(spark, folder)
    lm = lg.masked_mean(lg.token_loss(F.col("student"), F.col("label")), F.col("label"))
    kd = lg.masked_mean(lg.divergence("rkl", F.col("student"), F.col("teacher")), F.col("label"))
    aux = lg.masked_mean(lg.token_loss(F.col("teacher"), F.col("label")), F.col("label"))
    return rows.agg(rounded(lg.combined_loss(lm, kd, RATIO), 9).alias("loss"),
                    rounded(lg.combined_loss(lm, kd, RATIO, aux, COEF), 9).alias("loss_with_corpus"))


def _entropies(spark, folder):
    mask = (F.col("label") != -100).cast("int")
    return paired(spark, folder).select(
        "example_id", "pos", rounded(lg.entropy(F.col("student"), mask)).alias("entropy"),
        rounded(lg.cross_entropy(F.col("student"), F.col("teacher"), mask)).alias("cross_entropy"))


def _reg(spark, folder):
    rows = paired(spark, folder).withColumn("mask", (F.col("label") != -100).cast("int"))
    return distance.reg_loss(rows).select(rounded(F.col("reg_loss"), 9).alias("reg_loss"))


def _reward(spark, folder):
    value = lg.centred_reward(F.col("teacher"), F.col("label"))
    live = F.col("label") != -100
    return paired(spark, folder).select("example_id", "pos", rounded(F.when(live, value).otherwise(0.0)).alias("reward"))


QUERIES = {
    "jon3_pair_logits": _pair,
    "jon3_pair_logits_stored": _pair_stored,
    "jon4_gather_token": _gather,
    "agg9_lm_loss": _lm_loss,
    "agg10_forward_kl": _one("fkl"),
    "agg11_reverse_kl": _one("rkl"),
    "agg12_symmetric_kl": _one("skl"),
    "agg13_jensen_shannon": _one("jsd"),
    "agg14_total_variation": _one("tvd"),
    "agg15_skewed_forward_kl": _one("sfkl"),
    "agg16_skewed_reverse_kl": _one("srkl"),
    "agg10_16_divergence_report": _report,
    "agg10_16_divergence_report_arrow": _arrow,
    "agg17_divergence_by_run_type": _dispatch,
    "agg18_combined_loss": _combined,
    "agg19_entropies": _entropies,
    "agg20_reg_loss": _reg,
    "agg22_teacher_reward": _reward,
}

_SUMS = {
    "fkl": "sum(-p * lq)",
    "rkl": "sum(q * (lq - lp))",
    "jsd": "sum(0.9 * q * (lq - ln(0.1 * p + 0.9 * q)) + 0.1 * p * (lp - ln(0.1 * p + 0.9 * q)))",
    "tvd": "sum(0.5 * abs(p - q))",
    "sfkl": "sum(-p * ln(0.1 * p + 0.9 * q))",
    "srkl": "sum(q * (lq - ln(0.9 * p + 0.1 * q)))",
    "ent": "sum(-q * lq)",
    "xent": "sum(-q * lp)",
}
DIVERGED = LOGITS + ", d0 AS (SELECT example_id, pos, label, {} FROM long GROUP BY ALL), d AS (SELECT *, 0.1 * fkl + 0.9 * rkl AS skl FROM d0)".format(
    ", ".join(f"{v} AS {k}" for k, v in _SUMS.items()))
NLL = """nll AS (SELECT example_id, pos, label, CASE WHEN label <> -100 THEN zs - student[label + 1] END AS s,
    CASE WHEN label <> -100 THEN zt - teacher[label + 1] END AS t FROM logp)"""


def _mean(name: str) -> str:
    return f"WITH {DIVERGED} SELECT round(avg({name}), 9) AS {name} FROM d WHERE label <> -100"


_GROUPED = "WITH {} SELECT example_id % 4 AS grp, count(*) AS positions, {} FROM d WHERE label <> -100 GROUP BY 1".format(
    DIVERGED, ", ".join(f"round(avg({n}), 9) AS {n}" for n in lg.ALL))

ORACLES = {
    "jon3_pair_logits": f"""WITH {LOGITS} SELECT example_id, pos, label, round(list_max(student), 6) AS student_max,
        round(list_max(teacher), 6) AS teacher_max FROM pairs""",
    "jon3_pair_logits_stored": f"""WITH {LOGITS} SELECT example_id, pos, label, round(list_max(student), 6) AS student_max,
        round(list_max(teacher), 6) AS teacher_max FROM pairs""",
    "jon4_gather_token": f"""WITH {LOGITS} SELECT example_id, pos, CASE WHEN label >= 0 THEN round(student[label + 1], 6) END AS logit,
        CASE WHEN label >= 0 THEN round(teacher[label + 1] - zt, 6) END AS logprob FROM logp""",
    "agg9_lm_loss": f"""WITH {LOGITS}, {NLL}, r AS (SELECT example_id, avg(s) AS m FROM nll GROUP BY 1)
        SELECT round((SELECT avg(s) FROM nll), 6) AS token_mean, round(avg(m), 6) AS row_mean FROM r""",
    "agg10_forward_kl": _mean("fkl"),
    "agg11_reverse_kl": _mean("rkl"),
    "agg12_symmetric_kl": _mean("skl"),
    "agg13_jensen_shannon": _mean("jsd"),
    "agg14_total_variation": _mean("tvd"),
    "agg15_skewed_forward_kl": _mean("sfkl"),
    "agg16_skewed_reverse_kl": _mean("srkl"),
    "agg10_16_divergence_report": _GROUPED,
    "agg10_16_divergence_report_arrow": _GROUPED,
    "agg17_divergence_by_run_type": f"""WITH {DIVERGED} SELECT round(avg(sfkl), 9) AS sfkl, round(avg(srkl), 9) AS adaptive_srkl, round(avg(jsd), 9) AS jsd,
        round(avg(tvd), 9) AS tvd, round(avg(fkl), 9) AS fkl, round(avg(fkl), 9) AS kd, round(avg(rkl), 9) AS rkl FROM d WHERE label <> -100""",
    "agg18_combined_loss": f"""WITH {DIVERGED}, {NLL}, m AS (SELECT avg(s) AS lm, avg(t) AS aux FROM nll), k AS (SELECT avg(rkl) AS kd FROM d WHERE label <> -100)
        SELECT round(0.5 * lm + 0.5 * kd, 9) AS loss, round(0.5 * lm + 0.5 * kd + 0.1 * aux, 9) AS loss_with_corpus FROM m, k""",
    "agg19_entropies": f"""WITH {DIVERGED} SELECT example_id, pos, round(CASE WHEN label <> -100 THEN ent ELSE 0 END, 6) AS entropy,
        round(CASE WHEN label <> -100 THEN xent ELSE 0 END, 6) AS cross_entropy FROM d""",
    "agg20_reg_loss": f"WITH {DIVERGED} SELECT round(avg(xent - ent), 9) AS reg_loss FROM d WHERE label <> -100",
    "agg22_teacher_reward": f"WITH {LOGITS}, {NLL} SELECT example_id, pos, round(coalesce(-t, 0.0), 6) AS reward FROM nll",
}
