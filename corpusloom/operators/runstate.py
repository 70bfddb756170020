"""Run-state reports: merged views, streaks, retries, staleness, hangs. Nothing is acted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordered import carry, scan
from corpusloom.operators.runlogs import HARD_FAILURE_THRESHOLD, attempt_markers

MAX_BACKOFF_SECONDS = 900
STALE_GRACE_SECONDS = 300
DEFAULT_MAX_RETRIES = 2
DEFAULT_RETRY_SLEEP = 60
TERMINAL = ("failed", "success", "hard_failure")


def run_view(queue: DataFrame, runs: DataFrame, status: DataFrame) -> DataFrame:
    """Queue definition overlaid by the run copy, beside the authoritative status.

    ``runs`` and ``status`` are keyed by the folder they were found in (``run_dir``). A run
    copy whose own id is missing or differs is ignored; columns only the queue has stay.
    """
    q = queue.where(F.coalesce(F.col("exp_id"), F.lit("")) != "")
    good = runs.where(F.col("exp_id") == F.col("run_dir"))
    shared = [c for c in good.columns if c in q.columns and c not in ("exp_id", "run_dir")]
    extra = [c for c in good.columns if c not in q.columns and c != "run_dir"]
    r = good.select(F.col("run_dir").alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in [*shared, *extra]])
    s = status.select(F.col("run_dir").alias("_s"), *[F.col(c).alias(f"status_{c}") for c in status.columns if c not in ("run_dir", "exp_id")])
    joined = q.join(r, F.col("exp_id") == F.col("_r"), "left").join(s, F.col("exp_id") == F.col("_s"), "left")
    columns = [
        F.coalesce(F.col(f"_r_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in q.columns
    ]
    return joined.select(
        *columns,
        *[F.col(f"_r_{c}").alias(c) for c in extra],
        F.col("_r").isNotNull().alias("has_run"),
        *[c for c in joined.columns if c.startswith("status_")],
    )


def status_summary(runs: DataFrame, by: tuple[str, ...] = (), status: str = "status") -> DataFrame:
    """Done, pending, running and other counts; ``other`` holds states in none of these."""
    s = F.coalesce(F.col(status), F.lit("pending"))
    done, pending, running = s.isin("success", "hard_failure"), s.isin("pending", "failed"), s == "running"
    return runs.groupBy(*by).agg(
        F.count_if(running).alias("running"),
        F.count_if(done).alias("done"),
        F.count_if(pending).alias("pending"),
        F.count_if(~(done | pending | running)).alias("other"),
        F.count(F.lit(1)).alias("total"),
    )


def failure_streak(attempts: DataFrame, run: str, order: str, failed: Column, name: str = "streak") -> DataFrame:
    """Failures in a row up to each attempt, reset by a success.

    One pass over the attempts, whatever share of them a run has: a stretch is summed up by the failures since its last success
    and whether it has one.
    """
    lost = failed.cast("long")
    layers = [
        lambda w: {"_lost": F.coalesce(F.sum(lost).over(w), F.lit(0)), "_reset": F.max((~failed).cast("int")).over(w)},
        lambda w: {"_kept": F.max(F.when(~failed, F.col("_lost"))).over(w)},
    ]
    state = F.struct((F.col("_lost") - F.coalesce("_kept", F.lit(0))).alias("fails"), F.coalesce(F.col("_reset") == 1, F.lit(False)).alias("reset"))

    def combine(a: Column, b: Column) -> Column:
        return F.struct((F.when(b["reset"], F.lit(0)).otherwise(a["fails"]) + b["fails"]).alias("fails"), (a["reset"] | b["reset"]).alias("reset"))

    empty = F.struct(F.lit(0).cast("long").alias("fails"), F.lit(False).alias("reset"))
    found = scan(attempts, order, layers, state, combine, empty, "_streak", by=run)
    return found.select(*attempts.columns, F.col("_streak.fails").alias(name))


def retry_report(
    runs: DataFrame, now: Column, attempt: str = "attempt", base: str = "retry_sleep", streak: str = "consecutive_failures",
    last_failed: str = "last_failed_at", max_retries: str = "max_retries",
) -> DataFrame:
    """Cool-down and exhaustion of failed runs. ``now`` and ``last_failed`` are epoch seconds."""
    sleep = F.coalesce(F.col(base), F.lit(DEFAULT_RETRY_SLEEP)).cast("double")
    # Past 2^30 the limit has long been reached; capping the exponent avoids overflow.
    power = F.pow(F.lit(2.0), F.least(F.coalesce(F.col(streak), F.lit(0)), F.lit(30)).cast("double"))
    wait = F.least(sleep * power, F.lit(float(MAX_BACKOFF_SECONDS)))
    elapsed = now - F.col(last_failed).try_cast("double")
    cooling = F.coalesce(elapsed < wait, F.lit(False))
    exhausted = F.coalesce(F.col(attempt), F.lit(0)) > F.coalesce(F.col(max_retries), F.lit(DEFAULT_MAX_RETRIES))
    state = F.when(cooling, "cooling_down").when(exhausted, "exhausted").otherwise("ready")
    return runs.withColumn("wait_seconds", wait).withColumn("retry_state", state)


def stale_report(view: DataFrame) -> DataFrame:
    """Which runs marked ``running`` have lost their worker.

    Expects the merged view with ``status_status`` (null: no readable status),
    ``lock_present``, ``pid_alive`` (null: no recorded process) and ``artifact_age_s``: the age of
    the status file, of the run copy where there is none, null when neither exists.
    """
    st, age = F.col("status_status"), F.col("artifact_age_s")
    has_lock, alive = F.coalesce(F.col("lock_present"), F.lit(False)), F.col("pid_alive")
    # A lock whose recorded process is dead counts as removed before any case is looked at.
    dead = has_lock & F.coalesce(~alive, F.lit(False))
    locked = has_lock & ~dead
    case = (
        F.when(F.coalesce(st.isin(*TERMINAL), F.lit(False)), "terminal_status")
        .when(F.coalesce(st == "running", F.lit(False)) & ~locked, "running_without_lock")
        .when(~locked & (F.coalesce(age, F.lit(0.0)) > STALE_GRACE_SECONDS), "no_status_after_grace")
        .otherwise("healthy")
    )
    report = view.where(F.col("status") == "running").withColumn("stale_case", case).withColumn("orphan_lock", dead)
    recovered = F.col("stale_case").isin("running_without_lock", "no_status_after_grace")
    return report.withColumn(
        "new_status",
        F.when(F.col("stale_case") == "terminal_status", F.col("status_status")).when(recovered, "failed").otherwise("running"),
    ).withColumn(
        "new_streak",
        F.when((F.col("stale_case") == "terminal_status") & (st == "success"), F.lit(0))
        .when(recovered, F.coalesce(F.col("consecutive_failures"), F.lit(0)) + 1)
        .otherwise(F.coalesce(F.col("consecutive_failures"), F.lit(0))),
    )


def hang_report(samples: DataFrame, run: str, ts: str, size: str, timeout: int, order: str | None = None) -> DataFrame:
    """Samples at which a log had been silent for longer than ``timeout`` seconds.

    ``ts`` is epoch seconds; ``order`` an integer that orders the samples of a run (``ts``
    itself by default). The clock restarts when the size changes, and at an unreadable
    (null) sample.
    """
    order = order or ts
    at, value = F.col(ts), F.col(size)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # Inside a bucket the clock of all rows is known but for the first that can be read: it restarts or not by the size before the bucket.
    layers = [
        lambda w: {"_prev": F.last(value, True).over(before(w)), "_first": F.first(F.when(value.isNotNull(), F.struct(value.alias("v"), at.alias("t"))), True).over(w),
                   "_last": F.last(value, True).over(w)},
        lambda w: {"_late": F.last(F.when((F.col("_prev").isNotNull() & (value.isNull() | (value != F.col("_prev")))), at), True).over(w),
                   "_early": F.last(F.when(value.isNull() & F.col("_prev").isNull(), at), True).over(w)},
    ]
    state = F.struct(*[F.col(f"_{n}").alias(n) for n in ("first", "last", "late", "early")])

    def combine(a: Column, b: Column) -> Column:
        known, reads = a["last"].isNotNull(), b["first"].isNotNull()
        restart = F.when(reads & (b["first"]["v"] != a["last"]), b["first"]["t"])
        since = F.coalesce(b["late"], restart, b["early"])
        return F.struct(
            F.coalesce(a["first"], b["first"]).alias("first"), F.coalesce(b["last"], a["last"]).alias("last"),
            F.when(known, F.coalesce(since, a["late"])).otherwise(b["late"]).alias("late"),
            F.when(known, a["early"]).otherwise(F.coalesce(b["early"], a["early"])).alias("early"))

    kinds = dict(samples.dtypes)
    nothing = {"first": f"struct<v:{kinds[size]},t:{kinds[ts]}>", "last": kinds[size], "late": kinds[ts], "early": kinds[ts]}
    empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    found = scan(samples, order, layers, state, combine, empty, "_clock", by=run)
    clock = F.col("_clock")
    since = F.coalesce(clock["late"], clock["first"]["t"], clock["early"])
    out = found.withColumn("silent_seconds", at - since).where(value.isNotNull() & (F.col("silent_seconds") > timeout))
    return out.select(*samples.columns, "silent_seconds")


def repeat_failures(
    failures: DataFrame, run: str, order: str, error_hash: str, threshold: int = HARD_FAILURE_THRESHOLD,
    success: str | None = None, reset_on_success: bool = True,
) -> DataFrame:
    """Repeats of each fingerprint within a run, and the attempt at which it becomes hard.

    Hard means: the same non-empty fingerprint as the previous attempt, counted at least
    ``threshold`` times so far. ``success`` names a boolean column; a success clears the
    previous fingerprint.
    """
    h = F.col(error_hash)
    ok = F.coalesce(F.col(success), F.lit(False)) if success and reset_on_success else F.lit(False)
    seen = F.when(ok, F.lit("")).otherwise(F.coalesce(h, F.lit("")))
    # Both scans keep their rows in one shuffle; a stretch hands on its last fingerprint, or its count.
    layers = [lambda w: {"_prior": F.lag(seen).over(w), "_seen": seen}]
    state = F.struct(F.col("_prior").alias("prior"), F.col("_seen").alias("last"))
    take = lambda a, b: F.struct(F.coalesce(b["prior"], a["last"]).alias("prior"), b["last"].alias("last"))
    nothing = F.struct(F.lit(None).cast("string").alias("prior"), F.lit(None).cast("string").alias("last"))
    prior = scan(failures, order, layers, state, take, nothing, "_p", by=run).withColumn("_prior", F.col("_p.prior"))
    one = F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("long")
    counts = [lambda w: {"_n": F.sum(one).over(w)}]
    counted = scan(prior, order, counts, F.col("_n"), lambda a, b: a + b, F.lit(0).cast("long"), "repeats", by=[run, error_hash])
    hard = (F.coalesce(h, F.lit("")) != "") & ~ok & (h == F.col("_prior")) & (F.col("repeats") >= threshold)
    return counted.withColumn("hard_failure", F.coalesce(hard, F.lit(False))).select(
        *failures.columns, "repeats", "hard_failure"
    )


def attempt_timeline(lines: DataFrame, run: str = "run_id", order: str = "line_no", raw: str = "raw") -> DataFrame:
    """Start of each attempt, the start of the next one, and how the attempt was ended.

    An end marker belongs to the last start before it.
    """
    marks = attempt_markers(lines, raw)
    start = F.col("marker") == "start"
    owned = carry(marks, order, F.when(start, F.col(order)), "_start", by=run, inclusive=True)
    ends = owned.where(~start & F.col("_start").isNotNull()).groupBy(run, "_start").agg(
        F.min_by("marker", order).alias("ended_by"), F.min_by("marked_at", order).alias("ended_at")
    )
    starts = marks.where(start)
    nexts = carry(starts, order, F.col("marked_at"), "next_start", by=run, backward=True)
    ended = ends.select(F.col(run).alias("_run"), "_start", "ended_by", "ended_at")
    joined = nexts.join(ended, F.col(run).eqNullSafe(F.col("_run")) & (F.col(order) == F.col("_start")), "left")
    return joined.select(run, order, F.col("marked_at").alias("started_at"), "next_start", "ended_by", "ended_at")
