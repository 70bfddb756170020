"""Scoring predictions against references, and the reports built on scores."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.rouge import rouge_l
from corpusloom.operators.peers import Peer, best_of_peers
from corpusloom.functions.text import normalize_answer

Metric = Callable[[Column, Column], Column]


def exact_match(prediction: Column, reference: Column) -> Column:
    """1.0 when the normalised texts are equal."""
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("double")


METRICS: dict[str, Metric] = {"exact_match": exact_match, "rougeL": rouge_l}


def align(predictions: DataFrame, references: DataFrame, key: str = "idx") -> DataFrame:
    """Predictions joined to their references by id, never by position."""
    return predictions.join(references, key)


def alignment_audit(predictions: DataFrame, references: DataFrame, key: str = "idx") -> DataFrame:
    """Counts of matched and unmatched ids on both sides."""
    left = predictions.select(F.col(key).alias("_p"))
    right = references.select(F.col(key).alias("_r"))
    both = left.join(right, F.col("_p") == F.col("_r"), "full_outer")
    return both.agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("only_prediction"),
        F.count_if(F.col("_p").isNull()).alias("only_reference"),
    )


def attach_generations(origin: DataFrame, generations: DataFrame, key: str, text: str, seq: str, name: str = "gen_answer") -> DataFrame:
    """Origin rows that were generated for, with the latest text of each id."""
    latest = generations.groupBy(key).agg(F.max_by(text, seq).alias(name))
    return origin.join(latest, key)


def max_over_references(
    df: DataFrame, metrics: dict[str, Metric] | None = None, key: str = "idx",
    prediction: str = "text", references: str = "references", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Best value of each metric over a row's references.

    References are exploded so that pairs spread over tasks; the maximum is combined before
    the shuffle. Rows without references do not appear.
    """
    metrics = METRICS if metrics is None else metrics
    pairs = df.select(key, *keep, F.col(prediction).alias("_p"), F.explode(references).alias("_r"))
    scored = pairs.select(key, *keep, *[m(F.col("_p"), F.col("_r")).alias(n) for n, m in metrics.items()])
    return scored.groupBy(key, *keep).agg(*[F.max(n).alias(n) for n in metrics])


PEER_TEXTS, PEER_BYTES = 512, 1 << 22  # different texts, and bytes of them, that a block of a group holds


def max_over_peers(df: DataFrame, group: str, member: str, text: str, stem: bool = True) -> DataFrame:
    """``group, member, exact_match, rougeL, pairs``: the best of each row's text over the texts of all other members of its group.

    The members of a group are each other's references. Equal texts are scored once: a text that two members have is its
    own best reference, and all others meet the different texts of the group, block against block, so no task holds a whole
    group. Inside two blocks the words that two texts share, counted with repeats, bound their common subsequence, and
    only pairs that can still beat the best so far are scored; ``pairs`` is how many. A member with several texts gets the best of them;
    null texts score null and are no reference. Members of a group of one have no reference and do not appear, nor do null groups or members.
    """
    same = F.when(F.col(text).isNull(), F.lit("~")).otherwise(F.md5(text))
    rows = df.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(
        F.col(group).alias("_g"), F.col(member).alias("_m"), F.col(text).alias("_t"), same.alias("_k"))
    units = rows.groupBy("_g", "_k").agg(F.first("_t").alias("_t"), F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    whole = units.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_texts"), F.sum(F.octet_length("_t")).alias("_bytes"), F.min("_lo").alias("_first"), F.max("_hi").alias("_last"))
    blocks = F.greatest(F.col("_texts") / PEER_TEXTS, F.coalesce("_bytes", F.lit(0)) / PEER_BYTES).cast("int") + 1
    whole = whole.where("_first < _last").select("_g", blocks.alias("_blocks"))
    placed = units.join(whole, "_g").withColumn("_own", F.pmod(F.xxhash64("_k"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = placed.select(
        "_g", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_lo",
        (F.col("_lo") < F.col("_hi")).alias("_shared"), "_t", normalize_answer(F.col("_t")).alias("_n"))
    kinds = dict(met.dtypes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (g, i, j), held in itertools.groupby(lines, key=lambda line: line[:3]):
            found = best_of_peers([Peer(*line[3:]) for line in held], i, j, stem)
            if found:
                columns = [[g] * len(found), *zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=names)

    names = ["_g", "_m", "exact_match", "rougeL", "pairs"]
    in_place = met.repartition("_g", "_i", "_j").sortWithinPartitions("_g", "_i", "_j")
    types = [kinds["_g"], kinds["_lo"], "double", "double", "long"]
    arrow = to_arrow_schema(units.select("_g", "_lo").schema).types + [pa.float64(), pa.float64(), pa.int64()]
    single = in_place.mapInArrow(meet, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))

    shared = units.where("_lo < _hi").select("_g", "_k")
    worded = F.lower("_t").rlike("[a-z0-9]").cast("double")
    twice = rows.join(shared, ["_g", "_k"], "left_semi").select(
        "_g", "_m", F.when(F.col("_t").isNotNull(), 1.0).alias("exact_match"), worded.alias("rougeL"), F.lit(0).cast("long").alias("pairs"))
    return single.unionByName(twice).groupBy(F.col("_g").alias(group), F.col("_m").alias(member)).agg(
        F.max("exact_match").alias("exact_match"), F.max("rougeL").alias("rougeL"), F.sum("pairs").alias("pairs"))


def score(scored: DataFrame, metrics: tuple[str, ...] = ("exact_match", "rougeL")) -> DataFrame:
    """Corpus means times 100; null when nothing was scored."""
    return scored.agg(*[(100.0 * F.avg(m)).alias(m) for m in metrics], F.count(F.lit(1)).alias("rows"))


def score_by(scored: DataFrame, *groups: str, metrics: tuple[str, ...] = ("exact_match", "rougeL")) -> DataFrame:
    """Tidy ``(group, metric, value)`` means times 100."""
    means = scored.groupBy(*groups).agg(*[(100.0 * F.avg(m)).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return means.select(*groups, F.explode(pairs).alias("_m")).select(*groups, "_m.*")


def named_by_group(tidy: DataFrame, group: str) -> DataFrame:
    """Names of the wide report: ``{metric}_for_{group}``."""
    return tidy.select(F.concat_ws("_for_", "metric", F.col(group).cast("string")).alias("name"), "value")


def length_stats(df: DataFrame, *columns: str, by: str = "split") -> DataFrame:
    """Row count and mean, maximum, minimum length of id columns per split."""
    wanted = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        n = F.size(c)
        wanted += [F.avg(n).alias(f"{c}_mean"), F.max(n).alias(f"{c}_max"), F.min(n).alias(f"{c}_min")]
    return df.groupBy(by).agg(*wanted)


def mean_length(df: DataFrame, ids: str, first: int | None = None, row_id: str = "row_id") -> DataFrame:
    """Mean id count, over all rows or the ``first`` rows by number."""
    kept = df if first is None else df.where(F.col(row_id) < first)
    return kept.agg(F.avg(F.size(ids)).alias("mean_length"))


def throughput(df: DataFrame, text: str, seconds: Column) -> DataFrame:
    """Documents and megabytes (real bytes of the text) per second of elapsed time."""
    totals = df.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.octet_length(text)).alias("bytes"),
        seconds.cast("double").alias("seconds"),
    )
    rate = lambda c: F.try_divide(c.cast("double"), F.col("seconds"))
    return totals.withColumn("documents_per_s", rate(F.col("documents"))).withColumn(
        "mb_per_s", rate(F.col("bytes") / F.lit(1048576.0))
    )


def seed_summary(df: DataFrame, value: str, by: tuple[str, ...], ddof: int = 1) -> DataFrame:
    """Mean and deviation over seeds; sample deviation unless ``ddof=0``."""
    spread = F.stddev_samp if ddof else F.stddev_pop
    return df.groupBy(*by).agg(
        F.count(value).alias("seeds"), F.avg(value).alias("mean"), spread(value).alias("deviation")
    )


def benchmark_matrix(df: DataFrame, run: str, benchmark: str, value: str, benchmarks: list[str]) -> DataFrame:
    """One row per run, one column per named benchmark."""
    return df.groupBy(run).pivot(benchmark, benchmarks).agg(F.max(value))


def compare_runs(first: DataFrame, second: DataFrame, key: str = "benchmark", value: str = "rougeL") -> DataFrame:
    """Ratio and difference of two score tables; a missing side stays null."""
    a = first.select(F.col(key).alias("_a"), F.col(value).alias("first"))
    b = second.select(F.col(key).alias("_b"), F.col(value).alias("second"))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return joined.select(
        F.coalesce("_a", "_b").alias(key),
        "first",
        "second",
        F.try_divide("first", "second").alias("ratio"),
        (F.col("first") - F.col("second")).alias("delta"),
    )
