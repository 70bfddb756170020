"""Ordered scans without a global window.

Every operator here cuts the order key into buckets, summarises each bucket with a
partially aggregated ``groupBy``, combines the (few) summaries, and only then runs a
window *inside* a bucket. No task ever holds more than one bucket of rows, however
skewed the grouping key is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.session import checkpointed

SPAN_BITS = 12  # key values a bucket of a prefix sum covers, as a power of two
SUPER_BITS = 12  # buckets per super-bucket: their totals are what one task sees of a whole table
CARRY_BITS = 16  # the same for carried values, whose summaries form one level
_UP = (Window.unboundedPreceding, -1)


def _by(by: Sequence[str] | str | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def span_bucket(key: Column | str, bits: int = SPAN_BITS) -> Column:
    """Bucket of an integer key: at most ``2**bits`` distinct keys share one."""
    key = F.col(key) if isinstance(key, str) else key
    return F.shiftright(key.cast("long"), bits)


def int_div(a: Column, b: Column | int) -> Column:
    """Floor division of integers, exact over the whole range of a long."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def hex_bucket(key: Column, digits: int = 4) -> Column:
    """Bucket of a hex digest: its leading digits, in digest order."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def _summary_offsets(totals: DataFrame, by: list[str], count: int, levels: int) -> DataFrame:
    """Exclusive running sums ``_base{i}`` over bucket totals ``_t{i}``.

    With two levels the totals are themselves cut into super-buckets, and only those are
    summed in one task per group.
    """
    if levels <= 1:
        window = Window.partitionBy(*by, F.lit(0)).orderBy("_b").rowsBetween(*_UP)
        return totals.select(*by, "_b", *[_running(f"_t{i}", window).alias(f"_base{i}") for i in range(count)])
    outer = totals.withColumn("_s", span_bucket("_b", SUPER_BITS))
    supers = outer.groupBy(*by, "_s").agg(*[F.sum(f"_t{i}").alias(f"_st{i}") for i in range(count)])
    across = Window.partitionBy(*by, F.lit(0)).orderBy("_s").rowsBetween(*_UP)
    supers = supers.select(*by, "_s", *[_running(f"_st{i}", across).alias(f"_sb{i}") for i in range(count)])
    inner = Window.partitionBy(*by, "_s").orderBy("_b").rowsBetween(*_UP)
    placed = outer.select(*by, "_s", "_b", *[_running(f"_t{i}", inner).alias(f"_in{i}") for i in range(count)])
    joined = _join_null_safe(placed, supers, [*by, "_s"])
    return joined.select(*by, "_b", *[(F.col(f"_in{i}") + F.col(f"_sb{i}")).alias(f"_base{i}") for i in range(count)])


def _running(column: str, window: Window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def prefix_sum(
    df: DataFrame,
    order: str,
    value: Column,
    name: str = "offset",
    by: Sequence[str] | str | None = None,
    bucket: Column | None = None,
    levels: int | None = None,
) -> DataFrame:
    """Exclusive prefix sum of ``value`` in the order of ``order`` within ``by``."""
    return prefix_sums(df, order, {name: value}, by, bucket, levels)


def prefix_sums(
    df: DataFrame,
    order: str,
    values: dict[str, Column],
    by: Sequence[str] | str | None = None,
    bucket: Column | None = None,
    levels: int | None = None,
) -> DataFrame:
    """Exclusive prefix sums, one column per entry of ``values``, in one pass.

    ``bucket`` must be monotone in ``order`` and a function of the row alone, so that the
    summary branch and the row branch always agree; the default cuts integer keys by
    ``SPAN_BITS``. The rows are shuffled once, by bucket.
    """
    keys = _by(by)
    if bucket is None:
        bucket, levels = span_bucket(order), levels or 2
    named = list(values.items())
    rows = df.withColumns({"_b": bucket, **{f"_v{i}": v for i, (_, v) in enumerate(named)}})
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(named))])
    offsets = _summary_offsets(totals, keys, len(named), levels or 1)
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(*_UP)
    local = rows.withColumns({f"_p{i}": _running(f"_v{i}", inside) for i in range(len(named))})
    joined = _join_null_safe(local, offsets, [*keys, "_b"])
    return joined.select(
        *df.columns, *[(F.col(f"_p{i}") + F.col(f"_base{i}")).alias(name) for i, (name, _) in enumerate(named)]
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key is a key of its own."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def carry(
    df: DataFrame,
    order: str,
    value: Column,
    name: str,
    by: Sequence[str] | str | None = None,
    inclusive: bool = False,
    backward: bool = False,
    bits: int = CARRY_BITS,
) -> DataFrame:
    """Last non-null ``value`` before each row (or next after it, ``backward``) within ``by``.

    ``inclusive`` lets the row's own value count. Distributed ``last(ignore nulls)``: a
    bucket hands its final value on, and rows look inside their bucket first.
    """
    keys = _by(by)
    rows = df.withColumn("_b", span_bucket(order, bits)).withColumn("_v", value)
    pick = F.min_by if backward else F.max_by
    kept = rows.where(F.col("_v").isNotNull())
    ends = kept.groupBy(*keys, "_b").agg(pick("_v", order).alias("_end"))

    def ordered(window: Window, column: str) -> Window:
        return window.orderBy(F.col(column).desc() if backward else F.col(column).asc())

    # Buckets without a value still need the carry, so they appear with a null end.
    present = rows.groupBy(*keys, "_b").agg(F.lit(1).alias("_one"))
    summary = _join_null_safe(present, ends, [*keys, "_b"], "left")
    across = ordered(Window.partitionBy(*keys, F.lit(0)), "_b").rowsBetween(*_UP)
    summary = summary.select(*keys, "_b", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    inside = ordered(Window.partitionBy(*keys, "_b"), order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumn("_l", F.last("_v", ignorenulls=True).over(inside))
    joined = _join_null_safe(local, summary, [*keys, "_b"])
    return joined.select(*df.columns, F.coalesce("_l", "_carry").alias(name))


def running_max(
    df: DataFrame, order: str, value: Column, name: str, by: Sequence[str] | str | None = None, bits: int = CARRY_BITS
) -> DataFrame:
    """Largest ``value`` strictly before each row within ``by``; null on the first row."""
    keys = _by(by)
    rows = df.withColumn("_b", span_bucket(order, bits)).withColumn("_v", value)
    tops = rows.groupBy(*keys, "_b").agg(F.max("_v").alias("_top"))
    across = Window.partitionBy(*keys, F.lit(0)).orderBy("_b").rowsBetween(*_UP)
    tops = tops.select(*keys, "_b", F.max("_top").over(across).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(*_UP)
    joined = _join_null_safe(rows.withColumn("_p", F.max("_v").over(inside)), tops, [*keys, "_b"])
    return joined.select(*df.columns, F.greatest("_p", "_base").alias(name))


def scan(
    df: DataFrame,
    order: str,
    layers: Sequence[Callable[[WindowSpec], dict[str, Column]]],
    state: Column,
    combine: Callable[[Column, Column], Column],
    empty: Column,
    name: str,
    by: Sequence[str] | str | None = None,
    bits: int = CARRY_BITS,
) -> DataFrame:
    """State of all rows up to each row, itself included, for any associative summary, in one pass.

    ``layers`` add columns by windows inside a bucket (a layer may read those before it), ``state`` is the summary of a
    bucket's rows up to a row, and ``combine(earlier, later)`` joins the summaries of two stretches; ``empty`` is the one of
    no rows. Rows are shuffled once, by bucket; the last state of each bucket goes through two levels of summaries.
    """
    keys = _by(by)
    local = df.withColumn("_b", span_bucket(order, bits))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    for layer in layers:
        local = local.withColumns(layer(inside))
    local = local.withColumn("_state", state)
    ends = local.groupBy(*keys, "_b").agg(F.max_by("_state", order).alias("_end")).withColumn("_s", span_bucket("_b", SUPER_BITS))

    # The state before each bucket of a super-bucket, and the state of them all.
    listed = ends.groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("at"), F.col("_end").alias("v")))).alias("_a"))
    none = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("at"), empty.alias("before"))), lambda x: F.lit(False))
    folded = F.aggregate("_a", F.struct(none.alias("out"), empty.alias("now")), lambda acc, x: F.struct(
        F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["now"].alias("before")))).alias("out"), combine(acc["now"], x["v"]).alias("now")))
    inner = listed.select(*keys, "_s", folded.alias("_f"))
    # Only here does one task see a whole group: a state for 2**(bits + SUPER_BITS) keys.
    earlier = F.collect_list("_f.now").over(Window.partitionBy(*keys, F.lit(0)).orderBy("_s").rowsBetween(*_UP))
    outer = inner.withColumn("_base", F.aggregate(earlier, empty, combine))
    placed = outer.select(*keys, "_base", F.explode("_f.out").alias("_x"))
    placed = placed.select(*keys, F.col("_x.at").alias("_b"), combine(F.col("_base"), F.col("_x.before")).alias("_before"))
    joined = _join_null_safe(local, placed, [*keys, "_b"])
    return joined.select(*df.columns, combine(F.col("_before"), F.col("_state")).alias(name))


def number_rows(
    df: DataFrame,
    order: str,
    name: str = "row_id",
    by: Sequence[str] | str | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Dense 0-based row number by an integer (or bucketed) key; lazy, one shuffle."""
    return prefix_sum(df, order, F.lit(1).cast("long"), name, by, bucket)


def number_sorted(df: DataFrame, *order: Column | str, name: str = "row_id") -> DataFrame:
    """Dense row number in any sort order.

    The range-partitioned sort is checkpointed so that partition boundaries are fixed; a
    row's number is then its partition's offset plus its place in the partition, with no
    window and no second sort. Runs one job when called.
    """
    placed = checkpointed(df.orderBy(*order)).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumn("_b", F.shiftright("_m", 33)).withColumn(
        "_p", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    )
    totals = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_t0"))
    offsets = _summary_offsets(totals, [], 1, 1)
    joined = _join_null_safe(placed, offsets, ["_b"])
    return joined.select(*df.columns, (F.col("_p") + F.col("_base0")).alias(name))
