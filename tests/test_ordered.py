"""Bucketed scans against plain loops, over buckets small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from corpusloom.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    ids = sorted(rng.sample(range(-500, 5000), 400))
    # One group holds most rows, one is null.
    return [(i, rng.choice(["hot"] * 6 + ["cold", None]), rng.randint(0, 9), rng.choice([None, rng.randint(1, 99)])) for i in ids]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, v int, maybe int").repartition(5)


def by_group(rows, keyed):
    return {} if not keyed else {r[1]: [x for x in rows if x[1] == r[1]] for r in rows}


@pytest.mark.parametrize("by", [None, "grp"])
@pytest.mark.parametrize("bits", [3, 12])
def test_prefix_sum(df, rows, by, bits):
    found = ordered.prefix_sum(df, "id", F.col("v").cast("long"), "at", by=by, bucket=ordered.span_bucket("id", bits), levels=2)
    running, expected = {}, {}
    for i, grp, v, _ in rows:
        key = grp if by else 0
        expected[i] = running.get(key, 0)
        running[key] = expected[i] + v
    assert {r.id: r["at"] for r in found.collect()} == expected


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("bits", [2, 6, 20])
def test_carry(df, rows, inclusive, backward, bits):
    found = ordered.carry(df, "id", F.col("maybe"), "got", by="grp", inclusive=inclusive, backward=backward, bits=bits)
    expected, last = {}, {}
    for i, grp, _, maybe in reversed(rows) if backward else rows:
        seen = maybe if inclusive and maybe is not None else last.get(grp)
        expected[i] = seen
        if maybe is not None:
            last[grp] = maybe
    assert {r.id: r.got for r in found.collect()} == expected


def test_running_max(df, rows):
    found = ordered.running_max(df, "id", F.col("v"), "top", by="grp", bits=4)
    expected, top = {}, {}
    for i, grp, v, _ in rows:
        expected[i] = top.get(grp)
        top[grp] = v if grp not in top else max(top[grp], v)
    assert {r.id: r.top for r in found.collect()} == expected


def test_number_sorted_any_order(df, rows):
    found = {r.id: r.row_id for r in ordered.number_sorted(df, F.desc("v"), "id").collect()}
    expected = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert found == expected


def test_int_div_is_exact(spark):
    big = 2**60 + 7
    row = spark.range(1).select(ordered.int_div(F.lit(big), 512).alias("q"), ordered.int_div(F.lit(-5), 4).alias("n")).first()
    assert (row.q, row.n) == (big // 512, -2)


def test_no_single_task_holds_the_rows(df):
    plan = ordered.number_rows(df, "id")._jdf.queryExecution().executedPlan().toString()
    # The only single partition is the one over super-bucket totals.
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in part.split("\n")[1]


def test_scan_of_a_summary_that_does_not_commute(spark):
    """Words joined in order, over many buckets and super-buckets, for null keys and groups of all sizes."""
    rows = [(None if k % 5 == 0 else k % 3, (k * 7919) % 40_000 * 613, chr(97 + k % 26)) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, at long, c string").repartition(7)
    layers = [lambda w: {"_t": F.array_join(F.collect_list("c").over(w), "")}]
    got = ordered.scan(df, "at", layers, F.col("_t"), lambda a, b: F.concat(a, b), F.lit(""), "up", by="g", bits=6)
    want = {}
    for g, at, c in sorted(rows, key=lambda r: r[1]):
        want[g] = want.get(g, "") + c
        assert want.setdefault((g, at), want[g])
    assert {(r.g, r.at): r.up for r in got.collect()} == {k: v for k, v in want.items() if isinstance(k, tuple)}


@pytest.mark.parametrize("name, scans", [("win7_failure_streak", 2), ("win12_hang_report", 2), ("snk3_token_index", 2), ("agg35_repeat_failures", 4)])
def test_one_pass_reads_its_table_twice_at_most(spark, name, scans):
    """Rows and bucket summaries share a shuffle; only the summaries are planned beside the rows."""
    plan = driver.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= scans
