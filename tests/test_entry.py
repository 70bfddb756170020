"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def test_entry_runs(spark):
    assert driver.entry(spark).count() >= 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


WIDE = ("pak1_pack", "snk3_token_index", "pre1_prefix_sum", "win7_failure_streak", "win12_hang_report", "agg32_classify_failures",
        "agg35_repeat_failures", "bat1_plan_batches", "win6_adaptive_threshold", "agg26_whiten", "jon3_pair_logits")


@pytest.mark.parametrize("name", WIDE)
def test_plans(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A single partition may only hold partial aggregates or bucket totals.
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = re.sub(r"^[\s:+|\-*()0-9]*", "", lines[i + 1])
            assert below.startswith(("HashAggregate", "ObjectHashAggregate", "Project")), below


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["pre1_prefix_sum"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("text" not in s for s in schemas)
