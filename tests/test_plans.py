"""Physical-plan checks: the exchanges each key operator is designed to have."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan)), plan


@pytest.fixture(scope="module")
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name,expected", [
    ("repair_blocks", 0),        # row-local array program
    ("plan_splits", 0),          # row-local fold
    ("chunk_targets", 0),
    ("replace_divs", 0),
    ("compress_round", 1),       # one exchange on the chunk key, token work after it
    ("collect_summaries", 0),
])
def test_exchange_count(static, name, expected):
    n, plan = exchanges(E.queries()[name](static, SF))
    assert n == expected, plan


def test_scan_prunes_columns(static):
    _, plan = exchanges(E.queries()["repair_blocks"](static, SF))
    scan = [l for l in plan.split("\n") if "FileScan parquet" in l][0]
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in scan
