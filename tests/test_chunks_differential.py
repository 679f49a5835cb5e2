"""Chunk planning: Spark fold vs the recursive-CTE formulation on random
texts (long lines, no newlines, runs of blank lines, non-ASCII)."""

import random

import duckdb
from pyspark.sql import functions as F

from quire import oracle as O
from quire.operators.chunks import plan_splits


def test_plan_matches_recursive_cte(spark):
    rnd = random.Random(9)
    alphabet = "ab éü\n\n\n"
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))), rnd.randint(1, 60))
            for i in range(200)]
    rows += [(1000, "x" * 500, 10), (1001, "", 5), (1002, "\n" * 30, 3)]
    # one job: the limit is a per-row column
    df = spark.createDataFrame(rows, "id long, text string, mx long")
    got = {(r.id, r.split_index, r.initial_pos, r.end_pos)
           for r in plan_splits(df, F.col("mx"), keep_chunk=False).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(id BIGINT, text VARCHAR, mx BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = set(con.sql(O.splits_sql("t", "id", "text", "mx")).fetchall())
    assert got == want
