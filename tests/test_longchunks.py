"""Chunk planning over line rows against the fold over one row and a loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.chunks import plan_splits
from quire.operators.longchunks import plan_line_splits, successors, text_lines


def plans(df, keys=("k",)):
    return sorted(tuple(r) for r in df.select(*keys, "split_index", "initial_pos", "end_pos").collect())


@pytest.mark.parametrize("limit,block_chars", [(1, 1), (5, 16), (37, 64), (400, 64), (3, 1 << 20)])
def test_same_as_the_fold(spark, limit, block_chars):
    rng = random.Random(limit)
    texts = ["", "\n", "\n\n\n", "abc", "abc\n", "x" * 300, "A" * 100 + "\n" + "B" * 100, "ab\n\ncd\ne", "\n" * 40 + "é\U0001F600" * 30 + "\n"]
    texts += ["".join(rng.choice("ab\n" + "c" * rng.randint(1, 9)) for _ in range(rng.randint(0, 400))) for _ in range(25)]
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "k long, text string")
    want = plans(plan_splits(df, limit, keep_chunk=False).fillna(-1, ["k"]))
    assert plans(plan_line_splits(text_lines(df, ["k"]), ["k"], limit, block_chars=block_chars).fillna(-1, ["k"])) == want


def test_two_keys_and_empty_tables(spark):
    df = spark.createDataFrame([("en", 1, "a\nbb\nccc"), ("en", 2, "dd\ne"), ("pt", 1, "f\ng"), ("pt", 3, None)], "lang string, book long, text string")
    keys = ["lang", "book"]
    got = plans(plan_line_splits(text_lines(df, keys), keys, 2), keys)
    assert got == plans(plan_splits(df.where("text is not null"), 2, keep_chunk=False), keys)
    assert plan_line_splits(text_lines(df.limit(0), keys), keys, 2).count() == 0
    with pytest.raises(ValueError):
        plan_line_splits(text_lines(df, keys), keys, 0)


def test_successors_leave_the_block():
    newlines = np.array([3, 9, 10, 18, 30])
    step, leave = successors(newlines, 5, 32)
    # 3 -> a newline at 9 or later -> at 15 or later (18) -> at 24 or later (30) -> out at 36
    assert step.tolist() == [1, 3, 3, 4, 4] and leave.tolist() == [36] * 5


def test_a_million_lines_of_one_text(spark):
    """One text of a million lines, which no row holds."""
    n, limit = 1_000_000, 2000
    length = lambda i: (i * 7919 + (i >> 4)) % 97
    lines = spark.range(n).select(F.lit("book").alias("k"), F.col("id").alias("line_no"),
                                  ((F.col("id") * 7919 + F.shiftright("id", 4)) % 97).alias("n_chars"))
    got = plan_line_splits(lines, ["k"], limit)
    ends = np.cumsum(length(np.arange(n, dtype=np.int64)) + 1)
    ends[-1] -= 1  # the last line has no newline
    want, start = [], 0
    while start < ends[-1]:
        at = np.searchsorted(ends[:-1] - 1, start + limit)
        to = int(ends[at])
        want.append((start, to))
        start = to
    rows = got.select("split_index", "initial_pos", "end_pos").toPandas().sort_values("split_index")
    assert rows["split_index"].tolist() == list(range(len(want)))
    assert list(zip(rows["initial_pos"].tolist(), rows["end_pos"].tolist())) == want
