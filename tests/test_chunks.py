"""Golden cases and a brute-force property check of chunk planning."""

import pytest
from hypothesis import given, settings, strategies as st

from quire.functions import prompts as P
from quire.operators.chunks import check_max_chunk, plan_splits, target_size

GOLDEN = [
    ("short note", 400, [(0, 10)]),
    ("north wind\nsouth wind\n", 6, [(0, 11), (11, 22)]),
    ("one long line that has no end", 8, [(0, 29)]),
    ("", 7, []),
    ("seven..", 7, [(0, 7)]),
    ("seven..\nz", 7, [(0, 8), (8, 9)]),
    ("seven..\nz", 8, [(0, 9)]),
    ("ab\n\ncd\ne", 2, [(0, 3), (3, 7), (7, 8)]),
]


def check_plan(text, mx, rows):
    """What any right plan has: chunks are contiguous and cover the text, an
    inner cut is behind the first line end at or after ``start + mx``."""
    assert "".join(chunk for *_, chunk in rows) == text
    at = 0
    for start, end, chunk in rows:
        assert start == at and end > start and chunk == text[start:end]
        at = end
    for start, end, chunk in rows[:-1]:
        assert chunk[mx:].count("\n") == 1 and chunk.endswith("\n")
    if rows:
        start, end, chunk = rows[-1]
        assert len(chunk) <= mx or "\n" not in chunk[mx:-1]


@pytest.mark.parametrize("text,mx,want", GOLDEN)
def test_golden(spark, text, mx, want):
    df = spark.createDataFrame([(text,)], "text string")
    got = [(r.initial_pos, r.end_pos) for r in plan_splits(df, mx).orderBy("split_index").collect()]
    assert got == want


def test_rejects_non_positive():
    for bad in (0, -5):
        with pytest.raises(ValueError):
            check_max_chunk(bad)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ab \néü", max_size=60), min_size=30, max_size=30), st.integers(1, 12))
def test_property_matches_rule(spark, texts, mx):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {}
    for r in plan_splits(df, mx).collect():
        got.setdefault(r.id, []).append((r.split_index, r.initial_pos, r.end_pos, r.chunk))
    for i, t in enumerate(texts):
        check_plan(t, mx, [r[1:] for r in sorted(got.get(i, []))])


def test_target_size(spark):
    df = spark.createDataFrame([("x" * n,) for n in (0, 9, 10, 19, 1234)], "c string")
    assert [r.t for r in df.select(target_size("c").alias("t")).collect()] == [0, 0, 1, 1, 123]


def test_prompt_overhead_and_render(spark):
    assert P.overhead("{A}{B}", ["A", "B"]) == 0
    assert P.overhead("no keys", []) == 7
    assert P.overhead("x {A}", ["A", "MISSING"]) == 5 - 3 - 9
    df = spark.createDataFrame([("has {LANGUAGE} inside", "pt")], "t string, l string")
    from pyspark.sql import functions as F
    got = df.select(P.render("T={TEXT} L={LANGUAGE}", ["TEXT", "LANGUAGE"],
                             {"TEXT": F.col("t"), "LANGUAGE": F.col("l")}).alias("p")).first().p
    assert got == "T=has pt inside L=pt"
    with pytest.raises(KeyError):
        P.render("{A}", ["A"], {})


def test_prompt_versions(tmp_path):
    d = tmp_path / "resume"
    d.mkdir()
    for n in ("v2.txt", "v10.txt", "vx.txt", "notes.md"):
        (d / n).write_text(n)
    assert P.available_versions("resume", str(tmp_path)) == [2, 10]
    assert P.load_template("resume", None, str(tmp_path)) == "v10.txt"
    assert P.available_versions("missing", str(tmp_path)) == []


def test_overhead_over_prompt_table(spark):
    from pyspark.sql import functions as F
    rows = [("{A}{B}", ["A", "B"]), ("no keys", []), ("x {A}", ["A", "MISSING"])]
    df = spark.createDataFrame(rows, "template string, keys array<string>")
    got = [r.o for r in df.select(P.overhead_col(F.col("template"), F.col("keys")).alias("o")).collect()]
    assert got == [P.overhead(t, k) for t, k in rows]
