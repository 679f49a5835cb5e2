"""Tasks that cut texts into words get a bounded share of them."""

import re

import pytest

from quire import session
from quire.operators import tasks as TK
from quire.plans.compress import adaptive_compress, compress_round

TEXT = "\n".join(f"Line {i} tells of rivers and hills. It ends soon." for i in range(40))


@pytest.fixture()
def books(spark):
    return spark.createDataFrame([(i, "en", f"{TEXT} {i}") for i in range(30)], "book long, lang string, content string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def dealt_to(df):
    """Tasks behind the exchanges that were given a number."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)]


def test_splits_are_dealt_by_size(spark, books, monkeypatch):
    run = lambda: compress_round(books.drop("lang"), ["book"], 300)
    few = run()
    monkeypatch.setattr(session, "TASK_TEXT", 2000)
    many = run()
    size = sum(len(r.content) for r in books.collect())
    assert dealt_to(many) == [-(-size // 2000)] and dealt_to(few)[0] < dealt_to(many)[0]
    assert rows(many) == rows(few)


def test_rounds_are_dealt_by_size(spark, books, monkeypatch):
    run = lambda: adaptive_compress(spark, books.drop("lang"), ["book"], 200, 150)
    few, seen = rows(run()), []
    counted = lambda texts, col: seen.append(col) or 40
    monkeypatch.setattr("quire.plans.compress.text_tasks", counted)
    assert rows(run()) == few and seen == ["content"] * len(seen) and len(seen) == max(r[1] for r in few)


def test_summaries_are_dealt_by_size(spark, books, monkeypatch):
    inputs = books.select("book", "lang", "content").toDF("book", "kind", "input")
    few = TK.native_summaries(inputs, ["book"])
    monkeypatch.setattr("quire.operators.tasks.text_tasks", lambda texts, col: 40)
    many = TK.native_summaries(inputs, ["book"])
    assert dealt_to(many) == [40] and rows(many) == rows(few)


def test_keyword_rows_are_dealt_by_size(spark, books, monkeypatch):
    run = lambda: TK.keywords(spark, books, "book", "lang", "content")
    few = run()
    monkeypatch.setattr(TK, "text_tasks", lambda texts, col: 40)
    many = run()
    assert dealt_to(many).count(40) >= 2 and rows(many) == rows(few)


@pytest.mark.parametrize("most", [TK.MAX_BROADCAST_TERMS, 3])
def test_frequent_terms_of_categories_are_dealt_by_book(spark, monkeypatch, most):
    words = [f"word{chr(97 + k)}" for k in range(20)]
    texts = [(i, " ".join(words[i % 7:i % 7 + 5] * 2 + ["everywhere", f"only{'xyz'[i % 3]}"]), "ab"[i % 2]) for i in range(400)]
    books = spark.createDataFrame(texts, "book long, text string, class string")
    model = TK.train_categories(books, "book", "text", "class")
    plain = rows(TK.categories(books.select("book", "text"), "book", "text", model))
    monkeypatch.setattr(TK, "MAX_BROADCAST_TERMS", most)
    monkeypatch.setattr(TK, "text_tasks", lambda texts, col: 40)
    many = TK.categories(books.select("book", "text"), "book", "text", model)
    assert 40 in dealt_to(many) and "__by" in many._jdf.queryExecution().analyzed().toString()
    assert rows(many) == plain
