"""Keywords with more frequent terms than are broadcast."""

from quire.operators import tasks as TK


def test_many_frequent_terms_are_not_broadcast(spark, monkeypatch):
    rows = [(i, f"l{i % 3}", " ".join(f"word{chr(97 + (i * k) % 26)}abc" for k in range(20))) for i in range(12)]
    books = spark.createDataFrame(rows, "book long, lang string, text string")
    run = lambda: TK.keywords(spark, books, "book", "lang", "text")
    hints = lambda df: df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")
    small = run()
    monkeypatch.setattr(TK, "MAX_BROADCAST_TERMS", 3)
    large = run()
    assert hints(large) < hints(small)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
