"""Streaming cleanup: a book whose pages arrive in two batches is rebuilt whole."""

import os

from quire.streaming.incremental import latest_contents, start_cleanup_stream


def write(p, text):
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)


def test_incremental_cleanup(spark, tmp_path):
    root = str(tmp_path / "books")
    out, pages, ck = (str(tmp_path / x) for x in ("contents", "pages", "ck"))
    write(f"{root}/pt/b1/paddle_output/page_1.md", "Primeira linha")
    q = start_cleanup_stream(spark, root, pages, out, ck)
    q.awaitTermination(120)
    first = {r.book: r.content for r in latest_contents(spark, out).collect()}
    assert first == {"b1": "Primeira linha"}
    write(f"{root}/pt/b1/paddle_output/page_2.md", "continua aqui")
    write(f"{root}/pt/b2/paddle_output/page_1.md", "Outro livro.")
    q = start_cleanup_stream(spark, root, pages, out, ck)
    q.awaitTermination(120)
    second = {r.book: r.content for r in latest_contents(spark, out).collect()}
    assert second == {"b1": "Primeira linha continua aqui", "b2": "Outro livro."}


def test_bad_page_replay_and_compaction(spark, tmp_path):
    from quire.streaming.incremental import book_states, compact, latest_contents, open_issues, start_cleanup_stream
    root, pages, contents, ck = (str(tmp_path / n) for n in ("books", "pages", "contents", "ck"))
    issues = f"{contents}_issues"

    def feed(checkpoint=ck):
        start_cleanup_stream(spark, root, pages, contents, checkpoint).awaitTermination()

    def states():
        return {r.book: (r.status, r.content) for r in book_states(spark, contents).collect()}

    write(f"{root}/en/b1/paddle_output/p_1.md", "Good page.")
    write(f"{root}/en/b2/paddle_output/p_1.md", "First.")
    write(f"{root}/en/b2/paddle_output/oops.md", "no id")
    feed()
    assert states() == {"b1": ("ok", "Good page."), "b2": ("withheld", None)}
    assert [(r.book, r.stage, r.reason) for r in open_issues(spark, contents, issues).collect()] == [
        ("b2", "pages", "invalid page file name: oops.md")]
    assert {r.book for r in latest_contents(spark, contents).collect()} == {"b1"}
    # a page more: only b1 is rebuilt, whole
    write(f"{root}/en/b1/paddle_output/p_2.md", "Second page.")
    feed()
    assert states()["b1"] == ("ok", "Good page.\n\nSecond page.")
    before = states()
    # the stream starts over and delivers all files again: same states
    feed(str(tmp_path / "ck2"))
    assert states() == before
    n = spark.read.parquet(contents).count()
    new = compact(spark, pages, contents, issues, str(tmp_path / "compacted"))
    assert spark.read.parquet(new["contents"]).count() == 2 < n and spark.read.parquet(new["pages"]).count() == 4
    assert {r.book: (r.status, r.content) for r in book_states(spark, new["contents"]).collect()} == before
    assert [r.book for r in open_issues(spark, new["contents"], new["issues"]).collect()] == ["b2"]
    # the stream goes on from the compacted tables
    write(f"{root}/en/b1/paddle_output/p_3.md", "Third.")
    start_cleanup_stream(spark, root, new["pages"], new["contents"], ck, issues_path=new["issues"]).awaitTermination()
    assert {r.book: r.content for r in latest_contents(spark, new["contents"]).collect()} == {"b1": "Good page.\n\nSecond page.\n\nThird."}
