"""Summaries of books whose first abstracts do not fit the window."""

from quire.operators import tasks as TK
from quire.plans import catalog
from quire.plans.compress import adaptive_compress, compress_round, last_abstracts


def _long(n):
    return "\n".join(f"Sentence {i} of the long book tells about matter {i % 17} and place {i % 5}." for i in range(n))


def test_book_summaries_take_the_last_round(spark, tmp_path):
    rows = [(1, "en", _long(900)), (2, "en", _long(20)), (3, "en", "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.kind): r for r in catalog.book_summaries(spark, str(tmp_path)).collect()}

    contents = catalog._contents(spark, str(tmp_path))
    work = str(tmp_path / "w")
    books = adaptive_compress(spark, contents, ["doc_id"], catalog.WINDOW, catalog.MAX_CHUNK, on_error="drop", workdir=work)
    rounds = {r.doc_id: r for r in books.collect()}
    assert rounds[1].rounds > 1 and rounds[1].status == "done" and rounds[2].rounds == 1
    # the whole input is the finished text of the book, and fits the window
    inputs = TK.summary_inputs(last_abstracts(spark, books, ["doc_id"], work), ["doc_id"])
    texts = {r.doc_id: r.input for r in inputs.where("kind = 'summary'").collect()}
    assert texts[1] == rounds[1].abstract_contents and len(texts[1]) <= catalog.WINDOW
    # a tenth of the finished text, not of the first round's
    assert 0 < len(got[1, "summary"].summary) <= catalog.WINDOW // 10

    once = TK.native_summaries(TK.summary_inputs(compress_round(contents, ["doc_id"], catalog.MAX_CHUNK), ["doc_id"]), ["doc_id"])
    before = {(r.doc_id, r.kind): r.summary for r in once.collect()}
    assert set(before) == set(got)
    assert before[1, "summary"] != got[1, "summary"].summary
    assert all(before[k] == got[k].summary for k in before if k[0] != 1)
