"""Cleanup by pages against the cleanup of the merged book."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.scan import two_level_scan
from quire.plans.cleanup import clean_pages
from quire.plans.pagewise import assembled, clean_pages_by_page

SCHEMA = "lang string, book long, page_id long, text string"


def both(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {(r.lang, r.book): r.content for r in clean_pages(df.where("page_id is not null"), ["lang", "book"]).collect()}
    pieces = clean_pages_by_page(df, ["lang", "book"], **kw)
    rows = pieces.collect()
    got = {(r.lang, r.book): r.content for r in assembled(pieces, ["lang", "book"]).collect()}
    return whole, got, rows


def book(pages, n=1):
    return [("en", n, i, t) for i, t in enumerate(pages)]


CASES = {
    "hyphen over the page end": ["one two hyphen-", "ated words.", "Next"],
    "repeated word over the page end": ["ends with Paris", "Paris is", "Paris is big"],
    "pop of the first block": ["Paris", "Paris is beautiful"],
    "pop behind a lone first page that is blank": ["\n", "Paris", "Paris is"],
    "space over the page end": ["no full stop", "goes on", "\n\n", "and on\n", "\nto the end."],
    "div over three pages": ["a <div class='x'>b", "c alt=\"Fig", " 2\" d", "e</div> f", "g"],
    "open div that nothing closes": ["a <div>b", "c", "d"],
    "div closed late, one in between": ["a <div>b", "<div>c</div> d", "e</div> f <div>g</div>"],
    "close first": ["a</div>", "b <div>c", "d</div>", "</div>e"],
    "tag cut by the page end": ["a <div", "alt=\"x\">b", "c</div>d", "e"],
    "close that ends a tag": ["a <div </div> b", "c", "d</div> e", "f </div>"],
    "table over pages": ["t <table><tr><td>1", "</td><td>2</td></tr>", "</table> end", "x"],
    "table tag that a hyphen join completes": ["t <ta-", "ble><tr><td>1</td></tr></table> end.", "x"],
    "closing tag that a hyphen join completes": ["t <table><tr><td>1</td></tr>", "more </ta-", "ble> end.", "x"],
    "only newlines": ["\n\n\n"],
    "blank at both ends": ["\n", "\n\n", "\n"],
    "emptied by div": ["<div>x</div>", "a", "<div>y</div>", "b", "<div>z</div>"],
    "image": ["text", "<div><img alt=\"image\"></div>", "more text"],
}


@pytest.mark.parametrize("block_pages", [1, 2, 256])
def test_cases(spark, block_pages):
    rows = [r for n, pages in enumerate(CASES.values()) for r in book(pages, n)]
    whole, got, _ = both(spark, rows, block_pages=block_pages)
    for n, name in enumerate(CASES):
        assert got["en", n] == whole["en", n], name


def test_random_books(spark):
    rng = random.Random(1)
    parts = ["<div>", "<div", ">", "</div>", "</DIV>", "<table>", "</table>", "<tr><td>", "</td></tr>", "alt=\"Pic\"", "word", "Word", "word-", "ated",
             "end.", "\n", "\n\n", " ", "# Head", "[IMAGE]", "<", "/", "tab-", "é"]
    rows = [("en" if b % 3 else None, b, i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7))))
            for b in range(250) for i in range(rng.randint(1, 9))]
    whole, got, _ = both(spark, rows, block_pages=3)
    # the merge joins null languages like any key
    assert got == whole


def test_pages_keep_their_pieces(spark):
    rows = book(["A first page.", "<div>a", "b</div>x.", "Third."]) + [("en", 2, None, "no id"), ("en", 2, 5, None), ("en", 2, 6, ""), ("en", 2, 7, "only")]
    _, _, got = both(spark, rows)
    assert sorted((r.book, r.page_id, r.n_pages, r.start_pos, r.content) for r in got) == [
        (1, 0, 1, 0, "A first page."), (1, 1, 2, 13, "\n\nx."), (1, 3, 1, 17, "\n\nThird."), (2, 7, 1, 0, "only")]


def test_no_task_holds_a_book(spark):
    """The plan collects no lists, and no aggregate runs over a book alone."""
    df = spark.createDataFrame(book(["a", "b"]), SCHEMA)
    plan = clean_pages_by_page(df, ["lang", "book"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "listagg" not in plan


def test_two_level_scan_against_plain_loops(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randint(0, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, x long").withColumn("blk", F.floor(F.col("i") / 7)).repartition(5)
    got = {r.i: r for r in two_level_scan(df, ["k"], "blk", ["i"], {
        "p": ("prev", "x"), "n": ("next", "x"), "lb": ("last_before", "x"), "fa": ("first_after", "x"), "s": ("sum_before", "x")}).collect()}
    assert len(got) == 400
    for key in ("a", "b", None):
        own = [r for r in rows if r[0] == key]
        for at, (_, i, _x) in enumerate(own):
            r = got[i]
            assert (None if at == 0 else own[at - 1][2]) == (r.p.v if r.p else None) and (r.p is None) == (at == 0)
            assert (None if at == len(own) - 1 else own[at + 1][2]) == (r.n.v if r.n else None) and (r.n is None) == (at == len(own) - 1)
            assert r.lb == next((x[2] for x in reversed(own[:at]) if x[2] is not None), None)
            assert r.fa == next((x[2] for x in own[at + 1:] if x[2] is not None), None)
            assert r.s == sum(x[2] or 0 for x in own[:at])
    with pytest.raises(ValueError):
        two_level_scan(df, ["k"], "blk", ["i"], {"p": ("around", "x")})
