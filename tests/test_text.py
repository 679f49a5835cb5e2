"""Golden cases for the text transforms."""

from pyspark.sql import functions as F

from quire.functions.text import clean_summary, replace_divs, replace_tables, sentences, strip
from quire.operators.repair import block_rules, repair_blocks

REPAIR = [
    ("moun-\ntain path", "mountain path"),
    ("The rain fell\nOn every roof", "The rain fell On every roof"),
    ("It stopped.\nThen we left", "It stopped.\n\nThen we left"),
    ("Osaka\nOsaka was quiet", "Osaka was quiet"),
    ("They rowed on\n## Part two", "They rowed on\n\n## Part two"),
    ("", ""),
    ("the cat\ncat sat", "the cat\n\ncat sat"),
    ("Q.\nOsaka\nOsaka was", "Q.\n\n\n\nOsaka was"),
    ("OSAKA\nOsaka was", "OSAKA\n\nOsaka was"),
    ("Él\nél dijo", "Él\n\nél dijo"),
    ("¿Él\n¿Él dijo", "¿Él dijo"),
    ("\nabc", "\n\nabc"),
    ("abc\n", "abc "),
    ("abc.\n", "abc.\n\n"),
    ("a\n \nb", "a \n\nb"),
    ("foo-\nüber", "foo- über"),
    ("a--\nb", "a-b"),
    ("a\n[IMAGE]\nb", "a\n\n[IMAGE]\n\nb"),
    ("one;\ntwo", "one; two"),
    ("Harbour\n# Tide", "Harbour\n\n# Tide"),
    ("ends with quote.”\nnext", "ends with quote.”\n\nnext"),
    ("a\n\n\n\nb", "a b"),
]


def test_repair_golden(spark):
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(REPAIR)], "id int, text string, want string")
    got = {r.id: r.content for r in repair_blocks(df).collect()}
    for i, (t, w) in enumerate(REPAIR):
        assert got[i] == w, (t, got[i], w)


def test_block_rules(spark):
    df = spark.createDataFrame([(1, "Osaka\nOsaka was\nmoun-\ntain")], "id int, text string")
    rules = [r.rule for r in block_rules(df).orderBy("pos").collect()]
    assert rules == ["start", "pop", "space", "hyphen"]


DIVS = [
    ('<div alt="old map">ink</div>', "[OLD MAP]"),
    ("<div>margin note</div>", ""),
    ('<div alt="oak">a</div> and <div alt="elm">b</div>', "[OAK] and [ELM]"),
    ('<div ALT="Seal">wax</div>', "[SEAL]"),
    ('<div><img alt="Tower"></div>', "[TOWER]"),
    ("<div><div>x</div></div>", "</div>"),
    ("no markup", "no markup"),
    ('<DIV class="x">\nmulti\nline</DIV>after', "after"),
    ('<diſ>x</div>', '<diſ>x</div>'),                 # not a div tag
    ('<div aLT="ſeal">x</div>', "[SEAL]"),           # Unicode-aware case: ſ upper-cases to S
]


def test_replace_divs(spark):
    df = spark.createDataFrame(DIVS, "text string, want string")
    for r in df.select("want", replace_divs("text").alias("got")).collect():
        assert r.got == r.want


def test_replace_tables(spark):
    html = "x <table border=1><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2 | 3</td></tr></table> y"
    got = spark.createDataFrame([(html,)], "t string").select(replace_tables("t").alias("c")).first().c
    assert "<table" not in got
    assert got == "x | A | B |\n| --- | --- |\n| 1 | 2 \\| 3 | y"


def test_clean_summary(spark):
    rows = [("Book Summary:\nA b.\nKeywords: x", "A b."),
            ("x Keywords y Palavras-chave z", "x Keywords y"),
            ("Resumo do livro:\n  texto  ", "texto"),
            ("plain", "plain")]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("want", clean_summary("t").alias("got")).collect():
        assert r.got == r.want


def test_strip_unicode_whitespace(spark):
    s = "　  x y  \t"
    got = spark.createDataFrame([(s,)], "t string").select(strip("t").alias("c")).first().c
    assert got == s.strip()


def test_sentences(spark):
    t = "One. Two!  Three?\nFour\n\n  five…  six"
    got = spark.createDataFrame([(t,)], "t string").select(sentences("t").alias("s")).first().s
    assert got == ["One.", "Two!", "Three?", "Four", "five…", "six"]
