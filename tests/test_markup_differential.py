"""Div and table conversion: Spark vs the DuckDB formulation on random markup
(the driver pages hold no tables and no alt texts)."""

import random

import duckdb
from pyspark.sql import functions as F

from quire import oracle as O
from quire.functions.text import replace_divs, replace_tables

BITS = ['<div alt="fig one">x</div>', "<div>plain</div>", '<DIV ALT="Caps">y</DIV>', "<div><div>n</div></div>",
        '<div class="a"><img alt="pic"></div>', "text ", "more text\n", "<table><tr><th>A</th><th>B</th></tr>"
        "<tr><td>1</td><td>2 | 3</td></tr></table>", "<TABLE><tr><td>only</td></tr></TABLE>",
        "<table><tr><td> <b>bold</b>\n cell </td></tr><tr><td>z</td></tr></table>", "<table></table>", "é ü ç"]


def test_markup_matches_sql(spark):
    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 6)))) for i in range(300)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: (r.d, r.t) for r in df.select("id", replace_divs("text").alias("d"),
                                                replace_tables("text").alias("t")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE m(id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO m VALUES (?, ?)", texts)
    want = {i: (d, t) for i, d, t in con.sql(f"SELECT id, {O.divs_sql('text')}, {O.tables_sql('text')} FROM m").fetchall()}
    bad = [(t, got[i], want[i]) for i, t in texts if got[i] != want[i]]
    assert not bad, bad[:3]
