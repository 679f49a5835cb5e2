"""Block repair: Spark array program vs the DuckDB window formulation on
random texts built from the rule triggers the driver tables lack (headings,
hyphen line ends, [IMAGE], repeated words, quotes, accents, blank lines)."""

import random

import duckdb

from quire import oracle as O
from quire.operators.repair import repair_blocks

PIECES = ["Paris", "paris", "Paris is", "word-", "continuation", "über", "## Heading", "# T", "[IMAGE]",
          "end.", "said “yes.”", "one;", "Él", "¿Él dijo", "a--", "", " ", "x", "The cat", "cat sat",
          "ção", "árvore", "done!", "why?", "wait…", "\t", "#notheading"]


def random_text(rnd):
    parts = [rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))]
    seps = [rnd.choice(["\n", "\n\n", "\n\n\n", " "]) for _ in parts]
    return "".join(p + s for p, s in zip(parts, seps))[: rnd.randint(0, 400)] if parts else ""


def test_spark_matches_window_sql(spark):
    rnd = random.Random(11)
    texts = [(i, random_text(rnd)) for i in range(400)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: r.content for r in repair_blocks(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", texts)
    want = dict(con.sql(O.repair_sql("t", "id", "text")).fetchall())
    bad = [(t, got[i], want[i]) for i, t in texts if got[i] != want[i]]
    assert not bad, bad[:3]
