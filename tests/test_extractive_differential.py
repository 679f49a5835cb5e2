"""Extractive digest: Spark vs the SQL formulation on random chunks with the
edge cases (no sentence, punctuation-only sentences, tiny targets, ties)."""

import random

import duckdb
from pyspark.sql import functions as F

from quire import oracle as O
from quire.operators.chunks import target_size
from quire.operators.extractive import extractive_abstracts

WORDS = ["alpha", "beta", "gamma", "Alpha", "ção", "über", "x", "42"]
ENDS = [". ", "! ", "? ", "… ", "\n", "\n\n", " ", ", ", "... ", " . "]


def chunk(rnd):
    out = []
    for _ in range(rnd.randint(0, 15)):
        out.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 5))))
        out.append(rnd.choice(ENDS))
    return "".join(out)


def test_extractive_matches_sql(spark):
    rnd = random.Random(3)
    rows = [(i, 0, chunk(rnd)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, split_index long, chunk string").withColumn(
        "target_size", target_size("chunk"))
    got = {r.doc_id: r.abstract for r in extractive_abstracts(df, ["doc_id", "split_index"]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE c(doc_id BIGINT, split_index BIGINT, chunk VARCHAR)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?)", rows)
    con.execute("CREATE VIEW ct AS SELECT *, (length(chunk) // 10)::BIGINT AS target_size FROM c")
    want = {d: a for d, _, a in con.sql(O.extractive_sql("ct", "doc_id, split_index", "chunk", "target_size")).fetchall()}
    bad = [(c, got[i], want[i]) for i, _, c in rows if got[i] != want[i]]
    assert not bad, bad[:3]
