"""E7/E8/E11 reports, sinks and T2b."""

import csv
import glob
import json

from pyspark.sql import functions as F

from quire.functions.text import explode_table_cells
from quire.plans import reports


def test_score_table_with_vectors(spark, tmp_path):
    rows = [("en", "b1", "human", "the cat sat on the mat"), ("en", "b1", "m1", "the cat sat"),
            ("en", "b1", "m2", "a dog ran"), ("en", "b2", "m1", "orphan")]
    s = spark.createDataFrame(rows, "language string, book string, provider string, summary string")
    vec = [("en", "b1", "human", 1, [1.0, 0.0]), ("en", "b1", "human", 2, [0.0, 1.0]),
           ("en", "b1", "m1", 3, [1.0, 0.0]), ("en", "b1", "m2", 4, [1.0, 1.0])]
    v = spark.createDataFrame(vec, "language string, book string, provider string, vec_id long, embedding array<double>")
    scores, skipped = reports.score_table(s, v)
    got = {r.provider: r for r in scores.collect()}
    assert set(got) == {"m1", "m2"} and [r.book for r in skipped.collect()] == ["b2"]
    assert got["m1"].rouge1_p == 1.0 and got["m1"].bert_precision == 1.0 and got["m1"].bert_recall == 0.5
    assert abs(got["m2"].bert_precision - 0.707107) < 1e-6
    reports.write_score_table(scores, str(tmp_path / "scores"))
    lines = list(csv.reader(open(glob.glob(str(tmp_path / "scores" / "part-*.csv"))[0], encoding="utf-8")))
    assert lines[0][:4] == ["language", "book", "provider", "bert_precision"] and lines[1][3] == "1.0000"


def test_collect_summaries_and_json_sink(spark, tmp_path):
    rows = [("m", "en", "b", "Book Summary:\nText é.\nKeywords: k"), ("m", "pt", "b", "Outro")]
    s = spark.createDataFrame(rows, "provider string, language string, book string, summary string")
    full = reports.collect_summaries(s)
    assert full.count() == 2
    compat = reports.collect_summaries(s, compat=True).first()
    assert compat.summary == "Outro"
    reports.write_summary_collections(full, str(tmp_path / "maps"))
    objs = [json.loads(l) for f in glob.glob(str(tmp_path / "maps" / "provider=m" / "part-*")) for l in open(f, encoding="utf-8")]
    assert {"b": "Text é."} in objs


def test_table_cells(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td>z</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "id int, t string")
    cells = sorted((r.table_no, r.row_no, r.col_no, r.is_header, r.cell) for r in explode_table_cells(df, ["id"], "t").collect())
    assert cells == [(0, 0, 0, True, "A"), (0, 0, 1, True, "B"), (0, 1, 0, False, "1"), (0, 1, 1, False, "2"),
                     (1, 0, 0, True, "z")]


def test_score_table_stems(spark):
    rows = [("en", "b1", "human", "the runner run"), ("en", "b1", "m", "the runners running")]
    s = spark.createDataFrame(rows, "language string, book string, provider string, summary string")
    from quire.plans.reports import score_table
    scores, _ = score_table(s, None)
    r = scores.first()
    assert (r.rouge1_f, r.rouge2_f, r.rougeL_f) == (1.0, 1.0, 1.0)


def test_missing_summaries_with_more_providers_than_bits(spark):
    from quire.plans.reports import missing_summaries
    names = [f"p{i:03}" for i in range(130)]
    rows = [("en", b, n, "x") for b in range(4) for i, n in enumerate(names) if b == 0 or (i * 7 + b) % 5]
    rows += [("en", 2, "p000", None), (None, 9, "other", "x")]
    df = spark.createDataFrame(rows, "language string, book long, provider string, summary string")
    have = {(r[1], r[2]) for r in rows if r[3]}
    want = sorted((b, n) for b in (0, 1, 2, 3, 9) for n in names if (b, n) not in have)
    assert sorted((r.book, r.provider) for r in missing_summaries(df, names).collect()) == want
    assert missing_summaries(df, []).count() == 0
