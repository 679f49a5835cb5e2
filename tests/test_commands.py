"""End to end: folder tree -> cleanup -> compression -> keywords -> evaluation."""

import glob
import os

from pyspark.sql import functions as F

from quire import fixed
from quire.plans import commands as C


def write(p, text):
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)


def test_end_to_end(spark, tmp_path):
    root = str(tmp_path / "books")
    body = "\n".join(f"Page text line {i} tells part {i % 9} of the story." for i in range(120))
    write(f"{root}/english/b1/paddle_output/page_1.md", body)
    write(f"{root}/english/b1/paddle_output/page_2.md", "The story ends here.")
    write(f"{root}/english/b2/notes.txt", "no ocr")
    write(f"{root}/english/b3.pdf", "pdf")
    plan = [r.dst for r in C.layout_plan(spark, root).collect()]
    assert plan == ["english/b3/b3.pdf"]
    ok, _ = C.validate_layout(spark, root)
    assert not ok

    issues = C.post_process(spark, root, str(tmp_path / "contents"))
    assert [(r.book, r.stage) for r in issues.collect()] == [("b2", "content")]
    contents = spark.read.parquet(str(tmp_path / "contents"))
    outputs_path = str(tmp_path / "outputs")
    books = C.resume(spark, contents, "native", 1500, outputs_path, workdir=str(tmp_path / "w"))
    assert books.first().status == "done"
    outputs = spark.read.parquet(outputs_path)
    assert outputs.filter(F.col("kind") == fixed.KIND_ABSTRACTS).count() == 1
    # a second resume finds the abstracts and does nothing
    again = C.resume(spark, contents, "native", 1500, outputs_path, existing_outputs=outputs,
                     workdir=str(tmp_path / "w2"))
    assert again.count() == 0

    splits = spark.read.parquet(str(tmp_path / "w" / "splits"))
    res = C.book_task(spark, "keywords", contents, splits, outputs,
                      lambda ps: ["alpha\nbeta" for _ in ps], "native", outputs_path, sleep=lambda s: None)
    assert [r.status for r in res.collect()] == ["ok"]

    results = str(tmp_path / "results")
    write(f"{results}/english/b1/providers/human/summary.txt", "The story of parts and lines.")
    write(f"{results}/english/b1/providers/native/summary.txt", "Book Summary:\nA story of lines.\nKeywords: x")
    scores, skipped = C.evaluate_summaries(spark, results, str(tmp_path / "scores"))
    row = scores.first()
    assert row.provider == "native" and row.rouge1_p > 0 and skipped.count() == 0
    assert glob.glob(str(tmp_path / "scores" / "part-*.csv"))
    rep = C.coherence_report(spark, results, str(tmp_path / "coh"))
    assert [(r.provider, r.n_books, r.coherence) for r in rep.collect()] == [("human", 1, 1.0), ("native", 1, 1.0)]
