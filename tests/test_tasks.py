"""Model-backed compression and book tasks with a fake model."""

from pyspark.sql import functions as F

from quire import fixed
from quire.plans.compress import adaptive_compress
from quire.plans.tasks import prompted_chunk_model, run_book_task


def test_prompted_compression(spark, tmp_path):
    def shrink_model(prompts):
        """Fake model: answers with the first tenth of the passage it was given
        (defined inside the test so it is shipped to the workers by value)."""
        out = []
        for p in prompts:
            text = p.split("Passage:\n", 1)[-1]
            out.append(text[: max(1, len(text) // 10)])
        return out

    text = "\n".join(f"Line {i} of the book." for i in range(300))
    books = spark.createDataFrame([("pt", "b1", text)], "language string, book string, content string")
    stage = prompted_chunk_model(shrink_model, sleep=lambda s: None)
    r = adaptive_compress(spark, books, ["language", "book"], 500, 300, model=stage,
                          workdir=str(tmp_path / "w")).first()
    assert r.status == "done" and 0 < len(r.abstract_contents) <= 500


def test_book_task_runs_once(spark, tmp_path):
    books = spark.createDataFrame([("pt", "b1", "t"), ("pt", "b2", "t"), ("pt", "b3", "t")],
                                  "language string, book string, content string")
    splits = spark.createDataFrame(
        [("pt", "b1", 1, 0, "old", "ok"), ("pt", "b1", 2, 0, "Alpha.", "ok"), ("pt", "b1", 2, 1, "Beta.", "ok"),
         ("pt", "b2", 1, 0, "Gamma.", "ok")],
        "language string, book string, batch int, split_index long, abstract string, status string")
    outputs = spark.createDataFrame(
        [("pt", "b1", fixed.KIND_ABSTRACTS, "x"), ("pt", "b2", fixed.KIND_ABSTRACTS, "y"),
         ("pt", "b2", fixed.KIND_KEYWORDS, "done")],
        "language string, book string, kind string, text string")
    def model(prompts):
        return ["k1\n" + p for p in prompts]          # echo the prompt to inspect it

    path = str(tmp_path / "outputs")
    res = run_book_task(spark, "keywords", books, splits, outputs, model, "fake", path, sleep=lambda s: None)
    rows = res.collect()
    assert [(r.book, r.status) for r in rows] == [("b1", "ok")]      # b2 done, b3 has no state
    assert "Alpha.\n\nBeta." in rows[0].text and "old" not in rows[0].text
    written = spark.read.parquet(path)
    assert written.count() == 1
    again = run_book_task(spark, "keywords", books, splits, written.drop("provider"), model, "fake", path,
                          sleep=lambda s: None)
    assert again.count() == 0 and spark.read.parquet(path).count() == 1


def test_summary_task_writes_both_variants(spark, tmp_path):
    books = spark.createDataFrame([("pt", "b1", "t")], "language string, book string, content string")
    splits = spark.createDataFrame([("pt", "b1", 1, 0, "Intro.", "ok"), ("pt", "b1", 1, 1, "Body.", "ok")],
                                   "language string, book string, batch int, split_index long, abstract string, status string")
    outputs = spark.createDataFrame([("pt", "b1", fixed.KIND_ABSTRACTS, "x")],
                                    "language string, book string, kind string, text string")
    path = str(tmp_path / "o")
    res = run_book_task(spark, "abstract", books, splits, outputs, lambda ps: ["S" for _ in ps], "fake", path,
                        sleep=lambda s: None)
    assert sorted(r.kind for r in res.collect()) == sorted(fixed.SUMMARY_KINDS)
    assert spark.read.parquet(path).filter(F.col("text") == "S").count() == 2
