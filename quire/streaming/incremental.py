"""Incremental corpus cleanup with Structured Streaming.

New page files are picked up by a file-source stream; each micro-batch
appends them to a pages table partitioned by a hash bucket of the book, then
re-cleans only the books it touched: their pages are re-read with a semi-join
on (language, book, bucket), so dynamic partition pruning limits the scan to
the touched buckets, and a book whose pages arrive over several batches is
rebuilt whole.  A file that arrives again replaces its earlier text.

The keyed state per book is its newest row in ``contents``: ``status`` ok with
the text, or ``withheld`` without one when a page's name carries no page id;
every such page has a row in ``issues`` with the version in which it was seen,
and a later version of the book without bad pages closes it.  Rows are appended
with the batch id as ``version``; a replayed batch writes identical rows, so
results are idempotent.  :func:`compact` rewrites the tables of a stopped stream
to the newest row of every book and file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.scan import join_same
from quire.plans.cleanup import clean_pages
from quire.sources.corpus import _re_escape, bad_pages, decoded_path, page_id

PAGE_SCHEMA = "value string"
BUCKETS = 1024


def book_bucket(lang="language", book="book"):
    return F.pmod(F.xxhash64(F.col(lang), F.col(book)), F.lit(BUCKETS)).cast("int")


def book_states(spark: SparkSession, contents_path: str) -> DataFrame:
    """``language, book, version, status, content``: the newest row of every book."""
    c = spark.read.parquet(contents_path)
    return c.groupBy("language", "book").agg(F.max_by(F.struct("version", "status", "content"), "version").alias("s")).select(
        "language", "book", "s.*")


def latest_contents(spark: SparkSession, contents_path: str) -> DataFrame:
    """The newest cleaned content of every book that is not withheld."""
    return book_states(spark, contents_path).where("status = 'ok'").select("language", "book", "content")


def open_issues(spark: SparkSession, contents_path: str, issues_path: str) -> DataFrame:
    """``language, book, stage, reason``: the bad pages of the books that are
    withheld now."""
    held = book_states(spark, contents_path).where("status = 'withheld'").select("language", "book", "version")
    issues = spark.read.parquet(issues_path)
    return join_same(issues, held, ["language", "book", "version"], "left_semi").select("language", "book", "stage", "reason").distinct()


def newest_pages(pages: DataFrame) -> DataFrame:
    """The newest text of every page file."""
    at = ["language", "book", "bucket", "file"]
    rest = [c for c in pages.columns if c not in at]
    return pages.groupBy(*at).agg(F.max_by(F.struct(*rest), F.struct("version", "text")).alias("p")).select(*at, "p.*")


def compact(spark: SparkSession, pages_table: str, contents_path: str, issues_path: str, target: str) -> dict[str, str]:
    """Newest rows only, written to ``target`` (pages by bucket, one row per
    book in contents, open issues); returns the paths to go on with.  The old
    tables stay as they are until the caller drops them."""
    paths = {name: f"{target.rstrip('/')}/{name}" for name in ("pages", "contents", "issues")}
    newest_pages(spark.read.parquet(pages_table)).repartition("bucket").write.partitionBy("bucket").parquet(paths["pages"])
    book_states(spark, contents_path).select("language", "book", "content", "version", "status").write.parquet(paths["contents"])
    held = book_states(spark, contents_path).where("status = 'withheld'").select("language", "book", "version")
    join_same(spark.read.parquet(issues_path), held, ["language", "book", "version"], "left_semi").distinct().write.parquet(paths["issues"])
    return paths


def start_cleanup_stream(spark: SparkSession, root: str, pages_table: str, contents_path: str,
                         checkpoint: str, ocr_dir: str = "paddle_output", trigger_once: bool = True,
                         max_files_per_trigger: int = 10_000, issues_path: str | None = None):
    """Start the stream; returns the ``StreamingQuery``.  ``max_files_per_trigger``
    bounds a micro-batch, which bounds the broadcast list of touched books.
    Issue rows go to ``issues_path`` (default: beside the contents)."""
    issues_path = issues_path or f"{contents_path.rstrip('/')}_issues"
    src = (spark.readStream.format("text").option("wholetext", True)
           .option("maxFilesPerTrigger", max_files_per_trigger)
           .option("recursiveFileLookup", "false")
           .load(f"{root.rstrip('/')}/*/*/{ocr_dir}/"))
    rel = F.regexp_replace(decoded_path(F.input_file_name()), "^" + _re_escape(root.rstrip("/")) + "/", "")
    parts = F.split(rel, "/")
    pages = src.select(parts[0].alias("language"), parts[1].alias("book"),
                       F.element_at(parts, -1).alias("file"),
                       F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    pages = pages.filter(F.lower("file").endswith(".md") & ~F.col("file").startswith("merged"))
    pages = pages.withColumn("page_id", page_id("file"))

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.withColumn("bucket", book_bucket()).withColumn("version", F.lit(epoch).cast("bigint"))
        # dealt by bucket first: one file per bucket and batch
        df.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(pages_table)
        keys = ["language", "book"]
        touched = df.select(*keys, "bucket").distinct()
        allp = newest_pages(spark.read.parquet(pages_table).join(touched, [*keys, "bucket"], "left_semi")).drop("version")
        # a book with a badly named page is withheld, as in the batch path, and says so
        bad = bad_pages(allp).withColumn("version", F.lit(epoch).cast("bigint"))
        bad.write.mode("append").parquet(issues_path)
        broken = allp.filter(F.col("page_id").isNull()).select(*keys).distinct()
        cleaned = clean_pages(allp.join(broken, keys, "left_anti"), keys).select(*keys, "content").withColumn("status", F.lit("ok"))
        withheld = broken.withColumn("content", F.lit(None).cast("string")).withColumn("status", F.lit("withheld"))
        out = cleaned.unionByName(withheld).withColumn("version", F.lit(epoch).cast("bigint"))
        out.select(*keys, "content", "version", "status").write.mode("append").parquet(contents_path)

    w = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
