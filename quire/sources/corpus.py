"""Corpus scans over a ``language/book/...`` folder tree.

Spark lists files, not folders: a book folder holding no file at all is
invisible to these scans (documented difference).  Texts are read as whole
files with universal newlines applied (``\\r\\n`` and ``\\r`` -> ``\\n``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.text import normalise_newlines
from quire.operators.scan import two_level_scan
from quire.plans.cleanup import PAGE_FOLDER_STEPS, SINGLE_FILE_STEPS, clean_text, merge_pages
from quire.plans.pagewise import clean_pages_by_page
from quire.session import written


CATALOGUE_BLOCK = 1 << 14


def decoded_path(c):
    """The plain path of a file URI as Spark reports it (``%20`` -> blank);
    a literal ``+`` in a name is no blank."""
    return local_path(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def _rel(path_col: str, root: str):
    root = root.rstrip("/")
    return F.regexp_replace(local_path(F.col(path_col)), "^" + _re_escape(root) + "/", "")


def local_path(c):
    """``file:/x`` and ``file:///x`` -> ``/x`` (other schemes are kept)."""
    return F.regexp_replace(c, "^file:/+", "/")


def _re_escape(s: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in s)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root``: ``relpath, parts ARRAY<STRING>`` (content
    is never read: the binary-file source only loads it when selected)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))
    rel = files.select(_rel("path", root).alias("relpath"))
    return rel.select("relpath", F.split("relpath", "/").alias("parts"))


def scan_books(spark: SparkSession, root: str) -> DataFrame:
    """Every (language, book) with at least one file inside the book folder."""
    f = list_files(spark, root).filter(F.size("parts") >= 3)
    return f.select(F.col("parts")[0].alias("language"), F.col("parts")[1].alias("book")).distinct()


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """Whole-file texts: ``path, text`` (newlines normalised); no match -> no rows."""
    try:
        t = spark.read.text(glob, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        t = spark.createDataFrame([], "value string")
    return t.select(decoded_path(F.input_file_name()).alias("path"),
                    normalise_newlines("value").alias("text"))


def scan_pages(spark: SparkSession, root: str, ocr_dir: str = "paddle_output") -> DataFrame:
    """S2 + S3: page files ``<root>/<language>/<book>/<ocr_dir>/*.md`` (any
    case of ``.md``, not starting with ``merged``) with their page id
    (digits after the last ``_`` before a lower-case ``.md``; others get a
    null id and are reported by :func:`bad_pages`)."""
    t = read_texts(spark, f"{root.rstrip('/')}/*/*/{ocr_dir}/*.[mM][dD]")
    parts = F.split(_rel("path", root), "/")
    pages = t.select(parts[0].alias("language"), parts[1].alias("book"),
                     F.element_at(parts, -1).alias("file"), "text")
    return page_files(pages).withColumn("page_id", page_id("file"))


def page_files(files: DataFrame, file_col: str = "file") -> DataFrame:
    """The rows whose file is a page: ``.md`` in any case, no merged output."""
    return files.filter(F.lower(file_col).endswith(".md") & ~F.col(file_col).startswith(fixed.MERGED_PREFIX))


def page_id(file_col) -> F.Column:
    """S3: BIGINT id from ``..._<digits>.md``; null when the name is invalid."""
    c = F.col(file_col) if isinstance(file_col, str) else file_col
    d = F.regexp_extract(c, fixed.PAGE_ID_PATTERN, 1)
    # a number beyond BIGINT is an invalid name, not a failure
    return F.when(d != "", d.try_cast("bigint"))


def bad_pages(pages: DataFrame) -> DataFrame:
    """Issue rows for page files whose name carries no page id."""
    return pages.filter(F.col("page_id").isNull()).select(
        "language", "book", F.lit("pages").alias("stage"),
        F.concat(F.lit("invalid page file name: "), F.col("file")).alias("reason"))


def book_contents(spark: SparkSession, root: str, ocr_dir: str = "paddle_output",
                  by_page: bool = False) -> tuple[DataFrame, DataFrame]:
    """S4 + F9: one cleaned content per book with its origin, by precedence:
    cached ``book_content.md`` (as is) > single ``<ocr_dir>`` markdown file
    (divs + tables) > folder of pages (merge, divs, repair, tables).
    Returns ``(contents, issues)``; a book with an invalid page name or with
    no source at all is an issue, never a job failure.

    ``by_page=True`` gives a folder of pages as one row per page instead
    (``page_id, n_pages, start_pos`` besides the content, see
    :mod:`quire.plans.pagewise`), so no row holds a whole book; the other
    origins are one piece at position 0 without a page id."""
    base = root.rstrip("/")
    cached = read_texts(spark, f"{base}/*/*/{fixed.CACHED_CONTENT_FILE}")
    cparts = F.split(_rel("path", root), "/")
    cached = cached.select(cparts[0].alias("language"), cparts[1].alias("book"),
                           F.col("text").alias("content"), F.lit(1).alias("rank"), F.lit("cached").alias("origin"))
    parts = []
    if ocr_dir.lower().endswith(".md"):
        # the OCR output is one markdown file per book: markup cleanup only
        single = read_texts(spark, f"{base}/*/*/{ocr_dir}")
        sparts = F.split(_rel("path", root), "/")
        single = single.select(sparts[0].alias("language"), sparts[1].alias("book"), F.col("text").alias("content"))
        parts.append(clean_text(single, SINGLE_FILE_STEPS).select(
            "language", "book", "content", F.lit(2).alias("rank"), F.lit("single_file").alias("origin")))
        broken = spark.createDataFrame([], "language string, book string")
        pages = spark.createDataFrame([], "language string, book string, file string, text string, page_id bigint")
    else:
        pages = scan_pages(spark, root, ocr_dir)
        broken = pages.filter(F.col("page_id").isNull()).select("language", "book").distinct()
        good = pages.join(broken, ["language", "book"], "left_anti")
        if by_page:
            pieces = clean_pages_by_page(good, ["language", "book"], tie_col="file")
            parts.append(pieces.withColumn("rank", F.lit(3)).withColumn("origin", F.lit("pages")))
        else:
            merged = merge_pages(good, ["language", "book"], tie_col="file")
            parts.append(clean_text(merged, PAGE_FOLDER_STEPS).select(
                "language", "book", "content", F.lit(3).alias("rank"), F.lit("pages").alias("origin")))
    if by_page:
        whole = lambda df: df if "page_id" in df.columns else df.withColumns(
            {"page_id": F.lit(None).cast("bigint"), "n_pages": F.lit(0).cast("bigint"), "start_pos": F.lit(0).cast("bigint")})
        rest = whole(parts[0]).join(cached.select("language", "book"), ["language", "book"], "left_anti")
        contents = whole(cached).unionByName(rest).drop("rank")
    else:
        cand = cached.unionByName(parts[0])
        w = Window.partitionBy("language", "book").orderBy("rank")
        contents = cand.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r", "rank")
    books = scan_books(spark, root)
    missing = books.join(contents.select("language", "book"), ["language", "book"], "left_anti").join(
        broken, ["language", "book"], "left_anti").select(
        "language", "book", F.lit("content").alias("stage"), F.lit("no OCR output found").alias("reason"))
    # the pages of a cached book are never looked at
    issues = bad_pages(pages.join(cached.select("language", "book"), ["language", "book"], "left_anti")).unionByName(missing)
    return contents, issues


def fill_down(df: DataFrame, col: str, keys: list[str], block: str, order: list[str]) -> DataFrame:
    """A blank or null ``col`` takes the last value given before it in the
    order of (``block``, ``order``), within ``keys`` (which may be none).  Each
    block is filled on its own; the last value of every block is carried into
    the next ones, so no task sees more than a block."""
    given = df.withColumn("__given", F.when(F.trim(F.col(col)) != "", F.col(col)))
    filled = two_level_scan(given, keys, block, order, {"__carried": ("last_before", "__given")})
    return filled.withColumn(col, F.coalesce("__given", "__carried")).drop("__given", "__carried")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Sparse-header CSV where the language is given on the first row of
    each group only; fill it down in file order.  Rows are numbered as they are
    read (a multi-line file by one task) and written once; blocks of
    ``CATALOGUE_BLOCK`` rows are filled in parallel."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    names = df.columns
    # the row number in the low bits rises within a file, which one task reads
    rows = written(df.withColumn("__file", F.input_file_name()).withColumn("__order", F.monotonically_increasing_id()), "catalogue")
    rows = rows.withColumn("__block", F.floor(F.col("__order") / CATALOGUE_BLOCK))
    return fill_down(rows, names[0], ["__file"], "__block", ["__order"]).orderBy("__order").select(*names)


def prompt_table(spark: SparkSession, prompts_dir: str) -> DataFrame:
    """``name, version, template`` for every ``<name>/v<int>.txt``."""
    t = read_texts(spark, f"{prompts_dir.rstrip('/')}/*/v*.txt")
    parts = F.split(_rel("path", prompts_dir), "/")
    v = F.regexp_extract(F.element_at(parts, -1), r"^v(\d+)\.txt$", 1)
    return t.select(parts[0].alias("name"), v.alias("v"), F.col("text").alias("template")).filter(
        F.col("v") != "").select("name", F.col("v").cast("int").alias("version"), "template")


def latest_prompts(prompts: DataFrame) -> DataFrame:
    """S11 default: the highest version of each prompt, with the version list."""
    return prompts.groupBy("name").agg(F.sort_array(F.collect_list("version")).alias("versions"),
                                       F.max("version").alias("version"),
                                       F.max_by("template", "version").alias("template"))
