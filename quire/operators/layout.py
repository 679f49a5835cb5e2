"""L1/L2: layout checks over a table of file paths (``relpath, parts``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stem(name):
    return F.regexp_replace(name, r"\.[^.]*$", "")


def layout_issues(files: DataFrame) -> DataFrame:
    """L1: per language folder, (a) a PDF directly in it, (b) a book folder
    without PDF, (c) with several, (d) one PDF whose stem differs from the
    folder.  ``.pdf`` is matched in any case; only direct children count.
    Returns ``language, item, issue``; no rows means the layout is valid.
    (b) needs some other file in the folder to be visible to a file scan."""
    f = files.select(F.col("parts")[0].alias("language"), F.size("parts").alias("depth"), "parts")
    is_pdf = F.lower(F.element_at("parts", -1)).endswith(".pdf")
    loose = f.filter((F.col("depth") == 2) & is_pdf).select(
        "language", F.col("parts")[1].alias("item"), F.lit("loose_pdf").alias("issue"))
    inner = f.filter(F.col("depth") >= 3).select(
        "language", F.col("parts")[1].alias("folder"),
        F.when((F.col("depth") == 3) & is_pdf, F.col("parts")[2]).alias("pdf"))
    per = inner.groupBy("language", "folder").agg(F.count("pdf").alias("n_pdf"), F.max("pdf").alias("pdf"))
    issue = (F.when(F.col("n_pdf") == 0, "folder_without_pdf")
             .when(F.col("n_pdf") > 1, "folder_with_several_pdfs")
             .when(_stem(F.col("pdf")) != F.col("folder"), "pdf_not_named_after_folder"))
    item = F.when(F.col("n_pdf") == 1, F.concat_ws("/", "folder", "pdf")).otherwise(F.col("folder"))
    books = per.select("language", item.alias("item"), issue.alias("issue")).filter(F.col("issue").isNotNull())
    return loose.unionByName(books)


def plan_layout(files: DataFrame) -> DataFrame:
    """L2: every PDF at any depth under a language folder whose parent folder
    is not named after it gets a target ``<parent>/<stem>/<file>`` (a plan;
    the move itself is left to the caller)."""
    f = files.filter((F.size("parts") >= 2) & F.lower(F.element_at("parts", -1)).endswith(".pdf"))
    name = F.element_at("parts", -1)
    parent = F.element_at("parts", -2)
    folder = F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/")
    return f.filter(parent != _stem(name)).select(
        F.col("parts")[0].alias("language"), F.col("relpath").alias("src"),
        F.concat_ws("/", folder, _stem(name), name).alias("dst"))
