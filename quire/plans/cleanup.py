"""S8 + T4 + F9: pages of a book -> one cleaned text per book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.text import replace_divs, replace_tables
from quire.operators.repair import repair_blocks


def merge_pages(pages: DataFrame, keys: list[str], page_col: str = "page_id",
                text_col: str = "text", tie_col: str | None = None) -> DataFrame:
    """Non-empty page texts in page-id order joined by a blank line.

    ``collect_list`` is a partial aggregate: each map task pre-collects its
    pages per book before the shuffle.  The grouped value is one book's text,
    the unit of output, so its size is that of one book
    (:mod:`quire.plans.pagewise` does without).  Pages of one id are ordered by
    ``tie_col`` (the file name, where there is one), then by text.
    """
    pages = pages.filter(F.col(text_col) != "")
    return pages.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page_col, *([tie_col] if tie_col else []), text_col))),
                                 lambda x: x[text_col]), fixed.BLANK_LINE).alias("content"),
        F.count("*").cast("bigint").alias("n_pages"))


def clean_text(df: DataFrame, steps, text_col: str = "content") -> DataFrame:
    """T4: left-to-right composition of ``Column -> Column`` steps; a step
    may also be ``'repair'`` for the block repair (a multi-projection step)."""
    for step in steps:
        if step == "repair":
            df = repair_blocks(df, text_col, text_col)
        else:
            df = df.withColumn(text_col, step(F.col(text_col)))
    return df


PAGE_FOLDER_STEPS = (replace_divs, "repair", replace_tables)
SINGLE_FILE_STEPS = (replace_divs, replace_tables)


def clean_pages(pages: DataFrame, keys: list[str], page_col: str = "page_id",
                text_col: str = "text") -> DataFrame:
    """A folder of pages: merge, then divs -> block repair -> tables."""
    return clean_text(merge_pages(pages, keys, page_col, text_col), PAGE_FOLDER_STEPS)
