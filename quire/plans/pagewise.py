"""S8 + T4 by pages: the cleaned text of a book without the book in one row.

:func:`clean_pages_by_page` gives, page by page, the pieces whose
concatenation is exactly what :func:`quire.plans.cleanup.clean_pages` makes of
the merged book.  What a page needs from the rest of its book is small and
travels as a halo:

* **Markup** (T1, T2).  A ``<div`` or ``<table`` that a page leaves open is
  closed on a later page.  Every page says whether it can leave one open,
  whether it certainly ends outside of any (whatever it began in), and whether
  it holds a closing tag; fill-down scans over these flags tell which pages
  belong to one element, and only those are joined into one row.  An opening
  tag that is never closed joins nothing, as the pattern does not match it.
* **Block repair** (T3).  The rule of a block looks at its predecessor, its
  text at the rule of its successor: a page gets the last block of the page
  before and the first block of the page behind.
* **Blank lines.**  A page that is empty or only newlines has no block between
  two others; at either end of the book it leaves one empty block.
* **Positions.**  The start of a piece is a running total of lengths.

Every scan is two-level (:mod:`quire.operators.scan`), so a book of any number
of pages spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.text import replace_divs, replace_tables
from quire.operators.repair import block_features, blocks, emit_block, join_rule
from quire.operators.scan import join_same, two_level_scan
from quire.session import written

# pages that one first-level window holds
BLOCK_PAGES = 256
# the longest piece of a tag that a hyphen join can complete: "</table" and a hyphen
SEAM = 8

PAGE = ["__block", "__n"]


def tag_flags(text: Column, tag: str) -> tuple[Column, Column, Column]:
    """(opens, settles, closes) of one page for a lazy ``<tag ...>...</tag>``:
    begun outside, it ends inside of one; begun anywhere, it ends outside; it
    holds a closing tag."""
    # a newline in place of a match: what stands around it must not become a tag
    rest = lambda t: F.regexp_replace(t, f"(?isu)<{tag}[^>]*>.*?</{tag}>", "\n")
    left_open = lambda t: rest(t).rlike(f"(?iu)<{tag}")
    closes = lambda t: t.rlike(f"(?iu)</{tag}>")
    # begun inside of an element, or inside of its opening tag
    out_of_inside = lambda t: closes(t) & ~left_open(F.regexp_replace(t, f"(?isu)\\A.*?</{tag}>", ""))
    opens = left_open(text)
    settles = ~opens & out_of_inside(text) & text.contains(">") & out_of_inside(F.regexp_replace(text, r"(?s)\A[^>]*>", ""))
    return opens, settles, closes(text)


def _runs(pages: DataFrame, keys: list[str], seam: Column | None = None) -> DataFrame | None:
    """(keys, __block, __n, __run) of the pages that share an element with a
    neighbour, ``__run`` being the first page of theirs; None if there are
    none.  ``pages``: a written table with ``__event`` and ``__closes``.
    ``seam``: whether the join with the next page may complete a tag."""
    narrow = pages.select(*keys, *PAGE, "page", "__event", "__closes", (F.lit(False) if seam is None else seam).alias("__seam"))
    s = two_level_scan(narrow, keys, "__block", ["__n"], {
        "__state": ("last_before", "__event"), "__closed_later": ("first_after", "__closes"), "__seam_before": ("prev", "__seam")})
    inside = (F.col("__state") == "open") & F.coalesce(F.col("__closes"), F.col("__closed_later"), F.lit(False))
    glue = F.coalesce(inside, F.lit(False)) | F.coalesce(F.col("__seam_before.v"), F.lit(False))
    s = written(s.select(*keys, *PAGE, glue.alias("__glue"), F.when(~glue, F.struct(*PAGE, "page")).alias("__start")), "pagewise-runs")
    if s.where("__glue").isEmpty():
        return None
    s = two_level_scan(s, keys, "__block", ["__n"], {"__before": ("last_before", "__start"), "__next": ("next", "__glue")})
    s = s.where(F.col("__glue") | F.coalesce(F.col("__next.v"), F.lit(False)))
    return s.select(*keys, *PAGE, F.coalesce("__start", "__before").alias("__run"))


def _join_runs(pages: DataFrame, runs: DataFrame | None, keys: list[str], sep: str) -> DataFrame:
    """``pages`` (keys, __block, __n, page, text, n_pages, first, last) with
    the pages of a run joined by ``sep`` into its first."""
    kept = [*keys, *PAGE, "page", "text", "n_pages", "first", "last"]
    if runs is None:
        return pages.select(*kept)
    both = join_same(pages.select(*kept), runs, [*keys, *PAGE], "left")
    joined = (both.where(F.col("__run").isNotNull()).groupBy(*keys, "__run").agg(
        F.expr(f"listagg(text, '{sep}') WITHIN GROUP (ORDER BY __block, __n)").alias("text"), F.sum("n_pages").alias("n_pages"),
        F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))
        .select(*keys, "__run.*", "text", "n_pages", "first", "last").select(*kept))
    return both.where(F.col("__run").isNull()).select(*kept).unionByName(joined)


def _with_events(df: DataFrame, tag: str, text: Column, seam: Column | None = None) -> DataFrame:
    opens, settles, closes = tag_flags(text, tag)
    seam = F.lit(False) if seam is None else seam
    return df.withColumn("__event", F.when(opens | seam, "open").when(settles, "settled")).withColumn(
        "__closes", F.when(closes | seam, True))


def clean_pages_by_page(pages: DataFrame, keys: list[str], page_col: str = "page_id", text_col: str = "text",
                        tie_col: str | None = None, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """``keys, page_col, n_pages, start_pos, content``: the pieces of every
    book's cleaned text in the order of ``start_pos`` (0-based, code points).

    Pages with null or empty text or without a page id are dropped, as in the
    merge; pages of one id follow each other by ``tie_col`` (their text where
    none is given).  Pages that share an element of markup come as one piece
    under the first page's id with their number in ``n_pages``; pages that
    leave nothing between two others (only newlines) give no row.

    The pages are written three times on the way (with page numbers, without
    divs, repaired), and every scan starts from a written table.
    """
    p = pages.where((F.col(text_col) != "") & F.col(page_col).isNotNull())
    p = p.select(*keys, F.col(page_col).alias("page"), F.col(text_col).alias("text"), F.col(tie_col or text_col).alias("__tie"),
                 F.floor(F.col(page_col) / block_pages).alias("__block"), F.lit(1).cast("bigint").alias("n_pages"))
    w = Window.partitionBy(*keys, "__block").orderBy("page", "__tie")
    p = written(_with_events(p.withColumn("__n", F.row_number().over(w)).drop("__tie"), "div", F.col("text")), "pagewise-pages")
    runs = _runs(p, keys)
    p = two_level_scan(p, keys, "__block", ["__n"], {"__prev": ("prev", "__n"), "__next": ("next", "__n")})
    p = p.withColumn("first", F.col("__prev").isNull()).withColumn("last", F.col("__next").isNull())
    p = _join_runs(p, runs, keys, "\\n\\n").withColumn("text", replace_divs("text"))

    # the blank line between pages swallows the newlines at their ends
    p = p.withColumn("text", F.when(F.col("first"), F.col("text")).otherwise(F.regexp_replace("text", r"\A\n+", "")))
    p = p.withColumn("text", F.when(F.col("last"), F.col("text")).otherwise(F.regexp_replace("text", r"\n+\z", "")))
    p = p.where((F.col("text") != "") | F.col("first") | F.col("last"))
    ends = p.withColumn("__blocks", blocks("text"))
    p = written(ends.withColumn("__head", block_features(F.col("__blocks")[0])).withColumn("__tail", F.struct(
        block_features(F.element_at("__blocks", -1)).alias("block"), (F.col("first") & (F.size("__blocks") == 1)).alias("lone")))
        .drop("__blocks"), "pagewise-text")

    p = two_level_scan(p, keys, "__block", ["__n"], {"__before": ("prev", "__tail"), "__behind": ("next", "__head")})
    p = p.withColumn("__own", F.transform(blocks("text"), block_features)).drop("text")
    none = F.slice("__own", 1, 0)
    p = p.withColumn("__off", F.when(F.col("__before").isNotNull(), 1).otherwise(0)).withColumn("__all", F.concat(
        F.when(F.col("__before").isNotNull(), F.array(F.col("__before.v.block"))).otherwise(none), F.col("__own"),
        F.when(F.col("__behind").isNotNull(), F.array(F.col("__behind.v"))).otherwise(none)))
    p = p.withColumn("__rules", F.transform("__all", lambda x, i: join_rule(F.col("__all"), x, i)))
    at_start = F.col("first") | F.coalesce(F.col("__before.v.lone"), F.lit(False))
    pieces = F.transform("__all", lambda x, i: emit_block(F.col("__all"), F.col("__rules"), x, i, at_start))
    # a hyphen join leaves nothing between two pages: a tag cut there is whole again
    hyphen = F.coalesce(F.get("__rules", F.col("__off") + F.size("__own")) == "hyphen", F.lit(False))
    p = p.select(*keys, *PAGE, "page", "n_pages", "first", "last", hyphen.alias("__hyphen"),
                 F.array_join(F.slice(pieces, F.col("__off") + 1, F.size("__own")), "").alias("text"))
    p = p.withColumn("__seam", F.col("__hyphen") & F.expr(f"right(text, {SEAM})").contains("<")).drop("__hyphen")
    p = written(_with_events(p, "table", F.col("text"), F.col("__seam")), "pagewise-pieces")

    p = _join_runs(p, _runs(p, keys, F.col("__seam")), keys, "")
    p = p.select(*keys, *PAGE, "page", "n_pages", replace_tables("text").alias("content"))
    p = written(p.withColumn("__len", F.length("content").cast("bigint")), "pagewise-content")
    p = two_level_scan(p, keys, "__block", ["__n"], {"start_pos": ("sum_before", "__len")})
    return p.select(*keys, F.col("page").alias(page_col), "n_pages", "start_pos", "content")


def assembled(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, content``: the pieces put together, for users who want a book
    in one row."""
    return pieces.groupBy(*keys).agg(F.expr("listagg(content, '') WITHIN GROUP (ORDER BY start_pos, length(content))").alias("content"))
