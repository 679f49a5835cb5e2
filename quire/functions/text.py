"""Column -> Column text functions (JVM-side, codegen or HOF; no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed

WS = fixed.WHITESPACE
WS_CLASS = fixed.java_class_body(WS)
WORD = fixed.WORD_CLASS

DIV_PATTERN, ALT_PATTERN, TABLE_PATTERN = fixed.DIV_PATTERN, fixed.ALT_PATTERN, fixed.TABLE_PATTERN
ROW_PATTERN = r"(?isu)<tr[^>]*>(.*?)</tr>"
CELL_PATTERN = r"(?isu)<t[hd][^>]*>(.*?)</t[hd]>"
# sentence marker used to split text into sentences in both engines
SENTENCE_MARK = "\u0001"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """``str.strip()``: trims the whole Unicode whitespace set, not only U+0020."""
    return F.btrim(col_of(c), F.lit(WS))


def normalise_newlines(c) -> Column:
    """Universal-newline reading: ``\\r\\n`` and ``\\r`` become ``\\n``."""
    return F.regexp_replace(col_of(c), r"\r\n?", "\n")


def _interleave(text: Column, pattern: str, replace_fn) -> Column:
    """Replace every match of ``pattern`` (dot-all, any case) by ``replace_fn(match)``.

    ``regexp_replace`` cannot transform a capture, so the text is split on the
    pattern and the transformed matches are put back between the pieces.
    """
    # (?u): case-insensitive matching is Unicode-aware, as in the original
    pieces = F.split(text, f"(?isu){pattern}", -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(f"(?isu)({pattern})"), 1), replace_fn)
    return F.array_join(
        F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(matches, i), F.lit("")))), "")


def replace_divs(c) -> Column:
    """Each ``<div ...>...</div>`` (lazy, dot-all, any case) becomes ``[ALT]``
    with the upper-cased first non-empty double-quoted ``alt`` inside it, or
    disappears when there is none."""

    def repl(d: Column) -> Column:
        alt = F.regexp_extract(d, ALT_PATTERN, 1)
        return F.when(alt != "", F.concat(F.lit("["), F.upper(alt), F.lit("]"))).otherwise(F.lit(""))

    return _interleave(col_of(c), DIV_PATTERN, repl)


def _clean_cell(c: Column) -> Column:
    no_tags = F.regexp_replace(c, r"<[^>]+>", "")
    collapsed = F.regexp_replace(no_tags, f"[{WS_CLASS}]+", " ")
    return F.regexp_replace(strip(collapsed), r"\|", r"\\|")


def table_rows(table_html: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: cleaned cell texts per ``<tr>`` of one table."""
    rows = F.regexp_extract_all(table_html, F.lit(ROW_PATTERN), 1)
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL_PATTERN), 1), _clean_cell))


def _md_table(table_html: Column) -> Column:
    rows = table_rows(table_html)

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    header = F.get(rows, 0)
    rule = F.concat(F.lit("|"), F.array_join(F.transform(header, lambda x: F.lit(" --- ")), "|"), F.lit("|"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    lines = F.concat(F.array(line(header), rule), body)
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def replace_tables(c) -> Column:
    """Each ``<table>..</table>`` becomes a Markdown pipe table.

    Our rule: the first row is the header, a ``---`` rule follows, cell text has
    its tags removed, whitespace collapsed and pipes escaped.
    """
    return _interleave(col_of(c), TABLE_PATTERN, _md_table)


def clean_summary(c) -> Column:
    """Drop the two boilerplate headings, cut at the first keyword marker
    (the Portuguese one wins even when the English one comes first), strip."""
    t = col_of(c)
    for heading in fixed.SUMMARY_HEADINGS:
        t = F.replace(t, F.lit(heading), F.lit(""))
    first, second = fixed.KEYWORD_MARKERS
    k = F.when(F.instr(t, first) > 0, F.instr(t, first)).otherwise(F.instr(t, second))
    cut = F.when(k > 0, t.substr(F.lit(1), k - 1)).otherwise(t)
    return strip(cut)


def first_word(c) -> Column:
    return F.regexp_extract(col_of(c), f"[{WORD}]+", 0)


def last_word(c) -> Column:
    """The last run of word characters: the first word of the reversed text,
    reversed back (an anchored-at-end regex would restart at every position
    of every word; the class is per code point, so reversal is exact)."""
    return F.reverse(F.regexp_extract(F.reverse(col_of(c)), f"[{WORD}]+", 0))


def sentences(c) -> Column:
    """ARRAY<STRING>: non-empty stripped sentences.  A sentence ends at a run
    of ``. ! ? …`` followed by spaces/tabs, or at a line break."""
    t = F.regexp_replace(col_of(c), r"([.!?…])[ \t]+", "$1" + SENTENCE_MARK)
    t = F.regexp_replace(t, r"[ \t]*\n[ \t\n]*", SENTENCE_MARK)
    # splitting on the marker together with the whitespace around it, after
    # stripping the ends, yields stripped pieces without a per-piece lambda
    pieces = F.split(strip(t), f"[{WS_CLASS}]*{SENTENCE_MARK}[{WS_CLASS}]*", -1)
    return F.array_remove(pieces, "")


def word_tokens(c) -> Column:
    """ARRAY<STRING>: lower-cased Unicode word tokens."""
    return F.array_remove(F.split(F.lower(col_of(c)), f"[^{WORD}]+", -1), "")


def rouge_tokens(c) -> Column:
    """ARRAY<STRING>: ROUGE tokenisation: lower-case, every run outside
    ``a-z0-9`` separates tokens (accented letters split words)."""
    return F.array_remove(F.split(F.lower(col_of(c)), r"[^a-z0-9]+", -1), "")


def parse_lines(c) -> Column:
    """ARRAY<STRING>: the non-blank stripped lines of a keyword/category answer."""
    return F.filter(F.transform(F.split(col_of(c), "\n", -1), strip), lambda x: x != "")


def explode_table_cells(df, keys: list, text_col: str):
    """One row per table cell: ``keys, table_no, row_no, col_no,
    is_header, cell`` (first row of a table is the header)."""
    tables = F.regexp_extract_all(F.col(text_col), F.lit(f"(?isu)({TABLE_PATTERN})"), 1)
    t = df.select(*keys, F.posexplode_outer(tables).alias("table_no", "t")).filter(F.col("t").isNotNull())
    r = t.select(*keys, "table_no", F.posexplode_outer(table_rows(F.col("t"))).alias("row_no", "cells")).filter(
        F.col("cells").isNotNull())
    c = r.select(*keys, "table_no", "row_no", F.posexplode_outer("cells").alias("col_no", "cell")).filter(
        F.col("cell").isNotNull())
    return c.withColumn("is_header", F.col("row_no") == 0)
