"""C1-C3 chunk planning: contiguous, covering chunks cut just behind a newline.

From a cursor ``start`` the next cut is just behind the first newline at or
after ``start + max_chunk``; if there is none, or the text ends first, the rest
is one chunk.  The cut sequence is a left fold over the newline positions,
expressed with ``aggregate`` on the row's own line-length array: the plan is
row-local (no shuffle) and linear in the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.text import col_of

_SPLIT_T = "array<struct<initial_pos:bigint,end_pos:bigint>>"


def check_max_chunk(max_chunk: int) -> int:
    if max_chunk is None or int(max_chunk) <= 0:
        raise ValueError(f"max_chunk must be positive (window smaller than the prompt?): {max_chunk}")
    return int(max_chunk)


def split_bounds(text, max_chunk) -> Column:
    """ARRAY<STRUCT<initial_pos, end_pos>> (0-based, half-open, code points).

    ``text`` is a column; ``max_chunk`` an int or a column (per-row limit).
    Callers should pass the line-length array precomputed (see
    :func:`plan_splits`); here it is derived inline.
    """
    return _fold(F.transform(F.split(col_of(text), "\n", -1), F.length), F.length(col_of(text)), max_chunk)


def _fold(line_lens: Column, total: Column, max_chunk) -> Column:
    mx = F.lit(max_chunk).cast("bigint") if isinstance(max_chunk, int) else max_chunk.cast("bigint")
    # every line but the last is followed by a newline
    with_newline = F.slice(line_lens, 1, F.greatest(F.size(line_lens) - 1, F.lit(0)))
    init = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("start"),
                    F.array().cast(_SPLIT_T).alias("out"))

    def step(acc, n):
        nl = acc["pos"] + n.cast("bigint")          # index of this line's newline
        cut = nl >= acc["start"] + mx
        piece = F.array(F.struct(acc["start"].alias("initial_pos"), (nl + 1).alias("end_pos")))
        return F.struct((nl + 1).alias("pos"),
                        F.when(cut, nl + 1).otherwise(acc["start"]).alias("start"),
                        F.when(cut, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    def finish(acc):
        tail = F.array(F.struct(acc["start"].alias("initial_pos"), total.cast("bigint").alias("end_pos")))
        return F.when(acc["start"] < total, F.concat(acc["out"], tail)).otherwise(acc["out"])

    return F.aggregate(with_newline, init, step, finish)


def plan_splits(df: DataFrame, max_chunk, text_col: str = "text", keep_chunk: bool = True,
                index_col: str = "split_index") -> DataFrame:
    """One row per chunk: ``index_col, initial_pos, end_pos`` (+ ``chunk``).

    The line-length array is computed in its own projection so the fold's
    lambda does not re-split the text per element.
    """
    if isinstance(max_chunk, int):
        check_max_chunk(max_chunk)
    lens = "__line_lens"
    staged = df.withColumn(lens, F.transform(F.split(F.col(text_col), "\n", -1), F.length))
    planned = staged.withColumn(
        "__splits", _fold(F.col(lens), F.length(F.col(text_col)), max_chunk)).drop(lens)
    keep = [c for c in df.columns if keep_chunk or c != text_col]
    # outer explode + null filter: a plain explode makes Catalyst infer a
    # size(...) > 0 filter and push it below the projections, which inlines
    # the whole upstream expression tree into one predicate
    out = (planned.select(*keep, F.posexplode_outer("__splits").alias(index_col, "__s"))
           .filter(F.col("__s").isNotNull()))
    out = out.select(*keep, F.col(index_col).cast("bigint").alias(index_col),
                     F.col("__s.initial_pos").alias("initial_pos"), F.col("__s.end_pos").alias("end_pos"))
    if keep_chunk:
        out = out.withColumn("chunk", cut_chunk(F.col(text_col), F.col("initial_pos"), F.col("end_pos")))
    return out


def cut_chunk(text: Column, start: Column, end: Column) -> Column:
    """``content[start:end]``."""
    return text.substr((start + 1).cast("int"), (end - start).cast("int"))


def target_size(chunk) -> Column:
    """``int(len(chunk) * 0.10)`` (integer division is exact and equal)."""
    return F.floor(F.length(col_of(chunk)) / fixed.TARGET_DIVISOR).cast("bigint")
