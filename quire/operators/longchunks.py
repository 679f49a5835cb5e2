"""C1 for texts of any length: chunk planning over rows of lines.

:func:`quire.operators.chunks.plan_splits` folds over the line array of one
row.  Here a text is a table of lines, and no row, task or driver sees it
whole.  The end of a chunk is decided by its *query*, the first position at
which a newline may end it (its start plus the limit); the newline found gives
the next query.  A chunk plan is therefore the orbit of one number under a
successor function, and orbits can be cut:

1. Positions of newlines by a two-level prefix sum over line lengths, packed
   into blocks of ``block_chars`` characters.
2. Each block doubles its successors (every newline jumps to the newline two,
   four, eight chunks on) until all have left it: a newline's *exit* is the
   query with which a plan that passes it leaves the block.  Few differ, as
   they lie within one limit behind the block.
3. These queries are looked up in the block where they end, which gives a
   successor table over queries, small beside the lines; doubling it, round by
   round, finds the queries that the plan from position 0 really makes.
4. Blocks that are entered by one of these cut their chunks.

Rounds grow with the logarithm of the number of blocks; every step is written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.chunks import check_max_chunk
from quire.operators.scan import join_same, two_level_scan
from quire.session import ship_package, written

BLOCK_CHARS = 1 << 20
# lines, blocks and chunks in one first-level window
SCAN_ROWS = 1 << 14


def line_positions(lines: DataFrame, keys: list[str], line_col: str, length_col: str) -> DataFrame:
    """``keys, newline``: the position behind every line's characters.  The last
    line of a text has no newline there; it may count as one all the same, as
    the chunk that it would end ends with the text."""
    rows = lines.select(*keys, F.col(line_col).alias("__line"), F.col(length_col).cast("bigint").alias("__len"),
                        F.floor(F.col(line_col) / SCAN_ROWS).alias("__block")).withColumn("__step", F.col("__len") + 1)
    placed = two_level_scan(rows, keys, "__block", ["__line"], {"start": ("sum_before", "__step")})
    return placed.select(*keys, (F.col("start") + F.col("__len")).alias("newline"))


def successors(newlines: np.ndarray, limit: int, block_end: int) -> tuple[np.ndarray, np.ndarray]:
    """Per newline of a block: the place of the newline that ends the next
    chunk (its own place where that lies outside), and the exit query."""
    query = newlines + 1 + limit
    to = np.searchsorted(newlines, query)
    own = np.arange(len(newlines))
    inside = to < len(newlines)
    step = np.where(inside, to, own)
    # no newline between the query and the end of the block: as good as asked there
    leave = np.maximum(query, block_end)
    last = step
    while True:
        further = last[last]
        if (further == last).all():
            return step, leave[last]
        last = further


def _blocks_of(pdf: pd.DataFrame, block_chars: int):
    for row in pdf.itertuples(index=False):
        yield row, np.asarray(row.newlines, np.int64), (row.blk + 1) * block_chars


def plan_line_splits(lines: DataFrame, keys: list[str], max_chunk: int, line_col: str = "line_no", length_col: str = "n_chars",
                     block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keys, split_index, initial_pos, end_pos`` of every text in ``lines``
    (one row per line, numbered from 0 without gaps, its length without the
    newline): the same plan as for the joined text in one row.  A text without
    characters has no chunk.  The numbering has to be unique per key."""
    limit = check_max_chunk(max_chunk)
    ship_package(lines.sparkSession)
    placed = written(line_positions(lines, keys, line_col, length_col), "splits-lines")
    at = [*keys, "blk"]
    schema = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)
    blk = F.floor(F.col("newline") / block_chars)
    # newlines of a block, no more than its characters
    blocks = written(placed.groupBy(*keys, blk.alias("blk")).agg(F.sort_array(F.collect_list("newline")).alias("newlines")), "splits-blocks")

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, newlines, block_end in _blocks_of(pdf, block_chars):
                found = pd.DataFrame({"query": np.unique(successors(newlines, limit, block_end)[1])})
                for k in reversed(keys):
                    found.insert(0, k, getattr(row, k))
                yield found

    texts = placed.groupBy(*keys).agg(F.max("newline").alias("n")).where(F.col("n") > 0)
    first = texts.select(*keys, F.lit(limit).cast("bigint").alias("query"))
    asked = blocks.mapInPandas(exits, f"{schema}, query bigint").unionByName(first).distinct()
    # the block that answers a query: its own if a newline follows there, else the next that has any
    ends = blocks.select(*keys, "blk", F.element_at("newlines", -1).alias("last"))
    points = written(asked.select(*keys, F.floor(F.col("query") / block_chars).alias("blk"), "query", F.lit(None).cast("bigint").alias("last")).unionByName(
        ends.select(*keys, "blk", F.lit(None).cast("bigint").alias("query"), "last")).withColumn("group", F.floor(F.col("blk") / SCAN_ROWS))
        .withColumn("place", F.coalesce("query", F.lit(-1))), "splits-queries")
    # rows of a block: first the block itself, then the queries into it
    seen = two_level_scan(points.withColumn("there", F.when(F.col("query").isNull(), F.col("blk"))), keys, "group", ["blk", "place"],
                          {"next_block": ("first_after", "there"), "mine": ("last_before", "last"), "my_block": ("last_before", "there")})
    inside = (F.col("my_block") == F.col("blk")) & (F.col("mine") >= F.col("query"))
    target = F.when(F.coalesce(inside, F.lit(False)), F.col("blk")).otherwise(F.col("next_block"))
    queries = written(seen.where("query is not null").select(*keys, target.alias("blk"), "query").where("blk is not null"), "splits-asked")

    def answered(found: DataFrame) -> DataFrame:
        return join_same(blocks, found.groupBy(*at).agg(F.collect_list("query").alias("queries")), at)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, newlines, block_end in _blocks_of(pdf, block_chars):
                asked = np.asarray(row.queries, np.int64)
                found = pd.DataFrame({"query": asked, "then": successors(newlines, limit, block_end)[1][np.searchsorted(newlines, asked)]})
                for k in reversed(keys):
                    found.insert(0, k, getattr(row, k))
                yield found

    jump = written(answered(queries).mapInPandas(follow, f"{schema}, query bigint, `then` bigint"), "splits-jumps")
    made = written(first, "splits-made")
    while True:
        reached = join_same(made, jump, [*keys, "query"]).select(*keys, F.col("then").alias("query"))
        more = written(made.unionByName(reached).distinct(), "splits-made")
        if more.count() == made.count():
            break
        made = more
        far = jump.select(*keys, F.col("query").alias("then"), F.col("then").alias("far"))
        jump = written(join_same(jump, far, [*keys, "then"]).select(*keys, "query", F.col("far").alias("then")), "splits-jumps")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, newlines, block_end in _blocks_of(pdf, block_chars):
                step, _ = successors(newlines, limit, block_end)
                out = []
                for at in np.searchsorted(newlines, np.asarray(row.queries, np.int64)).tolist():
                    out.append(at)
                    while step[at] != at:
                        at = int(step[at])
                        out.append(at)
                found = pd.DataFrame({"end": newlines[out] + 1})
                for k in reversed(keys):
                    found.insert(0, k, getattr(row, k))
                yield found

    entered = join_same(queries, made, [*keys, "query"], "left_semi")
    cuts = answered(entered).mapInPandas(cut, f"{schema}, `end` bigint").distinct().withColumn("final", F.lit(None).cast("boolean"))
    cuts = cuts.unionByName(texts.select(*keys, F.col("n").alias("end"), F.lit(True).alias("final")))
    # one row for each end; the text's own end where a chunk ends there too
    cuts = cuts.groupBy(*keys, "end").agg(F.max("final").alias("final")).withColumn("blk", F.floor(F.col("end") / block_chars))
    cuts = written(cuts.withColumn("one", F.lit(1).cast("bigint")), "splits-cuts")
    out = two_level_scan(cuts, keys, "blk", ["end"], {
        "before": ("prev", "end"), "split_index": ("sum_before", "one"), "beyond": ("last_before", "final")})
    # what ends behind the text was ended by the last line
    return out.where(F.col("beyond").isNull()).select(
        *keys, "split_index", F.coalesce("before.v", F.lit(0).cast("bigint")).alias("initial_pos"), F.col("end").alias("end_pos"))


def text_lines(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, line_no, n_chars`` out of texts that fit a row."""
    lengths = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), F.length)
    return texts.select(*keys, F.posexplode_outer(lengths).alias("line_no", "n_chars"))
