"""Hard-negative mining by exact integer inner products of tiles.

Components become integers, ``floor(scale * x)``; the score of two rows is
their inner product.  An anchor's positives are its best rows of its label;
for every positive the best rows of other labels are kept whose score lies in
a window of the positive's score, near enough to be hard, not so near that
they could be positives themselves.

Every anchor meets every row, in blocks: anchors and rows are dealt into the
cells of a grid (fragment and replicate), each cell a bounded number of either
(``CELL_ANCHORS``, ``CELL_ROWS``, fewer where vectors are long), and a cell
multiplies its tiles of int64 by Strassen's recursion: seven products of half
the size, odd sizes padded with zeros, additions exact.  int64 wraps, and
sums and products modulo 2^64 agree with the true ones whenever the result
fits, which the bound on the norms below guarantees.  Only the best of a cell
leave it, as heaps of fixed size that merge into one another: in the task tile
by tile, between cells by a rank that Spark cuts before its shuffle.  Two such
passes are needed, as a window is known once all positives are: the first
multiplies rows of equal labels only.

Cells are dealt by row number, so neither a frequent label nor copies of a
row gather in one of them.  The rows are written once, as integers, to the
shared folder; a lost executor costs the cells it held.

Cases: rows without id, label or vector, or with a component that is null or
not finite, take no part, nor do vectors whose integers have a squared norm of
2^62 or more (their scores might not fit a long; for components below 2^20 and
64 dimensions that cannot happen).  Shorter vectors count as padded with
zeros, an empty one scores 0.  Rows equal in id, label and vector count once;
rows that share an id but differ are rows of their own.  Ties go to the smaller
id.  An anchor without positives, or a positive without negatives, gives no
rows, nor does an empty table.  Other columns are ignored whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import stash

# rows of a cell of the grid, and their components
CELL_ANCHORS, CELL_ROWS, CELL_NUMBERS = 2048, 8192, 1 << 22
# tiles that one recursion multiplies, and the side below which it stops
TILE_ANCHORS, TILE_ROWS, LEAF = 512, 2048, 16
MAX_NORM = float(1 << 62)
NONE = np.iinfo(np.int64).min  # below every score


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices modulo 2^64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, q, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :q], a[:h, q:], a[h:, :q], a[h:, q:]
    b11, b12, b21, b22 = b[:q, :w], b[:q, w:], b[q:, :w], b[q:, w:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * w), np.int64)
    out[:h, :w] = p1 + p4 - p5 + p7
    out[:h, w:] = p3 + p5
    out[h:, :w] = p2 + p4
    out[h:, w:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best ``size`` of (score, id, key) for each of ``n`` anchors, best
    first: higher scores, then smaller ids, then smaller keys."""

    def __init__(self, n: int, size: int):
        self.score = np.full((n, size), NONE)
        self.id = np.zeros((n, size), np.int64)
        self.key = np.zeros((n, size), np.int64)

    def merge(self, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """Take in a tile: ``score`` (NONE: not a candidate, overwritten here)
        of every anchor and column; columns ascend by (id, key)."""
        line, size = np.arange(len(score)), self.score.shape[1]
        tops = []
        for _ in range(min(size, score.shape[1])):
            at = score.argmax(axis=1)  # the first of equal scores: the smallest id
            tops.append((score[line, at], ids[at], keys[at]))
            score[line, at] = NONE
        s, i, k = (np.hstack([old, np.stack(new, axis=1)]) for old, new in zip((self.score, self.id, self.key), zip(*tops)))
        first = np.lexsort((k, i, ~s))[:, :size]
        self.score, self.id, self.key = (np.take_along_axis(x, first, axis=1) for x in (s, i, k))


def integer_rows(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, label, v) of the rows that take part; ``key`` tells rows of
    one id apart."""
    v = F.transform(vectors[vector_col], lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = F.forall(vectors[vector_col], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(vectors[id_col].isNotNull() & vectors[vector_col].isNotNull() & finite).select(
        vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where(F.col("label").isNotNull() & (norm < MAX_NORM)).select("id", F.xxhash64("label", "v").alias("key"), "label", "v")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to the longest."""
    held = column.combine_chunks()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(held), int(lengths.max(initial=0)) or 1), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, keys, labels, vectors: each row once, ascending by id and key."""
    ids, keys, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "key", "label"))
    order = np.lexsort((keys, ids))
    again = np.zeros(len(order), bool)
    again[1:] = (ids[order][1:] == ids[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    order = order[~again]
    return ids[order], keys[order], labels[order], matrix(table.column("v"))[order]


def tiles(a: np.ndarray, b: np.ndarray):
    """(anchors, [(rows, scores), ...]) of the tiles of ``a`` times ``b``
    transposed; the inner pairs are made one at a time."""
    k = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, k - x.shape[1]))) for x in (a, b))
    for i in range(0, len(a), TILE_ANCHORS):
        mine = slice(i, i + TILE_ANCHORS)
        parts = (slice(j, j + TILE_ROWS) for j in range(0, len(b), TILE_ROWS))
        yield mine, ((part, strassen(a[mine], b[part].T)) for part in parts)


POSITIVE = "a_id long, a_key long, id long, key long, score long"
NEGATIVE = "a_id long, a_key long, nth int, positive_id long, positive_score long, id long, key long, score long"


def _cell_positives(size: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 5), np.int64)]
        if left.num_rows and right.num_rows:
            a_ids, a_keys, a_labels, a = unpack(left)
            ids, keys, labels, b = unpack(right)
            for label in np.unique(a_labels):
                mine, same = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
                if not len(same):
                    continue
                for rows, columns in tiles(a[mine], b[same]):
                    own_id, own_key, col_id, col_key = a_ids[mine][rows], a_keys[mine][rows], ids[same], keys[same]
                    heaps = Heaps(len(own_id), size)
                    for cols, s in columns:
                        s[(own_id[:, None] == col_id[cols]) & (own_key[:, None] == col_key[cols])] = NONE
                        heaps.merge(s, col_id[cols], col_key[cols])
                    at, nth = np.nonzero(heaps.score != NONE)
                    out.append(np.stack([own_id[at], own_key[at], heaps.id[at, nth], heaps.key[at, nth], heaps.score[at, nth]], axis=1))
        held = np.concatenate(out)
        return pa.table({c: held[:, i] for i, c in enumerate(("a_id", "a_key", "id", "key", "score"))})
    return run


def window_bounds(score: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer between the fractions ``low`` and ``high``
    of each score, without leaving 64 bits."""
    q, r = np.divmod(score, low[1])
    least = low[0] * q - (-low[0] * r) // low[1]
    q, r = np.divmod(score, high[1])
    return least, high[0] * q + high[0] * r // high[1]


def _cell_negatives(size: int, low: tuple[int, int], high: tuple[int, int]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 8), np.int64)]
        if left.num_rows and right.num_rows:
            positives = {(i, k): (p, s) for i, k, p, s in zip(*(left.column(c).to_pylist() for c in ("id", "key", "p_ids", "p_scores")))}
            a_ids, a_keys, a_labels, a = unpack(left)
            ids, keys, labels, b = unpack(right)
            for rows, columns in tiles(a, b):
                own_id, own_key = a_ids[rows], a_keys[rows]
                held = [positives[x] for x in zip(own_id.tolist(), own_key.tolist())]
                most = max(len(p) for p, _ in held)
                p_ids, p_scores = np.zeros((len(held), most), np.int64), np.zeros((len(held), most), np.int64)
                for i, (p, s) in enumerate(held):
                    p_ids[i, :len(p)], p_scores[i, :len(p)] = p, s
                there = np.arange(most) < np.array([len(p) for p, _ in held])[:, None]
                least, greatest = window_bounds(p_scores, low, high)
                least[~there], greatest[~there] = 1, 0
                heaps = [Heaps(len(held), size) for _ in range(most)]
                for cols, s in columns:
                    s[a_labels[rows][:, None] == labels[cols]] = NONE
                    for nth, heap in enumerate(heaps):
                        fits = (s >= least[:, nth, None]) & (s <= greatest[:, nth, None])
                        heap.merge(np.where(fits, s, NONE), ids[cols], keys[cols])
                for nth, heap in enumerate(heaps):
                    at, k = np.nonzero(heap.score != NONE)
                    out.append(np.stack([own_id[at], own_key[at], np.full(len(at), nth), p_ids[at, nth], p_scores[at, nth],
                                         heap.id[at, k], heap.key[at, k], heap.score[at, k]], axis=1))
        held = np.concatenate(out)
        names = ("a_id", "a_key", "nth", "positive_id", "positive_score", "id", "key", "score")
        return pa.table({c: pa.array(held[:, i]).cast(pa.int32()) if c == "nth" else held[:, i] for i, c in enumerate(names)})
    return run


def _grid(anchors: DataFrame, rows: DataFrame, r: int, c: int, run, schema: str) -> DataFrame:
    """``run`` over every cell of ``r`` times ``c``: anchors are dealt to grid
    rows and sent to all columns, rows the other way round."""
    number = F.monotonically_increasing_id()
    left = anchors.withColumn("r", F.pmod(number, F.lit(r)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    right = rows.withColumn("c", F.pmod(number, F.lit(c)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(run, schema)


def _best(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Heaps of all cells merged: the first ``size`` of each key, as ``rank``.
    A copied row comes from several cells, with one rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= size).dropDuplicates([*keys, "rank"])


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3,
                   low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), scale: int = 256,
                   id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each of an anchor's first ``positives`` other rows of
    its label the first ``negatives`` rows of other labels whose score is
    within ``low`` and ``high`` (numerator, denominator) of the positive's.
    ``is_anchor`` is a condition on ``id``."""
    held = stash(integer_rows(vectors, label, scale, id_col, vector_col), "negatives-rows")
    size = held.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a"), F.max(F.size("v")).alias("k")).first()
    width = max(size["k"] or 1, 1)
    r = max(1, -(-size["a"] // max(1, min(CELL_ANCHORS, CELL_NUMBERS // width))))
    c = max(1, -(-size["n"] // max(1, min(CELL_ROWS, CELL_NUMBERS // width))))
    anchors = held.where(is_anchor)
    found = _best(_grid(anchors, held, r, c, _cell_positives(positives), POSITIVE), ["a_id", "a_key"], positives)
    lists = found.groupBy("a_id", "a_key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    windows = anchors.join(lists.select(F.col("a_id").alias("id"), F.col("a_key").alias("key"), F.col("p.id").alias("p_ids"),
                                        F.col("p.score").alias("p_scores")), ["id", "key"])
    windows = stash(windows, "negatives-anchors")
    mined = _best(_grid(windows, held, r, c, _cell_negatives(negatives, low, high), NEGATIVE), ["a_id", "a_key", "nth"], negatives)
    return mined.select(F.col("a_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))


ORACLE = """
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM held a JOIN held b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
