"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words.  A rolling
Karp-Rabin value over ``min_match`` words seeds the search: a document is
compared with an item only if they share a seed.  For such a pair, maximal
common runs are found by running the seeds along diagonals, and the longest
run that overlaps no earlier tile is marked again and again until no run of
``min_match`` words is left (greedy string tiling).  Tiles may come in any
order, so passages that were cut up and reordered still count.  A document is
contaminated by an item if the tiles cover at least ``coverage`` of its words.

Scale.  Seeds of the benchmark are spread to the tasks in blocks of at most
``block_words`` benchmark words, one pass over the documents per block, so a
benchmark of any size is searched with bounded memory; an ordinary benchmark
is one block and the documents are read once, without any shuffle.  A passage
that a third of all documents share costs each of them one tiling.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_MATCH = 5
COVERAGE = 0.8
# words of benchmark text that one pass holds in each task (about 100 MB)
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values (mod 2**64) of all windows of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + ids[k:k + n]
    return out


def common_runs(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Maximal runs (length, doc start, item start) of at least ``width``
    equal ids.  Memory is in proportion to the document and the runs."""
    hd, hi = rolling(doc, width), rolling(item, width)
    if not len(hd) or not len(hi):
        return []
    at = np.flatnonzero(np.isin(hd, hi))
    if not len(at):
        return []
    keys = hd[at]
    follows = np.concatenate(([False], np.diff(at) == 1))
    before = np.zeros(len(at), np.int64)  # windows of the run that ends at each place, for the item place before
    out = []
    for i in range(len(hi) + 1):
        now = np.zeros(len(at), np.int64)
        if i < len(hi):
            hit = keys == hi[i]
            # equal values are compared word by word
            places = np.flatnonzero(hit)
            if len(places):
                same = (doc[at[places][:, None] + np.arange(width)] == item[i:i + width]).all(axis=1)
                places = places[same]
                prev = np.where(follows[places], before[places - 1], 0)
                now[places] = prev + 1
        # runs of the item place before that do not go on
        ended = np.flatnonzero(before)
        if len(ended):
            nxt = ended + 1
            on = np.zeros(len(ended), bool)
            ok = nxt < len(at)
            on[ok] = follows[nxt[ok]] & (now[nxt[ok]] == before[ended[ok]] + 1)
            for e in ended[~on].tolist():
                n = int(before[e])
                out.append((n + width - 1, int(at[e]) - n + 1, i - n))
        before = now
    return out


def greedy_tiles(doc: np.ndarray, item: np.ndarray, width: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (length, doc start, item start), longest first;
    ties go to the earliest place in the document, then in the item."""
    heap = [(-n, d, i) for n, d, i in common_runs(doc, item, width)]
    heapq.heapify(heap)
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles = []
    left = len(item)
    while heap and left >= width:
        n, d, i = heapq.heappop(heap)
        n = -n
        taken = used_doc[d:d + n] | used_item[i:i + n]
        if not taken.any():
            used_doc[d:d + n] = True
            used_item[i:i + n] = True
            tiles.append((n, d, i))
            left -= n
            continue
        # the free pieces of a partly marked run are runs of their own
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= width:
                heapq.heappush(heap, (-(e - s), d + s, i + s))
    return tiles


class BenchmarkIndex:
    """Seeds of a block of benchmark items (picklable)."""

    def __init__(self, items: list[tuple[object, str]], width: int):
        self.width = width
        self.vocab: dict[str, int] = {}
        self.ids, self.items = [], []
        seeds, owner = [], []
        for item_id, text in items:
            ws = tokens(text)
            if not ws:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.uint64)
            # an item shorter than a seed is matched as a whole
            h = rolling(ids, min(width, len(ids)))
            seeds.append(h)
            owner.append(np.full(len(h), len(self.items), np.int32))
            self.ids.append(item_id)
            self.items.append(ids)
        self.groups = {}
        if seeds:
            seeds, owner = np.concatenate(seeds), np.concatenate(owner)
            lens = np.array([min(width, len(x)) for x in self.items])[owner]
            for n in np.unique(lens).tolist():
                s, o = seeds[lens == n], owner[lens == n]
                order = np.argsort(s, kind="stable")
                self.groups[n] = (s[order], o[order])

    def match(self, text: str | None, coverage: float) -> Iterator[tuple[object, int, list[tuple[int, int, int]]]]:
        """(item id, item words, tiles) of every item that the text covers."""
        get = self.vocab.get
        doc = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        found: set[int] = set()
        for n, (seeds, owner) in self.groups.items():
            h = rolling(doc, n)
            if not len(h):
                continue
            h = np.unique(h)
            lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                found.update(owner[a:b].tolist())
        for k in sorted(found):
            item = self.items[k]
            tiles = greedy_tiles(doc, item, min(self.width, len(item)))
            if sum(t[0] for t in tiles) >= coverage * len(item) - 1e-9:
                yield self.ids[k], len(item), tiles


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of bounded size.  Items are assigned to blocks
    by hash; a block reaches the driver alone and goes out to the tasks."""
    items = benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].alias("text")).where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // (2 * block_words)))  # a word and its blank are two characters at least
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).distinct() if blocks > 1 else items.distinct()
        rows = [(r.id, r.text) for r in part.orderBy("id", "text").collect()]
        if rows:
            yield rows


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                       id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item, item_words, matched_words, tiles): every document and item
    whose tiles cover ``coverage`` of the item; ``tiles`` are (length, start in
    the document, start in the item) in words.

    Null and empty texts, and items without words, match nothing.  An item
    shorter than ``min_match`` words must occur as a whole.  Repeated rows
    repeat their pairs, repeated items count once, empty tables give no rows,
    and only the named columns are read.
    """
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    tile = T.StructType([T.StructField(n, T.IntegerType()) for n in ("length", "doc_start", "item_start")])
    schema = T.StructType([T.StructField("id", id_type), T.StructField("item", item_type),
                           T.StructField("item_words", T.LongType()), T.StructField("matched_words", T.LongType()),
                           T.StructField("tiles", T.ArrayType(tile))])
    slim = docs.select(docs[id_col], docs[text_col])

    def search(index: BenchmarkIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("length", "doc_start", "item_start")]))
            for b in batches:
                rows = [(k, *m) for k, t in enumerate(b.column(1)) for m in index.match(t.as_py(), coverage)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([r[1] for r in rows], benchmark_type),
                     pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([sum(t[0] for t in r[3]) for r in rows], pa.int64()),
                     pa.array([[dict(zip(("length", "doc_start", "item_start"), t)) for t in r[3]] for r in rows], kind)],
                    schema.names)
        return run

    from pyspark.sql.pandas.types import to_arrow_type
    benchmark_type = to_arrow_type(item_type)
    parts = [slim.mapInArrow(search(BenchmarkIndex(rows, min_match)), schema)
             for rows in benchmark_blocks(benchmark, item_col, item_text_col, block_words)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` that no benchmark item contaminates, unchanged."""
    import pyarrow.compute as pc
    k = docs.columns.index(text_col)
    schema = docs.schema

    def clean(index: BenchmarkIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = pa.array([next(index.match(t.as_py(), coverage), None) is None for t in b.column(k)], pa.bool_())
                yield b if pc.all(keep).as_py() else b.filter(keep)
        return run

    for rows in benchmark_blocks(benchmark, item_col, item_text_col, block_words):
        docs = docs.mapInArrow(clean(BenchmarkIndex(rows, min_match)), schema)
    return docs
