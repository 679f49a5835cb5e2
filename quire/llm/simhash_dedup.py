"""SimHash near-dedup with pigeonring candidate pruning.

Fingerprints are 64 bits over word shingles.  Two fingerprints link when they
differ in at most ``max_bits`` bits; groups are the connected components.

Search.  The 64 bits form a ring of ``max_bits + 1`` segments.  If two
fingerprints differ in at most ``t`` bits, then on the ring some start segment
opens a chain whose every prefix of ``l`` consecutive segments differs in at
most ``floor(l * t / m)`` bits (the pigeonring principle).  With ``m = t + 1``
the first segment of that chain is equal, so it is the join key; the longer
prefixes prune candidates before the full Hamming check.

Scale.  Documents with equal fingerprints collapse first, so a group of exact
copies of any size is one row.  A bucket of fingerprints that share a segment
is compared by numpy inside one task and yields a spanning forest, never all
its pairs.  Buckets above ``bucket_rows`` are not gathered: their fingerprints
probe the set of fingerprints with every variant of at most ``t`` flipped
bits, an equi-join that is linear in the bucket and free of skew.  Both ways
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import broadcast_if_small, connected_components, stash

SEED = 42
BITS = 64
# largest bucket compared inside one task: 256 KB of fingerprints
BUCKET_ROWS = 32_768
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``width`` lower-cased words (A-Z
    only), repeats included.  A shorter text is one shingle, a text without
    words has none."""
    import xxhash
    if not text:
        return np.empty(0, np.uint64)
    # bytes.lower and bytes.split know ASCII only: A-Z, and blank, TAB..CR
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    joined = b" ".join(ws)
    if len(ws) <= width:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(ws) - width + 1].tolist()
    stops = (ends[width - 1:] - 1).tolist()
    return np.fromiter((digest(joined[s:e]) for s, e in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; none give 0."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    # eight byte lanes per word hold counts up to 255, so 255 hashes at a time
    for s in range(8):
        lanes = (hashes >> np.uint64(s)) & _LANES
        pad = (-n) % 255
        if pad:
            lanes = np.concatenate((lanes, np.zeros(pad, np.uint64)))
        sums = lanes.reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[s::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    out = 0
    for i in np.flatnonzero(counts * 2 > n):
        out |= 1 << int(i)
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row's whole text."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t, width)) for t in map(pa.StringScalar.as_py, b.column(1))),
                              np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("fp", T.LongType())])
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, mask) of the ring's ``max_bits + 1`` segments, low bits first."""
    m = max_bits + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(lo, ((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]


def chain_links(fps: np.ndarray, start: int, max_bits: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked fingerprints among ``fps`` (uint64, equal in
    segment ``start``): chain prefixes first, the full check last."""
    segs = segments(max_bits)
    m = len(segs)
    masks, seen = [], 0
    for length in range(2, m):
        shift, mask = segs[(start + length - 1) % m]
        seen |= mask << shift
        masks.append((np.uint64(seen), length * max_bits // m))
    for lo in range(0, len(fps), block):
        left = fps[lo:lo + block]
        diff = left[:, None] ^ fps[None, lo:]
        i, j = np.nonzero(np.triu(np.ones(diff.shape, bool), 1))
        diff = diff[i, j]
        for mask, budget in masks:
            keep = np.bitwise_count(diff & mask) <= budget
            i, j, diff = i[keep], j[keep], diff[keep]
        keep = np.bitwise_count(diff) <= max_bits
        yield i[keep] + lo, j[keep] + lo


def spanning_forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph on ``range(n)``."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in links:
        for x, y in zip(i.tolist(), j.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
    return out


def linked_fingerprints(fps: DataFrame, max_bits: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column ``fp`` that
    connect exactly the components of the full link graph."""
    segs = segments(max_bits)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"),
                 F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(_signed(mask))).alias("val"))
        for i, (shift, mask) in enumerate(segs)])).alias("k")).select("fp", "k.seg", "k.val")
    hot = keyed.groupBy("seg", "val").count().where(F.col("count") > bucket_rows).select("seg", "val")
    hot = stash(hot, "simhash-hot")
    has_hot = not hot.isEmpty()
    cold = keyed.join(hot, ["seg", "val"], "left_anti") if has_hot else keyed
    buckets = cold.groupBy("seg", "val").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for seg, group in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.sort(group.values.to_numpy(zero_copy_only=False))
                for x, y in spanning_forest(len(v), chain_links(v.view(np.uint64), seg, max_bits)):
                    a.append(v[x])
                    b.append(v[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = buckets.select("seg", "fps").mapInArrow(forest, "a long, b long")
    if has_hot:
        flips = [0] + [sum(1 << p for p in c) for n in range(1, max_bits + 1) for c in combinations(range(BITS), n)]
        flips = F.array(*[F.lit(_signed(f)) for f in flips[1:]])
        probe = (keyed.join(hot, ["seg", "val"], "left_semi").select("fp").distinct()
                 .select(F.col("fp").alias("a"), F.explode(flips).alias("x"))
                 .select("a", F.col("a").bitwiseXOR(F.col("x")).alias("b")))
        links = links.unionByName(probe.join(fps.select(F.col("fp").alias("b")), "b").select("a", "b"))
    return links


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                   text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fp, component): one row per input row.

    ``component`` is the smallest id of the group (null only if the group has
    no other ids).  Null and empty texts have fingerprint 0 and link like any
    other; repeated rows give repeated rows; an empty table gives none; only
    ``id_col`` and ``text_col`` are read, so other columns cannot clash.
    """
    prints = stash(fingerprints(docs, width, id_col, text_col), "simhash-fp")
    distinct = stash(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    cc = connected_components(linked_fingerprints(distinct.select("fp"), max_bits, bucket_rows))
    rooted = distinct.join(cc.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    labels = rooted.join(first, "root").select("fp", "component")
    return prints.join(labels, "fp").select("id", "fp", "component")


def drop_near_copies(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id.

    Rows that repeat the kept id are told apart by nothing but their other
    columns, so one of them stays, picked by the smallest hash of the row.  If
    a group has null ids only, one of its rows stays likewise.
    """
    marked = stash(simhash_groups(docs, width, max_bits, id_col, text_col), "simhash-groups")
    gone = marked.where(~F.col("id").eqNullSafe(F.col("component"))).select("id")
    kept = marked.where(F.col("id").eqNullSafe(F.col("component")))
    repeated = kept.groupBy("id", "component").count().where((F.col("count") > 1) & F.col("id").isNotNull()).select("id")
    nulls = marked.where(F.col("id").isNull())
    drop = stash(gone.where(F.col("id").isNotNull()).unionByName(repeated).distinct(), "simhash-drop")
    out = docs.join(broadcast_if_small(drop.withColumnRenamed("id", "__drop_id")),
                    docs[id_col] == F.col("__drop_id"), "left_anti").where(docs[id_col].isNotNull())
    repeated = stash(repeated, "simhash-repeated")
    if not repeated.isEmpty():
        cols = docs.columns
        again = docs.join(repeated.withColumnRenamed("id", "__again_id"), docs[id_col] == F.col("__again_id"), "left_semi")
        out = out.unionByName(_one_per(again, [id_col], cols))
    if not nulls.isEmpty():
        # ids do not tell these rows apart, so their fingerprints are taken again, beside the row
        null_rows = docs.where(docs[id_col].isNull())
        lone = nulls.where(F.col("component").isNull()).select("fp").distinct()
        out = out.unionByName(_lone_nulls(null_rows, lone, width, max_bits, text_col))
    return out


def _one_per(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    packed = rows.select(*[rows[k].alias(f"__k{i}") for i, k in enumerate(keys)],
                         F.struct(*[rows[c] for c in cols]).alias("__row"))
    packed = packed.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(
        F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return packed.select("__row.*")


def _lone_nulls(rows: DataFrame, lone: DataFrame, width: int, max_bits: int, text_col: str) -> DataFrame:
    """One row of every group that has null ids only."""
    cols = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = cols.index(text_col)
        for b in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), width)) for t in b.column(k)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*b.schema.names, "__fp"])

    schema = T.StructType([*rows.schema.fields, T.StructField("__fp", T.LongType())])
    with_fp = rows.mapInArrow(run, schema)
    lone = stash(lone, "simhash-lone")
    cc = connected_components(linked_fingerprints(lone, max_bits))
    roots = lone.join(cc.withColumnRenamed("node", "fp"), "fp", "left").select(
        F.col("fp").alias("__fp"), F.coalesce("component", "fp").alias("__root"))
    return _one_per(with_fp.join(roots, "__fp"), ["__root"], cols)
