"""Mixing sources to target weights with a hypergeometric splitting tree.

The words of every source are dealt by a keyed hash into permuted blocks of
about ``block_docs`` documents.  A source's target gives an exact quota of
blocks: whole passes over all of its blocks, then blocks in permuted order up
to the target, then documents of one boundary block, as many as fit.
A binary tree over the output shards splits the quota vector: at each node the
left half draws its share of all blocks without replacement, a multivariate
hypergeometric draw over the sources, the right half keeps the rest.  A leaf
holds its shard's exact quotas and takes that many consecutive blocks of each
source's permuted order, so shards are disjoint.  Inside a shard the order is
a hash of the copy, a local shuffle.

Scale.  The driver sees one row per source (the mixture's configuration) and
the quotas per source and shard.  Block totals, boundary blocks and documents
stay distributed; documents meet the plan in a join with the block table,
which is broadcast only after its rows were counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import broadcast_if_small, stash, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_DOCS = 256
MAX_BLOCKS = 65_536  # per source; larger sources have larger blocks
SHARD_WORDS = 20_000_000
SEED = 17


def target_words(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                 cap: float = MAX_REPEATS) -> dict[str | None, float]:
    """Target of each source: ``share`` of all words split by weight, sources
    by code point with null last and weights repeating; a target stops at
    ``cap`` times its source, and the excess is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    left = {s: (weights[i % len(weights)], float(n)) for i, (s, n) in enumerate(order)}
    pool, out = share * sum(n for _, n in order), {}
    while left:
        total = sum(w for w, _ in left.values())
        over = [s for s, (w, n) in left.items() if w / total * pool > cap * n]
        if not over:
            out.update({s: w / total * pool for s, (w, _) in left.items()})
            break
        for s in over:
            out[s] = cap * left.pop(s)[1]
        pool -= sum(out[s] for s in over)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Quota of each shard and source (``shards`` x sources), whose columns
    sum to ``quotas``; shard totals differ by at most the rounding of halves."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        share = int(q.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, share, method="marginals") if q.sum() else q
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


@dataclass
class Mixture:
    """A mixing plan: ``sources`` (one row per source), ``blocks`` (the draws
    of each block) and ``picks`` (documents drawn from boundary blocks)."""

    sources: DataFrame
    blocks: DataFrame
    picks: DataFrame
    shards: int
    seed: int


def _source_key(source: Column) -> list[Column]:
    return [F.isnull(source).alias("__no_source"), F.coalesce(source.cast("string"), F.lit("")).alias("__source")]


KEY = ["__no_source", "__source"]


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "__id", "__size"), F.col("n_blocks"))


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source key, id, size): the words of every row, a null text has none."""
    return docs.select(*_source_key(docs[source_col]), docs[id_col].alias("__id"), word_count(docs[text_col]).alias("__size"))


def plan_mixture(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_REPEATS,
                 block_docs: int = BLOCK_DOCS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> Mixture:
    """Plan over the rows of :func:`document_sizes`.

    Rows that agree in source, id and size are drawn from together (``n`` of
    them).  Sources without words get no draws, an empty table an empty plan.
    """
    spark = sizes.sparkSession
    units = stash(sizes.groupBy(*KEY, "__id", "__size").agg(F.count("*").alias("__n")), "mix-units")
    totals = units.groupBy(*KEY).agg(F.sum(F.col("__size") * F.col("__n")).alias("words"), F.count("*").alias("units")).collect()
    totals.sort(key=lambda r: (r["__no_source"], r["__source"]))
    targets = target_words([(None if r["__no_source"] else r["__source"], r.words) for r in totals], weights, share, cap)
    rows = []
    for r in totals:
        target = targets[None if r["__no_source"] else r["__source"]]
        passes = int(target / r.words + 1e-9) if r.words else 0
        n_blocks = min(MAX_BLOCKS, max(1, r.units // block_docs))
        rows.append((r["__no_source"], r["__source"], int(r.words), float(target), passes,
                     max(0.0, target - passes * r.words), n_blocks))
    # one row per source
    sources = spark.createDataFrame(rows, "__no_source boolean, __source string, source_size long, target double, "
                                          "passes int, rest double, n_blocks long")
    small = F.broadcast(sources)
    units = units.join(small, KEY).withColumn("block", _block(seed))
    by_block = units.groupBy(*KEY, "block", "passes", "rest").agg(F.sum(F.col("__size") * F.col("__n")).alias("words"))
    cum = "sum(words) OVER (PARTITION BY __no_source, __source ORDER BY xxhash64({0}, block), block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rank = "row_number() OVER (PARTITION BY __no_source, __source ORDER BY xxhash64({0}, block), block) - 1"
    blocks = by_block.withColumn("upto", F.expr(cum.format(seed))).withColumn("rank", F.expr(rank.format(seed)))
    blocks = stash(blocks.select(*KEY, "block", "rank", "passes", "rest", "upto", "words"), "mix-blocks")
    whole = F.col("upto") <= F.col("rest")
    edge = ~whole & (F.col("upto") - F.col("words") < F.col("rest"))
    counts = {(r["__no_source"], r["__source"]): r for r in blocks.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.sum(F.when(whole, 1).otherwise(0)).alias("last"),
        F.sum(F.when(edge, 1).otherwise(0)).alias("edge"), F.max("passes").alias("passes")).collect()}
    quotas = [0 if (c := counts.get((r[0], r[1]))) is None else c.passes * c.n + c.last + c.edge for r in rows]
    shards = max(1, -(-int(sum(r[3] for r in rows)) // shard_words))
    starts = np.cumsum(np.vstack((np.zeros((1, len(rows)), np.int64), split_quotas(np.array(quotas, np.int64), shards, seed))), axis=0)
    # one row per source, with as many numbers as shards
    starts = spark.createDataFrame(
        [(r[0], r[1], int(counts[r[0], r[1]].n) if (r[0], r[1]) in counts else 0, starts[:-1, i].tolist()) for i, r in enumerate(rows)],
        "__no_source boolean, __source string, all_blocks long, starts array<long>")
    shard = lambda p: F.size(F.filter("starts", lambda s: s <= p * F.col("all_blocks") + F.col("rank"))) - 1
    draws = F.transform(F.filter(F.sequence(F.lit(0), F.col("passes")), lambda p: (p < F.col("passes")) | whole),
                        lambda p: F.struct(p.cast("int").alias("copy"), shard(p).alias("shard")))
    blocks = blocks.join(F.broadcast(starts), KEY).select(
        *KEY, "block", draws.alias("draws"), F.when(edge, F.col("rest") - F.col("upto") + F.col("words")).alias("room"),
        F.when(edge, shard(F.col("passes"))).alias("edge_shard"), "passes")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        room = float(pdf["room"].iloc[0])
        pdf = pdf.sort_values(["order", "__id", "__size"], na_position="last")
        sizes, rows = pdf["__size"].tolist(), pdf["__n"].tolist()
        take = [0] * len(sizes)
        # in hash order while any document still fits, the rest by falling size, so that little room is left
        stop = int(np.searchsorted(np.cumsum(np.array(sizes) * np.array(rows)), room - max(sizes), "right"))
        for i in [*range(stop), *sorted(range(stop, len(sizes)), key=lambda i: -sizes[i])]:
            take[i] = int(min(rows[i], room // sizes[i])) if sizes[i] else rows[i]
            room -= take[i] * sizes[i]
        # one more if that comes nearer to the target
        over = min((i for i in range(len(sizes)) if take[i] < rows[i]), key=lambda i: sizes[i], default=None)
        if over is not None and sizes[over] - room < room:
            take[over] += 1
        return pdf.assign(take=take)[[*KEY, "__id", "__size", "__n", "take", "edge_shard", "passes"]]

    at_edge = units.select(*KEY, "block", "__id", "__size", "__n", F.xxhash64(F.lit(seed + 1), "__id", "__size").alias("order")).join(
        broadcast_if_small(blocks.where("room is not null").select(*KEY, "block", "room", "edge_shard", "passes")), [*KEY, "block"])
    schema = T.StructType([*[at_edge.schema[c] for c in (*KEY, "__id", "__size", "__n")], T.StructField("take", T.LongType()),
                           T.StructField("edge_shard", T.IntegerType()), T.StructField("passes", T.IntegerType())])
    # a boundary block of each source: about block_docs rows
    picks = stash(at_edge.groupBy(*KEY).applyInPandas(fill, schema).where("take > 0"), "mix-picks")
    return Mixture(sources, stash(blocks.select(*KEY, "block", "draws"), "mix-draws"), picks, shards, seed)


def apply_mixture(rows: DataFrame, plan: Mixture) -> DataFrame:
    """``rows`` (with the columns of :func:`document_sizes`) plus source_size,
    target and ``draws``: the copies taken, each with its shard and its place
    in the shard's local shuffle."""
    sources = F.broadcast(plan.sources.select(*KEY, "source_size", "target", "n_blocks"))
    rows = rows.join(sources, KEY, "left").withColumn("block", _block(plan.seed))
    picks = plan.picks.select(*KEY, F.col("__id").alias("__pick_id"), "__size", "__n", "take", "edge_shard",
                              F.col("passes").alias("edge_copy"))
    cond = [rows[c] == picks[c] for c in (*KEY, "__size")] + [rows["__id"].eqNullSafe(picks["__pick_id"])]
    out = rows.join(broadcast_if_small(picks), cond, "left").drop(*[picks[c] for c in (*KEY, "__size")], "__pick_id")
    # of n equal rows only some are drawn: number them (n is 1 unless rows repeat)
    n = F.when(F.coalesce("take", F.lit(0)) >= F.coalesce("__n", F.lit(0)), F.lit(True))
    partial = plan.picks.where("take < __n").limit(1).count() > 0
    if partial:
        some = out.where("take < __n").withColumn("__row", F.expr(
            "row_number() OVER (PARTITION BY __no_source, __source, __id, __size ORDER BY 1)"))
        out = out.where("take is null or take >= __n").withColumn("__row", F.lit(1)).unionByName(some)
        n = (F.col("take") >= F.col("__n")) | (F.col("__row") <= F.col("take"))
    out = out.join(broadcast_if_small(plan.blocks), [*KEY, "block"], "left")
    last = F.when(F.col("take").isNotNull() & n, F.array(F.struct(F.col("edge_copy").alias("copy"), F.col("edge_shard").alias("shard"))))
    empty = F.array().cast("array<struct<copy:int,shard:int>>")
    draws = F.transform(F.concat(F.coalesce("draws", empty), F.coalesce(last, empty)), lambda d: F.struct(
        d["copy"].alias("copy"), d["shard"].alias("shard"),
        F.xxhash64(F.lit(plan.seed), d["shard"], d["copy"], "__id", "__size").alias("place")))
    return out.withColumn("draws", draws).drop("block", "n_blocks", "__n", "take", "edge_shard", "edge_copy", "__row")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, source, size, source_size, target, draws), one row per input row.

    ``draws`` lists the copies taken (copy, shard, place), empty if none.  A
    null text or one without words has size 0; null ids and sources are values
    of their own; repeated rows are drawn as rows of their own; an empty table
    gives none; other columns are not read.
    """
    sizes = stash(document_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    out = apply_mixture(sizes, plan_mixture(sizes, **options))
    return out.select(F.col("__id").alias("id"), F.when(~F.col("__no_source"), F.col("__source")).alias("source"),
                      F.col("__size").alias("size"), "source_size", "target", "draws")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """Rows of ``docs``, each as often as the mixture takes it, unchanged."""
    plan = plan_mixture(document_sizes(docs, id_col, text_col, source_col), **options)
    cols = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in cols]).alias("__doc"), *_source_key(docs[source_col]),
                       docs[id_col].alias("__id"), word_count(docs[text_col]).alias("__size"))
    taken = apply_mixture(rows, plan).where(F.size("draws") > 0)
    return taken.select("__doc", F.explode("draws")).select("__doc.*")
