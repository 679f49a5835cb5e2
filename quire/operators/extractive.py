"""G4 native compression: an extractive digest of each chunk, fully relational.

Per chunk: sentences -> word tokens -> term frequency inside the chunk ->
sentence score = mean term frequency of its tokens (an integer sum divided by
an integer count: the same double in every engine, so ties stay ties) -> rank by (score desc, position asc) -> keep
the ranked prefix whose running length (sentences joined by one space) stays
within the target, always at least the top sentence -> restore reading order,
join with spaces, cut to ``max(target, 1)`` characters.

Execution: the chunk rows are hash-partitioned on the chunk key once; the
sentence/token explosion, the term counts (window on key+token), the sentence
scores (aggregate on key+sentence), the ranking window and the final collect
all require a clustering that this one partitioning already satisfies, so
the token stream is never shuffled.  A group is one chunk; chunks
end at the first line end behind their limit, so a text without line ends is
one chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import sentences, word_tokens


def extractive_abstracts(splits: DataFrame, keys: list[str], chunk_col: str = "chunk",
                         target_col: str = "target_size", out_col: str = "abstract",
                         num_partitions: int | None = None, prepartitioned: bool = False) -> DataFrame:
    """Add ``out_col`` (empty string when the chunk has no sentence).

    ``prepartitioned=True`` skips the exchange when the caller's rows are
    already hash-partitioned by a prefix of ``keys`` (e.g. straight out of a
    ``groupBy`` on the book): every later step only needs that clustering.

    The result keeps every input column except the chunk text itself (the
    small per-chunk columns ride along through the aggregates), so the chunk
    pipeline is computed once and never joined back to itself.
    """
    if prepartitioned:
        base = splits
    else:
        base = splits.repartition(num_partitions, *keys) if num_partitions else splits.repartition(*keys)
    k = [F.col(c) for c in keys]
    carry = [c for c in splits.columns if c not in keys and c != chunk_col]
    sent = base.select(*k, *carry, F.col(target_col).alias("__target"),
                       F.posexplode_outer(sentences(chunk_col)).alias("__spos", "__sent"))
    # the sentence text rides only on the first token row of its sentence, so
    # the token sort below moves ids and tokens, not copies of the sentence
    tok = sent.select("*", F.posexplode_outer(word_tokens("__sent")).alias("__tpos", "__tok"))
    tok = tok.withColumn("__sent", F.when(F.coalesce(F.col("__tpos"), F.lit(0)) == 0, F.col("__sent")))
    tf = F.when(F.col("__tok").isNotNull(), F.count("__tok").over(Window.partitionBy(*k, F.col("__tok"))))
    scored = (tok.withColumn("__tf", tf)
              .groupBy(*k, "__spos")
              .agg(F.first("__sent", ignorenulls=True).alias("__sent"), F.first("__target").alias("__target"),
                   *[F.first(c).alias(c) for c in carry],
                   F.coalesce(F.avg("__tf"), F.lit(0.0)).alias("__score")))
    w = Window.partitionBy(*k).orderBy(F.col("__score").desc(), F.col("__spos").asc_nulls_last())
    ranked = (scored
              .withColumn("__rank", F.row_number().over(w))
              .withColumn("__run", F.sum(F.coalesce(F.length("__sent"), F.lit(0)) + 1).over(
                  w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1))
    kept = ranked.filter((F.col("__rank") == 1) | (F.col("__run") <= F.col("__target")))
    digest = kept.groupBy(*k).agg(
        F.array_sort(F.collect_list(F.struct("__spos", "__sent"))).alias("__kept"),
        F.first("__target").alias("__target"), *[F.first(c).alias(c) for c in carry])
    text = F.array_join(F.transform("__kept", lambda x: x["__sent"]), " ")
    return digest.select(*k, *carry, text.substr(F.lit(1), F.greatest(F.col("__target"), F.lit(1)).cast("int"))
                         .alias(out_col))
