"""E7, E8, E11 reports: one job each, written by the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.stem import stemmed_rouge_tokens
from quire.functions.text import clean_summary
from quire.operators import evaluate as EV
from quire.sinks import write_scores_csv, write_summary_maps

SCORE_COLUMNS = fixed.SCORE_COLUMNS


def score_table(summaries: DataFrame, vectors: DataFrame | None, keys: list[str] = ("language", "book"),
                provider_col: str = "provider", lang_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """E1 + E4 + E5 + E6 -> E7: one row per (language, book, provider) with 12
    metrics.  ``vectors`` holds token vectors per summary text
    (``language, book, provider, vec_id, embedding``; the reference's vectors
    under the reference provider); without it the embedding metrics are null.
    With ``lang_col``, one of ``keys``, the language code (E2) stands in
    ``lang``.  Scores are not rounded; the CSV sink does it once.  Returns
    ``(scores, skipped_books)``."""
    keys = list(keys)
    pairs, skipped = EV.pair_with_reference(summaries, keys, provider_col)
    pk = keys + [provider_col]
    # stemmed tokens of both sides, made once per pair for all three scores
    stemmed = pairs.select(*pk, stemmed_rouge_tokens("candidate").alias("candidate"), stemmed_rouge_tokens("reference").alias("reference"))
    as_is = {"tokens": F.col, "decimals": None}
    r1 = EV.rouge_n(stemmed, pk, 1, **as_is)
    r2 = EV.rouge_n(stemmed, pk, 2, **as_is)
    rl = EV.rouge_l(stemmed, pk, **as_is)
    scores = r1.join(r2, pk).join(rl, pk)
    if vectors is not None:
        # candidate vectors (side 0) of each pair meet the reference vectors (side 1) of its book
        ref = vectors.filter(F.col(provider_col) == fixed.REFERENCE_PROVIDER).drop(provider_col)
        cand = vectors.filter(F.col(provider_col) != fixed.REFERENCE_PROVIDER)
        provs = pairs.select(*pk)
        both = (cand.join(provs, pk, "left_semi").withColumn("side", F.lit(0))
                .unionByName(ref.join(provs, keys).withColumn("side", F.lit(1))))
        # a pair is named by its keys as they are
        keyed = both.withColumn("pair", F.to_json(F.struct(*pk), {"ignoreNullFields": "false"}))
        em = EV.embedding_match(keyed, "pair", "side", decimals=None).withColumnRenamed("book", "pair")
        ids = keyed.select("pair", *pk).distinct()
        scores = scores.join(em.join(ids, "pair").drop("pair"), pk, "left")
    else:
        for c in SCORE_COLUMNS[:3]:
            scores = scores.withColumn(c, F.lit(None).cast("double"))
    if lang_col is not None:
        scores = scores.withColumn("lang", EV.language_code(lang_col))
        return scores.select(*pk, "lang", *SCORE_COLUMNS), skipped
    return scores.select(*pk, *SCORE_COLUMNS), skipped


def write_score_table(scores: DataFrame, path: str) -> None:
    """K4: the score CSV (4 decimals only at the sink)."""
    write_scores_csv(scores.orderBy(*scores.columns[:3]), path, decimals=4)


def collect_summaries(summaries: DataFrame, compat: bool = False) -> DataFrame:
    """Per provider, book -> cleaned summary.  Keyed by (language, book)
    by default; ``compat=True`` keys by book name only, the last language in
    sort order winning, like the original tool."""
    s = summaries.select("provider", "language", "book", clean_summary("summary").alias("summary"))
    if compat:
        s = s.groupBy("provider", "book").agg(F.max_by("summary", "language").alias("summary"))
    return s


# providers in one BIGINT of a book's bitmap
WORD_BITS = 62


def missing_summaries(summaries: DataFrame, providers: list[str], keys: list[str] = ("language", "book"),
                      provider_col: str = "provider", text_col: str = "summary") -> DataFrame:
    """E8's report: ``keys, provider`` for every book without a summary (a null
    text is none) of one of ``providers``, names as :func:`select_providers`
    gives them.  A book is one whose key has any row.

    Each book keeps a bitmap of the providers it has, one aggregate with
    map-side combine; only the bits that miss become rows.
    """
    keys, names = list(keys), list(dict.fromkeys(providers))
    if not names:
        return summaries.select(*keys, provider_col).limit(0)
    words = -(-len(names) // WORD_BITS)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(provider_col)).cast("int") - 1
    there = summaries.select(*keys, F.when(F.col(text_col).isNotNull(), place).alias("__p"))
    # an unknown provider has place -1 and sets no bit
    bit = lambda w: F.when(F.floor(F.col("__p") / WORD_BITS) == w, F.expr(f"shiftleft(1L, pmod(__p, {WORD_BITS}))"))
    masks = there.groupBy(*keys).agg(*[F.coalesce(F.bit_or(bit(w)), F.lit(0).cast("bigint")).alias(f"__w{w}") for w in range(words)])
    absent = F.lit(False)
    at = F.col("__i")
    for w in range(words):
        absent = absent | ((F.floor(at / WORD_BITS) == w) & (F.expr(f"shiftright(__w{w}, pmod(__i, {WORD_BITS}))").bitwiseAND(1) == 0))
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)])
    # only books with a missing bit are unfolded
    full = F.lit(True)
    for w in range(words):
        n = min(WORD_BITS, len(names) - w * WORD_BITS)
        full = full & (F.col(f"__w{w}") == F.lit((1 << n) - 1))
    each = masks.where(~full).select("*", F.explode(listed).alias("__x")).select("*", F.col("__x.i").alias("__i"))
    return each.where(absent).select(*keys, F.col("__x.n").alias(provider_col))


def write_summary_collections(collected: DataFrame, path: str) -> None:
    """K5 sink for E8."""
    write_summary_maps(collected, path)


def provider_report(flags: DataFrame, path: str | None = None, provider_col: str = "provider",
                    book_keys: list[str] = ("language", "book")) -> DataFrame:
    """E9 + E11: coherence per provider, ordered by provider; optional CSV."""
    rep = EV.coherence(flags, provider_col, list(book_keys)).orderBy(provider_col)
    if path:
        write_scores_csv(rep, path, decimals=4)
    return rep
