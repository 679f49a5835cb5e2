"""Summary evaluation as joins and aggregations.

* pairing with the reference summary is an equi-join on the book key;
* ROUGE-N is an n-gram count per side, aggregated on (pair, gram) after one
  hash exchange on the pair key (the explode happens after the exchange, so
  only the pair rows travel, never the n-gram stream);
* ROUGE-L needs a longest common subsequence: match points by an equi-join on
  (pair, token), then the longest rising subsequence by patience sorting;
* the embedding match is max-cosine over a grid of vector blocks (numpy inside
  tasks), a fragment-and-replicate join on (book, block, block);
* coherence is a two-level aggregation of per-sentence flags.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.text import col_of, rouge_tokens, sentences, strip
from quire.operators.scan import join_same
from quire.session import ship_package


# --- E1 / E2 --------------------------------------------------------------------

def pair_with_reference(summaries: DataFrame, keys: list[str], provider_col: str = "provider",
                        text_col: str = "summary",
                        reference: str = fixed.REFERENCE_PROVIDER) -> tuple[DataFrame, DataFrame]:
    """Each non-reference summary of a book next to the book's reference.

    Returns ``(pairs, skipped)``: ``pairs`` = keys, provider, candidate,
    reference (both stripped, blank candidates dropped); ``skipped`` = books
    without a reference or with a blank one.
    """
    s = summaries.select(*keys, provider_col, strip(text_col).alias("__t"))
    ref = s.filter(F.col(provider_col) == reference).select(*keys, F.col("__t").alias("reference"))
    good_ref = ref.filter(F.col("reference") != "")
    cand = s.filter((F.col(provider_col) != reference) & (F.col("__t") != "")).withColumnRenamed("__t", "candidate")
    pairs = cand.join(good_ref, keys)
    books = s.select(*keys).distinct()
    skipped = books.join(good_ref, keys, "left_anti")
    return pairs, skipped


def language_code(lang_col) -> Column:
    """Lower-cased language folder name -> code, default ``en``."""
    m = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_CODES.items() for x in kv])
    c = F.col(lang_col) if isinstance(lang_col, str) else lang_col
    return F.coalesce(m[F.lower(c)], F.lit(fixed.DEFAULT_LANGUAGE_CODE))


# --- E3 / E4 ----------------------------------------------------------------------

def ngrams(tokens: Column, n: int) -> Column:
    """ARRAY<STRING> of space-joined n-grams (empty when too short)."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1),
                    lambda i: F.array_join(F.slice(tokens, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


# decimals of scores; None leaves them as they are, for a sink that rounds
DECIMALS = 6


def rounded(c: Column, decimals: int | None) -> Column:
    return c if decimals is None else F.round(c, decimals)


def prf(overlap: Column, n_cand: Column, n_ref: Column, prefix: str, decimals: int | None = DECIMALS) -> list[Column]:
    p = F.when(n_cand > 0, overlap / n_cand).otherwise(F.lit(0.0))
    r = F.when(n_ref > 0, overlap / n_ref).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [rounded(c, decimals).alias(f"{prefix}_{n}") for n, c in (("p", p), ("r", r), ("f", f))]


def rouge_n(pairs: DataFrame, keys: list[str], n: int, cand_col: str = "candidate",
            ref_col: str = "reference", tokens=rouge_tokens, prepartitioned: bool = False,
            decimals: int | None = DECIMALS) -> DataFrame:
    """Clipped n-gram overlap; precision over candidate n-grams, recall
    over reference n-grams (reference is the first argument in the original
    scorer, candidate the second).  ``prepartitioned=True`` skips the exchange
    when ``pairs`` are already hash-partitioned by a prefix of ``keys``."""
    # token arrays are computed before the one exchange on the pair key (a
    # Python tokenizer stage would otherwise hide the partitioning from the
    # aggregates) and get their own projection, so the n-gram lambda does not
    # re-derive them for every position
    base = pairs.select(*keys, tokens(cand_col).alias("__ct"), tokens(ref_col).alias("__rt"))
    if not prepartitioned:
        base = base.repartition(*keys)
    tagged = F.concat(
        F.transform(ngrams(F.col("__ct"), n), lambda g: F.struct(g.alias("g"), F.lit(1).alias("c"), F.lit(0).alias("r"))),
        F.transform(ngrams(F.col("__rt"), n), lambda g: F.struct(g.alias("g"), F.lit(0).alias("c"), F.lit(1).alias("r"))))
    grams = base.select(*keys, F.explode_outer(tagged).alias("x"))
    per_gram = grams.groupBy(*keys, F.col("x.g").alias("g")).agg(
        F.coalesce(F.sum("x.c"), F.lit(0)).alias("c"), F.coalesce(F.sum("x.r"), F.lit(0)).alias("r"))
    per_pair = per_gram.groupBy(*keys).agg(
        F.sum(F.least("c", "r")).alias("overlap"), F.sum("c").alias("n_c"), F.sum("r").alias("n_r"))
    return per_pair.select(*keys, *prf(F.col("overlap"), F.col("n_c"), F.col("n_r"), f"rouge{n}", decimals))


# --- E5 ---------------------------------------------------------------------------

def match_points(tokens: DataFrame, keys: list[str], cand_col: str, ref_col: str) -> DataFrame:
    """``keys, points``: for every pair the reference positions of the
    candidate's tokens, in candidate order and falling within one token, so
    that a chain of rising positions takes at most one of each.  Pairs without
    a common token have no row."""
    ref = tokens.select(*keys, F.posexplode_outer(ref_col).alias("j", "t")).filter(F.col("t").isNotNull())
    at = ref.groupBy(*keys, "t").agg(F.sort_array(F.collect_list("j"), asc=False).alias("js"))
    cand = tokens.select(*keys, F.posexplode_outer(cand_col).alias("i", "t")).filter(F.col("t").isNotNull())
    met = join_same(cand, at, [*keys, "t"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "js"))).alias("m"))
    return met.select(*keys, F.flatten(F.transform("m", lambda x: x["js"])).alias("points"))


def rising_length(points) -> Column:
    """Length of the longest strictly rising subsequence by patience sorting:
    pile k holds the smallest end of a rising chain of k values, a value goes
    on the first pile that is not smaller."""

    def put(piles: Column, x: Column) -> Column:
        # piles rise, so the place of x among them is its place once sorted in
        at = F.array_position(F.sort_array(F.concat(piles, F.array(x))), x).cast("int")
        return F.concat(F.slice(piles, 1, at - 1), F.array(x), F.slice(piles, at + 1, F.greatest(F.size(piles) - at, F.lit(0))))

    return F.aggregate(col_of(points), F.array().cast("array<int>"), put, F.size)


def rouge_l(pairs: DataFrame, keys: list[str], cand_col: str = "candidate", ref_col: str = "reference",
            tokens=rouge_tokens, decimals: int | None = DECIMALS) -> DataFrame:
    """E5: LCS over whole token lists (not per sentence); P/R/F as ROUGE-N.

    A common subsequence is a chain of match points (a candidate and a
    reference position with the same token) that rises in both, so its length
    is that of the longest rising subsequence of the match points in candidate
    order.  The points come from an equi-join on (pair, token)."""
    t = pairs.select(*keys, tokens(cand_col).alias("__c"), tokens(ref_col).alias("__r"))
    lcs = match_points(t, keys, "__c", "__r").select(*keys, rising_length("points").alias("lcs"))
    sized = join_same(t.select(*keys, F.size("__c").alias("n_c"), F.size("__r").alias("n_r")), lcs, keys, "left")
    return sized.select(*keys, *prf(F.coalesce("lcs", F.lit(0)), F.col("n_c"), F.col("n_r"), "rougeL", decimals))


# --- E6 ---------------------------------------------------------------------------

# vectors of a block; a cell of the grid is one block of either side
BLOCK = 2048
# books whose block counts are broadcast; more are joined by a shuffle, a book's vectors dealt over so many keys
MAX_BROADCAST_BOOKS, BOOK_SALTS = 200_000, 64


def _cell_best(batches):
    """For every cell: best cosine of each candidate with the cell's
    references and of each reference with its candidates."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            sims = np.vstack(row.c_vecs).astype(np.float64) @ np.vstack(row.r_vecs).astype(np.float64).T
            for side, ids, best in ((0, row.c_ids, sims.max(axis=1)), (1, row.r_ids, sims.max(axis=0))):
                out.append(pd.DataFrame({"book": [row.book] * len(best), "side": side, "vec_id": np.asarray(ids, dtype=np.int64), "best": best}))
        if out:
            yield pd.concat(out, ignore_index=True)


def embedding_match(vectors: DataFrame, book_col: str, side_col: str, id_col: str = "vec_id",
                    vec_col: str = "embedding", block: int = BLOCK, decimals: int | None = DECIMALS) -> DataFrame:
    """Per book, P = mean over candidate vectors (side 0) of the best
    cosine with any reference vector (side 1), R the reverse, F1 harmonic.

    Fragment and replicate: a book's candidates are dealt into blocks of about
    ``block`` vectors, its references too, and each block is copied to all
    blocks of the other side; (book, c_blk, r_blk) is one cell of the grid and
    one numpy product.  Numbers of blocks come from an aggregate of counts, so
    no join has the book alone as its key, and a book with a third of all
    vectors is spread over all its cells.
    """
    book_type = vectors.schema[book_col].dataType.simpleString()
    v = vectors.select(F.col(book_col).alias("book"), F.col(side_col).cast("int").alias("side"),
                       F.col(id_col).cast("bigint").alias("vid"), F.col(vec_col).alias("vec"))
    of = lambda side: F.ceil(F.count_if(F.col("side") == side) / F.lit(block))
    sizes = v.groupBy("book").agg(of(0).alias("c_n"), of(1).alias("r_n")).where("c_n > 0 and r_n > 0")
    if sizes.limit(MAX_BROADCAST_BOOKS + 1).count() <= MAX_BROADCAST_BOOKS:
        v = v.join(F.broadcast(sizes), "book")
    else:
        salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(BOOK_SALTS - 1))))
        v = v.withColumn("salt", F.pmod(F.xxhash64("vid"), F.lit(BOOK_SALTS)).cast("int")).join(salted, ["book", "salt"]).drop("salt")
    v = v.withColumn("vec", F.transform("vec", lambda x: x.cast("double"))).withColumn(
        "__n", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    v = v.withColumn("vec", F.transform("vec", lambda x: F.coalesce(F.try_divide(x, F.col("__n")), F.lit(0.0)))).drop("__n")
    own = F.when(F.col("side") == 0, F.col("c_n")).otherwise(F.col("r_n"))
    blocks = v.withColumn("blk", F.pmod(F.xxhash64("vid"), own)).groupBy("book", "side", "blk").agg(
        F.first("c_n").alias("c_n"), F.first("r_n").alias("r_n"), F.collect_list(F.struct("vid", "vec")).alias("m"))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    c = blocks.where("side = 0").select("book", F.col("blk").alias("c_blk"), to_all("r_n").alias("r_blk"),
                                        F.col("m.vid").alias("c_ids"), F.col("m.vec").alias("c_vecs"))
    r = blocks.where("side = 1").select("book", to_all("c_n").alias("c_blk"), F.col("blk").alias("r_blk"),
                                        F.col("m.vid").alias("r_ids"), F.col("m.vec").alias("r_vecs"))
    cells = c.join(r, ["book", "c_blk", "r_blk"])
    best = cells.mapInPandas(_cell_best, f"book {book_type}, side int, vec_id long, best double")
    per_vec = best.groupBy("book", "side", "vec_id").agg(F.max("best").alias("best"))
    per_side = per_vec.groupBy("book").agg(
        F.avg(F.when(F.col("side") == 0, F.col("best"))).alias("p"),
        F.avg(F.when(F.col("side") == 1, F.col("best"))).alias("r"))
    f = F.when(F.col("p") + F.col("r") != 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return per_side.select("book", *[rounded(c, decimals).alias(f"bert_{n}") for n, c in
                                     (("precision", F.col("p")), ("recall", F.col("r")), ("f1", f))])


# --- E9 / E10 / E11 -------------------------------------------------------------------

_TERMINAL = f"[.!?…][{fixed.java_class_body(fixed.SENTENCE_END_QUOTES)}]?\\z"


def sentence_flags(summaries: DataFrame, keys: list[str], text_col: str = "summary") -> DataFrame:
    """Native annotator: a sentence is confusing when it repeats an earlier
    sentence of the same summary or lacks terminal punctuation.
    Returns ``keys, sentence_no, sentence, confusing``."""
    base = summaries.repartition(*keys)
    s = base.select(*keys, F.posexplode_outer(sentences(text_col)).alias("sentence_no", "sentence")).filter(
        F.col("sentence").isNotNull())
    first = F.min("sentence_no").over(Window.partitionBy(*keys, "sentence"))
    return s.withColumn("confusing", (F.col("sentence_no") > first) | ~F.col("sentence").rlike(_TERMINAL))


def coherence(flags: DataFrame, provider_col: str, book_keys: list[str]) -> DataFrame:
    """E9 + E11: share of non-confusing sentences per book, averaged per
    provider (two-level aggregation)."""
    per_book = flags.groupBy(provider_col, *book_keys).agg(
        F.avg(F.when(F.col("confusing"), 0.0).otherwise(1.0)).alias("score"))
    return per_book.groupBy(provider_col).agg(
        F.count("*").cast("bigint").alias("n_books"), F.round(F.avg("score"), 6).alias("coherence"))


def pending_annotations(summaries: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Books not yet annotated for (provider, evaluator)."""
    return summaries.join(annotations.select(*keys).distinct(), keys, "left_anti")


ANNOTATE_KEYS = ["CONTEXT", "SENTENCE"]   # declared keys of the annotate prompt


def sentence_rows(summaries: DataFrame, keys: list[str], text_col: str = "summary") -> DataFrame:
    """``keys, sentence_no, sentence``: what is shuffled is each sentence once."""
    s = summaries.select(*keys, F.posexplode_outer(sentences(text_col)).alias("sentence_no", "sentence"))
    return s.filter(F.col("sentence").isNotNull())


def running_contexts(batches, keys, width):
    """(keys, sentence_no, sentence) in order, with the text of the sentences
    before: one string per book is carried from row to row, and from batch to
    batch."""
    of, context = None, ""
    for pdf in batches:
        contexts = []
        for row in pdf.itertuples(index=False):
            book = tuple(getattr(row, k) for k in keys)
            if book != of:
                of, context = book, ""
            contexts.append(context)
            context = f"{context}\n{row.sentence}" if context else row.sentence
            if width is not None:
                context = context[max(0, len(context) - width):]
        yield pdf.assign(context=contexts)


def annotation_prompts(summaries: DataFrame, keys: list[str], text_col: str = "summary", template: str | None = None,
                       context_chars: int | None = None) -> DataFrame:
    """``keys, sentence_no, sentence, prompt`` for every sentence.

    Sentences are dealt by book and sorted; a sorted iterator then keeps the
    context that grows from sentence to sentence inside of the task.  So the
    shuffle moves every sentence once, linear in the text, and a book's
    contexts exist one at a time.
    """
    from quire.functions.prompts import load_template, render

    if template is None:
        template = load_template("annotate")
    rows = sentence_rows(summaries, keys, text_col)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "sentence_no")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    context = ordered.mapInPandas(lambda batches: running_contexts(batches, keys, context_chars), f"{fields}, context string")
    return context.select(*keys, "sentence_no", "sentence",
                          render(template, ANNOTATE_KEYS, {"CONTEXT": F.col("context"), "SENTENCE": F.col("sentence")}).alias("prompt"))


def annotate_with_model(summaries: DataFrame, keys: list[str], model_fn, evaluator: str,
                        annotations: DataFrame | None = None, text_col: str = "summary",
                        template: str | None = None, context_chars: int | None = None, **gen) -> DataFrame:
    """E9 with a model as annotator (E10: books already annotated by
    ``evaluator`` are not sent again).  One prompt per sentence with the
    sentences before it as context (the last ``context_chars`` characters of
    them, as many as the model's window takes); an answer starting with "yes" flags it.
    Returns ``keys, evaluator, sentence_no, sentence, confusing, status``; a
    failed call counts as not confusing and is reported in ``status``."""
    from quire.functions.prompts import load_template
    from quire.operators.generate import generate

    if template is None:
        template = load_template("annotate")
    ship_package(summaries.sparkSession)
    todo = summaries
    if annotations is not None:
        done = annotations.filter(F.col("evaluator") == evaluator).select(*keys).distinct()
        todo = summaries.join(done, keys, "left_anti")
    prompts = annotation_prompts(todo, keys, text_col, template, context_chars)
    out = generate(prompts, model_fn, keys + ["sentence_no"], **gen)
    yes = F.lower(F.coalesce(strip("text"), F.lit(""))).startswith("yes")
    return out.select(*keys, F.lit(evaluator).alias("evaluator"), "sentence_no", "sentence",
                      (yes & (F.col("status") == "ok")).alias("confusing"), "status")
