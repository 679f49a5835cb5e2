"""G5-G8 native book products: summaries, keywords, categories.

The native generators are relational stand-ins for a model: they are exact,
deterministic and run as DataFrame jobs.  A real model plugs in through
:mod:`quire.operators.generate` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.text import parse_lines, word_tokens
from quire.operators.chunks import target_size
from quire.operators.extractive import extractive_abstracts
from quire.session import text_tasks, written

# Function words left out of keywords (per language code; our own lists).
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with be by as this are at from an or not but his her".split(),
    "fr": "de la le et les des en un du une que pour est qui par dans sur au pas avec ce il elle se ne".split(),
    "de": "der die und in den von zu das mit sich auf des für ist nicht dem im ein als eine es ich".split(),
    "es": "de la que el en y los se del las por un no con su una es para al lo como más".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos".split(),
    "it": "di e il la che in un per non una con del della le si da al lo".split(),
}
MIN_KEYWORD_LEN = 3
TOP_KEYWORDS = 5

TOP_CATEGORIES = 5


def stop_words_df(spark: SparkSession) -> DataFrame:
    rows = [(lang, w) for lang, ws in STOP_WORDS.items() for w in ws]
    return spark.createDataFrame(rows, "lang string, term string")


def term_counts(books: DataFrame, keys: list[str], text_col: str, tasks: int) -> DataFrame:
    """(keys, term, tf) after one exchange on the first key (the book) to
    ``tasks`` tasks; the explode happens after it."""
    base = books.repartition(tasks, keys[0])
    t = base.select(*keys, F.explode_outer(word_tokens(text_col)).alias("term")).filter(F.col("term").isNotNull())
    return t.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


# Languages counted as a broadcast table; more of them are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 100_000
# A term is frequent if it stands in more than this share of its language's
# books.  There are at most 1 / share times the mean number of distinct terms
# of a book of those, whatever the number of books.
FREQUENT_SHARE = 0.01
# Frequent terms counted as a broadcast table.  In a language of fewer than
# 1 / share books every term is frequent; more rows are joined by a shuffle in
# which a term is dealt over so many tasks by book.
MAX_BROADCAST_TERMS = 200_000
TERM_SALTS = 64


def books_per_language(books: DataFrame, lang_col: str) -> DataFrame:
    """(language, n_books), broadcast up to ``MAX_BROADCAST_LANGUAGES`` rows."""
    counts = books.groupBy(lang_col).agg(F.count("*").alias("n_books"))
    few = counts.limit(MAX_BROADCAST_LANGUAGES + 1).count() <= MAX_BROADCAST_LANGUAGES
    return F.broadcast(counts) if few else counts


def keywords(spark: SparkSession, books: DataFrame, book_col: str, lang_col: str, text_col: str,
             top: int = TOP_KEYWORDS) -> DataFrame:
    """G6 native: TF-IDF within each language corpus, function words and
    short or numeric tokens removed, top ``top`` per book (ties by term).
    Returns ``book, rank, keyword, score``."""
    keys = [book_col, lang_col]
    # every exchange of these rows is dealt by the size of the texts
    tasks = text_tasks(books, text_col)
    tf = term_counts(books.select(*keys, text_col), keys, text_col, tasks)
    tf = tf.filter((F.length("term") >= MIN_KEYWORD_LEN) & ~F.col("term").rlike("^[0-9]+$"))
    stop = stop_words_df(spark).withColumnRenamed("lang", lang_col)
    tf = tf.join(F.broadcast(stop), [lang_col, "term"], "left_anti")   # fixed-size list
    # counted once: document frequencies, frequent terms and scores all read this table
    tf = written(tf, "term-counts")
    per_lang = books_per_language(books, lang_col)
    df = tf.groupBy(lang_col, "term").agg(F.count("*").alias("df"))
    often = df.join(per_lang, lang_col).filter(F.col("df") > F.col("n_books") * FREQUENT_SHARE)
    often = often.select(lang_col, "term", F.col("df").alias("__often"))
    often = written(often, "frequent-terms")
    # rows of frequent terms take their df from this table and are dealt by book
    # below, so no term gathers a language's books in one task
    if often.count() <= MAX_BROADCAST_TERMS:
        tf = tf.join(F.broadcast(often), [lang_col, "term"], "left")
    else:
        salted = often.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TERM_SALTS - 1).cast("long"))))
        at = [lang_col, "term", "__salt"]
        tf = tf.withColumn("__salt", F.pmod(F.xxhash64(book_col), F.lit(TERM_SALTS))).repartition(tasks, *at).join(
            salted.repartition(tasks, *at), at, "left").drop("__salt")
    by = F.when(F.col("__often").isNull(), F.col("term")).otherwise(F.concat(F.lit("\0"), F.col(book_col).cast("string")))
    at = [lang_col, "__by"]
    s = tf.withColumn("__by", by).repartition(tasks, *at).join(df.withColumnRenamed("term", "__by").repartition(tasks, *at), at, "left")
    s = s.withColumn("df", F.coalesce("__often", "df")).join(per_lang, lang_col)
    s = s.withColumn("score", F.col("tf") * F.log(F.col("n_books") / F.col("df"))).repartition(tasks, book_col)
    w = Window.partitionBy(book_col).orderBy(F.round("score", 9).desc(), F.col("term"))
    r = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return r.select(book_col, F.col("rank").cast("bigint").alias("rank"), F.col("term").alias("keyword"),
                    F.round("score", 6).alias("score"))


# --- G7: categories by naive Bayes -----------------------------------------------

# A class is proposed if its posterior is at least this share of the best one's.
CATEGORY_SHARE = 0.1
# Classes of a model: a fixed list of fields, held on the driver.
MAX_CLASSES = 1_000


def train_categories(books: DataFrame, book_col: str, text_col: str, class_col: str) -> tuple[DataFrame, DataFrame]:
    """Naive Bayes as two tables of counts: ``(terms, classes)`` with
    ``term, category, n`` (occurrences) and ``category, n_books, n_terms,
    n_vocabulary`` (distinct terms of all classes).  ``books`` are the labelled
    ones; a book may carry several classes in several rows.  Rows without
    text or class teach nothing."""
    known = books.where(F.col(class_col).isNotNull() & F.col(text_col).isNotNull())
    words = known.select(F.col(class_col).alias("category"), F.explode_outer(word_tokens(text_col)).alias("term")).where(F.col("term").isNotNull())
    terms = words.groupBy("term", "category").agg(F.count("*").alias("n"))
    vocabulary = terms.agg(F.count_distinct("term").alias("n_vocabulary"))
    sums = terms.groupBy("category").agg(F.sum("n").alias("n_terms"))
    classes = known.groupBy(F.col(class_col).alias("category")).agg(F.count("*").alias("n_books")).join(sums, "category", "left")
    # one row on the right: the size of the vocabulary
    classes = classes.withColumn("one", F.lit(1)).join(F.broadcast(vocabulary.withColumn("one", F.lit(1))), "one").drop("one")
    return terms, classes.withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))


def categories(books: DataFrame, book_col: str, text_col: str, model: tuple[DataFrame, DataFrame],
               share: float = CATEGORY_SHARE, top: int = TOP_CATEGORIES) -> DataFrame:
    """G7 native: the most probable classes of every book, ``book, rank,
    category, score`` (score: posterior probability, best first, ties by name).

    Log posterior of a class: ln(its share of books) plus, for every occurrence
    of a term that any class knows, ln((n + 1) / (n_terms + n_vocabulary)).  The
    log of an unseen term is the same for all terms of a class, so a book needs
    the count of its known occurrences times that, and a correction only where
    (term, class) was seen: one join with the count table, one sum.  A term that
    all classes know meets one row per class, whatever the number of books, and
    rows of terms that stand in many books are dealt by book.
    """
    terms, classes = model
    fields = classes.orderBy("category").limit(MAX_CLASSES + 1).collect()
    if len(fields) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    all_books = sum(r.n_books for r in fields)
    each = F.array(*[F.struct(F.lit(r.category).alias("category"), F.log(F.lit(r.n_books) / F.lit(all_books)).alias("prior"),
                              F.lit(r.n_terms + r.n_vocabulary).alias("size")) for r in fields])
    if not fields:
        each = F.array().cast("array<struct<category:string,prior:double,size:bigint>>")
    tasks = text_tasks(books, text_col)
    tf = written(term_counts(books.select(book_col, text_col), [book_col], text_col, tasks), "term-counts")
    # all seen classes of a term with its counts, in one row per term
    seen = written(terms.groupBy("term").agg(F.collect_list(F.struct("category", "n")).alias("seen")), "seen-terms")
    often = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") > books.count() * FREQUENT_SHARE)
    often = written(seen.join(often, "term", "left_semi").withColumnRenamed("seen", "__often"), "frequent-terms")
    if (often.agg(F.sum(F.size("__often"))).first()[0] or 0) <= MAX_BROADCAST_TERMS:
        tf = tf.join(F.broadcast(often), "term", "left")
    else:
        salted = often.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TERM_SALTS - 1).cast("long"))))
        at = ["term", "__salt"]
        tf = tf.withColumn("__salt", F.pmod(F.xxhash64(book_col), F.lit(TERM_SALTS))).repartition(tasks, *at).join(
            salted.repartition(tasks, *at), at, "left").drop("__salt")
    by = F.when(F.col("__often").isNull(), F.col("term")).otherwise(F.concat(F.lit("\0"), F.col(book_col).cast("string")))
    hit = tf.withColumn("__by", by).repartition(tasks, "__by").join(
        seen.withColumnRenamed("term", "__by").repartition(tasks, "__by"), "__by", "left")
    hit = hit.withColumn("seen", F.coalesce("__often", "seen")).where(F.col("seen").isNotNull())
    per_book = hit.groupBy(book_col).agg(F.sum("tf").alias("known"))
    gains = (hit.select(book_col, "tf", F.explode("seen").alias("s")).groupBy(book_col, "s.category")
             .agg(F.sum(F.col("tf") * F.log(F.col("s.n") + 1)).alias("gain")))
    known = books.select(book_col).join(per_book, book_col, "left").withColumn("known", F.coalesce("known", F.lit(0)))
    all_classes = known.select("*", F.inline(each))
    scored = all_classes.join(gains, [book_col, "category"], "left").withColumn(
        "log", F.round(F.col("prior") + F.coalesce("gain", F.lit(0.0)) - F.col("known") * F.log("size"), 9))
    of_book = Window.partitionBy(book_col)
    best = scored.withColumn("up", F.exp(F.col("log") - F.max("log").over(of_book)))
    ranked = best.withColumn("score", F.col("up") / F.sum("up").over(of_book)).withColumn(
        "rank", F.row_number().over(of_book.orderBy(F.desc("log"), "category")))
    return ranked.where((F.col("rank") <= top) & (F.col("up") >= share)).select(
        book_col, F.col("rank").cast("bigint").alias("rank"), "category", F.round("score", 6).alias("score"))


def as_answer(items: DataFrame, book_col: str, item_col: str) -> DataFrame:
    """One text per book, one item per line (the shape a model answers in)."""
    return items.groupBy(book_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item_col))), lambda x: x[item_col]),
                     "\n").alias("text"))


def answer_lines(answers: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Answer text -> one row per non-blank stripped line."""
    return answers.select(*keys, F.posexplode_outer(parse_lines(text_col)).alias("line_no", "item")).filter(
        F.col("item").isNotNull()).withColumn("line_no", F.col("line_no").cast("bigint"))


def summary_inputs(abstracts: DataFrame, keys: list[str]) -> DataFrame:
    """G5 inputs: all abstracts (``summary``) and all but the first
    (``summary_without_intro``; empty for a one-abstract book, still sent).
    ``abstracts``: keys, split_index, abstract, status."""
    ok = F.when(F.col("status") == "ok", F.struct("split_index", "abstract"))
    arr = abstracts.groupBy(*keys).agg(F.array_sort(F.collect_list(ok)).alias("__a"))
    texts = F.transform("__a", lambda x: x["abstract"])
    both = arr.select(*keys, F.array(
        F.struct(F.lit(fixed.KIND_SUMMARY).alias("kind"), F.array_join(texts, fixed.BLANK_LINE).alias("input")),
        F.struct(F.lit(fixed.KIND_SUMMARY_NO_INTRO).alias("kind"),
                 F.array_join(F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1))), fixed.BLANK_LINE).alias("input")),
    ).alias("__v"))
    return both.select(*keys, F.inline("__v"))


def native_summaries(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """G5 native: extractive digest of each input at a tenth of its size.
    ``inputs`` (see :func:`summary_inputs`) are made once and dealt by size."""
    inputs = written(inputs, "summary-inputs")
    staged = inputs.withColumn("target_size", target_size("input"))
    out = extractive_abstracts(staged, keys + ["kind"], chunk_col="input", out_col="summary", num_partitions=text_tasks(inputs, "input"))
    return out.drop("target_size")
