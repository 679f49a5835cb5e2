"""Compress every book round by round until its text fits the window.

State lives in tables, ``input`` (the text of every book, appended as books
arrive) and ``splits`` (one row per answer, append-only), both partitioned by
``provider`` and ``config`` (a digest of window, chunk size and keys), splits
also by ``batch``.  Providers and settings never see each other's state.
In each round the open splits, those without a usable answer, are found by an
anti-join and only they are sent to the model; answers are appended a part at
a time, so a crash loses one part at most.  Outcomes per book are derived from
the splits in every run: a ``held`` book is driven on by the next run, and a
book added later joins in.  All books of a round are one job.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from functools import partial, reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.text import strip
from quire.operators.chunks import check_max_chunk, plan_splits, target_size
from quire.operators.extractive import extractive_abstracts
from quire.operators.scan import join_same
from quire.session import shared_dir, text_tasks, written

# A model stage: splits (keys, split_index, chunk, target_size, ...) -> same rows
# plus ``abstract`` (string, may be blank or null on failure).
ChunkModel = Callable[[DataFrame, list], DataFrame]


def native_model(splits: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    return extractive_abstracts(splits, keys + ["split_index"], num_partitions=tasks)


def dealt(model: ChunkModel, texts: DataFrame, text_col: str) -> ChunkModel:
    """The native model deals the splits of ``texts`` to as many tasks as their
    size asks for; other models decide that themselves."""
    return partial(model, tasks=text_tasks(texts, text_col)) if model is native_model else model


def with_split_status(df: DataFrame, col: str = "abstract") -> DataFrame:
    """I4: a blank or missing answer leaves the split open (status failed);
    the model stage's own error is kept."""
    ok = F.col(col).isNotNull() & (strip(col) != "")
    told = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("error", F.when(~ok, F.coalesce(told, F.lit("blank answer"))))
              .withColumn("status", F.when(ok, "ok").otherwise("failed")))


def compress_round(contents: DataFrame, keys: list[str], max_chunk: int, text_col: str = "content",
                   model: ChunkModel = native_model, sized: tuple[DataFrame, str] | None = None) -> DataFrame:
    """One round (C1-C3, G4, I3, I4): one row per split with its abstract.
    The chunk text is not kept: the round's input text is stored and the
    offsets reproduce any chunk.  ``sized`` is a table and column of about the
    size of the texts, if measuring those would make them twice."""
    model = dealt(model, *(sized or (contents, text_col)))
    splits = plan_splits(contents.select(*keys, text_col), max_chunk, text_col=text_col)
    splits = splits.drop(text_col).withColumn("target_size", target_size("chunk"))
    return with_split_status(model(splits, keys))


def join_abstracts(splits: DataFrame, keys: list[str]) -> DataFrame:
    """I5 + I6: per book, the successful abstracts in index order joined by a
    blank line; ``n_ok`` / ``n_splits`` for the failure rules."""
    ok = F.when(F.col("status") == "ok", F.struct("split_index", "abstract"))
    return splits.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(ok)), lambda x: x["abstract"]),
                     fixed.BLANK_LINE).alias("joined"),
        F.count(ok).alias("n_ok"), F.count("*").alias("n_splits"))


def classify(joined: DataFrame, before: DataFrame, keys: list[str], window: int, round_no: int,
             max_rounds: int | None, on_error: str) -> DataFrame:
    """Outcome of one round per book: done / failed (no usable split, also a
    book without text) / held / stalled (no shrink) / unfinished (round
    limit) / continue."""
    j = before.select(*keys, F.length("content").alias("__prev_len")).join(joined, keys, "left")
    n_ok = F.coalesce(F.col("n_ok"), F.lit(0))
    n = F.length("joined")
    status = (F.when(n_ok == 0, "failed")
              .when(F.lit(on_error == "hold") & (n_ok < F.col("n_splits")), "held")
              .when(n <= window, "done")
              .when(n >= F.col("__prev_len"), "stalled")
              .when(F.lit(max_rounds is not None and round_no >= max_rounds), "unfinished")
              .otherwise("continue"))
    return j.select(*keys, F.lit(round_no).cast("bigint").alias("rounds"), status.alias("status"),
                    F.coalesce(F.col("joined"), F.lit("")).alias("abstract_contents"))


def open_splits(planned: DataFrame, answered: DataFrame | None, keys: list[str]) -> DataFrame:
    """The planned splits of a batch without a usable answer yet."""
    if answered is None:
        return planned
    good = answered.filter(F.col("status") == "ok").select(*keys, "split_index").distinct()
    return planned.join(good, keys + ["split_index"], "left_anti")


def latest_answers(planned: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """One row per planned split: its usable answer, else its last failure."""
    at = keys + ["split_index"]
    best = answered.groupBy(*at).agg(F.max_by(F.struct("abstract", "status", "error"),
                                              F.struct((F.col("status") == "ok").alias("ok"), "run")).alias("__a"))
    return planned.select(*at).join(best, at, "left").select(
        *at, F.col("__a.abstract").alias("abstract"), F.coalesce("__a.status", F.lit("open")).alias("status"),
        F.col("__a.error").alias("error"))


def adaptive_compress(spark: SparkSession, contents: DataFrame, keys: list[str], window: int,
                      max_chunk: int, text_col: str = "content", model: ChunkModel = native_model,
                      max_rounds: int | None = None, on_error: str = "hold",
                      workdir: str | None = None, provider: str = "native", parts: int = 1,
                      keep_digest: bool = False) -> DataFrame:
    """Rounds until every book's joined abstracts fit ``window``.

    ``max_chunk`` is ``window - prompt overhead``.  Always at least one round,
    and no limit by default: a book that no longer shrinks ends ``stalled``.
    ``on_error='hold'`` leaves a book with failed splits open (``held``), and a
    later run on the same ``workdir`` sends only those splits again; ``'drop'``
    goes on without them like the original tool.  ``parts`` cuts a round's
    open splits into that many model jobs, each written before the next.
    Returns ``keys, rounds, status, abstract_contents`` per book of
    ``contents`` (and ``input_digest`` with ``keep_digest``).  State belongs to
    a book *and* its text: a book whose text has changed is compressed anew,
    and :func:`split_state` tells which are.
    """
    check_max_chunk(max_chunk)
    if on_error not in ("drop", "hold"):
        raise ValueError("on_error must be 'drop' or 'hold'")
    workdir = workdir or shared_dir(spark, "compress")
    mine = f"provider={quote(provider, safe='')}/config={_config(window, max_chunk, keys)}"
    run = uuid.uuid4().hex[:12]
    # every text is stored once: all rounds cut the same stored text.  Rows are
    # addressed by book and digest, so a corrected text starts anew and the state
    # of the old one stays where it was
    input_path = f"{workdir}/input/{mine}"
    new = with_digest(contents.select(*keys, F.col(text_col).alias("content")))
    book, keys = keys, [*keys, DIGEST]
    if _exists(spark, input_path):
        # the texts of this run are made once, here, and only unknown ones are added
        new = written(new, "compress-texts")
        wanted = new.select(*keys)
        join_same(new, spark.read.parquet(input_path).select(*keys), keys, "left_anti").write.mode("append").parquet(input_path)
        pending = join_same(spark.read.parquet(input_path), wanted, keys, "left_semi")
    else:
        new.write.mode("append").parquet(input_path)
        pending = spark.read.schema(new.schema).parquet(input_path)
        wanted = pending.select(*keys)
    round_no, outcomes = 1, []
    while True:
        splits_path = f"{workdir}/splits/{mine}/batch={round_no}"
        planned = plan_splits(pending.select(*keys, "content"), max_chunk, text_col="content").drop("content").withColumn(
            "target_size", target_size("chunk"))
        ask = dealt(model, pending, "content")
        for part in range(parts):
            todo = planned
            if parts > 1:
                todo = todo.filter(F.pmod(F.xxhash64(*keys, "split_index"), F.lit(parts)) == part)
            done = spark.read.parquet(splits_path) if _exists(spark, splits_path) else None
            todo = open_splits(todo, done, keys)
            if done is not None and todo.isEmpty():
                continue
            # a model knows books, of which a run has one text each
            answers = join_same(with_split_status(ask(todo.drop(DIGEST), book)), wanted, book)
            answers = answers.select(*keys, "split_index", "abstract", "status", "error", F.lit(_now()).alias("run"))
            answers.write.mode("append").parquet(splits_path)
        answers_now = latest_answers(planned, spark.read.parquet(splits_path), keys)
        outcome_path = f"{workdir}/runs/{run}/round={round_no}"
        classify(join_abstracts(answers_now, keys), pending, keys, window, round_no, max_rounds, on_error).write.parquet(outcome_path)
        state = spark.read.parquet(outcome_path)
        outcomes.append(state.filter(F.col("status") != "continue"))
        pending = state.filter(F.col("status") == "continue").select(
            *keys, F.col("abstract_contents").alias("content"))
        if pending.isEmpty():
            break
        round_no += 1
    return reduce(DataFrame.unionByName, outcomes).drop(*([] if keep_digest else [DIGEST]))


DIGEST = "input_digest"


def with_digest(contents: DataFrame, text_col: str = "content") -> DataFrame:
    """SHA-256 of a book's text; of nothing for a null one."""
    return contents.withColumn(DIGEST, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def split_state(spark: SparkSession, contents: DataFrame, keys: list[str], workdir: str, window: int, max_chunk: int,
                text_col: str = "content", provider: str = "native") -> DataFrame:
    """``keys, state, n_answers, n_old``: what ``workdir`` holds for the books
    as they are now.  ``state`` is ``new`` (no text of the book was ever
    stored), ``changed`` (only other texts were: the next run starts anew),
    ``stored`` (this text, no usable answer yet) or ``answered``; ``n_answers``
    counts the usable answers to this text, ``n_old`` other texts."""
    mine = f"provider={quote(provider, safe='')}/config={_config(window, max_chunk, keys)}"
    now = with_digest(contents.select(*keys, F.col(text_col).alias("content"))).drop("content")
    stored, answers = now.limit(0), now.limit(0).withColumn("n_answers", F.lit(0).cast("bigint"))
    if _exists(spark, f"{workdir}/input/{mine}"):
        stored = spark.read.parquet(f"{workdir}/input/{mine}").select(*keys, DIGEST).distinct()
        splits = spark.read.parquet(f"{workdir}/splits/{mine}").where("status = 'ok'")
        answers = splits.groupBy(*keys, DIGEST).agg(F.count_distinct("batch", "split_index").alias("n_answers"))
    seen = join_same(now.withColumnRenamed(DIGEST, "now"), stored, keys, "left").groupBy(*keys, "now").agg(
        F.coalesce(F.bool_or(F.col(DIGEST) == F.col("now")), F.lit(False)).alias("same"),
        F.count_if(F.col(DIGEST) != F.col("now")).alias("n_old")).withColumnRenamed("now", DIGEST)
    n = F.coalesce("n_answers", F.lit(0))
    state = F.when(F.col("same") & (n > 0), "answered").when(F.col("same"), "stored").when(F.col("n_old") > 0, "changed").otherwise("new")
    return join_same(seen, answers, [*keys, DIGEST], "left").select(*keys, state.alias("state"), n.alias("n_answers"), "n_old")


def changed_issues(state: DataFrame, keys: list[str]) -> DataFrame:
    """Issue rows for books whose text is not the one that was compressed."""
    return state.where("state = 'changed'").select(*keys, F.lit("compress").alias("stage"),
                                                   F.concat(F.lit("text changed; versions stored before: "), "n_old").alias("reason"))


def last_abstracts(spark: SparkSession, books: DataFrame, keys: list[str], workdir: str) -> DataFrame:
    """Splits of each book's last batch: ``keys, split_index, abstract, status``.
    ``books`` is what one :func:`adaptive_compress` returned from a ``workdir``
    that no run of other settings wrote to; with ``keep_digest``, if books there
    have changed."""
    splits = spark.read.parquet(f"{workdir}/splits")
    at = keys + ([DIGEST] if DIGEST in books.columns else [])
    last = books.select(*at, F.col("rounds").alias("batch"))
    return splits.join(last, at + ["batch"]).select(*keys, "split_index", "abstract", "status")


def _config(window: int, max_chunk: int, keys: list[str]) -> str:
    return hashlib.sha1(repr((window, max_chunk, list(keys))).encode()).hexdigest()[:12]


def _now() -> int:
    return time.time_ns()


def _exists(spark: SparkSession, path: str) -> bool:
    """True when a completed Spark write (its _SUCCESS marker) is at ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
