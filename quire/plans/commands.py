"""The tool's commands as Spark jobs (Python functions, no CLI parser).

prepare_dir -> :func:`layout_plan` / :func:`validate_layout` (plan tables;
files are not moved); post-processing -> :func:`post_process`; resume ->
:func:`resume`; abstract / keywords / categories -> :func:`book_task`;
evaluation -> :func:`evaluate_summaries`, :func:`coherence_report`.
Every command is one set of jobs over all books, with errors as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import prompts as P
from quire.operators import evaluate as EV
from quire.operators.gating import of_provider
from quire.operators.generate import MODELS
from quire.operators.layout import layout_issues, plan_layout
from quire.plans.compress import adaptive_compress
from quire.plans.reports import missing_summaries, provider_report, score_table, write_score_table
from quire.plans.tasks import prompted_chunk_model, run_book_task
from quire.sinks import append_missing_outputs, write_table
from quire.sources.corpus import book_contents, list_files
from quire.sources.summaries import discover_providers, read_summaries, summary_paths

KEYS = ["language", "book"]


def layout_plan(spark: SparkSession, books_root: str) -> DataFrame:
    """prepare_dir as a plan: ``language, src, dst`` for every misplaced PDF."""
    return plan_layout(list_files(spark, books_root))


def validate_layout(spark: SparkSession, books_root: str) -> tuple[bool, DataFrame]:
    issues = layout_issues(list_files(spark, books_root))
    return issues.isEmpty(), issues


def post_process(spark: SparkSession, books_root: str, contents_path: str,
                 ocr_dir: str = "paddle_output", by_page: bool = False) -> DataFrame:
    """Clean every book with OCR output and write ``contents`` (partitioned by
    language); returns the issues (books without usable output).  With
    ``by_page`` the contents are pieces with their ``start_pos``."""
    contents, issues = book_contents(spark, books_root, ocr_dir, by_page)
    write_table(contents, contents_path, ["language"], mode="overwrite")
    return issues


def resume(spark: SparkSession, contents: DataFrame, provider: str, window: int, outputs_path: str,
           model_fn=None, existing_outputs: DataFrame | None = None, workdir: str | None = None,
           max_rounds: int | None = None, on_error: str = "hold", **gen) -> DataFrame:
    """Compress every book without non-empty abstracts of ``provider`` until it
    fits ``window``; append ``abstract_contents`` outputs.  ``model_fn`` is a
    callable or the name of a registered model; ``None`` uses the native
    extractive model.  Only books that fit are written as finished."""
    max_chunk = window - P.overhead(P.load_template("resume"), P.PROMPT_KEYS["resume"])
    todo = contents
    if existing_outputs is not None:
        done = of_provider(existing_outputs, provider).filter(
            (F.col("kind") == fixed.KIND_ABSTRACTS) & (F.length("text") > 0))
        todo = contents.join(done.select(*KEYS), KEYS, "left_anti")
    if isinstance(model_fn, str):
        model_fn, gen = MODELS[model_fn], {**gen, "factory": True}
    kw = {} if model_fn is None else {"model": prompted_chunk_model(model_fn, **gen)}
    books = adaptive_compress(spark, todo, KEYS, window, max_chunk, max_rounds=max_rounds, on_error=on_error,
                              workdir=workdir, provider=provider, **kw)
    out = books.filter(F.col("status") == "done").select(
        *KEYS, F.lit(provider).alias("provider"), F.lit(fixed.KIND_ABSTRACTS).alias("kind"),
        F.col("abstract_contents").alias("text"))
    append_missing_outputs(out, existing_outputs, outputs_path, KEYS)
    return books


def book_task(spark: SparkSession, task: str, books: DataFrame, splits: DataFrame, outputs: DataFrame | None,
              model_fn, provider: str, outputs_path: str, **gen) -> DataFrame:
    """abstract / keywords / categories for every eligible book."""
    return run_book_task(spark, task, books, splits, outputs, model_fn, provider, outputs_path, KEYS, **gen)


def evaluate_summaries(spark: SparkSession, results_root: str, out_csv: str | None = None,
                       vectors: DataFrame | None = None, with_language: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reference-based scores (E1-E7) for every provider's summary;
    ``with_language`` adds the language code (E2)."""
    scores, skipped = score_table(read_summaries(spark, results_root), vectors, lang_col="language" if with_language else None)
    if out_csv:
        write_score_table(scores, out_csv)
    return scores, skipped


def coherence_report(spark: SparkSession, results_root: str, out_csv: str | None = None,
                     providers: list[str] | None = None, missing_path: str | None = None) -> DataFrame:
    """Coherence per provider (E8-E11) with the native sentence flags.
    Providers have short names (S7) and include the reference summaries;
    ``missing_path`` takes the books without a summary of a chosen provider."""
    from quire.operators.gating import select_providers
    from quire.functions.text import clean_summary

    paths = summary_paths(spark, results_root)
    # short names, the human summaries among them; the first path of a name stands for it
    found = discover_providers(paths).where(F.col("provider").isNotNull())
    chosen = select_providers(found, providers)
    known = found.where(F.col("provider").isin(*chosen)).select(F.col("provider").alias("short"), F.col("relpath").alias("provider"))
    s = read_summaries(spark, results_root).join(known, "provider").drop("provider").withColumnRenamed("short", "provider")
    s = s.withColumn("summary", clean_summary("summary"))
    if missing_path:
        write_table(missing_summaries(s, chosen, KEYS), missing_path, mode="overwrite")
    flags = EV.sentence_flags(s, ["provider", *KEYS])
    return provider_report(flags, out_csv, "provider", KEYS)
