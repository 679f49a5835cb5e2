"""Model-backed stages: compression rounds and book tasks through ``generate``.

* :func:`prompted_chunk_model` turns a ``model_fn`` into a chunk stage for
  :func:`quire.plans.compress.adaptive_compress`: C5 renders the resume
  prompt per split, G1 calls the model, the answer becomes the abstract.
* :func:`run_book_task` is one of the abstract / keywords / categories
  commands for every eligible book at once: F3 eligibility -> I5 abstracts ->
  C5 prompt -> G1 -> K1 append (never overwriting a non-empty output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import prompts as P
from quire.operators.gating import eligibility, of_provider
from quire.operators.generate import DEFAULT_MAX_ATTEMPTS, generate, prompt_id
from quire.operators.tasks import summary_inputs
from quire.session import shared_dir
from quire.sinks import append_missing_outputs


def prompted_chunk_model(model_fn, language_col: str = "language", template: str | None = None,
                         max_attempts: int = DEFAULT_MAX_ATTEMPTS, factory: bool = False, **gen):
    """ChunkModel: splits -> splits + ``abstract`` from ``model_fn``.
    ``language_col`` must be one of the book keys."""
    tpl = template if template is not None else P.load_template("resume")
    keys_order = P.PROMPT_KEYS["resume"]

    def stage(splits: DataFrame, keys: list[str]) -> DataFrame:
        values = {"TARGET_SIZE": F.col("target_size"), "TEXT": F.col("chunk"), "LANGUAGE": F.col(language_col)}
        prompts = splits.withColumn("prompt", P.render(tpl, keys_order, values))
        out = generate(prompts, model_fn, keys + ["split_index"], max_attempts=max_attempts, factory=factory, **gen)
        # the error and the attempts stay with the split
        return out.withColumnRenamed("text", "abstract").withColumn(
            "error", F.when(F.col("error").isNotNull(), F.concat_ws("", "error", F.lit(" (attempts: "), "attempts", F.lit(")")))
        ).drop("prompt", "status", "attempts")
    return stage


TASK_KIND = {
    "abstract": [fixed.KIND_SUMMARY, fixed.KIND_SUMMARY_NO_INTRO],
    "keywords": [fixed.KIND_KEYWORDS],
    "categories": [fixed.KIND_CATEGORIES],
}


def run_book_task(spark: SparkSession, task: str, books: DataFrame, splits: DataFrame, outputs: DataFrame | None,
                  model_fn, provider: str, outputs_path: str, keys: list[str] = ("language", "book"),
                  language_col: str = "language", template: str | None = None,
                  max_attempts: int = DEFAULT_MAX_ATTEMPTS, **gen) -> DataFrame:
    """Run ``task`` for every eligible book of ``provider`` and append the
    answers to ``outputs_path``.  ``splits`` is the provider's splits table
    (last batch per book is used); ``outputs`` the existing outputs.
    Returns the rows written (failed answers are returned with their error
    but not written, so the next run retries them)."""
    keys = list(keys)
    if task not in TASK_KIND:
        raise ValueError(f"unknown task {task!r}")
    tpl = template if template is not None else P.load_template(task)
    key_order = P.PROMPT_KEYS[task]
    existing = of_provider(outputs, provider) if outputs is not None else spark.createDataFrame(
        [], ", ".join(f"{k} string" for k in keys) + ", kind string, text string")
    splits = of_provider(splits, provider)
    # The last batch of each book
    last = splits.groupBy(*keys).agg(F.max("batch").alias("batch"))
    cur = splits.join(last, keys + ["batch"])
    state = cur.select(*keys).distinct()
    ok = eligibility(books, state, existing, keys).filter((F.col("task") == task) & F.col("eligible"))
    cur = cur.join(ok.select(*keys), keys, "left_semi")
    if task == "abstract":
        inputs = summary_inputs(cur, keys)                   # G5: both variants
    else:
        okrow = F.when(F.col("status") == "ok", F.struct("split_index", "abstract"))
        inputs = cur.groupBy(*keys).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(okrow)), lambda x: x["abstract"]),
                         fixed.BLANK_LINE).alias("input")).withColumn("kind", F.lit(TASK_KIND[task][0]))
    inputs = inputs.join(books.select(*keys, F.col(language_col).alias("__lang")) if language_col not in keys
                         else books.select(*keys).withColumn("__lang", F.col(language_col)), keys)
    values = {"ABSTRACT_CONTENTS": F.col("input"), "LANGUAGE": F.col("__lang")}
    prompts = inputs.withColumn("prompt", P.render(tpl, key_order, values)).withColumn(
        "prompt_id", prompt_id(F.lit(provider), F.col("prompt")))
    answers = generate(prompts, model_fn, keys + ["kind"], max_attempts=max_attempts, **gen)
    # materialise once: the model must not run again for a later action
    done_path = shared_dir(spark, f"answers-{task}")
    answers.withColumn("provider", F.lit(provider)).drop("prompt").write.parquet(done_path)
    answers = spark.read.parquet(done_path)
    good = answers.filter(F.col("status") == "ok").select(*keys, "provider", "kind", "text")
    append_missing_outputs(good, existing, outputs_path, keys)
    return answers.select(*keys, "provider", "kind", "text", "status", "error", "attempts")
