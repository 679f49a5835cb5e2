"""F1-F8: what still has to run, as semi/anti joins over the state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import fixed

TASKS = ("resume", "abstract", "keywords", "categories")
# downstream task -> output kinds that must all exist (non-empty) for "done"
TASK_OUTPUTS = {
    "abstract": list(fixed.SUMMARY_KINDS),
    "keywords": [fixed.KIND_KEYWORDS],
    "categories": [fixed.KIND_CATEGORIES],
}


def present_outputs(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """an output counts only when its text is non-empty."""
    return outputs.filter(F.col("text").isNotNull() & (F.length("text") > 0)).select(*keys, "kind").distinct()


def of_provider(outputs: DataFrame, provider: str) -> DataFrame:
    """the outputs of one provider.  A table without a provider column
    belongs to the provider that reads it."""
    if "provider" not in outputs.columns:
        return outputs
    return outputs.filter(F.col("provider") == provider)


def output_flags(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Per book: has_abstracts and done_<task> (F1, F2: the summary needs
    both variants)."""
    p = present_outputs(outputs, keys)
    aggs = [F.bool_or(F.col("kind") == fixed.KIND_ABSTRACTS).alias("has_abstracts")]
    for task, kinds in TASK_OUTPUTS.items():
        done = F.lit(True)
        for kind in kinds:
            done = done & F.bool_or(F.col("kind") == kind)
        aggs.append(done.alias(f"done_{task}"))
    return p.groupBy(*keys).agg(*aggs)


def eligibility(books: DataFrame, state: DataFrame, outputs: DataFrame, keys: list[str],
                text_col: str = "content") -> DataFrame:
    """F3 + F4: one row per (book, task) with ``eligible`` and a reason:
    ``no_content`` / ``no_state`` / ``no_abstracts`` / ``already_done`` / ``run``.

    ``state`` lists the books whose compression state exists.  Tasks are a
    fixed literal list exploded per book (no join for them).
    """
    st = state.select(*keys).distinct().withColumn("has_state", F.lit(True))
    flags = output_flags(outputs, keys)
    b = (books.select(*keys, (F.coalesce(F.length(text_col), F.lit(0)) > 0).alias("has_content"))
         .join(st, keys, "left").join(flags, keys, "left"))
    has_state = F.coalesce(F.col("has_state"), F.lit(False))
    has_abs = F.coalesce(F.col("has_abstracts"), F.lit(False))
    t = b.withColumn("task", F.explode(F.array(*[F.lit(x) for x in TASKS])))
    done = F.coalesce(F.when(F.col("task") == "abstract", F.col("done_abstract"))
                      .when(F.col("task") == "keywords", F.col("done_keywords"))
                      .when(F.col("task") == "categories", F.col("done_categories")), F.lit(False))
    reason = (F.when(F.col("task") == "resume",
                     F.when(~F.col("has_content"), "no_content").when(has_abs, "already_done").otherwise("run"))
              .when(~has_state, "no_state")
              .when(~has_abs, "no_abstracts")
              .when(done, "already_done")
              .otherwise("run"))
    return t.select(*keys, "task", (reason == "run").alias("eligible"), reason.alias("reason"))


def missing_outputs(books: DataFrame, outputs: DataFrame, keys: list[str],
                    kinds=(fixed.KIND_SUMMARY, fixed.KIND_SUMMARY_NO_INTRO, fixed.KIND_KEYWORDS,
                           fixed.KIND_CATEGORIES)) -> DataFrame:
    """F1/K1: for books whose abstracts exist, the outputs still to write
    (left-anti join against the non-empty outputs)."""
    p = present_outputs(outputs, keys)
    ready = books.select(*keys).join(p.filter(F.col("kind") == fixed.KIND_ABSTRACTS).select(*keys), keys, "left_semi")
    need = ready.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return need.join(p, keys + ["kind"], "left_anti")


def select_providers(known: DataFrame, chosen: list[str] | None, col: str = "provider") -> list[str]:
    """F8: the chosen providers must all be known; default = all, sorted.
    ``known`` is a small distinct list (one row per provider)."""
    names = sorted(r[0] for r in known.select(col).distinct().collect())
    if not chosen:
        return names
    unknown = [p for p in chosen if p not in names]
    if unknown:
        raise ValueError(f"unknown providers {unknown}; available: {names}")
    return list(chosen)
