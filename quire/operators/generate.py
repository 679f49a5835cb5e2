"""Pluggable batch generation over a prompt table.

A model is a Python callable ``model_fn(prompts: list[str]) -> list[str]``
(one answer per prompt).  Calls that fail for a passing reason are retried
through a durable queue: every call leaves one row in a table of attempts, with
the outcome and, where another call may follow, the time before which it must
not be made.  A *wave* is one Spark job that makes a single call for every
prompt that is due; no task ever sleeps, so prompts that wait hold no
executor, retries may be unlimited, and a crash costs the wave in flight at
most.  Errors are data (``status``, ``error``, ``attempts``) and never fail the
job.  Between waves the driver waits for the next prompt that falls due.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.session import shared_dir, written

ModelFn = Callable[[list], list]

DEFAULT_MAX_ATTEMPTS = 6
UNLIMITED = -1

# outcomes of one call
GOOD, PASSING, FINAL = "good", "passing", "final"

CALL_SCHEMA = "prompt_id string, attempt int, outcome string, text string, error string"
ATTEMPT_SCHEMA = CALL_SCHEMA + ", status string, not_before double"

_PASSING_NAMES = re.compile("|".join(fixed.RETRYABLE_NAME_PARTS))


def outcome_of(answer) -> tuple[str, str | None, str | None]:
    """(outcome, text, error) of an answer or of the exception in its place."""
    if isinstance(answer, BaseException):
        name = type(answer).__name__
        passing = getattr(answer, "status_code", None) in fixed.RETRYABLE_STATUS_CODES or _PASSING_NAMES.search(name)
        return (PASSING if passing else FINAL), None, f"{name}: {answer}"
    if answer is None or not str(answer).strip():
        return FINAL, None, "BlankAnswer: model returned an empty answer"
    return GOOD, str(answer), None


def wait_seconds(attempt: Column) -> Column:
    """Seconds to wait after the given failed attempt (1, 2, ...)."""
    doublings = F.least(attempt - 1, F.lit(fixed.RETRY_MAX_DOUBLINGS))
    return (F.lit(fixed.RETRY_BASE_SECONDS) * F.pow(F.lit(2), doublings)).cast("double")


def with_policy(calls: DataFrame, max_attempts: int, now: Column) -> DataFrame:
    """G2 as columns over calls (``attempt``, ``outcome``): ``status`` ok,
    failed or waiting, and ``not_before`` of the next call.  ``max_attempts``
    counts all calls (0 and 1 both mean one); -1 is unlimited."""
    spent = F.lit(False) if max_attempts == UNLIMITED else F.col("attempt") >= max(max_attempts, 1)
    status = F.when(F.col("outcome") == GOOD, "ok").when((F.col("outcome") == FINAL) | spent, "failed").otherwise("waiting")
    return calls.withColumn("status", status).withColumn(
        "not_before", F.when(F.col("status") == "waiting", now + wait_seconds(F.col("attempt"))))


# Registry of named models (one place, so names cannot drift apart).
class Registry(dict):
    """Model factories by name; an unknown name is an error that lists them."""

    def __missing__(self, name: str):
        raise ValueError(f"model {name!r} not registered; choose from {sorted(self)}")


MODELS: Registry = Registry()


def register_model(name: str, factory: Callable[[], ModelFn]) -> None:
    MODELS[name] = factory


def build_model(name: str) -> ModelFn:
    return MODELS[name]()


def leading_lines() -> ModelFn:
    """A stand-in that needs no service: the lines that open the last tenth of
    a prompt's lines, one at least.  Deterministic, for dry runs of the book
    tasks and tests."""
    def answer(prompts: list) -> list:
        out = []
        for p in prompts:
            lines = [x for x in p.splitlines() if x.strip()]
            out.append("\n".join(lines[-max(1, len(lines) // fixed.TARGET_DIVISOR):]))
        return out
    return answer


register_model("native", leading_lines)


def _one_call_each(model, factory: bool):
    def run(batches):
        fn = model() if factory else model
        for pdf in batches:
            rows = []
            for prompt in pdf["prompt"]:
                try:  # one prompt per call, so that one failure never costs another
                    answer = fn([prompt])[0]
                except Exception as exc:  # error isolation: every failure becomes a row
                    answer = exc
                rows.append(outcome_of(answer))
            got = pd.DataFrame(rows, columns=["outcome", "text", "error"], index=pdf.index)
            yield pd.concat([pdf[["prompt_id", "attempt"]], got], axis=1)
    return run


def last_attempts(attempts: DataFrame) -> DataFrame:
    """The last row of every prompt."""
    rest = [c for c in attempts.columns if c != "prompt_id"]
    return attempts.groupBy("prompt_id").agg(F.max_by(F.struct(*rest), "attempt").alias("a")).select("prompt_id", "a.*")


def wave(asked: DataFrame, path: str, model, factory: bool, max_attempts: int, now: float, num_partitions: int) -> None:
    """One call for each prompt of ``asked`` (``prompt_id, prompt``) that is
    due at ``now``, appended to the attempts at ``path``."""
    spark = asked.sparkSession
    so_far = last_attempts(spark.read.schema(ATTEMPT_SCHEMA).parquet(path)).select("prompt_id", "attempt", "status", "not_before")
    due = asked.join(so_far, "prompt_id", "left").where(
        F.col("status").isNull() | ((F.col("status") == "waiting") & (F.col("not_before") <= now)))
    due = due.select("prompt_id", "prompt", (F.coalesce("attempt", F.lit(0)) + 1).cast("int").alias("attempt"))
    # an explicit count, which adaptive execution leaves alone: latency of the
    # model, not bytes, decides how many tasks there should be
    calls = due.repartition(num_partitions, F.xxhash64("prompt_id")).mapInPandas(_one_call_each(model, factory), CALL_SCHEMA)
    with_policy(calls, max_attempts, F.lit(now)).write.mode("append").parquet(path)


def generate(prompts: DataFrame, model: str | ModelFn | Callable[[], ModelFn], key_cols: list[str],
             prompt_col: str = "prompt", max_attempts: int = DEFAULT_MAX_ATTEMPTS,
             num_partitions: int | None = None, factory: bool = False,
             sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time,
             workdir: str | None = None) -> DataFrame:
    """G1: add ``text, status, error, attempts`` to every prompt row.

    ``model`` is the name of a registered model, the callable itself, or, with
    ``factory=True``, what builds it (called once per task, e.g. to load
    weights).  Rows equal in ``key_cols`` and prompt are asked once.  Waves run
    here, until no prompt waits; ``sleep`` and ``clock`` are the driver's.  With
    a ``workdir`` the queue outlives the session: a later call on it asks no
    answered or failed prompt again and keeps to the times of waiting ones.
    """
    if isinstance(model, str):
        model, factory = MODELS[model], True
    spark = prompts.sparkSession
    path = f"{workdir or shared_dir(spark, 'generate')}/attempts"
    ident = prompt_id(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in key_cols], F.coalesce(F.col(prompt_col), F.lit("")))
    rows = written(prompts.withColumn("__prompt_id", ident), "prompts")
    asked = rows.select(F.col("__prompt_id").alias("prompt_id"), F.coalesce(prompt_col, F.lit("")).alias("prompt")).dropDuplicates(["prompt_id"])
    n = num_partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.createDataFrame([], ATTEMPT_SCHEMA).write.mode("append").parquet(path)
    now = clock()
    while True:
        wave(asked, path, model, factory, max_attempts, now, n)
        waiting = last_attempts(spark.read.schema(ATTEMPT_SCHEMA).parquet(path)).join(asked, "prompt_id", "left_semi").where("status = 'waiting'")
        due = waiting.agg(F.min("not_before")).first()[0]
        if due is None:
            break
        if due > clock():
            sleep(due - clock())
        now = max(due, clock())
    last = last_attempts(spark.read.schema(ATTEMPT_SCHEMA).parquet(path)).select(
        F.col("prompt_id").alias("__prompt_id"), "text", "status", "error", F.col("attempt").alias("attempts"))
    return rows.join(last, "__prompt_id", "left").drop("__prompt_id")


def prompt_id(*cols) -> Column:
    """Stable id of a prompt (provider + prompt text) for write-once keys."""
    return F.sha2(F.concat_ws("\u0000", *cols), 256)
