"""The retry queue, its policy and batch generation with fake models."""

import pytest
from pyspark.sql import functions as F

from quire.operators.generate import FINAL, GOOD, PASSING, generate, last_attempts, outcome_of, wait_seconds, with_policy


class ApiError(Exception):
    def __init__(self, code):
        super().__init__(f"status {code}")
        self.status_code = code


class ReadTimeout(Exception):
    pass


class Clock:
    """The driver's time; waiting is noted and passes at once."""

    def __init__(self):
        self.now, self.waits = 1000.0, []

    def time(self):
        return self.now

    def sleep(self, seconds):
        self.waits.append(round(seconds, 6))
        self.now += seconds


def scripted(folder, plans):
    """A model that plays back, per prompt, codes to fail with and then an
    answer; calls are counted in files, as tasks share nothing else."""
    def model(prompts):
        import os

        class HttpError(Exception):
            pass

        out = []
        for p in prompts:
            codes, answer = plans[p]
            at = os.path.join(folder, p)
            n = os.path.getsize(at) if os.path.exists(at) else 0
            with open(at, "a") as f:
                f.write("x")
            if n < len(codes) or codes[-1:] == ["always"]:
                e = HttpError(f"status {codes[min(n, len(codes) - 2)] if codes[-1:] == ['always'] else codes[n]}")
                e.status_code = codes[min(n, len(codes) - 2)] if codes[-1:] == ["always"] else codes[n]
                raise e
            out.append(answer)
        return out
    return model


def run(spark, tmp_path, plans, limit):
    clock = Clock()
    calls = tmp_path / "calls"
    calls.mkdir(exist_ok=True)
    df = spark.createDataFrame([(p, p) for p in plans], "k string, prompt string")
    out = generate(df, scripted(str(calls), plans), ["k"], max_attempts=limit, sleep=clock.sleep, clock=clock.time, num_partitions=2,
                   workdir=str(tmp_path / "queue"))
    rows = {r.k: (r.text, r.status, r.attempts) for r in out.collect()}
    return rows, {p: len((calls / p).read_text()) for p in plans}, clock.waits


def test_fails_nine_times_and_ends_ok(spark, tmp_path):
    """Unlimited retries: no task waits, the driver does between the waves."""
    rows, calls, waits = run(spark, tmp_path, {"hard": ([429] * 9, "good"), "easy": ([], "fine"), "bad": ([400, 429], "never")}, -1)
    assert rows == {"hard": ("good", "ok", 10), "easy": ("fine", "ok", 1), "bad": (None, "failed", 1)}
    assert calls == {"hard": 10, "easy": 1, "bad": 1}
    assert waits == [5, 10, 20, 40, 80, 160, 160, 160, 160]
    attempts = spark.read.parquet(str(tmp_path / "queue" / "attempts"))
    assert attempts.count() == 12 and last_attempts(attempts).count() == 3


def test_limits(spark, tmp_path):
    rows, calls, waits = run(spark, tmp_path, {"a": ([503, "always"], ""), "b": ([429], "good"), "c": ([], "  ")}, 3)
    assert rows == {"a": (None, "failed", 3), "b": ("good", "ok", 2), "c": (None, "failed", 1)} and calls == {"a": 3, "b": 2, "c": 1}
    assert waits == [5, 10]


def test_the_queue_outlives_a_session(spark, tmp_path):
    """A run that dies while it waits: the next goes on with what is waiting."""
    plans = {"x": ([503, 503], "late"), "y": ([], "early")}

    class Killed(Exception):
        pass

    def dies(_):
        raise Killed
    calls = tmp_path / "calls"
    calls.mkdir()
    df = spark.createDataFrame([(p, p) for p in plans], "k string, prompt string")
    with pytest.raises(Killed):
        generate(df, scripted(str(calls), plans), ["k"], sleep=dies, clock=lambda: 1000.0, num_partitions=2, workdir=str(tmp_path / "queue"))
    rows, counted, waits = run(spark, tmp_path, plans, 6)
    assert rows == {"x": ("late", "ok", 3), "y": ("early", "ok", 1)} and counted == {"x": 3, "y": 1}
    assert waits == [5, 10]


@pytest.mark.parametrize("limit,want", [(0, "failed"), (1, "failed"), (2, "waiting"), (-1, "waiting")])
def test_policy_of_the_first_failure(spark, limit, want):
    df = spark.createDataFrame([(1, PASSING), (1, FINAL), (1, GOOD)], "attempt int, outcome string")
    got = [(r.status, r.not_before) for r in with_policy(df, limit, F.lit(100.0)).collect()]
    assert got == [(want, 105.0 if want == "waiting" else None), ("failed", None), ("ok", None)]


def test_outcomes_and_waits(spark):
    assert [outcome_of(x)[0] for x in (ReadTimeout(), ApiError(502), ValueError(), ApiError(400), "", "  ", None, "x")] == [
        PASSING, PASSING, FINAL, FINAL, FINAL, FINAL, FINAL, GOOD]
    assert [r.w for r in spark.range(1, 9).coalesce(1).select(wait_seconds(F.col("id")).alias("w")).collect()] == [5, 10, 20, 40, 80, 160, 160, 160]


def test_generate_over_dataframe(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "k int, prompt string")

    def model(prompts):
        return ["" if p == "p3" else p.upper() for p in prompts]

    out = {r.k: r for r in generate(df, model, ["k"], num_partitions=4, sleep=lambda s: None).collect()}
    assert len(out) == 20
    assert out[5].text == "P5" and out[5].status == "ok" and out[5].attempts == 1
    assert out[3].status == "failed" and out[3].text is None


def test_registry():
    import pytest
    from quire.operators.generate import build_model, register_model
    register_model("echo", lambda: (lambda ps: list(ps)))
    assert build_model("echo")(["a"]) == ["a"]
    with pytest.raises(ValueError):
        build_model("nope")


def test_prompts_are_spread_although_they_are_small(spark):
    prompts = spark.createDataFrame([(i, "x" * 2000) for i in range(200)], "k long, prompt string")

    def model(ps):
        from pyspark import TaskContext
        return [str(TaskContext.get().partitionId()) for _ in ps]
    assert generate(prompts, model, ["k"]).select("text").distinct().count() >= 4


def test_named_models_and_equal_rows(spark):
    prompts = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, None)], "k long, prompt string")
    rows = sorted((r.k, r.text, r.status) for r in generate(prompts, "native", ["k"]).collect())
    assert rows == [(1, "b", "ok"), (1, "b", "ok"), (2, None, "failed")]
    with pytest.raises(ValueError, match="native"):
        generate(prompts, "nope", ["k"])
