"""Round state, gating and restart behaviour."""

import pytest

from quire import fixed
from quire.operators import gating as G
from quire.plans import commands
from quire.plans.compress import adaptive_compress, join_abstracts, native_model


def test_adaptive_terminates_and_fits(spark, tmp_path):
    text = "\n".join(f"Sentence number {i} talks about topic {i % 7}. It goes on a bit." for i in range(400))
    books = spark.createDataFrame([(1, text), (2, "Short text."), (3, "")], "book long, content string")
    out = {r.book: r for r in adaptive_compress(spark, books, ["book"], window=800, max_chunk=500,
                                                workdir=str(tmp_path / "w")).collect()}
    assert out[1].status == "done" and len(out[1].abstract_contents) <= 800 and out[1].rounds >= 2
    assert out[2].status == "done" and out[2].rounds == 1          # at least one round, even if it fits
    assert out[3].status == "failed"                                # no text -> no abstracts


def test_max_rounds_marks_unfinished(spark, tmp_path):
    text = "\n".join(f"Line {i} has words." for i in range(2000))
    books = spark.createDataFrame([(1, text)], "book long, content string")
    r = adaptive_compress(spark, books, ["book"], window=50, max_chunk=300, max_rounds=1,
                          workdir=str(tmp_path / "w")).first()
    assert r.status == "unfinished" and r.rounds == 1


def test_load_abstracts_skips_failed(spark):
    rows = [(1, 2, "b", "ok"), (1, 0, "a", "ok"), (1, 1, None, "failed")]
    df = spark.createDataFrame(rows, "book long, split_index long, abstract string, status string")
    r = join_abstracts(df, ["book"]).first()
    assert r.joined == "a\n\nb" and r.n_ok == 2 and r.n_splits == 3


def outputs(spark, rows):
    return spark.createDataFrame(rows, "book long, kind string, text string")


def test_empty_output_is_missing(spark):
    books = spark.createDataFrame([(1,), (2,)], "book long")
    out = outputs(spark, [(1, fixed.KIND_ABSTRACTS, "x"), (1, fixed.KIND_KEYWORDS, ""),
                          (2, fixed.KIND_ABSTRACTS, "")])
    todo = sorted((r.book, r.kind) for r in G.missing_outputs(books, out, ["book"]).collect())
    assert (1, fixed.KIND_KEYWORDS) in todo and all(b == 1 for b, _ in todo) and len(todo) == 4


def test_summary_needs_both_variants(spark):
    books = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t"), (4, "")], "book long, content string")
    state = spark.createDataFrame([(1,), (2,), (4,)], "book long")
    out = outputs(spark, [(1, fixed.KIND_ABSTRACTS, "a"), (1, fixed.KIND_SUMMARY, "s"),
                          (2, fixed.KIND_ABSTRACTS, "a"), (2, fixed.KIND_SUMMARY, "s"),
                          (2, fixed.KIND_SUMMARY_NO_INTRO, "s")])
    e = {(r.book, r.task): r.reason for r in G.eligibility(books, state, out, ["book"]).collect()}
    assert e[(1, "abstract")] == "run" and e[(2, "abstract")] == "already_done"
    assert e[(3, "keywords")] == "no_state" and e[(4, "keywords")] == "no_abstracts"
    assert e[(1, "resume")] == "already_done" and e[(4, "resume")] == "no_content"
    assert e[(3, "resume")] == "run"


def test_provider_subset(spark):
    known = spark.createDataFrame([("b",), ("a",)], "provider string")
    assert G.select_providers(known, None) == ["a", "b"]
    try:
        G.select_providers(known, ["a", "zz"])
        raise AssertionError("unknown provider accepted")
    except ValueError:
        pass


LONG = "\n".join(f"Sentence {i} about item {i % 5}. More words here." for i in range(600))


def counting(log, fail=lambda text: False):
    """Chunk model that logs the splits it is sent and fails on demand."""
    def model(splits, keys):
        rows = native_model(splits, keys).join(splits.select(*keys, "split_index", "chunk"), keys + ["split_index"]).collect()
        log.extend((tuple(r[k] for k in keys), r.split_index) for r in rows)
        data = [(*[r[k] for k in keys], r.split_index, None if fail(r.chunk) else r.abstract,
                 "Timeout: slow" if fail(r.chunk) else None) for r in rows]
        return splits.sparkSession.createDataFrame(data, "book long, split_index long, abstract string, error string")
    return model


def result(df):
    return {r.book: (r.rounds, r.status, r.abstract_contents) for r in df.collect()}


def test_rerun_sends_nothing_again(spark, tmp_path):
    books = spark.createDataFrame([(1, LONG), (2, "Tiny.")], "book long, content string")
    log = []
    first = result(adaptive_compress(spark, books, ["book"], 600, 400, workdir=str(tmp_path / "w"), model=counting(log)))
    assert first[1][0] >= 2 and first[1][1] == "done" and log
    log.clear()
    again = result(adaptive_compress(spark, books, ["book"], 600, 400, workdir=str(tmp_path / "w"), model=counting(log)))
    assert again == first and log == []


def test_held_book_is_released_by_a_rerun_of_its_open_splits(spark, tmp_path):
    books = spark.createDataFrame([(1, LONG), (2, "Tiny.")], "book long, content string")
    want = result(adaptive_compress(spark, books, ["book"], 600, 400, workdir=str(tmp_path / "a")))
    w = str(tmp_path / "b")
    got = result(adaptive_compress(spark, books, ["book"], 600, 400, workdir=w,
                                   model=counting([], fail=lambda text: "Sentence 7 " in text)))
    assert got[1][1] == "held" and got[2][1] == "done"
    errors = spark.read.parquet(f"{w}/splits").filter("status = 'failed'").collect()
    assert [r.error for r in errors] == ["Timeout: slow"] and errors[0].provider == "native"
    log = []
    assert result(adaptive_compress(spark, books, ["book"], 600, 400, workdir=w, model=counting(log))) == want
    assert [x for x in log if x[0] == (2,)] == [] and log.count(((1,), errors[0].split_index)) >= 1


def test_books_added_later_join_in(spark, tmp_path):
    one = spark.createDataFrame([(1, LONG)], "book long, content string")
    two = spark.createDataFrame([(1, LONG), (2, "Tiny.")], "book long, content string")
    w, log = str(tmp_path / "w"), []
    adaptive_compress(spark, one, ["book"], 600, 400, workdir=w)
    got = result(adaptive_compress(spark, two, ["book"], 600, 400, workdir=w, model=counting(log)))
    assert set(got) == {1, 2} and {k for k, _ in log} == {(2,)}


def test_a_crash_keeps_the_parts_already_answered(spark, tmp_path):
    books = spark.createDataFrame([(1, LONG)], "book long, content string")
    w, log, calls = str(tmp_path / "w"), [], []

    def crashing(splits, keys):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return counting(log)(splits, keys)

    with pytest.raises(RuntimeError):
        adaptive_compress(spark, books, ["book"], 600, 400, workdir=w, model=crashing, parts=4)
    before = set(log)
    log.clear()
    got = result(adaptive_compress(spark, books, ["book"], 600, 400, workdir=w, model=counting(log), parts=4))
    first_round = {r.split_index for r in spark.read.parquet(f"{w}/splits").filter("batch = 1").collect()}
    assert got[1][1] == "done" and before and len(before) < len(first_round)
    assert len(spark.read.parquet(f"{w}/splits").filter("batch = 1").collect()) == len(first_round)


def test_providers_do_not_hide_each_other(spark, tmp_path):
    books = spark.createDataFrame([("pt", "b 1", "Tiny text.")], "language string, book string, content string")
    path = str(tmp_path / "outputs")
    for name, existing in (("provA", None), ("org/provB", path)):
        seen = spark.read.parquet(existing) if existing else None
        got = commands.resume(spark, books, name, 5000, path, existing_outputs=seen, workdir=str(tmp_path / "w"))
        assert got.count() == 1
    outputs = spark.read.parquet(path)
    assert sorted(r.provider for r in outputs.collect()) == ["org/provB", "provA"]
    again = commands.resume(spark, books, "provA", 5000, path, existing_outputs=outputs, workdir=str(tmp_path / "w"))
    assert again.count() == 0
    splits = spark.read.parquet(str(tmp_path / "w" / "splits"))
    for name in ("provA", "org/provB"):
        res = commands.book_task(spark, "keywords", books, splits, spark.read.parquet(path), lambda ps: ["k" for _ in ps], name, path,
                                 sleep=lambda s: None)
        assert res.count() == 1


def test_changed_text_is_compressed_anew(spark, tmp_path):
    """Unchanged, changed and new books on one workdir: answers to the old
    text are not given for the new one, and unchanged books cost no call."""
    from quire.plans.compress import changed_issues, last_abstracts, split_state
    w = str(tmp_path / "w")
    text = lambda word, n: "\n".join(f"{word} line {i}." for i in range(n))
    first = spark.createDataFrame([(1, text("same", 30)), (2, text("old", 30))], "book long, content string")
    log = []
    adaptive_compress(spark, first, ["book"], 200, 150, model=counting(log), workdir=w).collect()
    second = spark.createDataFrame([(1, text("same", 30)), (2, text("new", 40)), (3, text("third", 20))], "book long, content string")
    state = split_state(spark, second, ["book"], w, 200, 150)
    assert {r.book: (r.state, r.n_old) for r in state.collect()} == {1: ("answered", 0), 2: ("changed", 1), 3: ("new", 0)}
    issues = changed_issues(state, ["book"]).collect()
    assert [(r.book, r.stage) for r in issues] == [(2, "compress")]
    sent = len(log)
    books = adaptive_compress(spark, second, ["book"], 200, 150, model=counting(log), workdir=w, keep_digest=True)
    rows = {r.book: r for r in books.collect()}
    assert set(rows) == {1, 2, 3} and {b[0] for b, _ in log[sent:]} == {2, 3}
    assert "new line" in rows[2].abstract_contents and "old line" not in rows[2].abstract_contents
    last = {r.book for r in last_abstracts(spark, books, ["book"], w).collect() if "old line" in (r.abstract or "")}
    assert last == set()
    assert {r.book: r.state for r in split_state(spark, second, ["book"], w, 200, 150).collect()} == {1: "answered", 2: "answered", 3: "answered"}
    # back to the first text: its answers are still there
    sent = len(log)
    adaptive_compress(spark, first, ["book"], 200, 150, model=counting(log), workdir=w).collect()
    assert len(log) == sent
