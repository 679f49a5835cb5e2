"""Evaluation operators against brute force on small fixtures."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quire.operators import evaluate as EV


def lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def test_lcs_matches_dp(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.choice("abcd") for _ in range(rnd.randint(0, 40))], [rnd.choice("abcde") for _ in range(rnd.randint(0, 90))]) for i in range(200)]
    rows.append((200, ["x"] * 300, ["x"] * 250))
    df = spark.createDataFrame(rows, "k int, c array<string>, r array<string>")
    got = {r.k: r.n for r in EV.match_points(df, ["k"], "c", "r").select("k", EV.rising_length("points").alias("n")).collect()}
    assert {k: got.get(k, 0) for k, _, _ in rows} == {k: lcs_dp(c, r) for k, c, r in rows}


def test_rouge_l_has_no_python_stage(spark):
    df = spark.createDataFrame([(1, "a b", "b a")], "k int, candidate string, reference string")
    plan = EV.rouge_l(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def toks(s):
    return [t for t in re.split(r"[^a-z0-9]+", s.lower()) if t]


def brute_rouge(c, r, n):
    def grams(t):
        out = {}
        for i in range(len(t) - n + 1):
            g = " ".join(t[i:i + n])
            out[g] = out.get(g, 0) + 1
        return out
    gc, gr = grams(toks(c)), grams(toks(r))
    o = sum(min(v, gr.get(k, 0)) for k, v in gc.items())
    nc, nr = sum(gc.values()), sum(gr.values())
    p = o / nc if nc else 0.0
    rc = o / nr if nr else 0.0
    f = 2 * p * rc / (p + rc) if p + rc else 0.0
    return round(p, 6), round(rc, 6), round(f, 6)


PAIRS = [
    (1, "The cat sat on the mat.", "A cat sat on a mat today."),
    (2, "Ação e reação, ação!", "ação reação"),
    (3, "", "nothing here"),
    (4, "one", "one"),
    (5, "x y z x y z", "z y x"),
]


def test_rouge_n_and_l(spark):
    df = spark.createDataFrame(PAIRS, "k int, candidate string, reference string")
    for n in (1, 2):
        got = {r.k: (r[f"rouge{n}_p"], r[f"rouge{n}_r"], r[f"rouge{n}_f"]) for r in EV.rouge_n(df, ["k"], n).collect()}
        for k, c, r in PAIRS:
            assert got[k] == brute_rouge(c, r, n), (n, k)
    got = {r.k: r for r in EV.rouge_l(df, ["k"]).collect()}
    for k, c, r in PAIRS:
        l = lcs_dp(toks(c), toks(r))
        p = l / len(toks(c)) if toks(c) else 0.0
        rc = l / len(toks(r)) if toks(r) else 0.0
        assert got[k].rougeL_p == round(p, 6) and got[k].rougeL_r == round(rc, 6)


def test_rouge_swap_symmetry(spark):
    df = spark.createDataFrame(PAIRS, "k int, candidate string, reference string")
    a = {r.k: r for r in EV.rouge_n(df, ["k"], 1).collect()}
    b = {r.k: r for r in EV.rouge_n(df, ["k"], 1, cand_col="reference", ref_col="candidate").collect()}
    for k in a:
        assert a[k].rouge1_p == b[k].rouge1_r and a[k].rouge1_r == b[k].rouge1_p


def test_embedding_match_vs_numpy(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for book in range(3):
        for vid in range(book * 100, book * 100 + 37 + book * 20):
            rows.append((book, vid, [float(x) for x in rnd.normal(size=8)]))
    df = spark.createDataFrame(rows, "book long, vec_id long, embedding array<double>").withColumn(
        "side", (F.col("vec_id") % 2).cast("int"))
    got = {r.book: r for r in EV.embedding_match(df, "book", "side", block=7).collect()}
    for book in range(3):
        vs = [(vid, np.array(e)) for b, vid, e in rows if b == book]
        c = np.array([e / np.linalg.norm(e) for vid, e in vs if vid % 2 == 0])
        r = np.array([e / np.linalg.norm(e) for vid, e in vs if vid % 2 == 1])
        s = c @ r.T
        p, rc = s.max(axis=1).mean(), s.max(axis=0).mean()
        assert abs(got[book].bert_precision - p) < 2e-6 and abs(got[book].bert_recall - rc) < 2e-6


def test_one_book_is_spread_over_a_grid(spark, monkeypatch):
    """One book holds nearly all vectors: no join has the book alone as key,
    with broadcast counts and without."""
    rnd = np.random.default_rng(5)
    rows = [("hot", i, i % 2, [float(x) for x in rnd.normal(size=4)]) for i in range(300)] + [("b", 900 + i, i, [1.0, 0.0, float(i), 0.0]) for i in range(2)]
    df = spark.createDataFrame(rows + [("one side", 1000, 0, [1.0] * 4)], "book string, vec_id long, side int, embedding array<double>")
    want = sorted(tuple(r) for r in EV.embedding_match(df, "book", "side", block=1000).collect())
    assert [r[0] for r in want] == ["b", "hot"]
    for most in (EV.MAX_BROADCAST_BOOKS, 0):
        monkeypatch.setattr(EV, "MAX_BROADCAST_BOOKS", most)
        got = EV.embedding_match(df, "book", "side", block=16)
        assert sorted(tuple(r) for r in got.collect()) == want
        joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "Broadcast" not in x]
        assert joins and all("c_blk" in x or "salt" in x for x in joins)


def test_coherence_two_levels(spark):
    rows = [("m1", 1, "Good one. Good one. No end"), ("m1", 2, "All fine."), ("m2", 3, "x")]
    df = spark.createDataFrame(rows, "provider string, book long, summary string")
    flags = EV.sentence_flags(df, ["provider", "book"])
    got = {r.provider: r for r in EV.coherence(flags, "provider", ["book"]).collect()}
    assert got["m1"].n_books == 2 and got["m1"].coherence == round((1 / 3 + 1.0) / 2, 6)
    assert got["m2"].coherence == 0.0


def test_pairing_and_language_codes(spark):
    rows = [("en", "b1", "human", " ref "), ("en", "b1", "m", "cand"), ("en", "b1", "n", "  "),
            ("en", "b2", "m", "cand"), ("en", "b3", "human", "   "), ("en", "b3", "m", "c")]
    df = spark.createDataFrame(rows, "language string, book string, provider string, summary string")
    pairs, skipped = EV.pair_with_reference(df, ["language", "book"])
    assert [(r.book, r.provider, r.reference) for r in pairs.collect()] == [("b1", "m", "ref")]
    assert sorted(r.book for r in skipped.collect()) == ["b2", "b3"]
    codes = spark.createDataFrame([("English",), ("italian",), ("klingon",)], "l string").select(
        EV.language_code("l").alias("c")).collect()
    assert [r.c for r in codes] == ["en", "it", "en"]


def test_pending_annotations(spark):
    s = spark.createDataFrame([("m", "judge", "b1"), ("m", "judge", "b2"), ("n", "judge", "b1")],
                              "provider string, evaluator string, book string")
    a = spark.createDataFrame([("m", "judge", "b1", 0, True)],
                              "provider string, evaluator string, book string, sentence_no int, confusing boolean")
    todo = sorted((r.provider, r.book) for r in EV.pending_annotations(s, a, ["provider", "evaluator", "book"]).collect())
    assert todo == [("m", "b2"), ("n", "b1")]


def test_annotate_with_model(spark):
    rows = [("m", "b1", "He went home. It was blue."), ("m", "b2", "Done."), ("m", "b3", "Skip me.")]
    s = spark.createDataFrame(rows, "provider string, book string, summary string")
    done = spark.createDataFrame([("m", "b3", "judge")], "provider string, book string, evaluator string")

    def model(prompts):
        return ["yes" if p.rstrip().endswith("It was blue.") else "no" for p in prompts]

    flags = EV.annotate_with_model(s, ["provider", "book"], model, "judge", annotations=done, sleep=lambda x: None)
    got = sorted((r.book, r.sentence_no, r.confusing) for r in flags.collect())
    assert got == [("b1", 0, False), ("b1", 1, True), ("b2", 0, False)]
    rep = {r.provider: r.coherence for r in EV.coherence(flags, "provider", ["book"]).collect()}
    assert rep["m"] == round((0.5 + 1.0) / 2, 6)


def test_contexts_grow_in_the_task(spark):
    """Every sentence with exactly the sentences before it, whatever the
    batches; the shuffled rows carry one sentence each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    texts = {b: [f"Sentence {i} of {b}." for i in range(n)] for b, n in (("b1", 10), ("b2", 1), ("b3", 7))}
    df = spark.createDataFrame([("m", b, " ".join(t)) for b, t in texts.items()] + [("m", "b4", None), ("m", "b5", "")],
                               "provider string, book string, summary string")
    prompts = EV.annotation_prompts(df, ["provider", "book"], template="{CONTEXT}|{SENTENCE}")
    got = {(r.book, r.sentence_no): r.prompt for r in prompts.collect()}
    short = {(r.book, r.sentence_no): r.prompt for r in EV.annotation_prompts(df, ["provider", "book"], template="{CONTEXT}|{SENTENCE}", context_chars=20).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(b, i): "\n".join(t[:i]) + "|" + t[i] for b, t in texts.items() for i in range(len(t))}
    assert short == {(b, i): "\n".join(t[:i])[-20:] + "|" + t[i] for b, t in texts.items() for i in range(len(t))}
    assert [f.name for f in EV.sentence_rows(df, ["provider", "book"]).schema.fields] == ["provider", "book", "sentence_no", "sentence"]


def test_zero_vector_matches_nothing(spark):
    from quire.operators.evaluate import embedding_match
    rows = [(1, 0, 0, [0.0, 0.0]), (1, 0, 1, [1.0, 0.0]), (1, 1, 2, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "book long, side int, vec_id long, embedding array<double>")
    r = embedding_match(v, "book", "side").first()
    assert (r.bert_precision, r.bert_recall) == (0.5, 1.0)
