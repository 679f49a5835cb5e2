"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import collocations as co
from quire.llm.collocations import collocations, frequent_phrases
from quire.session import ship_package

SCHEMA = "doc_id long, text string, lang string"


def counts(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    return f, n


def brute(rows, min_count=30, top=2000):
    f, n = counts(rows)
    out = []
    for lang in f:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in cand.items():
            inside = [q for q in cand if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * cand[q] >= 80 * a for q in inside):
                continue
            score, _, l, r = min((2000000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in collocations(df, **kw).collect())


def prose(rng, n):
    vocab = [f"w{i}" for i in range(25)] + ["É", "Zür", "\U0001F600", "ﬁ", "A"]
    return [(i, "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "  ", "\x1c"]) for _ in range(rng.randint(0, 60)))
             + "w1 w2 w3 w4 w5" * rng.randint(0, 2), rng.choice(["en", "en", "de", None, "und", ""])) for i in range(n)]


def test_against_brute_force(spark):
    ship_package(spark)
    rows = prose(random.Random(13), 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("x") for c in ("gram", "n", "k", "phrase", "f", "w1", "p2", "rank")})
    for kw in ({"min_count": 3}, {"min_count": 30}, {"min_count": 2, "top": 5}):
        want = brute(rows, **kw)
        assert len(want) > 3 and mined(df, **kw) == want


def test_phrase_counts(spark):
    ship_package(spark)
    rows = prose(random.Random(7), 200)
    f, n = counts(rows)
    got = frequent_phrases(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert {(r.lang, r.phrase): r.f for r in got if r.k} == {(x, " ".join(p)): a for x in f for p, a in f[x].items() if a >= 4}
    assert {r.lang: r.f for r in got if not r.k} == {x: a for x, a in n.items() if a}
    assert all(r.k == len(r.phrase.split(" ")) for r in got if r.k)


def test_edges(spark):
    ship_package(spark)
    rows = [(1, None, "en"), (2, "", None), (None, " . , \t", "en"), (3, "a b " * 40_000, "en"), (3, "a b " * 40_000, "en"),
            (4, "x" * 300_000 + " y", "en"), (5, "one two." * 30, None), (6, "One TWO;" * 30, "und"), (7, "p q r s\n" * 35 + "p q.", "fr")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df) == brute(rows)
    assert mined(df.limit(0)) == []


def test_words_of_a_slice():
    """Words, pieces and languages as the contract cuts them, at every offset."""
    rows = [("en", "Ab c.d\t e"), ("de", ""), ("en", "x"), ("fr", " y z\x0b\x0cw !"), ("fr", "\x1c\u00c9\u2028 q"), ("en", ".")]
    for lo in range(len(rows)):
        part = rows[lo:]
        w = co.Words(pa.array([r[0] for r in rows]).slice(lo), pa.array([r[1] for r in rows]).slice(lo))
        want = [(lang, i, p, word) for i, (lang, text) in enumerate(part)
                for p, piece in enumerate(re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text)))
                for word in re.findall("[^\x20\x09]+", piece)]
        assert [w.names[c].as_py() for c in w.codes.tolist()] == [x[3] for x in want]
        assert [w.langs[c].as_py() for c in w.lang.tolist()] == [x[0] for x in want]
        assert w.joined.tolist() == [a[1:3] == b[1:3] for a, b in zip(want, want[1:])] + [False] * (len(want) > 0)


def test_slices_and_a_full_filter_do_not_change_counts(spark, monkeypatch):
    ship_package(spark)
    rows = prose(random.Random(3), 120)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    want = brute(rows, min_count=3)
    monkeypatch.setattr(co, "CELL_CHARS", 1 << 30)
    assert mined(df, min_count=3) == want
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]})

    class All:
        value = np.full(1 << 13, 255, np.uint8)

    def total():
        c = Counter()
        for b in co.count_windows(All)(iter([batch])):
            for lang, g, n in zip(*(b.column(x).to_pylist() for x in ("lang", "gram", "n"))):
                c[lang, g] += n
        return c
    whole = total()
    for chars in (1, 100, 1000):
        monkeypatch.setattr(co, "SLICE_CHARS", chars)
        assert total() == whole


def test_scores_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    a, l, r = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 9_200_000_000_000_000_000
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(F.expr(co.SCORE).alias("s")).first().s
    assert got == 2000000 * a // (l + r)
