"""Naive Bayes from count tables, against a plain computation."""

import math
import re
from collections import Counter, defaultdict

import pytest

from quire.operators import tasks as TK

TRAINING = {
    "medicine": ["The doctor treats the patient with a new drug.", "Le médecin soigne le malade avec un remède.",
                 "El médico cura al enfermo con un remedio.", "Der Arzt heilt den Kranken mit einer Arznei."],
    "law": ["The judge hears the witness before the court.", "Le juge entend le témoin devant le tribunal.",
            "El juez escucha al testigo ante el tribunal.", "Der Richter hört den Zeugen vor Gericht."],
    "seafaring": ["The captain steers the ship through the storm.", "Le capitaine mène le navire dans la tempête.",
                  "El capitán guía el barco por la tormenta.", "Der Kapitän lenkt das Schiff durch den Sturm."],
}


def plain(known, texts, share, top):
    words = lambda t: re.findall(r"[^\W]+", t.lower())
    n, books, vocabulary = defaultdict(Counter), Counter(), set()
    for field, text in known:
        books[field] += 1
        n[field].update(words(text))
        vocabulary |= set(words(text))
    out = []
    for i, text in texts:
        logs = {f: math.log(books[f] / sum(books.values())) + sum(math.log((n[f][w] + 1) / (sum(n[f].values()) + len(vocabulary)))
                                                                   for w in words(text or "") if w in vocabulary) for f in books}
        best = max(logs.values())
        total = sum(math.exp(v - best) for v in logs.values())
        order = sorted(logs, key=lambda f: (-round(logs[f], 9), f))
        out += [(i, r, f, round(math.exp(logs[f] - best) / total, 6)) for r, f in enumerate(order, 1) if r <= top and math.exp(logs[f] - best) >= share]
    return out


@pytest.fixture(scope="module")
def known():
    return [(f, t) for f, ts in TRAINING.items() for t in ts]


def proposals(spark, known, texts, **kw):
    books = spark.createDataFrame([(i, t, f) for i, (f, t) in enumerate(known)], "book long, text string, class string")
    model = TK.train_categories(books, "book", "text", "class")
    df = spark.createDataFrame(texts, "book long, text string")
    return sorted(tuple(r) for r in TK.categories(df, "book", "text", model, **kw).collect())


SENTENCES = [("medicine", "A patient asks the doctor."), ("medicine", "Un malade appelle le médecin."), ("medicine", "Un enfermo busca al médico."),
             ("medicine", "Ein Kranker ruft den Arzt."), ("law", "The witness lied to the judge."), ("law", "Le témoin ment au juge."),
             ("law", "El testigo teme al juez."), ("law", "Der Zeuge belügt den Richter."), ("seafaring", "A storm broke the ship."),
             ("seafaring", "La tempête brise le navire."), ("seafaring", "La tormenta rompe el barco."), ("seafaring", "Der Sturm bricht das Schiff.")]


def test_sentences_of_every_language(spark, known):
    got = {i: c for i, r, c, _ in proposals(spark, known, [(i, t) for i, (_, t) in enumerate(SENTENCES)]) if r == 1}
    assert got == {i: f for i, (f, _) in enumerate(SENTENCES)}


def test_against_plain_computation(spark, known):
    texts = [(i, t) for i, (_, t) in enumerate(SENTENCES)] + [(90, None), (91, ""), (92, "unknown words only"), (93, "the judge the doctor the ship " * 50)]
    for kw in ({"share": 0.1, "top": 5}, {"share": 0.0, "top": 2}):
        assert proposals(spark, known, texts, **kw) == plain(known, texts, **kw)


def test_nothing_learned(spark):
    assert proposals(spark, [(None, "x"), ("a", None)], [(1, "x")]) == []
