"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to grammar symbols (insult, threat, intent, target, negation,
reported speech, other).  Five small transducers read the symbols of a clause
and scale the weight of each insult or threat: a threat counts in full only
with an intent before it, a target raises what follows, a negation lowers the
next words, reported speech lowers the rest of the clause.  They are composed
once into a single table.  A document's score is a logistic function of its
clause scores, so an isolated word in a negated quotation weighs little.

What the insults are is learned from labelled rows: words (and beginnings
shared by three words or more) whose documents are labelled toxic more often
than chance allows among all words tried; the weight is the lower confidence
bound of the log odds ratio.  Learning reads at most
``max_train`` labelled rows (a hash sample above that) and keeps at most
``max_lexicon`` entries; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import drop_stash, stash

# bounds of the learning sample, of the learned lexicon
MAX_TRAIN = 30_000
MAX_LEXICON = 5_000

INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, OTHER = "insult threat intent target negation report other".split()
SYMBOLS = (INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, OTHER)

# grammar words that do not depend on the labels
SEED_WORDS = {
    INSULT: "idiot idiots moron stupid scum worthless pathetic loser imbecile dumb disgusting",
    THREAT: "kill hurt destroy beat stab shoot strangle töten matar tuer",
    INTENT: "will gonna shall ll werde voy vais going",
    TARGET: "you your yours yourself u ihr euch dich du vous toi tu te ustedes",
    NEGATION: "not never no nobody without t nicht kein keine jamais nunca ni sin",
    REPORT: "said says say wrote writes quoted claimed reported reportedly sagte schrieb dijo écrit",
}
SEED_WEIGHT = {INSULT: 2.0, THREAT: 2.0}

_CLAUSE_END = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Transducer:
    """``step[state, symbol] -> (next state, factor on the symbol's weight)``;
    missing entries stay in their state with factor 1."""

    start: int
    states: int
    step: dict[tuple[int, str], tuple[int, float]]

    def get(self, state: int, symbol: str) -> tuple[int, float]:
        return self.step.get((state, symbol), (state, 1.0))


def _window(length: int, opener: str, scaled: tuple[str, ...], factor: float) -> Transducer:
    """Scales ``scaled`` symbols within ``length`` symbols after ``opener``."""
    step = {}
    for s, sym in product(range(length + 1), SYMBOLS):
        step[s, sym] = (length if sym == opener else max(0, s - 1), factor if s and sym in scaled else 1.0)
    return Transducer(0, length + 1, step)


def _latch(opener: str, scaled: tuple[str, ...], factor: float, before: float = 1.0) -> Transducer:
    """Scales ``scaled`` by ``before`` until ``opener`` was read, by ``factor`` afterwards."""
    step = {(0, opener): (1, 1.0)}
    for sym in scaled:
        step[0, sym] = (0, before)
        step[1, sym] = (1, factor)
    return Transducer(0, 2, step)


def compose(*parts: Transducer) -> Transducer:
    """One transducer that does what the parts do in turn on each symbol."""
    ids: dict[tuple[int, ...], int] = {}
    todo = [tuple(p.start for p in parts)]
    ids[todo[0]] = 0
    step = {}
    while todo:
        state = todo.pop()
        for sym in SYMBOLS:
            moves = [p.get(s, sym) for p, s in zip(parts, state)]
            nxt = tuple(m[0] for m in moves)
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            step[ids[state], sym] = (ids[nxt], float(np.prod([m[1] for m in moves])))
    return Transducer(0, len(ids), step)


GRAMMAR = compose(
    _latch(INTENT, (THREAT,), 1.0, before=0.25),
    _latch(TARGET, (INSULT, THREAT), 1.5),
    _window(3, NEGATION, (INSULT, THREAT), 0.5),
    _latch(REPORT, (INSULT, THREAT), 0.6),
)


@dataclass
class ToxicityModel:
    """Learned words and word beginnings with weights, and the logistic map
    from (log(1 + sum of clause scores), highest clause score)."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    coef: tuple[float, float, float] = (-3.0, 2.0, 0.5)

    def __post_init__(self) -> None:
        self._symbols: dict[str, tuple[str, float]] = {
            w: (sym, SEED_WEIGHT.get(sym, 0.0)) for sym, ws in SEED_WORDS.items() for w in ws.split()}
        for w, weight in self.words.items():
            sym, least = self._symbols.get(w, (INSULT, 0.0))
            if sym in (INSULT, THREAT):
                self._symbols[w] = (sym, max(weight, least))
        self._finder = None

    def __getstate__(self):
        return {"words": self.words, "prefixes": self.prefixes, "coef": self.coef}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def symbol(self, word: str) -> tuple[str, float]:
        hit = self._symbols.get(word)
        if hit:
            return hit
        for k in reversed(PREFIXES):
            if len(word) > k and word[:k] in self.prefixes:
                return INSULT, self.prefixes[word[:k]]
        return OTHER, 0.0

    def clause_score(self, clause: str) -> float:
        """Weight that the grammar gives a lower-cased clause."""
        state, total = GRAMMAR.start, 0.0
        for w in _WORD.findall(clause):
            sym, weight = self.symbol(w)
            state, factor = GRAMMAR.get(state, sym)
            total += weight * factor
        return total

    def clauses(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, score) in the lower-cased text of every clause with
        an insult or a threat."""
        if self._finder is None:
            import ahocorasick
            finder = ahocorasick.Automaton()
            for w, (sym, _) in self._symbols.items():
                if sym in (INSULT, THREAT):
                    finder.add_word(w, len(w))
            for p in self.prefixes:
                finder.add_word(p, len(p))
            finder.make_automaton()
            self._finder = finder
        done = 0
        for last, n in self._finder.iter(text):
            first = last - n + 1
            if first < done or first and (text[first - 1].isalnum() or text[first - 1] == "_"):
                continue
            start = max((text.rfind(c, done, first) for c in ".!?;\n"), default=-1) + 1
            stop = _CLAUSE_END.search(text, last + 1)
            end = stop.start() if stop else len(text)
            score = self.clause_score(text[max(start, done):end])
            if score > 0:
                yield max(start, done), end, score
            done = end

    def features(self, text: str | None) -> tuple[float, float]:
        scores = [s for *_, s in self.clauses(text.lower())] if text else []
        return float(np.log1p(sum(scores))), max(scores, default=0.0)

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _terms(text: str | None) -> set[str]:
    """Distinct words, and '^' + word beginning, of a text."""
    ws = set(_WORD.findall(text.lower())) if text else set()
    return ws | {"^" + w[:k] for w in ws for k in PREFIXES if len(w) > k}


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are kept >= 0."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(3)
    ridge = l2 * np.diag([0.0, 1.0, 1.0]) * len(x) ** 0.5 + 1e-9 * np.eye(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + ridge, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    if min(w[1:]) < 0:
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_lexicon: int = MAX_LEXICON,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn a model from the rows of ``docs`` that ``labels`` marks 0 or 1.

    Of several labels of an id the highest counts; null ids and labels are
    not used.  Without labels of both kinds the seed grammar is returned.
    """
    known = (labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull())
             .groupBy(labels[id_col].alias("__id")).agg(F.max(labels[label_col]).alias("__y")))
    n = known.count()
    if n > max_train:  # hash sample; its expected size is the bound
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * max_train / n))
    # at most about max_train rows of two numbers
    sample = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).join(
        F.broadcast(known), "__id").select("__text", F.col("__y").cast("int").alias("__y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                tally[""][y > 0] += 1  # documents of either label
                for t in _terms(text.as_py()):
                    tally[t][y > 0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tally)), pa.array([v[0] for v in tally.values()], pa.int64()),
                 pa.array([v[1] for v in tally.values()], pa.int64())], ["term", "clean", "toxic"])

    counts = sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stash(counts.where(F.col("toxic") > 0), "toxicity-counts")
    totals = counts.where(F.col("term") == "").first()
    if totals is None or not totals.clean:
        drop_stash(counts)
        return ToxicityModel()
    tox, n = F.col("toxic"), F.col("toxic") + F.col("clean")
    a, b = tox + 0.5, F.col("clean") + 0.5
    ratio = F.log(a / (totals.toxic + 1.0)) - F.log(b / (totals.clean + 1.0))
    base = totals.toxic / (totals.toxic + totals.clean)
    # n * KL(share of toxic || base rate) against the number of terms tried (a Bonferroni bound)
    surprise = tox * F.log(tox / n / base) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - base))).otherwise(0.0)
    prefix = F.startswith(F.col("term"), F.lit("^"))
    # a word beginning stands for a family: three words of it at least, not one word's own letters
    kinds = (counts.where(~prefix & (F.length("term") > min(PREFIXES)))
             .select("term", F.explode(F.array(*[F.lit(k) for k in PREFIXES])).alias("k"))
             .where(F.length("term") > F.col("k"))
             .groupBy(F.concat(F.lit("^"), F.expr("substring(term, 1, k)")).alias("term")).agg(F.count("*").alias("kinds")))
    best = (counts.where((F.col("term") != "") & (tox / n > base) & (surprise > F.log(F.lit(float(counts.count())))))
            .select("term", (ratio - 1.64 * F.sqrt(1 / a + 1 / b)).alias("w"))
            .join(kinds, "term", "left").where((F.col("w") > 0) & (~prefix | (F.col("kinds") >= 3)))
            .orderBy(F.desc("w"), "term").limit(max_lexicon).collect())
    drop_stash(counts)
    model = ToxicityModel({r.term: r.w for r in best if r.term[0] != "^"},
                          {r.term[1:]: r.w for r in best if r.term[0] == "^"})

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [model.features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()),
                                              pa.array([x[1] for x in f], pa.float64()), b.column(1)], ["a", "b", "y"])

    # equal feature rows are summed before they leave the executors
    rows = (sample.mapInArrow(feature_rows, "a double, b double, y int").groupBy("a", "b", "y").count().collect())
    x = np.array([[r.a, r.b] for r in rows])
    y = np.array([1.0 if r.y > 0 else 0.0 for r in rows])
    k = np.array([r["count"] for r in rows])
    model.coef = _fit_logistic(np.repeat(x, k, axis=0), np.repeat(y, k))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, clauses): probability that a document is toxic and the
    matched clauses with their scores and places in the lower-cased text.

    A null or empty text, or one without letters, has the score of a text
    without matches.  Repeated rows are scored alike; an empty table gives no
    rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            scores, found = [], []
            for t in b.column(1):
                text = t.as_py()
                scores.append(model.score(text))
                found.append([{"start": s, "end": e, "score": w} for s, e, w in model.clauses(text.lower())] if text else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)],
                                             ["id", "score", "clauses"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("clauses", T.ArrayType(T.StructType([
                               T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                               T.StructField("score", T.DoubleType())])))])
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, unchanged."""
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([model.score(t.as_py()) < threshold for t in b.column(k)], pa.bool_())
            yield b if pc.all(keep).as_py() else b.filter(keep)

    return docs.mapInArrow(run, docs.schema)
