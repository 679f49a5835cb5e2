"""Scoring texts with a hashed maximum-entropy language model.

Tokens are words lower-cased in A-Z, and one end token per text.  The model is
a class-factored softmax.  The most frequent words form classes by frequency
(``HEAD_CLASSES`` classes of ``WIDTH`` words); two more classes hold the other
words of a bounded dictionary and all the rest, unknown words included.

    P(w | context) = P(class | context) * P(w | class, context)

Both factors of a head word are softmaxes over ``WIDTH`` outcomes whose scores
are a log prior plus weights of hashed features: the previous word, the
previous two (n-grams), the word before the previous and the last frequent
word before that (skips).  In the last two classes a word's share comes from
its count over all training tokens, with absolute discounting, and unknown
words are one outcome with the discounted mass, so everything sums to one.

Training reads every training text once, in ``ROUNDS`` rounds.  In a round the
tasks run mini-batch gradient steps on their own texts from common weights;
the changes, weighted by tokens, are added up in two levels.  Scoring is numpy
over batches of texts.  Counts of words outside of the dictionary are never
gathered: a text's rare words are joined with the count table by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import stash

WIDTH = 32
HEAD_CLASSES = WIDTH - 2
HEAD = HEAD_CLASSES * WIDTH
# bounds of the dictionary sent to the tasks and of the weight table (2 MB)
DICTIONARY = 65_536
MIN_DICTIONARY_COUNT = 5
BUCKETS = 1 << 14
ROUNDS = 2
MODELS = 128  # local models per round at most
BATCH = 4096
RATE = 0.1
END = b""  # words are never empty
BLOCK = 512  # weight rows per shuffled block


def tokenize(text: str | None) -> list[bytes]:
    # bytes.lower and bytes.split know ASCII only: A-Z, and blank, TAB..CR
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    ws.append(END)
    return ws


@dataclass
class LanguageModel:
    """Bounded part of the model: dictionary counts by rank and weights."""

    words: list[bytes] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    total: int = 0
    distinct: int = 0
    rare_total: int = 0  # tokens outside of the dictionary
    rare_once: int = 0
    rare_twice: int = 0
    rare_distinct: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, WIDTH), np.float32))

    def __post_init__(self) -> None:
        self.rank = {w: i for i, w in enumerate(self.words)}
        c = self.counts.astype(np.float64)
        head = np.zeros(HEAD)
        head[:min(HEAD, len(c))] = c[:HEAD]
        members = head.reshape(HEAD_CLASSES, WIDTH)
        classes = np.concatenate((members.sum(axis=1), [c[HEAD:].sum(), self.rare_total]))
        # empty slots of the head are not outcomes
        self.member_prior = np.full((HEAD_CLASSES, WIDTH), -1e9, np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            prior = np.log(members / members.sum(axis=1, keepdims=True))
        self.member_prior[members > 0] = prior[members > 0]
        used = classes > 0
        used[-1] = True  # unknown words
        self.class_prior = np.where(used, np.log((classes + 1.0) / (classes.sum() + used.sum())), -1e9).astype(np.float32)
        self.middle_total = max(1.0, float(c[HEAD:].sum()))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rank", "member_prior", "class_prior", "middle_total")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def discount(self) -> float:
        return self.rare_once / (self.rare_once + 2 * self.rare_twice) if self.rare_once else 0.5

    def base_log10(self, c):
        """Base score of a token with training count ``c``."""
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(dictionary ranks, -1 for others; text number) of all tokens."""
        get = self.rank.get
        ids = np.fromiter((get(w, -1) for ws in texts for w in ws), np.int64, sum(map(len, texts)))
        return ids, np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])

    def contexts(self, ids: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        """Previous word, the one before, and the last head word before those;
        -2 before the text's start."""
        n = len(ids)
        at = np.arange(n)
        first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1)) if n else np.zeros(0, np.int64)
        begin = np.repeat(first, np.diff(np.concatenate((first, [n]))))
        back = lambda k: np.where(at - k >= begin, ids[np.maximum(at - k, 0)], -2)
        seen = np.maximum.accumulate(np.where((ids >= 0) & (ids < HEAD), at, -1)) if n else at
        last = seen[np.maximum(at - 3, 0)]
        far = np.where((at - 3 >= begin) & (last >= begin), ids[np.maximum(last, 0)], -2)
        return [back(1), back(2), far]


def _hash(kind: int, *values: np.ndarray) -> np.ndarray:
    h = np.full(np.shape(values[0]), kind, np.uint64)
    for v in values:
        h = (h ^ (v.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)  # a power of two


def class_features(ctx: list[np.ndarray]) -> list[np.ndarray]:
    p1, p2, far = ctx
    return [_hash(1, p1), _hash(2, p1, p2), _hash(3, p2), _hash(4, far)]


def member_features(ctx: list[np.ndarray], cls: np.ndarray) -> list[np.ndarray]:
    p1, p2, far = ctx
    return [_hash(5, cls, p1), _hash(6, cls, p2), _hash(7, cls, far)]


def _add_weights(z: np.ndarray, weights: np.ndarray, feats: list[np.ndarray]) -> np.ndarray:
    for f in feats:
        z += weights.take(f, axis=0)
    return z


def _log_chosen(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log softmax of one outcome of each row; ``z`` is spent."""
    z -= z.max(axis=1, keepdims=True)
    at = z[np.arange(len(z)), chosen]
    return at - np.log(np.exp(z, out=z).sum(axis=1))


def _gradient(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Softmax less the outcome that was seen, in place."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(z)), chosen] -= 1
    return z


def targets(ids: np.ndarray) -> np.ndarray:
    """Class of each token."""
    return np.where(ids < 0, WIDTH - 1, np.where(ids >= HEAD, WIDTH - 2, ids // WIDTH))


def natural_scores(model: LanguageModel, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """log P of each token, without the word's share of a tail class."""
    out = np.zeros(len(ids))
    ctx = model.contexts(ids, owner)
    for lo in range(0, len(ids), BATCH):
        part = slice(lo, lo + BATCH)
        sub, i = [c[part] for c in ctx], ids[part]
        cls = targets(i)
        z = np.repeat(model.class_prior[None], len(i), axis=0)
        logp = _log_chosen(_add_weights(z, model.weights, class_features(sub)), cls).astype(np.float64)
        h = np.flatnonzero(cls < HEAD_CLASSES)
        z = model.member_prior.take(cls[h], axis=0)
        logp[h] += _log_chosen(_add_weights(z, model.weights, member_features([c[h] for c in sub], cls[h])), i[h] % WIDTH)
        out[part] = logp
    return out


def _step(weights: np.ndarray, feats: list[np.ndarray], grad: np.ndarray, scale: np.ndarray) -> None:
    """Adagrad step on the rows of the hashed features, in place."""
    for f in feats:
        short = f.astype(np.uint16)  # sorted by radix
        order = np.argsort(short, kind="stable")
        sorted_rows = short[order]
        start = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
        rows = sorted_rows[start]
        # two numbers at a time: half as many sums
        g = np.add.reduceat(grad.take(order, axis=0).view(np.complex64), start, axis=0).view(np.float32)
        scale[rows] += np.einsum("ij,ij->i", g, g) / np.float32(WIDTH)
        weights[rows] -= (RATE / np.sqrt(scale[rows]))[:, None] * g


def train_batch(model: LanguageModel, weights: np.ndarray, scale: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> None:
    """Mini-batch gradient steps over all tokens, in place on ``weights``."""
    ctx = model.contexts(ids, owner)
    for lo in range(0, len(ids), BATCH):
        part = slice(lo, lo + BATCH)
        sub, i = [c[part] for c in ctx], ids[part]
        cls = targets(i)
        feats = class_features(sub)
        z = np.repeat(model.class_prior[None], len(i), axis=0)
        _step(weights, feats, _gradient(_add_weights(z, weights, feats), cls), scale)
        h = np.flatnonzero(cls < HEAD_CLASSES)
        if not len(h):
            continue
        feats = member_features([c[h] for c in sub], cls[h])
        z = model.member_prior.take(cls[h], axis=0)
        _step(weights, feats, _gradient(_add_weights(z, weights, feats), i[h] % WIDTH), scale)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over the whole texts of the only column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(tally.keys()), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["token", "c"])
        for b in batches:
            for t in b.column(0):
                tally.update(tokenize(t.as_py()))
                if len(tally) > 500_000:
                    yield flush()
                    tally.clear()
        yield flush()

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The most frequent tokens, ``most`` at most, by falling count.  A
    histogram of the counts' logarithms (some thousand rows) tells where to
    cut, so no task sends rows that are not kept."""
    level = F.floor(F.log2("c") * 64)
    room, cut = most, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        cut = r.level
    if cut is None:
        return []
    return sorted(counts.where(level >= cut).collect(), key=lambda r: (-r.c, bytes(r.token)))


def fit_language_model(texts: DataFrame, rounds: int = ROUNDS, dictionary: int = DICTIONARY) -> tuple[LanguageModel, DataFrame]:
    """(model, counts of all training tokens) from the whole texts of the
    only column; a null text is an empty one.  Without texts the model knows
    nothing and calls every token unknown."""
    texts = texts.toDF("text")
    counts = stash(count_tokens(texts), "lm-counts")
    common = _most_frequent(counts.where(F.col("c") >= MIN_DICTIONARY_COUNT), dictionary)
    agg = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"),
                     F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    known = np.array([r.c for r in common], np.int64)
    model = LanguageModel([bytes(r.token) for r in common], known, int(agg.n or 0), int(agg.v),
                          int((agg.n or 0) - known.sum()), int(agg.n1 or 0), int(agg.n2 or 0), int(agg.v) - len(common))
    for k in range(rounds if model.total else 0):
        model.weights = _train_round(texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), model)
    return model, counts


def _train_round(texts: DataFrame, model: LanguageModel) -> np.ndarray:
    """Weights after all tasks took steps over their texts, averaged by tokens."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, scale, n = model.weights.copy(), np.ones(BUCKETS, np.float32), 0
        for b in batches:
            held: list[list[bytes]] = []
            size = 0
            for t in b.column(0):
                held.append(tokenize(t.as_py()))
                size += len(held[-1])
                if size >= 1 << 18:
                    train_batch(model, weights, scale, *model.encode(held))
                    n, held, size = n + size, [], 0
            train_batch(model, weights, scale, *model.encode(held))
            n += size
        if n:
            delta = ((weights - model.weights).astype(np.float32) * np.float32(n)).reshape(-1, BLOCK * WIDTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(delta)), pa.int32()), pa.array([TaskContext.get().partitionId() % 16] * len(delta), pa.int32()),
                 pa.array([n] * len(delta), pa.int64()), pa.array([d.astype(np.float32).tobytes() for d in delta], pa.binary())],
                ["block", "part", "n", "delta"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, np.float32).astype(np.float64) for d in pdf["delta"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [0], "n": [pdf["n"].sum()], "delta": [total.astype(np.float32).tobytes()]})

    schema = "block int, part int, n long, delta binary"
    deltas = texts.coalesce(MODELS).mapInArrow(local, schema)
    summed = deltas.groupBy("block", "part").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    weights = model.weights.copy()
    for r in summed.collect():  # the weight table, 2 MB
        weights[r.block * BLOCK:(r.block + 1) * BLOCK] += (np.frombuffer(r.delta, np.float32) / np.float32(r.n)).reshape(BLOCK, WIDTH)
    return weights


def score_texts(docs: DataFrame, model: LanguageModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score), one row per input row.

    Scores are log10 probabilities of the whole text, its end included; a null
    or empty text has the end token only.  Repeated rows are scored alike, an
    empty table gives no rows, other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, texts):
            codes, owner = model.encode(texts)
            logp = natural_scores(model, codes, owner)
            known = codes >= 0
            c = model.counts[np.where(known, codes, 0)] if len(model.counts) else np.zeros(len(codes), np.int64)
            middle = codes >= HEAD
            logp[middle] += np.log(c[middle] / model.middle_total)
            base = np.where(known, model.base_log10(c) if model.total else 0.0, 0.0)
            k = len(texts)
            starts = np.cumsum([0] + [len(t) for t in texts])
            at = np.flatnonzero(~known)
            of = owner[at]
            tokens, times, ends = [], [], [0]
            where = np.searchsorted(of, np.arange(k + 1)).tolist()
            at = (at - starts[of]).tolist()
            for i, ws in enumerate(texts):
                found = Counter([ws[a] for a in at[where[i]:where[i + 1]]])
                tokens.extend(found)
                times.extend(found.values())
                ends.append(len(tokens))
            rare = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], ["token", "n"]))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_pa), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(np.bincount(owner, known, k).astype(np.int64)), pa.array(np.bincount(owner, base, k)),
                 pa.array(np.bincount(owner, logp, k) / np.log(10)), rare], names)

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                texts.append(tokenize(t.as_py()))
                size += len(texts[-1])
                if size >= 1 << 18:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield flush(ids, texts)

    from pyspark.sql.pandas.types import to_arrow_type
    names = ["id", "n_tokens", "known", "base", "part", "rare"]
    id_type = docs.schema[id_col].dataType
    id_pa = to_arrow_type(id_type)
    rare = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
                           T.StructField("base", T.DoubleType()), T.StructField("part", T.DoubleType()), T.StructField("rare", rare)])
    rows = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    words = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    words = words.join(counts, "token", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    d, total = model.discount, float(model.rare_total)
    c = F.col("c")
    # an unknown word has the discounted mass of its class
    if model.rare_total:
        share = F.when(c > 0, F.log10((F.greatest(c, F.lit(1)) - d) / total)).otherwise(F.lit(float(np.log10(d * model.rare_distinct / total))))
    else:
        share = F.lit(0.0)
    norm = model.total + 0.5 * (model.distinct + 1)
    sums = words.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"),
                                    F.sum(F.col("n") * F.log10((c + 0.5) / norm)).alias("rare_base"), F.sum(F.col("n") * share).alias("rare_part"))
    zero = F.lit(0.0)
    return rows.drop("rare").join(sums, "row", "left").select(
        "id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("part") + F.coalesce("rare_part", zero)).alias("score"))
