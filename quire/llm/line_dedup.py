"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Tokens are ordered by rarity; two sets with
Jaccard similarity of at least ``t`` must share a token among the first
``n - ceil(t * n) + 1`` of the larger and the first
``n - ceil(2 t / (1 + t) * n) + 1`` of the smaller set (prefix filter), their
sizes must be within ``t`` of each other (length filter), and what lies before
and behind a shared token must be enough to reach the overlap (positional
filter).  Two more exact bounds thin out what is left: 128 parities of the
sets, each that of the tokens hashed to it, may not differ in more bits than the
sets may in tokens, however large they are, and the larger the
sets, the more tokens their prefixes must share.  Survivors are verified on
their full sets.  A line goes if an earlier line, by (document, line number),
links with it.

The smaller set is found by its short (index) prefix, the larger by its long
(probing) prefix, and both under a key made of the token and a class of sizes:
a class spans the sizes of one factor ``1 / t``, so an indexed set is entered
for its own class and the next, and no others are looked at.

Rarity comes from ``COUNTERS`` hashed counters, a fixed 16 MB however large the
vocabulary is.  Any fixed order of the tokens keeps the join exact; a collision
only moves a token within it.  A token whose counter is 1 occurs in one set and
needs no posting.  A second pair of tables counts how many sets probe and how
many are entered under a key; a posting that meets no other set is not dealt.
Collisions there let postings through and lose none; all counters saturate.

Scale.  Texts are split into words once: the word sets are written in blocks
(64-bit hashes of a block's words, and their numbers set by set) beside the
narrow line rows, and everything after that reads those with numpy.  Lines with equal sets are one node, so a line that stands in a third
of all documents is one set with a count.  Postings are numbers, dealt by key,
and token sets move for candidate pairs only (a fixed-size bitmap of the
candidates, exact semi-join behind it, tells which).  The keys are dealt in
``DEALS`` parts, and shuffle files and tables go when they were read, so that
the disk holds a part of the postings at a time.

Near copies of one line would meet under nearly every key, and each pair of
them would be a row.  So sets that agree in min-hashes are put in groups
first; the join leaves pairs of one group out, and a group is compared in tiles
of ``CHUNK`` by ``CHUNK`` sets that give a row for each set and tile: how many
lines it links with there, and the earliest.  Any grouping gives the same
result, since pairs are either of one group or not.  Tiles still compare all
pairs of a group, as numbers in a matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import broadcast_if_small, drop_stash, stash
from quire.session import shared_dir

THRESHOLD = 0.8
COUNTERS = 1 << 22
KEYS = 1 << 24  # hashed keys of postings, half a byte each
DEALS = 3  # parts of the keys, dealt and joined one after the other
BITMAP_BYTES = 1 << 22
ROUNDS = 4  # signatures of a set, by which it finds its group
HASHES = 4  # min-hashes in a signature
ADOPT = 4  # sets with one label and signature that others follow
GROUP = 8  # sets in a group at least
CHUNK = 512  # sets of a group on one side of a tile, about
SPLITS = 16  # input splits behind one partial table, where there are many
_BLOCK = 1 << 18
_SEEN = 500_000


@dataclass
class LineSets:
    """The word sets of the lines with words of some texts.  ``words`` holds
    the sets one after the other; set ``i`` has ``n[i]`` distinct words, which
    are places in ``hashes``."""

    text: np.ndarray  # number of the text
    line: np.ndarray  # number of the line in it
    words: np.ndarray
    hashes: np.ndarray
    n: np.ndarray
    key: np.ndarray  # 64-bit key of the set, signed


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_CODES = np.arange(256, dtype=np.uint8)
_BLANK = (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))
# random numbers of the bytes, A-Z as a-z; a blank counts nothing
_BYTE = np.where(_BLANK, np.uint64(0), _mix(_mix(np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint64) + np.uint64(1))))


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """64-bit hashes of the words between ``start`` and ``end``: the sum over
    a word's bytes of the byte's number times an odd random number of its
    place, mixed with the length."""
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), step):
        s, e = start[lo:lo + step], end[lo:lo + step]
        gap = np.diff(np.append(s, e[-1]))
        odd = _mix(_mix(np.arange(1, gap.max() + 1, dtype=np.uint64))) | np.uint64(1)
        first = s - s[0]
        place = np.arange(first[-1] + gap[-1]) - np.repeat(first, gap)
        out[lo:lo + step] = np.add.reduceat(_BYTE[data[s[0]:e[-1]]] * odd[place], first)
    return _mix(out + (end - start).astype(np.uint64))


def line_sets(texts: Iterator, most: int = 1 << 20) -> Iterator[LineSets]:
    """Word sets of all lines (A-Z lowered) of UTF-8 texts (or None), about
    ``most`` bytes at a time."""
    def pack() -> LineSets | None:
        data = np.frombuffer(b"\n".join(held), np.uint8)
        edge = np.flatnonzero(np.diff(~_BLANK[data], prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return None
        breaks = np.flatnonzero(data == 10)
        sizes = np.array([len(v) + 1 for v in held], np.int64)
        first_line = np.searchsorted(breaks, np.cumsum(sizes) - sizes)
        hashes, place = np.unique(_hashed(data, start, end), return_inverse=True)
        # distinct words line by line
        both = np.sort((np.searchsorted(breaks, start) << 32) + place)
        both = both[np.append(True, both[1:] != both[:-1])]
        of, words = both >> 32, both & 0xFFFFFFFF
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        n, line = np.diff(np.append(begin, len(of))), of[begin]
        text = np.searchsorted(first_line, line, side="right") - 1
        # a sum of mixed hashes, mixed again with the size
        key = _mix(np.add.reduceat(_mix(hashes)[words], begin) + n.astype(np.uint64)).view(np.int64)
        return LineSets(np.array(number, np.int64)[text], (line - first_line[text]).astype(np.int32), words, hashes, n, key)

    held, number, size = [], [], 0
    for k, text in enumerate(texts):
        if text:
            held.append(text)
            number.append(k)
            size += len(text)
        if size >= most:
            if (x := pack()) is not None:
                yield x
            held, number, size = [], [], 0
    if held and (x := pack()) is not None:
        yield x


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # rows that agree in id and text are one row here
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))


BLOCK_SCHEMA = [T.StructField(c, T.BinaryType()) for c in ("keys", "sizes", "hashes", "words")]


def _block(x: LineSets, give: np.ndarray) -> list[bytes]:
    """Keys, sizes and words of some of the sets, words as places among the
    hashes that occur."""
    words = x.words[np.repeat(give, x.n)]
    used = np.zeros(len(x.hashes), bool)
    used[words] = True
    places = (np.cumsum(used) - 1)[words]
    hashes = x.hashes[used]
    short = np.uint16 if len(hashes) <= 1 << 16 else np.uint32
    return [a.tobytes() for a in (x.key[give], x.n[give].astype(np.uint32), hashes, places.astype(short))]


@dataclass
class Sets:
    """A block read back."""

    key: np.ndarray
    n: np.ndarray
    hashes: np.ndarray
    words: np.ndarray

    @classmethod
    def read(cls, b: pa.RecordBatch) -> Iterator[Sets]:
        for i in range(b.num_rows):
            keys, sizes, hashes, words = (b.column(c)[i].as_buffer() for c in ("keys", "sizes", "hashes", "words"))
            hashes = np.frombuffer(hashes, np.uint64)
            short = np.uint16 if len(hashes) <= 1 << 16 else np.uint32
            yield cls(np.frombuffer(keys, np.int64), np.frombuffer(sizes, np.uint32).astype(np.int64), hashes, np.frombuffer(words, short))

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    @property
    def slots(self) -> np.ndarray:
        return (self.hashes % np.uint64(COUNTERS)).astype(np.int64)


def split_lines(docs: DataFrame, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables in the shared folder out of one reading of the texts.

    Lines: (id, th, line, key), every line with words and the key of its set;
    ``th`` is a hash of the row's text.  Blocks: the sets that are large enough
    to be like another, each from every task that meets it.
    """
    rows = _rows(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType
    id_pa = to_arrow_type(id_type)
    fields = [T.StructField("id", id_type), T.StructField("th", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("key", T.LongType())]
    names = ["kind"] + [f.name for f in fields + BLOCK_SCHEMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kind = lambda k, n: pa.array(np.full(n, k, np.int32))
        for b in batches:
            for x in line_sets(v.as_buffer() for v in b.column(1)):
                take, n = pa.array(x.text), len(x.text)
                yield pa.RecordBatch.from_arrays(
                    [kind(0, n), b.column(0).take(take).cast(id_pa), b.column(2).take(take), pa.array(x.line), pa.array(x.key)]
                    + [pa.nulls(n, pa.binary())] * 4, names)
                # below 1 / (1 - t) - 1 words no other set is similar enough
                give = np.zeros(len(x.n), bool)
                give[np.unique(x.key, return_index=True)[1]] = True
                at = np.flatnonzero(give & (x.n >= 2) & (x.n >= t / (1 - t) - 1e-9))
                keys = x.key[at].tolist()
                give[:] = False
                give[at] = [k not in seen for k in keys]
                seen.update(keys)
                if len(seen) > _SEEN:
                    seen.clear()
                if give.any():
                    yield pa.RecordBatch.from_arrays(
                        [kind(1, 1), pa.nulls(1, id_pa), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())]
                        + [pa.array([v], pa.binary()) for v in _block(x, give)], names)

    spark = docs.sparkSession
    path = shared_dir(spark, "lines")
    made = rows.mapInArrow(run, T.StructType([T.StructField("kind", T.IntegerType()), *fields, *BLOCK_SCHEMA]))
    made.write.partitionBy("kind").parquet(path)

    def table(k: int, schema: list) -> DataFrame:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/kind={k}")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):  # no such rows
            return spark.createDataFrame([], T.StructType(schema))
        return spark.read.schema(T.StructType(schema)).parquet(f"{path}/kind={k}")

    return table(0, fields), table(1, BLOCK_SCHEMA)


def _flat(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many in each row) of a column of packed numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2]
    numbers = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].copy().view(dtype) if data is not None else np.zeros(0, dtype)
    return numbers, np.diff(ends).astype(np.int64) // np.dtype(dtype).itemsize


@contextmanager
def _spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries within go when their query has ended: each
    ends in a written table or in a small one on the driver."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _gathered(df: DataFrame, run: Callable, size: int, dtype: type, combine: Callable) -> np.ndarray:
    """One table of ``size`` numbers out of the partial tables of the tasks,
    combined in two levels where there are many.  Tasks grow with the input."""
    splits = df.rdd.getNumPartitions()
    tasks = splits if splits <= 4 * SPLITS else max(4 * SPLITS, -(-splits // SPLITS))
    parts = int(tasks ** 0.5) if tasks > 4 * SPLITS else 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = run(batches)
        part = TaskContext.get().partitionId() % parts
        blocks = [(i, part, table[lo:lo + _BLOCK]) for i, lo in enumerate(range(0, size, _BLOCK))]
        blocks = [x for x in blocks if x[2].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in blocks], pa.int32()), pa.array([x[1] for x in blocks], pa.int32()),
             pa.array([x[2].tobytes() for x in blocks], pa.binary())], ["block", "part", "numbers"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = combine([np.frombuffer(x, dtype) for x in pdf["numbers"]])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [0], "numbers": [out.tobytes()]})

    schema = "block int, part int, numbers binary"
    tables = (df if tasks == splits else df.coalesce(tasks)).mapInArrow(emit, schema)
    if parts > 1:
        tables = tables.groupBy("block", "part").applyInPandas(add, schema)
    out = np.zeros(size, dtype)
    for r in tables.groupBy("block").applyInPandas(add, schema).collect():  # the table's fixed size
        got = np.frombuffer(r.numbers, dtype)
        out[r.block * _BLOCK:r.block * _BLOCK + len(got)] = got
    return out


def _saturating(dtype: type) -> Callable:
    most = np.iinfo(dtype).max
    return lambda tables: np.minimum(np.sum(tables, axis=0, dtype=np.uint64), most).astype(dtype)


def rarity(blocks: DataFrame) -> np.ndarray:
    """Order of the tokens: how many sets hold a token (a hashed counter), on a
    logarithmic scale; 0 for a token of one set."""
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            for x in Sets.read(b):
                np.add.at(table, x.slots, np.bincount(x.words, minlength=len(x.hashes)).astype(np.uint32))
        return table

    counts = _gathered(blocks, run, COUNTERS, np.uint32, _saturating(np.uint32))
    return np.round(np.log2(np.maximum(counts, 1)) * 2000).astype(np.uint16)


def prefix_length(n, t: float):
    """Length of the probing prefix of a set of ``n`` tokens."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def index_length(n, t: float):
    """Length of the prefix by which the smaller of two sets is found."""
    return n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(np.int64) + 1


def size_class(n, t: float):
    """Sizes that differ by a factor of 1 / t at most lie in equal or
    neighbouring classes."""
    return np.floor(np.log(n) / -np.log(t) + 1e-9).astype(np.int64)


SIGNATURES = [f"sig{r}" for r in range(ROUNDS)]


def signatures(x: Sets, give: np.ndarray) -> list[np.ndarray]:
    """Signatures of some of the sets: near copies agree in one more often than not."""
    n = x.n[give]
    words, start = x.words[np.repeat(give, x.n)], np.cumsum(n) - n
    out = []
    for r in range(ROUNDS):
        sig = np.zeros(len(n), np.uint64)
        for i in range(r * HASHES + 1, (r + 1) * HASHES + 1):
            if len(n):
                sig = _mix(sig + np.minimum.reduceat(_mix(_mix(x.hashes + np.uint64(i)) + np.uint64(i))[words], start))
        out.append(sig.view(np.int64))
    return out


def prefixes(blocks: DataFrame, rare: np.ndarray, t: float) -> DataFrame:
    """(node, n, bits, skip, tokens, more, signatures), one row per set: the probing
    prefix as 32-bit hashes (sets are verified later), rarest first, without its
    first ``skip`` tokens, which stand in this set alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in Sets.read(b):
                n, of = x.n, np.repeat(np.arange(len(x.n)), x.n)
                bit = np.uint64(1) << (x.hashes >> np.uint64(58))
                high = x.hashes >> np.uint64(57) & np.uint64(1) == 1
                bits, more = (np.bitwise_xor.reduceat(np.where(h, bit, np.uint64(0))[x.words], x.start).view(np.int64) for h in (~high, high))
                common = rare[x.slots]
                order = np.lexsort((x.hashes, common))  # rarest word first
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                inside = np.sort((of << 32) + place[x.words])[np.arange(len(of)) - x.start[of] < prefix_length(n, t)[of]]
                of, word = inside >> 32, order[inside & 0xFFFFFFFF]
                alone = common[word] == 0
                skip = np.bincount(of[alone], minlength=len(n))
                token = (x.hashes[word[~alone]] >> np.uint64(16)).astype(np.uint32)
                ends = np.concatenate(([0], np.cumsum(np.bincount(of[~alone], minlength=len(n))) * 4)).astype(np.int32)
                give = np.diff(ends) > 0
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(x.key), pa.array(n.astype(np.int32)), pa.array(bits), pa.array(skip.astype(np.int32)),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(token)]), pa.array(more)],
                    ["node", "n", "bits", "skip", "tokens", "more"]).filter(pa.array(give))
                yield pa.RecordBatch.from_arrays(rows.columns + [pa.array(v) for v in signatures(x, give)], rows.schema.names + SIGNATURES)

    # tasks that met the same set give the same row
    schema = "node long, n int, bits long, skip int, tokens binary, more long" + "".join(f", {c} long" for c in SIGNATURES)
    return blocks.mapInArrow(run, schema).dropDuplicates(["node"])


def near_groups(prefix: DataFrame) -> DataFrame:
    """(node, cluster, parts) of the sets in groups, ``parts`` the chunks of the group.

    The first signature is a set's label; for every further one, a set takes
    the label most sets with that signature have, if these are ``ADOPT``."""
    label = prefix.select("node", *SIGNATURES[1:], F.col(SIGNATURES[0]).alias("cluster"))
    for r, sig in enumerate(SIGNATURES[1:]):
        most = label.groupBy(sig, "cluster").agg(F.count("*").alias("c")).where(F.col("c") >= ADOPT).groupBy(sig).agg(
            F.max(F.struct("c", "cluster"))["cluster"].alias("most"))
        before, rest = label, SIGNATURES[r + 2:]
        most = stash(most, "line-most")
        label = stash(label.join(broadcast_if_small(most), sig, "left").select("node", *rest, F.coalesce("most", "cluster").alias("cluster")), "line-labels")
        drop_stash(most)
        if r:
            drop_stash(before)
    # 0 stands for no group
    sizes = label.where(F.col("cluster") != 0).groupBy("cluster").agg(F.count("*").alias("c")).where(F.col("c") >= GROUP)
    groups = stash(label.join(sizes, "cluster").select("node", "cluster", F.ceil(F.col("c") / CHUNK).cast("int").alias("parts")), "line-groups")
    drop_stash(label)
    return groups


@dataclass
class Entries:
    """Postings of a batch of prefixes: each under the class of its set, which
    probes, and those of the index prefix under the next class, too."""

    of: np.ndarray
    pos: np.ndarray
    key: np.ndarray
    next_key: np.ndarray
    index: np.ndarray  # in the index prefix

    @classmethod
    def read(cls, b: pa.RecordBatch, t: float) -> Entries:
        n = b.column(1).to_numpy().astype(np.int64)
        token, c = _flat(b.column(4), np.uint32)
        of = np.repeat(np.arange(len(n)), c)
        pos = np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c) + b.column(3).to_numpy()[of]
        level = size_class(n, t)[of]
        key = lambda k: _mix((token.astype(np.uint64) << np.uint64(16)) + k.astype(np.uint64))
        return cls(of, pos, key(level), key(level + 1), pos < index_length(n, t)[of])


def _slot(key: np.ndarray) -> np.ndarray:
    return (key % np.uint64(KEYS)).astype(np.int64)


def occupancy(prefix: DataFrame, t: float) -> np.ndarray:
    """Whether no, one or more sets probe (first half) and are entered (second
    half) under a hashed key: two bits each, four to a byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(2 * KEYS, np.uint8)
        for b in batches:
            e = Entries.read(b, t)
            at = np.concatenate((_slot(e.key), KEYS + _slot(e.key[e.index]), KEYS + _slot(e.next_key[e.index])))
            at, c = np.unique(at, return_counts=True)
            table[at] = np.minimum(table[at] + c, 2)
        return table[0::4] | table[1::4] << 2 | table[2::4] << 4 | table[3::4] << 6

    def combine(tables: list[np.ndarray]) -> np.ndarray:
        out = tables[0].copy()
        for x in tables[1:]:  # 0, 1 and 2 add up to 2 at most
            one, two = 0x55, 0xAA
            out = (out | x) & two | (out & x & one) << 1 | (out ^ x) & one & ~((out | x) >> 1) & one
        return out

    return _gathered(prefix, run, KEYS // 2, np.uint8, combine)


def _count(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table[at >> 2] >> (at & 3).astype(np.uint8) * np.uint8(2) & np.uint8(3)


def postings(prefix: DataFrame, counts: np.ndarray, t: float, deal: int) -> DataFrame:
    """(key, node, n, pos, bits, more, role, cluster) of one part of the keys, dealt by key; ``role`` is the sum of 1
    for a posting that probes and 2 for one that is entered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = Entries.read(b, t)
            own, nxt = _slot(e.key), _slot(e.next_key)
            mine, next_mine = (k.astype(np.uint32) % np.uint32(DEALS) == deal for k in (e.key, e.next_key))
            probe = _count(counts, KEYS + own) > e.index
            entered = e.index & (_count(counts, own) > 1)
            further = np.flatnonzero(next_mine & e.index & (_count(counts, nxt) > 0))
            own = np.flatnonzero(mine & (probe | entered))
            at = np.concatenate((own, further))
            role = np.concatenate((probe[own] + 2 * entered[own], np.full(len(further), 2))).astype(np.int32)
            of = e.of[at]
            column = lambda i: b.column(i).take(pa.array(of))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((e.key[own], e.next_key[further])).astype(np.uint32).view(np.int32)), column(0), column(1),
                 pa.array(e.pos[at].astype(np.int32)), column(2), column(5), pa.array(role), column(6)],
                ["key", "node", "n", "pos", "bits", "more", "role", "cluster"])

    made = prefix.mapInArrow(run, "key int, node long, n int, pos int, bits long, more long, role int, cluster long")
    return made.repartition("key")  # one deal serves both sides of the join


def meetings(post: DataFrame, t: float) -> DataFrame:
    """(a, b, n1, n2), a the larger set: a row for every key under which two
    sets of different groups meet that pass the length, positional and parity
    filters."""
    side = lambda k: post.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "pos", "bits", "more", "role", "cluster")])
    left, right = side(1), side(2)
    both = F.col("n1") + F.col("n2")
    need = F.ceil(F.lit(t / (1 + t)) * both - 1e-9)
    reach = F.least("pos1", "pos2") + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    apart = F.bit_count(F.col("bits1").bitwiseXOR(F.col("bits2"))) + F.bit_count(F.col("more1").bitwiseXOR(F.col("more2")))
    return left.join(right, "key").where(
        # roles and groups are tested together, so that one deal serves both sides
        ((F.col("cluster1") != F.col("cluster2")) | (F.col("cluster1") == 0))
        & (F.col("role1") % 2 + F.floor(F.col("role2") / 2) == 2)
        & ((F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") > F.col("node2"))))
        & (F.col("n2") >= F.ceil(t * F.col("n1") - 1e-9)) & (reach >= need) & (apart <= both - 2 * need)).select(
        F.col("node1").alias("a"), F.col("node2").alias("b"), "n1", "n2")


def candidate_pairs(met: list[DataFrame], t: float) -> DataFrame:
    """Distinct (a, b) whose sets meet often enough."""
    pairs = reduce(DataFrame.unionByName, met)
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("n1") + F.col("n2")) - 1e-9)
    # beyond the prefix that ends first no more than the rest of that set is shared
    rest = F.greatest(F.ceil(t * F.col("n1") - 1e-9), F.ceil(2 * t / (1 + t) * F.col("n2") - 1e-9)) - 1
    shared = pairs.groupBy("a", "b", "n1", "n2").agg(F.count("*").alias("c"))
    return shared.where(F.col("c") >= need - rest).select("a", "b")


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % (BITMAP_BYTES * 8)


def _shared(row: np.ndarray, token: np.ndarray, m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens the sets ``left`` share with the sets ``right``, out of
    (row, token) pairs of ``m`` sets, as a matrix of floats; a set's own count
    leaves out what it alone holds.

    What more than half of the sets hold is counted by those that lack it; few
    pairs are left of near copies.  Tokens of few sets are counted pair by
    pair, others as columns of a matrix."""
    _, token, count = np.unique(token, return_inverse=True, return_counts=True)
    core = count * 2 > m
    held = np.zeros((m, core.sum()), bool)
    inside = core[token]
    held[row[inside], (np.cumsum(core) - 1)[token[inside]]] = True
    lack, missing = np.nonzero(~held)
    lacks = np.bincount(lack, minlength=m).astype(np.float32)
    row = np.concatenate((row[~inside], lack))
    token = np.concatenate((token[~inside], missing + len(count)))
    _, token, count = np.unique(token, return_inverse=True, return_counts=True)
    out = np.float32(core.sum()) - lacks[left][:, None] - lacks[right]

    at = lambda rows: np.bincount(rows, np.arange(1, len(rows) + 1), m).astype(np.int64) - 1
    many = count * 64 > m
    columns = np.zeros((m, many.sum()), np.float32)
    inside = many[token]
    columns[row[inside], (np.cumsum(many) - 1)[token[inside]]] = 1
    out += columns[left] @ columns[right].T

    few = ~inside & (count > 1)[token]
    i, j = row[few], row[few]
    i, of_i = at(left)[i][at(left)[i] >= 0], token[few][at(left)[i] >= 0]
    j, of_j = at(right)[j][at(right)[j] >= 0], token[few][at(right)[j] >= 0]
    j = j[np.argsort(of_j, kind="stable")]
    size = np.bincount(of_j, minlength=len(count))
    c = size[of_i]  # each of the left meets all of the right with its token
    begin = np.repeat((np.cumsum(size) - size)[of_i] - (np.cumsum(c) - c), c)
    pairs = np.repeat(i, c) * len(right) + j[begin + np.arange(len(begin))]
    out += np.bincount(pairs, minlength=out.size).reshape(out.shape)
    return out


TILE = ["cluster", "low", "high"]


def group_links(members: DataFrame, t: float) -> DataFrame:
    """(node, other, links) of the links between the sets of a group: a row for
    each set and tile of its group with links, how many lines it links with and
    which set's first line is the earliest of them.

    ``members``: (node, tokens, cluster, parts, lines, id, line, th), the last
    three of the set's first line."""
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    tiles = (members.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("low", F.least("part", "with")).withColumn("high", F.greatest("part", "with")).drop("with", "parts"))

    def compare(tile: pa.Table) -> pa.Table:
        # in Spark's order, null ids first
        tile = tile.take(pc.sort_indices(tile, [(c, "ascending") for c in ("id", "line", "th")], null_placement="at_start")).combine_chunks()
        node, lines, part = (tile.column(c).to_numpy() for c in ("node", "lines", "part"))
        tokens = tile.column("tokens").combine_chunks()
        n = pc.list_value_length(tokens).to_numpy().astype(np.int64)
        low, high = tile.column("low")[0].as_py(), tile.column("high")[0].as_py()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        shared = _shared(np.repeat(np.arange(len(n)), n), tokens.flatten().to_numpy(), len(n), left, right).astype(np.float64)
        both = (n[left][:, None] + n[right]).astype(np.float64)
        like = shared / (both - shared) >= t - 1e-12
        if low == high:
            np.fill_diagonal(like, False)
        out = []
        for like, a, b in [(like, left, right)] + [(like.T, right, left)] * (low != high):
            if like.size:
                hit = np.flatnonzero(like.any(axis=1))
                links = like[hit].astype(np.float64) @ lines[b].astype(np.float64)
                out.append((node[a[hit]], node[b[like[hit].argmax(axis=1)]], links.astype(np.int64)))
        return pa.table([np.concatenate([np.zeros(0, np.int64)] + [x[i] for x in out]) for i in range(3)], ["node", "other", "links"])

    return tiles.groupBy(*TILE).applyInArrow(compare, "node long, other long, links long")


def line_links(blocks: DataFrame, lines: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All links between different word sets of the blocks that
    :func:`split_lines` made for this threshold; the blocks are deleted.

    Nodes: (node, lines, first), how many lines a word set has and which is
    first.  Links: (node, other, links), a row for each side of a link between
    sets of different groups, ``links`` null, and the rows of
    :func:`group_links`."""
    t = threshold
    signed = stash(prefixes(blocks, rarity(blocks), t), "line-prefixes")
    groups = near_groups(signed)
    prefix = stash(signed.drop(*SIGNATURES).join(broadcast_if_small(groups.drop("parts")), "node", "left").fillna(0, ["cluster"]), "line-prefixes")
    drop_stash(signed)
    counts = occupancy(prefix, t)
    met = [stash(meetings(postings(prefix, counts, t, k), t), "line-meetings") for k in range(DEALS)]
    drop_stash(prefix)
    pairs = stash(candidate_pairs(met, t), "line-pairs")
    for m in met:
        drop_stash(m)
    nodes = _nodes(lines)
    touched = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(groups.select("node"))

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(BITMAP_BYTES, np.uint8)
        for b in batches:
            at = _slots(b.column(0).to_numpy())
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return table

    bitmap = _gathered(touched, mark, BITMAP_BYTES, np.uint8, np.bitwise_or.reduce)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in Sets.read(b):
                at = _slots(x.key)
                hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                h = x.hashes.view(np.int64)[x.words[np.repeat(hit, x.n)]]
                ends = pa.array(np.concatenate(([0], np.cumsum(x.n[hit]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x.key[hit]), pa.ListArray.from_arrays(ends, pa.array(h))], ["node", "tokens"])

    tokens = blocks.mapInArrow(marked, "node long, tokens array<long>")
    tokens = stash(tokens.join(touched.distinct(), "node", "left_semi").dropDuplicates(["node"]), "line-sets")
    drop_stash(blocks)
    both = (pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"))
    shared = F.size(F.array_intersect("ta", "tb"))
    scored = both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), shared.alias("s"))
    jaccard = F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))
    links = scored.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= t - 1e-12)
    links = stash(links, "line-links")
    none = F.lit(None).cast("long").alias("links")
    members = tokens.join(groups, "node").join(nodes.select("node", "lines", "first.*"), "node")
    inside = stash(group_links(members, t), "line-links")
    drop_stash(groups)
    drop_stash(tokens)
    drop_stash(pairs)
    return nodes, (inside.union(links.select(F.col("a").alias("node"), F.col("b").alias("other"), none))
                   .union(links.select(F.col("b").alias("node"), F.col("a").alias("other"), none)))


def _nodes(lines: DataFrame) -> DataFrame:
    """(node, lines, first): how many lines a word set has and which is first."""
    return stash(lines.groupBy(F.col("key").alias("node")).agg(
        F.count("*").alias("lines"), F.min(F.struct("id", "line", "th")).alias("first")), "line-nodes")


def judge_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_lines, removed, n_links) of every row with words.

    ``removed`` lists the numbers (from 0) of the lines that an earlier line
    links with, an equal word set included; ``n_links`` sums over the row's
    lines the other lines of similar but different word sets.  Order is (id,
    line number, text hash), null ids first.
    """
    lines, blocks = split_lines(docs, threshold, id_col, text_col)
    with _spent_shuffles(docs.sparkSession):
        nodes, links = line_links(blocks, lines, threshold)
    near = links.join(nodes.select(F.col("node").alias("other"), "first", "lines"), "other").groupBy("node").agg(
        F.min("first").alias("near_first"), F.sum(F.coalesce("links", "lines")).alias("links"))
    marks = nodes.join(near, "node", "left").select(
        F.col("node").alias("key"), F.least("first", F.coalesce("near_first", "first")).alias("earliest"), F.coalesce("links", F.lit(0)).alias("links"))
    judged = lines.join(marks, "key").withColumn("gone", F.col("earliest") < F.struct("id", "line", "th"))
    # lines of rows that agree in id and text are alike: count each place once
    return judged.groupBy("id", "th").agg(
        F.size(F.collect_set("line")).cast("long").alias("n_lines"),
        F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("line")))).alias("removed"), F.sum("links").alias("n_links"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, removed, n_links, text), one row per input row; ``text``
    is what stays of it.

    Lines without words are never removed; a null text stays null and has no
    lines; rows that agree in id and text get the same answer; an empty table
    gives no rows; only the named columns are read.
    """
    rows, judged = _rows(docs, id_col, text_col), judge_lines(docs, threshold, id_col, text_col)
    out = rows.join(judged.withColumnRenamed("id", "__id").withColumnRenamed("th", "__th"),
                    F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    return out.select("id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.size("removed") > 0, kept).otherwise(F.col("text")).alias("text"))
