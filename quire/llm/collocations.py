"""Phrase collocations by marginalising counts of the longest windows.

Every word occurrence opens one window of up to four words of its piece
(shorter where the piece ends): the word and its leads.  Only these windows are
counted; the count of a shorter phrase is the sum over all windows that begin
with it, which Spark's ROLLUP takes over the lead columns.  No phrase length
is exploded on its own.

Most windows are unique and would be shuffled for nothing.  So a first pass
fills a filter: the prefixes of every window hash to cells, and a cell that is
met less than ``min_count`` times holds none that frequent.  The second pass
cuts each window behind its last prefix that the filter lets pass (one without
any is left without words and counts for its language alone); no phrase that is
counted below can reach across the cut, as it would be a prefix that frequent.  The filter can only let too much pass, so counts stay exact.
It has a cell for every ``CELL_CHARS`` characters of text, up to ``MAX_CELLS``
(a broadcast of 64 MB); beyond that it lets more through and the shuffle grows.
Tasks send their cells as sparse blocks, three bytes for a distinct cell of a
slice, and a block is added up as a stream.

A candidate's parts occur at least as often as it does, so the rolled-up
phrases of ``min_count`` hold every count that scores need.  They join the
candidates' parts by language and phrase; a single word is part of very many
candidates, so its row is copied to ``SALTS`` keys over which its candidates
are spread.  The scores are exact: decimals of 38 digits where products may
pass 64 bits.

Scale: tasks read whole texts in slices of about ``SLICE_CHARS`` characters and
count a slice before they send it, so copies and frequent passages shrink
first; windows are exchanged by language and all their words, never by a single
word, language or document.  The ranking is cut to the first ``top`` of a
language in every task before its shuffle.  A lost executor costs its tasks;
the counted phrases are written to the shared folder once.

Cases: a null text is empty, a null language ``und``; repeated rows count
again; words and texts may be of any length (a text longer than a slice is a
slice of its own).  Ties in the score go to the more frequent, then the smaller
phrase in UTF-8 order, ties between cuts (after flooring) to the shorter first
part.  An empty table gives no rows.  Other columns are ignored whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import ASCII_LOWER, ASCII_UPPER, broadcast_if_small, stash

ORDER = 4
UNKNOWN_LANG = "und"
PIECE_END = "[.,;:!?\\x0A-\\x0D]"
SLICE_CHARS = 2 << 20
# the filter: cells of a block, characters of text for a cell, bounds of their number (powers of two)
BLOCK_CELLS, CELL_CHARS, MIN_CELLS, MAX_CELLS = 1 << 16, 16, 1 << 16, 1 << 29
SALTS = 16
# floor(2,000,000 a / (l + r)) in decimals
SCORE = "(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"

SPACE, END = 32, 10
# A-Z become lower case, a tab a blank, the ends of pieces a line feed; UTF-8 keeps these bytes to themselves
BYTES = bytes.maketrans((ASCII_UPPER + "\t.,;:!?\n\x0b\x0c\r").encode(), (ASCII_LOWER + " " + "\n" * 10).encode())


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) columns in slices of about ``SLICE_CHARS`` bytes of text."""
    for batch in batches:
        lang, text = batch.column("lang"), batch.column("text")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(text):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE_CHARS, side="right")))
            yield lang.slice(at, to - at), text.slice(at, to - at)
            at = to


class Words:
    """The words of a slice: ``codes`` into the dictionary ``names``, the code
    of the language in ``langs``, and ``joined``: whether a word and the next
    stand in one piece."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        text = pa.concat_arrays([text]).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        held = text.buffers()[2]
        data = np.frombuffer((held.to_pybytes() if held is not None else b"")[offsets[0]:offsets[-1]].translate(BYTES), np.uint8)
        starts_of_docs = offsets[:-1] - offsets[0]
        inside = (data != SPACE) & (data != END)
        # a word begins behind a separator, and where a text begins
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        first = starts_of_docs[starts_of_docs < len(data)]
        opens[first] = inside[first]
        begin = np.flatnonzero(opens)
        letters = np.concatenate([[0], np.cumsum(inside)])
        bounds = np.append(letters[begin], letters[-1]).astype(np.int64)
        names = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[inside].tobytes()))
        coded = names.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary
        doc = np.searchsorted(starts_of_docs, begin, side="right") - 1
        piece = np.cumsum(data == END)[begin] if len(begin) else begin
        self.joined = np.zeros(len(begin), bool)
        self.joined[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        langs = lang.dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]

    def grams(self, cells: int, often=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``ORDER`` words: the places where so many words of a piece
        begin, and their cells; with ``often`` only where it holds for the
        cells of these words and of the shorter ones before."""
        hashed = lambda names: pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False)
        word = hashed(self.names)[self.codes]
        at, h = np.arange(len(word)), word + hashed(self.langs)[self.lang]
        for k in range(ORDER):
            if k:
                on = self.joined[at + k - 1]
                at, h = at[on], h[on]
                h = h * np.uint64(0x9E3779B97F4A7C15) + word[at + k]
            cell = (h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)
            if often is not None:
                on = often(cell)
                at, h = at[on], h[on]
            yield at, cell


def filter_blocks(cells: int, min_count: int):
    """Tasks' side of the filter: (block, places, counts) of every slice."""
    wide = np.uint8 if min_count < 256 else np.uint32

    def run(batches):
        for lang, text in slices(batches):
            cell, n = np.unique(np.concatenate([cell for _, cell in Words(lang, text).grams(cells)]), return_counts=True)
            block, first = np.unique(cell // BLOCK_CELLS, return_index=True)
            places = np.split((cell % BLOCK_CELLS).astype(np.uint16), first[1:])
            # counts are only asked whether they reach min_count
            counts = np.split(np.minimum(n, min_count).astype(wide), first[1:])
            if len(block):
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([p.tobytes() for p in places], pa.binary()),
                                                  pa.array([c.tobytes() for c in counts], pa.binary())], ["block", "places", "counts"])

    def merge(batches):
        total, now = np.zeros(BLOCK_CELLS, np.int64), None
        out = lambda b: pa.RecordBatch.from_pydict({"block": [b], "bits": [np.packbits(total >= min_count).tobytes()]},
                                                   pa.schema([("block", pa.int32()), ("bits", pa.binary())]))
        for batch in batches:
            for block, places, counts in zip(*(batch.column(c) for c in ("block", "places", "counts"))):
                if block.as_py() != now:
                    if now is not None:
                        yield out(now)
                    total[:], now = 0, block.as_py()
                total[np.frombuffer(places.as_py(), np.uint16)] += np.frombuffer(counts.as_py(), wide)
        if now is not None:
            yield out(now)
    return run, merge


def frequency_filter(texts: DataFrame, min_count: int) -> np.ndarray:
    """Bits of the cells that are met at least ``min_count`` times."""
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (chars // CELL_CHARS).bit_length()))
    run, merge = filter_blocks(cells, min_count)
    sent = texts.mapInArrow(run, "block int, places binary, counts binary")
    merged = sent.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    bits = np.zeros((cells // BLOCK_CELLS, BLOCK_CELLS // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row.block] = np.frombuffer(row.bits, np.uint8)
    return bits.reshape(-1)


def count_windows(bits):
    """(lang, text) to (lang, gram, n): the padded longest windows of every
    word, cut before pairs that the filter rules out, counted by slice."""

    def run(batches):
        held = bits.value
        for lang, text in slices(batches):
            words = Words(lang, text)
            if not len(words.codes):
                continue
            often = lambda cell: (held[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            size = len(words.names) + 1
            # lead columns: 0 where the window has ended
            leads = [np.zeros(len(words.codes), np.int64) for _ in range(ORDER)]
            for k, (at, _) in enumerate(words.grams(len(held) * 8, often)):
                leads[k][at] = words.codes[at + k] + 1
            ids = words.lang
            for lead in leads:
                ids, kept = pd.factorize(ids * size + lead)
            n = np.bincount(ids, minlength=len(kept))
            first = np.empty(len(kept), np.int64)
            first[ids[::-1]] = np.arange(len(ids))[::-1]
            columns = [words.names.take(pa.array(lead[first] - 1, mask=lead[first] == 0)) for lead in leads]
            columns[0] = columns[0].fill_null("")
            gram = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()), null_handling="skip")
            out = pa.RecordBatch.from_arrays([words.langs.take(pa.array(words.lang[first])).cast(pa.string()), gram.cast(pa.string()), pa.array(n)],
                                             ["lang", "gram", "n"])
            for i in range(0, len(out), 1 << 16):
                yield out.slice(i, 1 << 16)
    return run


def frequent_phrases(documents: DataFrame, min_count: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, k, phrase, f): every phrase of 1 to 4 words that occurs at least
    ``min_count`` times in its language, and with k = 0 and a null phrase the
    number of all words of the language."""
    texts = documents.select(F.coalesce(documents[lang_col], F.lit(UNKNOWN_LANG)).alias("lang"),
                             F.coalesce(documents[text_col], F.lit("")).alias("text"))
    bits = documents.sparkSession.sparkContext.broadcast(frequency_filter(texts, min_count))
    windows = texts.mapInArrow(count_windows(bits), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    words = [f"w{i}" for i in range(1, ORDER + 1)]
    columns = windows.select("lang", F.split("gram", " ").alias("w"), "n").select(
        "lang", *[F.coalesce(F.get("w", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(words)], "n")
    rolled = columns.rollup("lang", *words).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    k = F.lit(ORDER) - F.bit_count("g")  # every rolled-up column sets a bit; -1: all languages
    phrase = F.array_join(F.filter(F.array(*words), lambda w: w.isNotNull()), " ")
    found = rolled.select("lang", k.cast("int").alias("k"), F.when(k > 0, phrase).alias("phrase"), "f",
                          F.array(*words).alias("w"))
    whole = (F.col("k") == 0) | ((F.col("k") > 0) & (F.col("f") >= min_count) & (F.get("w", F.col("k") - 1) != ""))
    return found.where(whole).drop("w")


def _part_counts(parts: DataFrame, part: str, out: str, counts: DataFrame) -> DataFrame:
    """``parts`` with the count of the phrase in column ``part`` as ``out``."""
    single = lambda c: F.instr(c, " ") == 0
    salt = F.when(single(F.col(part)), F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.explode(F.when(single(F.col(part)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    side = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(out)).withColumn("salt", copies)
    return parts.withColumn("salt", salt).join(broadcast_if_small(side), ["lang", part, "salt"]).drop("salt")


def collocations(documents: DataFrame, min_count: int = 30, top: int = 2000, absorb: tuple[int, int] = (80, 100),
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``
    candidates by score.  A candidate goes if a longer candidate around it
    occurs at least ``absorb`` (numerator, denominator) times as often."""
    held = stash(frequent_phrases(documents, min_count, text_col, lang_col), "collocations")
    phrases, totals = held.where("k > 0"), held.where("k = 0").select("lang", F.col("f").alias("n"))
    candidates = phrases.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    parts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = parts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn(
        "rest", F.substr("phrase", F.length("left") + 2))
    parts = _part_counts(_part_counts(parts, "left", "l", phrases), "rest", "r", phrases)
    scored = parts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    around = longest_around(candidates)
    many = F.col("around").cast("decimal(19,0)") * absorb[1] >= F.col("a").cast("decimal(19,0)") * absorb[0]
    kept = scored.join(around, ["lang", "phrase"], "left").where(~F.coalesce(many, F.lit(False)))
    ranked = kept.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(broadcast_if_small(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def longest_around(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, around): the greatest count of a longer candidate that
    holds the phrase (two words or more) as a run of words."""
    words = F.split("phrase", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))))
    return (candidates.where("k > 2").select("lang", F.explode(runs).alias("phrase"), "a")
            .groupBy("lang", "phrase").agg(F.max("a").alias("around")))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{PIECE_END}')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) ks(k)),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL),
frequent AS (SELECT * FROM counts WHERE f >= 30),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE k > 1),
cuts AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS rest
         FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts JOIN frequent x ON x.lang = cuts.lang AND x.phrase = head JOIN frequent y ON y.lang = cuts.lang AND y.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000::HUGEINT * a // (x.f::HUGEINT + y.f)), c) = 1),
inner_runs AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, w, a, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM (SELECT lang, w, a, unnest(range(2, len(w))) AS size FROM candidates)) GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN totals USING (lang) LEFT JOIN inner_runs USING (lang, phrase)
WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
