"""Word sets of lines, split with numpy, against plain Python."""

import random

import numpy as np
import pyarrow as pa

from quire.llm import line_dedup as L


def plain(texts):
    return {(k, i): frozenset(line.split()) for k, t in enumerate(texts) for i, line in enumerate((t or "").encode().lower().split(b"\n")) if line.split()}


def test_line_sets_equal_plain_split():
    rng = random.Random(5)
    pieces = ["a", "B", "b", "Ä", "ä", "é", " ", "  ", "\t", "\n", "\n\n", "\r", "\x0b", "\x0c", " ", "\x1c", "word", "WORD", "x" * 300]
    texts = [None, "", " \n\t", "same same\nsame", "same"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    column = pa.array(texts)
    for most in (1, 200, 1 << 20):
        got, words = {}, {}
        for x in L.line_sets((v.as_buffer() for v in column), most):
            start = np.cumsum(x.n) - x.n
            for k, line, s, n, key in zip(x.text.tolist(), x.line.tolist(), start, x.n, x.key.tolist()):
                got[k, line] = frozenset(x.hashes[x.words[s:s + n]].tolist())
                assert words.setdefault(key, got[k, line]) == got[k, line]
        want = plain(texts)
        assert got.keys() == want.keys()
        # hashes and words are one to one, and so are keys and sets
        assert len(set().union(*got.values())) == len(set().union(*want.values()))
        assert all(len(got[at]) == len(want[at]) for at in want)
        assert len(set(got.values())) == len(set(want.values())) == len(words)


def test_blocks_come_back():
    x = next(L.line_sets(pa.array(["a b c d\nb c d e f\ng h i j"])[i].as_buffer() for i in range(1)))
    give = np.array([True, False, True])
    batch = pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in L._block(x, give)], ["keys", "sizes", "hashes", "words"])
    back = next(L.Sets.read(batch))
    assert back.key.tolist() == x.key[give].tolist() and back.n.tolist() == [4, 4]
    assert back.hashes[back.words].tolist() == x.hashes[x.words[np.repeat(give, x.n)]].tolist()


def test_similar_sets_meet_under_a_key():
    """The first shared token of two similar sets lies in the probing prefix
    of the larger and the index prefix of the smaller, in a class that fits."""
    rng = random.Random(6)
    for _ in range(3000):
        t = rng.choice([0.5, 0.8, 0.9])
        a = set(rng.sample(range(60), rng.randrange(2, 40)))
        b = set(a)
        for _ in range(rng.randrange(0, 6)):
            b.symmetric_difference_update({rng.randrange(60)})
        if not b or len(a & b) / len(a | b) < t - 1e-12:
            continue
        big, small = sorted((sorted(a), sorted(b)), key=len, reverse=True)
        first = min(a & b)
        n1, n2 = np.array(len(big)), np.array(len(small))
        assert big.index(first) < L.prefix_length(n1, t) and small.index(first) < L.index_length(n2, t)
        assert 0 <= L.size_class(n1, t) - L.size_class(n2, t) <= 1
