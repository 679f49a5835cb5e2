"""Near copies of a line are counted in groups, without a row per pair."""

import random
from collections import Counter, defaultdict

import numpy as np

from quire.llm import line_dedup as L
from quire.session import ship_package


def near_copies(rng, n):
    base = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(40)] = f"x{rng.randrange(400)}"
        out.append(" ".join(words))
    return out


def test_group_of_near_copies(spark):
    """As all pairs say, several tiles included; fewer rows than a quarter of the pairs."""
    ship_package(spark)
    rng = random.Random(3)
    lines = near_copies(rng, 640) + [" ".join(f"y{rng.randrange(90)}" for _ in range(12)) for _ in range(200)]
    rng.shuffle(lines)
    docs = [(None if d == 7 else d, "\n".join(lines[4 * d:4 * d + 4])) for d in range(210)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flat = [(-1 if d is None else d, i, frozenset(x.split())) for d, t in docs for i, x in enumerate(t.split("\n"))]
    removed, links, pairs = defaultdict(list), Counter(), set()
    for d, i, w in flat:
        like = [(e, j, v) for e, j, v in flat if 9 * len(w & v) >= 4 * (len(w) + len(v))]
        if any((e, j) < (d, i) for e, j, _ in like):
            removed[d].append(i)
        links[d] += sum(v != w for _, _, v in like)
        pairs |= {frozenset((w, v)) for _, _, v in like if v != w}
    for r in L.dedup_lines(df).collect():
        d = -1 if r.id is None else r.id
        assert (r.removed, r.n_links) == (removed[d], links[d])
    rows, blocks = L.split_lines(df)
    assert L.line_links(blocks, rows)[1].count() < len(pairs) / 4


def test_shared_tokens():
    rng = np.random.default_rng(1)
    for _ in range(60):
        m = int(rng.integers(1, 150))
        base = rng.choice(500, 40, replace=False)
        sets = [set((base if rng.random() < 0.7 else rng.choice(500, 30)).tolist()) ^ set(rng.choice(500, 6).tolist()) for _ in range(m)]
        row, token = np.repeat(np.arange(m), [len(x) for x in sets]), np.array([t for x in sets for t in x], np.int64)
        side = rng.integers(0, 2, m)
        for a, b in ((np.arange(m), np.arange(m)), (np.flatnonzero(side == 0), np.flatnonzero(side == 1))):
            want = np.array([[len(sets[i] & sets[j]) for j in b] for i in a]).reshape(len(a), len(b))
            assert (L._shared(row, token, m, a, b) == want)[a[:, None] != b].all()
