"""Hard-negative mining against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives as hn
from quire.session import ship_package

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=3):
    """(anchor, positive, rank, negative, score, score), sorted."""
    held = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if sum(float(x) * x for x in v) < 2.0 ** 62:
            held.add((i, label, v))
    out = []
    for a in held:
        if not is_anchor(a[0]):
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in held if b != a]
        first = lambda xs, n: sorted(xs, key=lambda x: (-x[0], x[1][0]))[:n]
        for ps, p in first([x for x in scored if x[1][1] == a[1]], positives):
            window = [x for x in scored if x[1][1] != a[1] and 50 * ps <= 100 * x[0] <= 95 * ps]
            out += [(a[0], p[0], k, n[0], ps, ns) for k, (ns, n) in enumerate(first(window, negatives), 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
                  for r in hn.hard_negatives(df, F.col("id") % 5 == 0, df["label"], **kw).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (40, 40, 40), (17, 33, 129), (64, 65, 200)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for top in (4, 1 << 20, 1 << 62):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (hn.strassen(a, b, leaf=4) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    score, ids, keys = rng.integers(0, 6, (9, 50)), np.sort(rng.integers(0, 40, 50)), np.arange(50)
    for cuts in ([50], [10, 25, 50], [1, 49, 50]):
        heaps = hn.Heaps(9, 4)
        parts = [slice(a, b) for a, b in zip([0] + cuts, cuts)]
        for part in reversed(parts):
            heaps.merge(score[:, part].copy(), ids[part], keys[part])
        for i in range(9):
            best = sorted(zip(-score[i], ids, keys))[:4]
            assert [(-s, j, k) for s, j, k in zip(heaps.score[i], heaps.id[i], heaps.key[i])] == best


def test_window_bounds():
    for score in list(range(-50, 130)) + [2 ** 61 + 7, -2 ** 61 - 3]:
        least, greatest = (int(x[0]) for x in hn.window_bounds(np.array([score]), (1, 2), (19, 20)))
        assert least == math.ceil(score / 2) if abs(score) < 1000 else least == -((-score) // 2)
        assert greatest == 19 * score // 20


def test_against_brute_force(spark):
    ship_package(spark)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 9, 6) / 4], int(rng.integers(0, 3))) for i in range(120)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert mined(df) == want


def test_many_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 9, 6) / 4], int(rng.integers(0, 3))) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held = hn.integer_rows(df, df["label"], 256, "vec_id", "embedding")
    one = hn._best(hn._grid(held, held, 1, 1, hn._cell_positives(5), hn.POSITIVE), ["a_id", "a_key"], 5)
    many = hn._best(hn._grid(held, held, 4, 7, hn._cell_positives(5), hn.POSITIVE), ["a_id", "a_key"], 5)
    rows = lambda d: sorted(tuple(r) for r in d.select("a_id", "id", "score", "rank").collect())
    assert rows(one) == rows(many) and len(rows(one)) == 450


def test_edges(spark):
    ship_package(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (5, [1.0, 0.5], 1), (6, [0.75, 0.75], 2), (7, [0.75, 0.75], 2), (6, [0.75, 0.75], 2),
            (8, [0.5], 2), (9, [], 2), (None, [1.0, 1.0], 1), (11, None, 1), (12, [1.0, None], 2), (13, [nan, 1.0], 2), (14, [inf, 1.0], 2),
            (15, [1.0, 1.0], None), (16, [3e38, 1.0], 2), (20, [-1.0, -1.0], 3), (25, [-1.0, -1.0], 3), (30, [0.0, 0.0], 4), (31, [0.0, 0.0], 4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "key", "v", "r", "c", "score", "rank", "a_id", "n")})
    want = brute(rows, lambda i: i % 5 == 0)
    got = mined(df)
    assert got == want and {x[0] for x in got} >= {5, 30}
    assert mined(df.limit(0)) == []


def test_copies_of_a_row_over_all_cells(spark):
    """A third of all rows are one row, and one label holds nearly all."""
    ship_package(spark)
    rows = [(10, [1.0, 0.5], 1)] * 200 + [(i, [i / 400, 0.5], 1) for i in range(11, 400)] + [(1000, [0.5, 0.5], 2), (1001, [0.4, 0.5], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = [x for x in mined(df) if x[0] == 10]
    assert got == [x for x in brute(rows, lambda i: i == 10)]
