"""Gradient steps and scores of the language model against the plain formulas."""

import time

import numpy as np

from quire.llm import lm_scoring as M


def plain_log_softmax(z):
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def plain_step(weights, feats, grad, scale):
    for f in feats:
        order = np.argsort(f, kind="stable")
        rows, start = np.unique(f[order], return_index=True)
        g = np.add.reduceat(grad[order], start, axis=0)
        scale[rows] += (g * g).mean(axis=1)
        weights[rows] -= (M.RATE / np.sqrt(scale[rows]))[:, None] * g


def problem(n, seed=1):
    rng = np.random.default_rng(seed)
    feats = [rng.integers(0, M.BUCKETS, n), np.minimum(rng.zipf(1.3, n), M.BUCKETS - 1), np.full(n, M.BUCKETS - 1)]
    return feats, rng.standard_normal((n, M.WIDTH)).astype(np.float32)


def table():
    return np.zeros((M.BUCKETS, M.WIDTH), np.float32), np.ones(M.BUCKETS, np.float32)


def test_steps_equal_the_plain_sums():
    for n in (1, 2, 700, M.BATCH):
        feats, grad = problem(n)
        (w, s), (v, r) = table(), table()
        for _ in range(2):
            M._step(w, feats, grad, s)
            plain_step(v, feats, grad, r)
        assert np.allclose(w, v, atol=1e-5) and np.allclose(s, r, rtol=1e-4)


def test_steps_take_less_time_than_the_plain_sums():
    feats, grad = problem(M.BATCH)

    def best(step):
        w, s = table()
        seconds = []
        for _ in range(15):
            t = time.perf_counter()
            step(w, feats[:1], grad, s)
            seconds.append(time.perf_counter() - t)
        return min(seconds)

    assert best(M._step) < 0.75 * best(plain_step)


def test_hash_is_the_remainder():
    v = np.array([-2, -1, 0, 5, 1 << 40])
    h = np.full(len(v), 3, np.uint64)
    h = (h ^ (v.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    assert M._hash(3, v).tolist() == (h % np.uint64(M.BUCKETS)).tolist() and M.BUCKETS <= 1 << 16


def test_chosen_and_gradient_equal_the_softmax():
    rng = np.random.default_rng(2)
    z = (rng.standard_normal((50, M.WIDTH)) * 5).astype(np.float32)
    z[:, 3] = -1e9  # an empty slot
    chosen = rng.integers(4, M.WIDTH, 50)
    logp = plain_log_softmax(z)
    assert M._log_chosen(z.copy(), chosen).tolist() == logp[np.arange(50), chosen].tolist()
    want = np.exp(logp)
    want[np.arange(50), chosen] -= 1
    assert np.allclose(M._gradient(z.copy(), chosen), want, atol=1e-6)
