"""Operators against brute force on small fixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm.common import connected_components
from quire.llm.decontamination import greedy_tiles
from quire.llm.embedding_dedup import encode, linked_pairs, near_vectors, rotation
from quire.llm.line_dedup import dedup_lines
from quire.llm.lm_scoring import END, WIDTH, fit_language_model, natural_scores, score_texts, tokenize
from quire.llm.mixing import mix, split_quotas, target_words
from quire.llm.sharding import jump_shard, stable_key
from quire.llm.simhash_dedup import fingerprint, linked_fingerprints, shingle_hashes
from quire.llm.toxicity import GRAMMAR, ToxicityModel
from quire.llm.warc import chunked, dechunk, page_records, parse_records
from quire.session import ship_package


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == roots({x for e in real for x in e}, real)


def test_fingerprint_bits():
    import xxhash
    text = "The Cat sat on the mat the cat sat ON the mat"
    ws = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 3]).encode(), 42) for i in range(len(ws) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert fingerprint(shingle_hashes(text, 3)) == want
    many = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert fingerprint(many) == sum(1 << b for b in range(64) if 2 * int((many >> np.uint64(b) & np.uint64(1)).sum()) > 1000)


@pytest.mark.parametrize("bucket_rows", [32_768, 3])
@pytest.mark.parametrize("bits", [0, 2, 3])
def test_simhash_links_give_all_components(spark, bits, bucket_rows):
    ship_package(spark)
    rng = random.Random(bits)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [(r.a, r.b) for r in linked_fingerprints(df, bits, bucket_rows).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in got)
    want = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits]
    assert roots(signed, got) == roots(signed, want)


def test_binary_codes_lose_no_link():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 48))
    x[300:] = x[:300] + rng.standard_normal((300, 48)) * rng.uniform(0.1, 0.9, (300, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rot = rotation(48)
    assert np.allclose(rot @ rot.T, np.eye(48))
    codes, factors = encode(x, rot)
    got = {(i, j) for a, b in linked_pairs(x, codes, factors, x, rot, 0.9, True, rows=128) for i, j in zip(a.tolist(), b.tolist())}
    s = x @ x.T
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)))} and len(got) > 50


def test_near_vectors_over_many_blocks(spark):
    ship_package(spark)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 16))
    x[60:] = x[:60] + rng.standard_normal((60, 16)) * 0.2
    x[100] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in near_vectors(df, block_rows=25).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.9
    root = roots(range(120), [(i, j) for i, j in zip(*np.nonzero(np.triu(s, 1)))])
    assert got == {i: (int(s[i].sum()) - 1, root[i]) for i in range(120)}


def brute_tiles(doc, item, width):
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while (d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n]
                       and d + n not in used_d and i + n not in used_i):
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < width:
            return tiles
        tiles.append(best)
        used_d |= set(range(d, d + n))
        used_i |= set(range(i, i + n))


def test_greedy_tiles_equal_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 25))]
        doc = [rng.randrange(0, 5) for _ in range(10)]
        for _ in range(4):
            a = rng.randrange(len(item))
            doc += item[a:a + rng.randrange(2, 12)] + [0] * rng.randrange(2)
        got = greedy_tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert sorted(t[0] for t in got) == sorted(t[0] for t in brute_tiles(doc, item, 3))
        for n, d, i in got:
            assert doc[d:d + n] == item[i:i + n]


def test_jump_walk_equals_the_published_loop(spark):
    def published(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b
    df = spark.range(300)
    for n in (1, 7, 40, 1000):
        for r in df.select("id", stable_key(df["id"]).alias("k"), jump_shard(stable_key(df["id"]), n).alias("s")).collect():
            assert (r.s.shard, r.s.grown_shard) == (published(int(r.k), n), published(int(r.k), n + 1))


def test_mixing_targets_and_taken(spark):
    sizes = [("a", 100), ("b", 1000), (None, 500), ("B", 10), ("c", 0)]
    got = target_words(sizes)
    assert sum(got.values()) == pytest.approx(1.5 * 1610)
    assert got["B"] == 20 and got["a"] == 200 and got["c"] == 0 and all(got[s] <= 2 * n for s, n in sizes)
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1))), rng.choice(["x", "y", "y", "y", "z", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (mix(df, block_docs=32, shard_words=500).collect() for _ in range(2))
    taken, target, widest = defaultdict(int), {}, 0
    for r in first:
        taken[r.source] += r.size * len(r.draws)
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 3
    assert {r.id: r.draws for r in first} == {r.id: r.draws for r in again}


def test_split_quotas_are_exact():
    q = np.array([1000, 17, 0, 333])
    shards = split_quotas(q, 13)
    assert (shards.sum(axis=0) == q).all() and (shards >= 0).all()
    totals = shards.sum(axis=1)
    assert totals.max() - totals.min() <= 4


def test_language_model_sums_to_one_and_learns(spark):
    ship_package(spark)
    rng = random.Random(2)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    texts = [" ".join(rng.choice(side) for _ in range(60)) + f" once{k}" for k in range(200) for side in (left, right)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model, counts = fit_language_model(train)
    c = Counter(w for t in texts for w in tokenize(t))
    assert {bytes(r.token): r.c for r in counts.collect()} == dict(c) and model.total == sum(c.values()) and model.distinct == len(c)
    # every continuation of a context, unknown words as one outcome
    start = tokenize("l1 l2 l3")[:-1]
    outcomes = [[*start, w] for w in c] + [[*start, b"unheard"]]
    ids, owner = model.encode(outcomes)
    logp = natural_scores(model, ids, owner)
    total, each = 0.0, len(start) + 1
    for k, ws in enumerate(outcomes):
        p = np.exp(logp[(k + 1) * each - 1])
        n, i = c.get(ws[-1], 0), ids[(k + 1) * each - 1]
        if i >= (WIDTH - 2) * WIDTH:
            p *= n / model.middle_total
        if i < 0:
            p *= (n - model.discount) / model.rare_total if n else model.discount * model.rare_distinct / model.rare_total
        total += p
    assert total == pytest.approx(1, abs=1e-4)
    held = [" ".join(rng.choice(side) for _ in range(60)) + " new" for side in (left, right) * 10]
    rows = score_texts(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), model, counts).collect()
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = tokenize(held[r.id])
        assert ws[-1] == END and r.n_tokens == len(ws) == 62 and r.n_known == 61
        assert r.base_score == pytest.approx(sum(np.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score > r.base_score


def test_grammar_weighs_clauses():
    m = ToxicityModel({"foo": 3.0})
    score = m.clause_score
    assert score("he is a foo") == 3.0
    assert score("you are a foo") > score("he is a foo") > score("he is not a foo") > 0
    assert score("they said he is a foo") < score("he is a foo")
    assert score("i will kill you") > score("mosquitoes kill people")
    assert GRAMMAR.states <= 32
    assert m.score("a quiet text") == m.score(None) == m.score("") < m.score("you foo. you idiot! foo foo")
    assert [text for text in ("foo here", "food here") if list(m.clauses(text))] == ["foo here"]


def test_chunked_round_trip_and_segments():
    rng = random.Random(4)
    for n in (0, 1, 4096, 10_000):
        data = rng.randbytes(n)
        assert dechunk(chunked(data, 1000)) == data
        records = list(page_records(5, "http://x", data, "d", "response", "rid", None, 700))
        parsed = list(parse_records(b"".join(r + b"\r\n\r\n" for r in records)))
        body = b"".join(b for _, b in parsed)
        assert dechunk(body.partition(b"\r\n\r\n")[2]) == data
        assert len(parsed) == 1 or parsed[-1][0]["warc-segment-total-length"] == str(len(body))
    with pytest.raises(ValueError):
        dechunk(b"5\r\nabc")


def test_line_dedup_equals_all_pairs(spark):
    ship_package(spark)
    rng = random.Random(8)
    vocab = [f"t{i}" for i in range(60)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(6):
            base = [vocab[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randrange(0, 14))]
            lines.append(" ".join(base))
            if docs and rng.random() < 0.5:
                old = rng.choice(rng.choice(docs)[1].split("\n")).split()
                if old:
                    old[rng.randrange(len(old))] = rng.choice(vocab)
                lines.append(" ".join(old))
        docs.append((d, "\n".join(lines)))
    flat = [(d, i, frozenset(x.split())) for d, t in docs for i, x in enumerate(t.split("\n")) if x.split()]
    like = lambda a, b: len(a & b) / len(a | b) >= 0.8 - 1e-12
    removed, links, lines = defaultdict(list), Counter(), Counter()
    for d, i, w in flat:
        lines[d] += 1
        if any((e, j) < (d, i) and like(w, v) for e, j, v in flat):
            removed[d].append(i)
        links[d] += sum(v != w and like(w, v) for _, _, v in flat)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in dedup_lines(df).collect():
        assert (r.n_lines, r.removed, r.n_links) == (lines[r.id], removed[r.id], links[r.id])
        text = dict(docs)[r.id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(text) if k not in removed[r.id])
