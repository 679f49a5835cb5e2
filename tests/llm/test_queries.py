"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from quire.llm import queries
from quire.llm.decontamination import BenchmarkIndex
from quire.llm.simhash_dedup import fingerprint, shingle_hashes
from quire.llm.toxicity import fit_toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def stable(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)


def groups(fps, bits=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def first_of_group(rows):
    """doc_id -> smallest doc_id of its group, by comparing all pairs."""
    fps = {i: fingerprint(shingle_hashes(t, 3)) for i, t in rows}
    root = groups(set(fps.values()))
    first = defaultdict(lambda: math.inf)
    for i, f in fps.items():
        first[root[f]] = min(first[root[f]], i)
    return fps, {i: first[root[f]] for i, f in fps.items()}


def test_all_are_registered():
    names = [q.split("_")[0] for q in E.queries()]
    assert [f"op{n}" for n in range(1, 14) if f"op{n}" not in names] == [] and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ('documents', 'pages', 'embeddings'):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    flat = lambda rows, cols: sorted(str([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert flat([tuple(r) for r in df.collect()], df.columns) == flat(rel.fetchall(), rel.columns)


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps, first = first_of_group(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", first[i]) for i, _ in rows}


def test_vector_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    got = {r.vec_id: r.n_links for r in queries.op3_embedding_near_dedup(spark, SF).collect()}
    assert got == {r.vec_id: int(near[i].sum()) - 1 for i, r in enumerate(rows)}


def test_mixing_query(spark):
    rows = queries.op1_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        assert r.size == len((docs[r.doc_id].text or "").split()) and 0 <= r.taken <= 2 * r.size
        taken[docs[r.doc_id].source] += r.taken
        target[docs[r.doc_id].source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert all(abs(taken[s] - t) <= 0.1 * t + 5 for s, t in target.items())


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    same = defaultdict(list)
    for p in pages:
        same[(p.html or "").encode()].append(p.page_id)
    want = {}
    for data, ids in same.items():
        for i in ids:
            again = len(data) >= 1000 and i != max(ids)
            want[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(ids) if again else None)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op8_warc(spark, SF).collect()}
    assert got == want


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = fit_toxicity(docs, queries.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    bench = BenchmarkIndex([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 5)
    want = sorted(i for i, t in texts.items() if model.score(t) < 0.5)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":
            _, first = first_of_group([(i, texts[i]) for i in want])
            want = sorted(i for i in want if first[i] == i)
        if name == "decontamination":
            want = sorted(i for i in want if next(bench.match(texts[i], 0.8), None) is None)
        got = docs.collect()
        assert sorted(r.doc_id for r in got) == want and all(r.text == texts[r.doc_id] for r in got)
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= set(want) and max(copies.values()) <= 2
    words = lambda i: len((texts[i] or "").split())
    assert sum(words(i) * n for i, n in copies.items()) == pytest.approx(1.5 * sum(map(words, want)), rel=0.02)
    placed = corpus_pipeline.sharding(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in placed) == copies
    slots = defaultdict(list)
    for r in placed:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard) == (len(data) + 16, zlib.crc32(data), jump(stable(r.doc_id), 40))
        assert r.grown_shard == jump(stable(r.doc_id), 41)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
