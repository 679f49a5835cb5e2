"""Every operator over the awkward cases: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from quire.llm.decontamination import contaminated_pairs, drop_contaminated
from quire.llm.embedding_dedup import near_vectors
from quire.llm.license_scan import scan_licenses
from quire.llm.line_dedup import dedup_lines
from quire.llm.lm_scoring import fit_language_model, score_texts
from quire.llm.mixing import mix, mixed_documents
from quire.llm.sharding import assign_shards
from quire.llm.simhash_dedup import drop_near_copies, simhash_groups
from quire.llm.toxicity import ToxicityModel, fit_toxicity, reject_toxic, score_toxicity
from quire.llm.warc import read_archives, resolved_pages, write_archives
from quire.session import shared_dir, ship_package

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
    (2, None, "en", None), (None, "alpha beta gamma delta epsilon zeta", None, "b"), (None, None, None, None),
    (3, "", "de", ""), (4, " \t\n ", "de", "a"), (5, LONG, "en", "a"), (6, "one", "en", "b"), (7, "é ü\U0001F600 ß\nline\nline", "fr", "b"),
    (8, "Alpha BETA gamma delta epsilon zeta", "en", "c"),
]
CLASH = ("id", "fp", "__id", "n", "key", "node", "size", "shard", "token", "row", "block", "score", "place", "draws", "path_", "th", "v")


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_simhash(docs, empty):
    got = simhash_groups(docs).collect()
    assert len(got) == len(ROWS)
    comp = {(r.id, r.fp): r.component for r in got}
    assert {c for (i, f), c in comp.items() if f == 0} == {2}
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 5, 6, 7]
    assert simhash_groups(empty).count() == 0 and drop_near_copies(empty).count() == 0


def test_simhash_group_of_null_ids_keeps_one(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "A b c d"), (None, "q r s t u"), (1, "x y z")], "doc_id long, text string")
    rows = drop_near_copies(df).collect()
    assert len(rows) == 3 and sorted(r.text.lower() for r in rows) == ["a b c d", "q r s t u", "x y z"]


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.id in (2, 3, 4)}) == 1
    assert reject_toxic(docs, ToxicityModel()).count() == len(ROWS)
    assert score_toxicity(empty, ToxicityModel()).count() == 0
    assert fit_toxicity(empty, labels.limit(0)).words == {}


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (None, "one")],
                                  "item_id long, text string")
    got = contaminated_pairs(docs, bench).collect()
    assert sorted((str(r.id), str(r.item)) for r in got) == sorted([("1", "1"), ("1", "1"), ("None", "1"), ("8", "1"), ("6", "None")])
    assert drop_contaminated(docs, bench).count() == len(ROWS) - 5
    assert contaminated_pairs(empty, bench).count() == 0 and contaminated_pairs(docs, bench.limit(0)).count() == 0
    # many small blocks give the same pairs
    assert sorted(map(str, contaminated_pairs(docs, bench, block_words=8).collect())) == sorted(map(str, got))


def test_mixing(docs, empty):
    got = mix(docs).collect()
    assert len(got) == len(ROWS)
    assert all(len(r.draws) <= 2 for r in got)
    assert all(r.size == 0 for r in got if r.id in (2, 3, 4))
    again = mixed_documents(docs)
    assert again.columns == docs.columns
    assert again.count() == sum(len(r.draws) for r in got)
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_mixing_draws_some_of_equal_rows(spark):
    rows = [(7, "w " * 10, "b")] * 40 + [(1, "w " * 400, "a")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = sum(r.size * len(r.draws) for r in got if r.source == "b")
    target = next(r.target for r in got if r.source == "b")
    assert abs(taken - target) <= 10


def test_sharding(docs, empty):
    got = assign_shards(docs, 5).collect()
    assert len(got) == len(ROWS)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r.size, r.text_crc32) for r in got if r.id == 2} == {(16, 0)}
    assert assign_shards(empty, 5).count() == 0


def test_lm(docs, empty):
    model, counts = fit_language_model(docs.select("text"))
    got = score_texts(docs, model, counts).collect()
    assert len(got) == len(ROWS)
    assert {r.n_tokens for r in got if r.id in (2, 3, 4)} == {1}
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in got)
    assert score_texts(empty, model, counts).count() == 0
    blank, none = fit_language_model(empty.select("text"))
    assert all(r.n_known == 0 for r in score_texts(docs, blank, none).collect())


def test_lines(docs, empty):
    got = dedup_lines(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.id: r for r in got}
    assert by[7].removed == [2] and by[7].text == "é ü\U0001F600 ß\nline"
    assert by[2].text is None and by[2].n_lines == 0 and by[4].n_lines == 0
    assert by[8].removed == [0] and by[8].text == ""
    assert by[1].removed == [0] and by[None].n_lines in (0, 1)  # the null id comes first
    assert dedup_lines(empty).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (None, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-200, 0.0]), (12, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("id", "v", "n", "node", "block")})
    got = sorted(((r.id, r.n_links, r.component) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 4, 1), (2, 4, 1), (2, 4, 1), (11, 4, 1), (12, 4, 1), (None, 0, None), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6),
                          (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10)], key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_warc(spark):
    big, other = "x" * 1500, "é" * 40_000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, None, big), (3, "", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
            (7, "u\r\nX: y", other), (None, "u", other), (8, "u", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("digest", "payload", "top")})
    path = shared_dir(spark, "warc-test")
    write_archives(pages, path, records_per_file=3)
    records = read_archives(spark, path).cache()
    assert sorted(bytes(r.payload).decode() for r in records.where("type = 'response'").collect()) == sorted(
        [big, "small", "small", "", "", other, "WARC/1.1\r\n\r\n0\r\n\r\n"])
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.error) for r in resolved_pages(records).collect()), key=str)
    assert got == sorted([(1, 1500, "revisit", 2, None), (2, 1500, "response", None, None), (2, 1500, "revisit", 2, None),
                          (3, 5, "response", None, None), (4, 5, "response", None, None), (5, 0, "response", None, None),
                          (6, 0, "response", None, None), (7, 80_000, "response", None, None), (None, 80_000, "revisit", 7, None),
                          (8, 17, "response", None, None)], key=str)
    path = shared_dir(spark, "warc-empty")
    write_archives(pages.limit(0), path)
    assert read_archives(spark, path).count() == 0


def test_licenses(spark, docs):
    mit = "Released under the MIT License."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/file", "prose only"), (3, "a/b/LICENSE.txt", "All rights reserved."), (4, "a/x", f"One.\n{mit} More."),
            (5, None, "prose"), (6, "file", "prose"), (7, "ab/file", None), (8, "a/b/c/file", "prose only"), (9, "", ""), (None, "a/z", "prose")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit(0) for c in ("id", "dir", "own", "declared")})
    got = {(r.id, r.license, r.how, r.licence_file) for r in scan_licenses(files).collect()}
    assert got == {(1, "mit", "declared", None), (2, "proprietary", "inherited", "a/b/LICENSE.txt"), (3, "proprietary", "declared", None),
                   (4, "mit", "declared", None), (5, None, "none", None), (6, None, "none", None), (7, None, "none", None),
                   (8, "proprietary", "inherited", "a/b/LICENSE.txt"), (9, None, "none", None), (None, "mit", "inherited", "a/LICENSE")}
    assert scan_licenses(files.limit(0)).count() == 0
