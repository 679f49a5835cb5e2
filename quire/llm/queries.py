"""Registered queries of the operators in this subpackage.

Each ``opN_<name>`` applies one operator with its production parameters to
the whole table it is meant for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.decontamination import contaminated_pairs
from quire.llm.embedding_dedup import near_vectors
from quire.llm import collocations, hard_negatives, license_scan, sharding, url_filter
from quire.llm.line_dedup import dedup_lines
from quire.llm.lm_scoring import fit_language_model, score_texts
from quire.llm.mixing import mix
from quire.llm.simhash_dedup import simhash_groups
from quire.llm.toxicity import fit_toxicity, score_toxicity
from quire.llm.url_filter import judge_urls, rule_table
from quire.llm.warc import read_archives, resolved_pages, write_archives
from quire.session import shared_dir


SHARDS = 40


def op1_mixing(spark, sf_dir):
    """Every document with the words that the mixture takes of it."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))


# A tree of files out of documents: documents lie in the folder of their
# source and language or, two of three, one level below; every fifth document
# that says "licensed", "released" or "reserved" is its folder's licence file.
LICENSE_TREE = """
SELECT doc_id, concat(source, '/', lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('/', doc_id % 97) END, '/',
       CASE WHEN doc_id % 5 = 0 AND regexp_like(text, '[Ll]icensed|[Rr]eleased|reserved') THEN 'LICENSE' ELSE 'file' END, '.', doc_id) AS path, text
FROM documents
"""


def op2_license_scan(spark, sf_dir):
    """Every document with the license it declares or inherits."""
    docs = table(spark, sf_dir, "documents")
    files = docs.selectExpr("doc_id", LICENSE_TREE.split("doc_id, ", 1)[1].split(" AS path")[0] + " AS path", "text")
    return license_scan.scan_licenses(files).withColumnRenamed("id", "doc_id")


def op3_embedding_near_dedup(spark, sf_dir):
    """Every vector with its links at cosine 0.9 and its component."""
    near = near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return near.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                       F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op4_lm_scoring(spark, sf_dir):
    """Every document's log10 probability; learned outside of fold 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(fold(c) == 1, F.lit(False))
    model, counts = fit_language_model(docs.where(~held_out(docs["doc_id"])).select("text"))
    scored = score_texts(docs, model, counts)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_sharding(spark, sf_dir):
    """Every document with its shard and slot, and its shard if one is added."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_decontamination(spark, sf_dir):
    """Every document and benchmark item whose tiles cover 80 % of the item."""
    pairs = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "item_words", "matched_words",
                        (F.col("matched_words") / F.col("item_words")).alias("coverage"), F.size("tiles").alias("n_tiles"))


def fold(ids):
    """0 to 4: CRC-32 of the id as text, mod 5; null for a null id."""
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(5))


def training_labels(labels):
    """Labels outside of the held-out fold 0."""
    return labels.where(fold(labels["doc_id"]) != 0)


def op5_toxicity(spark, sf_dir):
    """Every document with its toxicity; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("clauses").alias("n_clauses"))


def op9_simhash_near_dedup(spark, sf_dir):
    """Every document with its fingerprint and the smallest doc_id reachable
    over links of at most two bits."""
    groups = simhash_groups(table(spark, sf_dir, "documents"), width=3, max_bits=2)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


def op8_warc(spark, sf_dir):
    """Every page as it comes back from the archives it was written to."""
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved_pages(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark, sf_dir):
    """Every document with the lines that earlier lines make redundant."""
    return dedup_lines(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_lines", "removed", "n_links")


# rules of op11: (host, path)
URL_ALLOW = [("org", "/"), ("com", "/fr/")]
URL_BLOCK = [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]


def op11_url_filter(spark, sf_dir):
    """Every page with the verdict on its url and the rule behind it."""
    judged = judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_ALLOW, URL_BLOCK))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every vector whose id is divisible by 50; every
    seventh vector's label is moved on first."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(vectors["vec_id"] % 7 == 0, (vectors["label"] + 1) % 10).otherwise(vectors["label"])
    return hard_negatives.hard_negatives(vectors, F.col("id") % 50 == 0, label)


def op13_collocations(spark, sf_dir):
    """The first 2,000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), min_count=30, top=2000)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op13_collocations": collocations.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op11_url_filter": url_filter.oracle_sql(URL_ALLOW, URL_BLOCK),
    "op6_sharding": sharding.oracle_sql("SELECT doc_id, text FROM documents", SHARDS),
    "op2_license_scan": license_scan.oracle_sql(LICENSE_TREE.replace("regexp_like", "regexp_matches")),
}
