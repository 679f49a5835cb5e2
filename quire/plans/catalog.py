"""Registered queries over the driver tables, each with its DuckDB oracle.

Mapping of the driver tables onto the book model:
``documents``: language = ``lang``, book = ``doc_id``, provider = ``source``;
``conversations``: book = ``conv_id``, page = ``turn``; ``pages.html``: OCR
markup; ``labels``: books that already have outputs; ``embeddings``: token
vectors, book = ``label``, candidate side = even ``vec_id``, reference = odd.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import fixed
from quire import oracle as O
from quire.functions import prompts as P
from quire.functions.text import replace_divs as _replace_divs
from quire.operators.chunks import plan_splits as _plan_splits, target_size
from quire.operators.longchunks import plan_line_splits, text_lines
from quire.operators.repair import repair_blocks as _repair
from quire.functions.text import clean_summary as _clean_summary
from quire.operators import evaluate as EV
from quire.operators import gating as G
from quire.operators import generate as GN
from quire.operators import tasks as TK
from quire.plans.cleanup import clean_pages, merge_pages as _merge_pages
from quire.plans.compress import adaptive_compress, compress_round as _compress_round, last_abstracts
from quire.plans.pagewise import clean_pages_by_page
from quire.plans import compress as CP
from quire.plans import derived, reports as RP
from quire.session import ship_package, shared_dir, table_path, text_tasks
from quire.sources.corpus import fill_down

MAX_CHUNK = 2000
# context window (characters) for the adaptive compression query
WINDOW = 2000
RESUME_TEMPLATE = P.load_template("resume", 1)
RESUME_KEYS = P.PROMPT_KEYS["resume"]
RESUME_OVERHEAD = P.overhead(RESUME_TEMPLATE, RESUME_KEYS)
ADAPTIVE_MAX_CHUNK = WINDOW - RESUME_OVERHEAD


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


# --- T3 ---------------------------------------------------------------------

def repair_blocks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = _repair(docs).select("doc_id", "lang", "content")
    return out.withColumn("n_chars", F.length("content").cast("bigint"))


SQL_REPAIR_BLOCKS = f"""
WITH r AS ({O.repair_sql('documents', 'doc_id', 'text')})
SELECT d.doc_id, d.lang, r.content, length(r.content)::BIGINT AS n_chars
FROM documents d JOIN r USING (doc_id)
"""


# --- C1-C3 ------------------------------------------------------------------

def plan_splits(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _plan_splits(docs, MAX_CHUNK, keep_chunk=False).select(
        "doc_id", "split_index", "initial_pos", "end_pos")


SQL_PLAN_SPLITS = O.splits_sql("documents", "doc_id", "text", str(MAX_CHUNK))


def chunk_targets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    s = _plan_splits(docs, MAX_CHUNK)
    return s.select("doc_id", "split_index", "chunk",
                    F.length("chunk").cast("bigint").alias("chunk_chars"),
                    target_size("chunk").alias("target_size"))


def plan_splits_lines(spark, sf_dir):
    """The same plan from rows of lines: no text in one row."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return plan_line_splits(text_lines(docs, ["doc_id"]), ["doc_id"], MAX_CHUNK)


SQL_CHUNK_TARGETS = f"""
WITH s AS ({O.splits_sql('documents', 'doc_id', 'text', str(MAX_CHUNK))})
SELECT s.doc_id, s.split_index, substr(d.text, s.initial_pos + 1, s.end_pos - s.initial_pos) AS chunk,
       (s.end_pos - s.initial_pos)::BIGINT AS chunk_chars, ((s.end_pos - s.initial_pos) // 10)::BIGINT AS target_size
FROM s JOIN documents d USING (doc_id)
"""


def _contents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return _repair(docs).select("doc_id", "lang", "content")


# --- G4 + I3/I4: one compression round -------------------------------------

def compress_round(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = _compress_round(_contents(spark, sf_dir), ["doc_id"], MAX_CHUNK, sized=(docs, "text"))
    return out.select("doc_id", "split_index", "target_size", "abstract", "status")


def _round_sql(src: str, max_chunk: int) -> str:
    """One native round over ``src(doc_id, content)`` in DuckDB SQL."""
    return f"""
    WITH c AS (
      SELECT s.doc_id, s.split_index,
             substr(x.content, s.initial_pos + 1, s.end_pos - s.initial_pos) AS chunk,
             ((s.end_pos - s.initial_pos) // {fixed.TARGET_DIVISOR})::BIGINT AS target_size
      FROM ({O.splits_sql(src, 'doc_id', 'content', str(max_chunk))}) s JOIN {src} x USING (doc_id))
    SELECT c.doc_id, c.split_index, c.target_size, a.abstract,
           CASE WHEN {O.strip('a.abstract')} <> '' THEN 'ok' ELSE 'failed' END AS status
    FROM c JOIN ({O.extractive_sql('c', 'doc_id, split_index', 'chunk', 'target_size')}) a
    USING (doc_id, split_index)
    """


SQL_COMPRESS_ROUND = f"""
WITH r AS ({O.repair_sql('documents', 'doc_id', 'text')}),
a AS ({_round_sql('r', MAX_CHUNK)})
SELECT * FROM a
"""


# --- I1/I5/I6: adaptive compression to the end --------------------------------

def adaptive_compress_all(spark, sf_dir):
    out = adaptive_compress(spark, _contents(spark, sf_dir), ["doc_id"], WINDOW, ADAPTIVE_MAX_CHUNK,
                            workdir=shared_dir(spark, "adaptive"))
    return out.select("doc_id", "rounds", "status", "abstract_contents",
                      F.length("abstract_contents").cast("bigint").alias("n_chars"))


# rounds that the oracle unrolls; a book still open after them would show up
# as a row with status 'open', which the query never returns
ORACLE_ROUNDS = 4


def _joined_sql(rnd: str, prev: str) -> str:
    keep = f"{O.strip('abstract')} <> ''"
    return f"""
    SELECT p.doc_id,
           coalesce(j.joined, '') AS joined,
           CASE WHEN coalesce(j.n_ok, 0) = 0 THEN 'failed'
                WHEN length(j.joined) <= {WINDOW} THEN 'done'
                WHEN length(j.joined) >= length(p.content) THEN 'stalled'
                ELSE 'continue' END AS status
    FROM {prev} p LEFT JOIN (
      SELECT doc_id, string_agg(abstract, chr(10) || chr(10) ORDER BY split_index) FILTER (WHERE {keep}) AS joined,
             count(*) FILTER (WHERE {keep}) AS n_ok
      FROM {rnd} GROUP BY doc_id) j USING (doc_id)
    """


def _adaptive_sql() -> str:
    parts = [f"r1 AS ({O.repair_sql('documents', 'doc_id', 'text')})"]
    for k in range(1, ORACLE_ROUNDS + 1):
        parts += [f"a{k} AS ({_round_sql(f'r{k}', ADAPTIVE_MAX_CHUNK)})", f"st{k} AS ({_joined_sql(f'a{k}', f'r{k}')})",
                  f"r{k + 1} AS (SELECT doc_id, joined AS content FROM st{k} WHERE status = 'continue')"]
    outcomes = [f"SELECT doc_id, {k}::BIGINT AS rounds, status, joined AS abstract_contents, length(joined)::BIGINT AS n_chars "
                f"FROM st{k} WHERE status <> 'continue'" for k in range(1, ORACLE_ROUNDS + 1)]
    outcomes.append(f"SELECT doc_id, {ORACLE_ROUNDS}::BIGINT, 'open', content, length(content)::BIGINT FROM r{ORACLE_ROUNDS + 1}")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + " UNION ALL ".join(outcomes)


SQL_ADAPTIVE = _adaptive_sql()


def split_state(spark, sf_dir):
    """State of the compressed documents after every third was corrected."""
    workdir = shared_dir(spark, "split-state")
    books = _contents(spark, sf_dir).select("doc_id", "content")
    adaptive_compress(spark, books, ["doc_id"], WINDOW, ADAPTIVE_MAX_CHUNK, workdir=workdir, max_rounds=1)
    corrected = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("content"), F.lit("!"))).otherwise(F.col("content"))
    return CP.split_state(spark, books.withColumn("content", corrected), ["doc_id"], workdir, WINDOW, ADAPTIVE_MAX_CHUNK)


SQL_SPLIT_STATE = f"""
WITH r1 AS ({O.repair_sql('documents', 'doc_id', 'text')}),
a1 AS ({_round_sql('r1', ADAPTIVE_MAX_CHUNK)}),
n AS (SELECT doc_id, count(*) FILTER (WHERE status = 'ok') AS n FROM a1 GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed' WHEN coalesce(n, 0) > 0 THEN 'answered' ELSE 'stored' END AS state,
       (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE coalesce(n, 0) END)::BIGINT AS n_answers, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_old
FROM r1 LEFT JOIN n USING (doc_id)
"""


# --- S8 / T4: pages of a book -------------------------------------------------

def _conv_pages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("book"), F.col("turn").alias("page_id"), "text")


def merge_pages(spark, sf_dir):
    m = _merge_pages(_conv_pages(spark, sf_dir), ["book"])
    return m.select(F.col("book").alias("conv_id"), "content", "n_pages")


SQL_MERGE_PAGES = """
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS content, count(*)::BIGINT AS n_pages
FROM conversations WHERE text <> '' GROUP BY conv_id
"""


def cleanup_book(spark, sf_dir):
    out = clean_pages(_conv_pages(spark, sf_dir), ["book"])
    return out.select(F.col("book").alias("conv_id"), "content")


SQL_CLEANUP_BOOK = f"""
WITH m AS (SELECT conv_id, {O.divs_sql("string_agg(text, chr(10) || chr(10) ORDER BY turn, text)")} AS merged
           FROM conversations WHERE text <> '' GROUP BY conv_id),
r AS ({O.repair_sql('m', 'conv_id', 'merged')})
SELECT conv_id, {O.tables_sql('content')} AS content FROM r
"""


def cleanup_pages(spark, sf_dir):
    """The same texts page by page: no row holds a book."""
    out = clean_pages_by_page(_conv_pages(spark, sf_dir), ["book"])
    return out.select(F.col("book").alias("conv_id"), "page_id", "n_pages", "start_pos", "content")


# the repaired blocks of the merged book, given back to the pages they began on
SQL_CLEANUP_PAGES = f"""
WITH pg AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n,
                   count(*) OVER (PARTITION BY conv_id) AS m FROM conversations WHERE text <> ''),
cut AS (SELECT *, {O.divs_sql('text')} AS plain FROM pg),
ends AS (SELECT *, CASE WHEN n > 1 THEN ltrim(plain, chr(10)) ELSE plain END AS behind FROM cut),
trimmed AS (SELECT conv_id, turn, n, m, CASE WHEN n < m THEN rtrim(behind, chr(10)) ELSE behind END AS t FROM ends),
sized AS (SELECT *, len(string_split_regex(t, '\n+')) AS nb FROM trimmed WHERE t <> '' OR n = 1 OR n = m),
spans AS (SELECT *, sum(nb) OVER (PARTITION BY conv_id ORDER BY n) - nb AS lo FROM sized),
merged AS (SELECT conv_id, {O.divs_sql("string_agg(text, chr(10) || chr(10) ORDER BY n)")} AS merged FROM pg GROUP BY conv_id),
e AS ({O.repair_pieces_sql('merged', 'conv_id', 'merged')}),
pieces AS (SELECT s.conv_id, s.turn, s.n, {O.tables_sql("string_agg(e.piece, '' ORDER BY e.pos)")} AS content
           FROM spans s JOIN e ON e.k = s.conv_id AND e.pos >= s.lo AND e.pos < s.lo + s.nb GROUP BY s.conv_id, s.turn, s.n)
SELECT conv_id, turn AS page_id, 1::BIGINT AS n_pages,
       (sum(length(content)) OVER (PARTITION BY conv_id ORDER BY n) - length(content))::BIGINT AS start_pos, content FROM pieces
"""


# --- T1 -----------------------------------------------------------------------

def replace_divs(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", _replace_divs("html").alias("text"))


SQL_REPLACE_DIVS = f"SELECT page_id, {O.divs_sql('html')} AS text FROM pages"


# --- C4/C5 ----------------------------------------------------------------------

def render_prompt(spark, sf_dir):
    s = _plan_splits(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ADAPTIVE_MAX_CHUNK)
    values = {"TARGET_SIZE": target_size("chunk"), "TEXT": F.col("chunk"), "LANGUAGE": F.col("lang")}
    return s.select("doc_id", "split_index",
                    F.lit(RESUME_OVERHEAD).cast("bigint").alias("overhead"),
                    P.render(RESUME_TEMPLATE, RESUME_KEYS, values).alias("prompt"))


def _render_sql() -> str:
    t = O.sql_str(RESUME_TEMPLATE)
    keys = "[" + ", ".join(O.sql_str(k) for k in RESUME_KEYS) + "]"
    overhead = f"(length({t}) - list_sum(list_transform({keys}, lambda k: length(k) + 2)))"
    return f"""
    WITH s AS ({O.splits_sql('documents', 'doc_id', 'text', str(ADAPTIVE_MAX_CHUNK))}),
    c AS (SELECT s.doc_id, s.split_index, d.lang,
                 substr(d.text, s.initial_pos + 1, s.end_pos - s.initial_pos) AS chunk
          FROM s JOIN documents d USING (doc_id))
    SELECT doc_id, split_index, {overhead}::BIGINT AS overhead,
           replace(replace(replace({t}, '{{TARGET_SIZE}}', CAST(length(chunk) // 10 AS VARCHAR)),
                   '{{TEXT}}', chunk), '{{LANGUAGE}}', lang) AS prompt
    FROM c
    """


SQL_RENDER_PROMPT = _render_sql()


# --- E1 / E3-E5: conversations as reference (user) vs candidate (assistant) -------

def _conv_summaries(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    provider = F.when(F.col("role") == "user", F.lit(fixed.REFERENCE_PROVIDER)).otherwise(F.col("role"))
    pages = c.select("conv_id", provider.alias("provider"), F.col("turn").alias("page_id"), "text")
    return _merge_pages(pages, ["conv_id", "provider"]).withColumnRenamed("content", "summary")


def _pairs(spark, sf_dir):
    pairs, _ = EV.pair_with_reference(_conv_summaries(spark, sf_dir), ["conv_id"])
    return pairs


def pair_reference(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "provider", "candidate", "reference")


_SQL_PAIRS = f"""
WITH s AS (
  SELECT conv_id, CASE WHEN role = 'user' THEN '{fixed.REFERENCE_PROVIDER}' ELSE role END AS provider,
         {O.strip("string_agg(text, chr(10) || chr(10) ORDER BY turn, text)")} AS t
  FROM conversations WHERE text <> '' GROUP BY ALL)
SELECT c.conv_id, c.provider, c.t AS candidate, r.t AS reference
FROM s c JOIN s r ON c.conv_id = r.conv_id AND r.provider = '{fixed.REFERENCE_PROVIDER}'
WHERE c.provider <> '{fixed.REFERENCE_PROVIDER}' AND c.t <> '' AND r.t <> ''
"""
SQL_PAIR_REFERENCE = _SQL_PAIRS


def _rouge(n):
    def q(spark, sf_dir):
        # the pairs come out of a join on conv_id: already clustered by it
        return EV.rouge_n(_pairs(spark, sf_dir), ["conv_id", "provider"], n, prepartitioned=True)
    q.__name__ = f"rouge_{n}"
    return q


def _rouge_sql(n: int) -> str:
    def grams(tk):
        return f"list_transform(range(1, len({tk}) - {n} + 2), lambda i: array_to_string({tk}[i:i + {n - 1}], ' '))"
    return f"""
    WITH p AS ({_SQL_PAIRS}),
    t AS (SELECT conv_id, provider, {O.rouge_tokens('candidate')} AS ct, {O.rouge_tokens('reference')} AS rt FROM p),
    g AS (SELECT conv_id, provider, unnest({grams('ct')}) AS g, 1 AS c, 0 AS r FROM t
          UNION ALL
          SELECT conv_id, provider, unnest({grams('rt')}), 0, 1 FROM t),
    pg AS (SELECT conv_id, provider, g, sum(c) AS c, sum(r) AS r FROM g GROUP BY ALL),
    pp AS (SELECT conv_id, provider, sum(least(c, r)) AS o, sum(c) AS nc, sum(r) AS nr FROM pg GROUP BY ALL),
    x AS (SELECT p.conv_id, p.provider, coalesce(o, 0) AS o, coalesce(nc, 0) AS nc, coalesce(nr, 0) AS nr
          FROM p LEFT JOIN pp USING (conv_id, provider)),
    y AS (SELECT *, CASE WHEN nc > 0 THEN o / nc ELSE 0.0 END AS pr, CASE WHEN nr > 0 THEN o / nr ELSE 0.0 END AS rc FROM x)
    SELECT conv_id, provider, round(pr, 6) AS rouge{n}_p, round(rc, 6) AS rouge{n}_r,
           round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS rouge{n}_f
    FROM y
    """


def rouge_l(spark, sf_dir):
    return EV.rouge_l(_pairs(spark, sf_dir), ["conv_id", "provider"])


# Match points by a join, then patience piles in a list; tests/test_evaluate.py
# holds the operator against the quadratic recurrence.
SQL_ROUGE_L = f"""
WITH p AS ({_SQL_PAIRS}),
t AS (SELECT conv_id, provider, {O.rouge_tokens('candidate')} AS ct, {O.rouge_tokens('reference')} AS rt FROM p),
c AS (SELECT conv_id, provider, unnest(ct) AS tok, generate_subscripts(ct, 1) AS i FROM t),
r AS (SELECT conv_id, provider, unnest(rt) AS tok, generate_subscripts(rt, 1) AS j FROM t),
m AS (SELECT conv_id, provider, list([j] ORDER BY i, j DESC) AS js FROM c JOIN r USING (conv_id, provider, tok) GROUP BY ALL),
l AS (SELECT conv_id, provider, len(list_reduce(js, lambda piles, x:
        piles[1:list_position(list_sort(piles || x), x[1]) - 1] || x || piles[list_position(list_sort(piles || x), x[1]) + 1:], []::BIGINT[])) AS lcs FROM m),
x AS (SELECT t.conv_id, t.provider, coalesce(l.lcs, 0) AS o, len(ct) AS nc, len(rt) AS nr FROM t LEFT JOIN l USING (conv_id, provider)),
y AS (SELECT *, CASE WHEN nc > 0 THEN o / nc ELSE 0.0 END AS pr, CASE WHEN nr > 0 THEN o / nr ELSE 0.0 END AS rc FROM x)
SELECT conv_id, provider, round(pr, 6) AS "rougeL_p", round(rc, 6) AS "rougeL_r",
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS "rougeL_f"
FROM y
"""


def rouge_1_stemmed(spark, sf_dir):
    """E3 with the Porter stemmer on (rows-only check: no stemmer in the oracle engine)."""
    from quire.functions.stem import stemmed_rouge_tokens
    return EV.rouge_n(_pairs(spark, sf_dir), ["conv_id", "provider"], 1, tokens=stemmed_rouge_tokens)


# --- E6 ---------------------------------------------------------------------------

def embedding_match(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("side", (F.col("vec_id") % 2).cast("int"))
    return EV.embedding_match(e.withColumn("label", F.col("label").cast("bigint")), "label", "side").withColumnRenamed("book", "label")


SQL_EMBEDDING_MATCH = """
WITH v AS (SELECT label::BIGINT AS book, vec_id % 2 AS side, vec_id, embedding AS e,
                  sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
pr AS (SELECT c.book, c.vec_id AS cid, r.vec_id AS rid,
              list_sum(list_transform(range(1, len(c.e) + 1), lambda i: c.e[i]::DOUBLE * r.e[i]::DOUBLE)) / (c.n * r.n) AS cs
       FROM v c JOIN v r ON c.book = r.book AND c.side = 0 AND r.side = 1),
p AS (SELECT book, avg(m) AS p FROM (SELECT book, cid, max(cs) AS m FROM pr GROUP BY ALL) GROUP BY book),
r AS (SELECT book, avg(m) AS r FROM (SELECT book, rid, max(cs) AS m FROM pr GROUP BY ALL) GROUP BY book)
SELECT book AS label, round(p, 6) AS bert_precision, round(r, 6) AS bert_recall,
       round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS bert_f1
FROM p JOIN r USING (book)
"""


# --- E9 / E11: coherence per provider (documents: provider = source) ------------

def coherence(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("provider"), "doc_id", "text")
    flags = EV.sentence_flags(d, ["provider", "doc_id"], "text")
    return EV.coherence(flags, "provider", ["doc_id"])


SQL_COHERENCE = f"""
WITH s0 AS (SELECT source AS provider, doc_id, {O.sentences('text')} AS sl FROM documents),
s AS (SELECT provider, doc_id, unnest(sl) AS sentence, generate_subscripts(sl, 1) - 1 AS sentence_no FROM s0),
f AS (SELECT *, (sentence_no > min(sentence_no) OVER (PARTITION BY provider, doc_id, sentence))
                OR NOT regexp_matches(sentence, '[.!?…][{O.SENT_QUOTES}]?\\z') AS confusing FROM s),
b AS (SELECT provider, doc_id, avg(CASE WHEN confusing THEN 0.0 ELSE 1.0 END) AS score FROM f GROUP BY ALL)
SELECT provider, count(*)::BIGINT AS n_books, round(avg(score), 6) AS coherence FROM b GROUP BY provider
"""


def annotation_prompts(spark, sf_dir):
    """E9's prompts for every sentence of the assistants' texts: length and
    digest of the context that each is asked with."""
    s = _conv_summaries(spark, sf_dir).where(F.col("provider") != fixed.REFERENCE_PROVIDER)
    prompts = EV.annotation_prompts(s, ["conv_id", "provider"], template="{CONTEXT}\n\n{SENTENCE}")
    return prompts.select("conv_id", "provider", F.col("sentence_no").cast("bigint").alias("sentence_no"), "sentence",
                          F.length("prompt").cast("bigint").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


SQL_ANNOTATION_PROMPTS = f"""
WITH s AS (SELECT conv_id, role AS provider, {O.sentences("string_agg(text, chr(10) || chr(10) ORDER BY turn, text)")} AS sl
           FROM conversations WHERE text <> '' AND role <> 'user' GROUP BY conv_id, role),
x AS (SELECT conv_id, provider, sl, unnest(range(1, len(sl) + 1)) AS i FROM s),
p AS (SELECT conv_id, provider, i, sl[i] AS sentence, array_to_string(sl[1:i - 1], chr(10)) || chr(10) || chr(10) || sl[i] AS prompt FROM x)
SELECT conv_id, provider, (i - 1)::BIGINT AS sentence_no, sentence, length(prompt)::BIGINT AS prompt_chars, md5(prompt) AS prompt_md5 FROM p
"""


# --- E8 + T5 ------------------------------------------------------------------------

def collect_summaries(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("provider"), "lang", "doc_id", _clean_summary("text").alias("summary"))


def _clean_summary_sql(col: str) -> str:
    t = col
    for h in fixed.SUMMARY_HEADINGS:
        t = f"replace({t}, {O.sql_str(h)}, '')"
    a, b = (O.sql_str(m) for m in fixed.KEYWORD_MARKERS)
    k = f"(CASE WHEN strpos({t}, {a}) > 0 THEN strpos({t}, {a}) ELSE strpos({t}, {b}) END)"
    return O.strip(f"CASE WHEN {k} > 0 THEN substr({t}, 1, {k} - 1) ELSE {t} END")


SQL_COLLECT_SUMMARIES = f"SELECT source AS provider, lang, doc_id, {_clean_summary_sql('text')} AS summary FROM documents"


def _books_by_source(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("provider"), (F.col("doc_id") % 97).alias("book"), F.col("text").alias("summary"))


def missing_summaries(spark, sf_dir):
    s = _books_by_source(spark, sf_dir)
    return RP.missing_summaries(s, G.select_providers(s.where("provider is not null"), None), ["book"])


SQL_MISSING_SUMMARIES = """
WITH s AS (SELECT source AS provider, doc_id % 97 AS book, text FROM documents)
SELECT book, provider FROM (SELECT DISTINCT book FROM s) b CROSS JOIN (SELECT DISTINCT provider FROM s WHERE provider IS NOT NULL) p
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.book = b.book AND s.provider = p.provider AND s.text IS NOT NULL)
"""


# --- S5: fill-down over the documents, of which four in five lose their language -----------

def filled_languages(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise("").alias("lang"))
    return fill_down(d.withColumn("block", F.floor(F.col("doc_id") / 1000)), "lang", [], "block", ["doc_id"]).select("doc_id", "lang")


SQL_FILLED_LANGUAGES = """
SELECT doc_id, last_value(CASE WHEN doc_id % 5 = 0 AND trim(lang) <> '' THEN lang END IGNORE NULLS) OVER (ORDER BY doc_id) AS lang FROM documents
"""


# --- S7 -------------------------------------------------------------------------------

def providers_first_wins(spark, sf_dir):
    from quire.sources.summaries import discover_providers
    d = read(spark, sf_dir, "documents").select(
        F.col("lang").alias("language"), F.col("doc_id").alias("book"),
        F.col("source").alias("entry"), F.col("lang").alias("sub"))
    return discover_providers(d)


SQL_PROVIDERS_FIRST_WINS = """
SELECT source AS provider, first(source || '/' || lang ORDER BY lang, doc_id, source, lang) AS relpath
FROM documents GROUP BY source
"""


# --- G6 / G7 / G8 -------------------------------------------------------------------------

def book_keywords(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return TK.keywords(spark, d, "doc_id", "lang", "text")


def _values(rows, cols):
    body = ", ".join("(" + ", ".join(O.sql_str(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({', '.join(cols)}))"


_STOP_SQL = _values([(lang, w) for lang, ws in TK.STOP_WORDS.items() for w in ws], ["lang", "term"])

SQL_BOOK_KEYWORDS = f"""
WITH t AS (SELECT doc_id, lang, unnest({O.word_tokens('text')}) AS term FROM documents),
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM t
       WHERE length(term) >= {TK.MIN_KEYWORD_LEN} AND NOT regexp_matches(term, '^[0-9]+$')
         AND NOT EXISTS (SELECT 1 FROM {_STOP_SQL} sw WHERE sw.lang = t.lang AND sw.term = t.term)
       GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
s AS (SELECT tf.doc_id, tf.term, tf.tf * ln(n.n / df.df) AS score FROM tf JOIN df USING (lang, term) JOIN n USING (lang)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS rank FROM s)
SELECT doc_id, rank::BIGINT AS rank, term AS keyword, round(score, 6) AS score FROM r WHERE rank <= {TK.TOP_KEYWORDS}
"""


def book_categories(spark, sf_dir):
    """Learned from the labelled documents, proposed for all."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    field = F.when(F.col("toxic") == 1, "offensive").when(F.col("quality") == 1, "prose").otherwise("junk")
    tasks = text_tasks(d, "text")
    known = d.repartition(tasks, "doc_id").join(labels.select("doc_id", field.alias("class")).repartition(tasks, "doc_id"), "doc_id")
    return TK.categories(d, "doc_id", "text", TK.train_categories(known, "doc_id", "text", "class"))


SQL_BOOK_CATEGORIES = f"""
WITH known AS (SELECT doc_id, text, CASE WHEN toxic = 1 THEN 'offensive' WHEN quality = 1 THEN 'prose' ELSE 'junk' END AS category
               FROM documents JOIN labels USING (doc_id)),
w AS (SELECT category, unnest({O.word_tokens('text')}) AS term FROM known),
terms AS (SELECT term, category, count(*) AS n FROM w GROUP BY ALL),
classes AS (SELECT category, (SELECT count(*) FROM known k WHERE k.category = c.category) / (SELECT count(*) FROM known) AS share,
                   coalesce((SELECT sum(n) FROM terms t WHERE t.category = c.category), 0) + (SELECT count(DISTINCT term) FROM terms) AS size
            FROM (SELECT DISTINCT category FROM known) c),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({O.word_tokens('text')}) AS term FROM documents) GROUP BY ALL),
gain AS (SELECT doc_id, category, sum(tf * ln(n + 1)) AS gain FROM tf JOIN terms USING (term) GROUP BY ALL),
hits AS (SELECT doc_id, sum(tf) AS known FROM tf WHERE term IN (SELECT term FROM terms) GROUP BY doc_id),
scored AS (SELECT d.doc_id, c.category, round(ln(share) + coalesce(gain, 0) - coalesce(known, 0) * ln(size), 9) AS l
           FROM documents d CROSS JOIN classes c LEFT JOIN gain USING (doc_id, category) LEFT JOIN hits USING (doc_id)),
up AS (SELECT *, exp(l - max(l) OVER (PARTITION BY doc_id)) AS u FROM scored),
r AS (SELECT *, u / sum(u) OVER (PARTITION BY doc_id) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, category) AS rank FROM up)
SELECT doc_id, rank::BIGINT AS rank, category, round(score, 6) AS score FROM r WHERE rank <= {TK.TOP_CATEGORIES} AND u >= {TK.CATEGORY_SHARE}
"""


def keyword_lines(spark, sf_dir):
    """G8 over the keyword answers (one keyword per line) of every book."""
    kw = book_keywords(spark, sf_dir)
    answers = TK.as_answer(kw, "doc_id", "keyword")
    return TK.answer_lines(answers, ["doc_id"]).select("doc_id", "line_no", "item")


SQL_KEYWORD_LINES = f"""
WITH k AS ({SQL_BOOK_KEYWORDS}),
a AS (SELECT doc_id, string_agg(keyword, chr(10) ORDER BY rank) AS text FROM k GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {O.strip('x')}), lambda x: x <> '') AS ls FROM a)
SELECT doc_id, (generate_subscripts(ls, 1) - 1)::BIGINT AS line_no, unnest(ls) AS item FROM l
"""


# --- G5: two summary variants per book ---------------------------------------------------

def book_summaries(spark, sf_dir):
    """The abstracts are those of each book's last round, when they fit the
    window (or no longer shrink).  A split without an answer does not hold its
    book, as the native model would give none again."""
    workdir = shared_dir(spark, "summaries")
    books = adaptive_compress(spark, _contents(spark, sf_dir), ["doc_id"], WINDOW, MAX_CHUNK, on_error="drop", workdir=workdir)
    inputs = TK.summary_inputs(last_abstracts(spark, books, ["doc_id"], workdir), ["doc_id"])
    out = TK.native_summaries(inputs, ["doc_id"])
    return out.select("doc_id", "kind", "summary",
                      F.when(F.length(F.btrim("summary")) > 0, "ok").otherwise("failed").alias("status"))


def _summaries_sql() -> str:
    """Rounds unrolled as for adaptive_compress; a book's splits are those of
    the round that ended it.  A book open after the last round has no row."""
    parts = [f"r1 AS ({O.repair_sql('documents', 'doc_id', 'text')})"]
    for k in range(1, ORACLE_ROUNDS + 1):
        parts += [f"a{k} AS ({_round_sql(f'r{k}', MAX_CHUNK)})", f"st{k} AS ({_joined_sql(f'a{k}', f'r{k}')})",
                  f"r{k + 1} AS (SELECT doc_id, joined AS content FROM st{k} WHERE status = 'continue')"]
    ended = " UNION ALL ".join(f"SELECT a.doc_id, split_index, abstract, a.status FROM a{k} a JOIN st{k} s USING (doc_id) WHERE s.status <> 'continue'"
                               for k in range(1, ORACLE_ROUNDS + 1))
    joined = lambda cond: f"coalesce(string_agg(abstract, chr(10) || chr(10) ORDER BY rn) FILTER (WHERE {cond}), '')"
    return "WITH RECURSIVE " + ",\n".join(parts) + f""",
a AS ({ended}),
ranked AS (SELECT doc_id, abstract, status, row_number() OVER (PARTITION BY doc_id, status ORDER BY split_index, abstract) AS rn FROM a),
v AS (SELECT doc_id, {joined("status = 'ok'")} AS whole, {joined("status = 'ok' AND rn > 1")} AS rest FROM ranked GROUP BY doc_id),
vi AS (SELECT doc_id, '{fixed.KIND_SUMMARY}' AS kind, whole AS input, (length(whole) // {fixed.TARGET_DIVISOR})::BIGINT AS target_size FROM v
       UNION ALL SELECT doc_id, '{fixed.KIND_SUMMARY_NO_INTRO}', rest, (length(rest) // {fixed.TARGET_DIVISOR})::BIGINT FROM v),
e AS ({O.extractive_sql('vi', 'doc_id, kind', 'input', 'target_size')})
SELECT doc_id, kind, abstract AS summary, CASE WHEN length(trim(abstract)) > 0 THEN 'ok' ELSE 'failed' END AS status FROM e
"""


SQL_BOOK_SUMMARIES = _summaries_sql()


# --- G2: the retry policy over a table of calls ------------------------------------------

def retry_schedule(spark, sf_dir):
    """A call table out of the documents: each fails for a passing reason
    ``doc_id % 9`` times and ends well, or badly for every fifth; the statuses
    and the seconds that a prompt has waited before each call."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 9 + 1).cast("int"))).alias("attempt"))
    outcome = F.when(F.col("attempt") <= F.col("doc_id") % 9, GN.PASSING).when(F.col("doc_id") % 5 == 0, GN.FINAL).otherwise(GN.GOOD)
    calls = GN.with_policy(d.withColumn("outcome", outcome), 7, F.lit(0.0)).where(F.col("attempt") <= 7)
    w = Window.partitionBy("doc_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return calls.select("doc_id", "attempt", "status", F.coalesce("not_before", F.lit(0.0)).alias("wait"),
                        F.coalesce(F.sum("not_before").over(w), F.lit(0.0)).alias("waited"))


SQL_RETRY_SCHEDULE = f"""
WITH calls AS (SELECT doc_id, unnest(range(1, doc_id % 9 + 2)) AS k FROM documents),
s AS (SELECT doc_id, k, CASE WHEN k > doc_id % 9 THEN (CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END)
                             WHEN k >= 7 THEN 'failed' ELSE 'waiting' END AS status FROM calls WHERE k <= 7),
w AS (SELECT *, CASE WHEN status = 'waiting' THEN {fixed.RETRY_BASE_SECONDS} * 2.0 ** least(k - 1, {fixed.RETRY_MAX_DOUBLINGS}) ELSE 0 END AS wait FROM s)
SELECT doc_id, k::INTEGER AS attempt, status, wait::DOUBLE AS wait, (sum(wait) OVER (PARTITION BY doc_id ORDER BY k) - wait)::DOUBLE AS waited FROM w
"""


# --- F1-F4: gating against existing outputs (labels = books already processed) ----------

def _state_tables(spark, sf_dir):
    """Outputs derived from ``labels`` (one join with ``documents``; the four
    output kinds come from one explode of conditional structs)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read(spark, sf_dir, "labels")
    j = lab.join(d, "doc_id")
    kinds = F.array(
        F.struct(F.lit(fixed.KIND_ABSTRACTS).alias("kind"),
                 F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("text")).alias("text")),
        F.when(F.col("quality") == 1, F.struct(F.lit(fixed.KIND_SUMMARY).alias("kind"), F.col("text").alias("text"))),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0),
               F.struct(F.lit(fixed.KIND_SUMMARY_NO_INTRO).alias("kind"), F.col("text").alias("text"))),
        F.when(F.col("quality") == 0, F.struct(F.lit(fixed.KIND_KEYWORDS).alias("kind"), F.col("text").alias("text"))))
    outputs = (j.select("doc_id", F.explode_outer(kinds).alias("o")).filter(F.col("o").isNotNull())
               .select("doc_id", "o.kind", "o.text"))
    return d, lab.select("doc_id"), outputs


_SQL_OUTPUTS = f"""
SELECT l.doc_id, '{fixed.KIND_ABSTRACTS}' AS kind, CASE WHEN toxic = 1 THEN '' ELSE d.text END AS text
FROM labels l JOIN documents d USING (doc_id)
UNION ALL SELECT l.doc_id, '{fixed.KIND_SUMMARY}', d.text FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1
UNION ALL SELECT l.doc_id, '{fixed.KIND_SUMMARY_NO_INTRO}', d.text FROM labels l JOIN documents d USING (doc_id)
          WHERE quality = 1 AND toxic = 0
UNION ALL SELECT l.doc_id, '{fixed.KIND_KEYWORDS}', d.text FROM labels l JOIN documents d USING (doc_id) WHERE quality = 0
"""


def eligibility(spark, sf_dir):
    d, state, outputs = _state_tables(spark, sf_dir)
    return G.eligibility(d, state, outputs, ["doc_id"], "text")


SQL_ELIGIBILITY = f"""
WITH o AS (SELECT DISTINCT doc_id, kind FROM ({_SQL_OUTPUTS}) WHERE length(text) > 0),
f AS (SELECT doc_id,
             bool_or(kind = '{fixed.KIND_ABSTRACTS}') AS has_abs,
             count(DISTINCT kind) FILTER (WHERE kind IN ('{fixed.KIND_SUMMARY}', '{fixed.KIND_SUMMARY_NO_INTRO}')) = 2 AS done_abstract,
             bool_or(kind = '{fixed.KIND_KEYWORDS}') AS done_keywords,
             bool_or(kind = '{fixed.KIND_CATEGORIES}') AS done_categories
      FROM o GROUP BY doc_id),
st AS (SELECT DISTINCT doc_id FROM labels),
b AS (SELECT d.doc_id, length(d.text) > 0 AS has_content, st.doc_id IS NOT NULL AS has_state,
             coalesce(f.has_abs, false) AS has_abs, coalesce(f.done_abstract, false) AS done_abstract,
             coalesce(f.done_keywords, false) AS done_keywords, coalesce(f.done_categories, false) AS done_categories
      FROM documents d LEFT JOIN st USING (doc_id) LEFT JOIN f USING (doc_id)),
t AS (SELECT b.*, unnest(['resume', 'abstract', 'keywords', 'categories']) AS task FROM b),
r AS (SELECT doc_id, task,
        CASE WHEN task = 'resume' THEN (CASE WHEN NOT has_content THEN 'no_content' WHEN has_abs THEN 'already_done' ELSE 'run' END)
             WHEN NOT has_state THEN 'no_state'
             WHEN NOT has_abs THEN 'no_abstracts'
             WHEN (task = 'abstract' AND done_abstract) OR (task = 'keywords' AND done_keywords)
                  OR (task = 'categories' AND done_categories) THEN 'already_done'
             ELSE 'run' END AS reason FROM t)
SELECT doc_id, task, reason = 'run' AS eligible, reason FROM r
"""


def todo_outputs(spark, sf_dir):
    d, _, outputs = _state_tables(spark, sf_dir)
    return G.missing_outputs(d, outputs, ["doc_id"]).select("doc_id", "kind")


SQL_TODO_OUTPUTS = f"""
WITH o AS (SELECT DISTINCT doc_id, kind FROM ({_SQL_OUTPUTS}) WHERE length(text) > 0),
ready AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM o WHERE kind = '{fixed.KIND_ABSTRACTS}')),
need AS (SELECT doc_id, unnest(['{fixed.KIND_SUMMARY}', '{fixed.KIND_SUMMARY_NO_INTRO}', '{fixed.KIND_KEYWORDS}', '{fixed.KIND_CATEGORIES}']) AS kind FROM ready)
SELECT doc_id, kind FROM need n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = n.doc_id AND o.kind = n.kind)
"""


QUERIES = {
    "repair_blocks": repair_blocks,
    "plan_splits": plan_splits,
    "plan_splits_lines": plan_splits_lines,
    "chunk_targets": chunk_targets,
    "compress_round": compress_round,
    "adaptive_compress": adaptive_compress_all,
    "split_state": split_state,
    "merge_pages": merge_pages,
    "cleanup_book": cleanup_book,
    "cleanup_pages": cleanup_pages,
    "replace_divs": replace_divs,
    "render_prompt": render_prompt,
    "pair_reference": pair_reference,
    "rouge_1": _rouge(1),
    "rouge_2": _rouge(2),
    "rouge_l": rouge_l,
    "rouge_1_stemmed": rouge_1_stemmed,
    "embedding_match": embedding_match,
    "coherence": coherence,
    "annotation_prompts": annotation_prompts,
    "collect_summaries": collect_summaries,
    "missing_summaries": missing_summaries,
    "filled_languages": filled_languages,
    "providers_first_wins": providers_first_wins,
    "book_keywords": book_keywords,
    "book_categories": book_categories,
    "keyword_lines": keyword_lines,
    "book_summaries": book_summaries,
    "retry_schedule": retry_schedule,
    "eligibility": eligibility,
    "todo_outputs": todo_outputs,
    **derived.QUERIES,
}

ORACLES = {
    "repair_blocks": SQL_REPAIR_BLOCKS,
    "plan_splits": SQL_PLAN_SPLITS,
    "plan_splits_lines": SQL_PLAN_SPLITS,
    "chunk_targets": SQL_CHUNK_TARGETS,
    "compress_round": SQL_COMPRESS_ROUND,
    "adaptive_compress": SQL_ADAPTIVE,
    "split_state": SQL_SPLIT_STATE,
    "merge_pages": SQL_MERGE_PAGES,
    "cleanup_book": SQL_CLEANUP_BOOK,
    "cleanup_pages": SQL_CLEANUP_PAGES,
    "replace_divs": SQL_REPLACE_DIVS,
    "render_prompt": SQL_RENDER_PROMPT,
    "pair_reference": SQL_PAIR_REFERENCE,
    "rouge_1": _rouge_sql(1),
    "rouge_2": _rouge_sql(2),
    "rouge_l": SQL_ROUGE_L,
    "embedding_match": SQL_EMBEDDING_MATCH,
    "coherence": SQL_COHERENCE,
    "annotation_prompts": SQL_ANNOTATION_PROMPTS,
    "collect_summaries": SQL_COLLECT_SUMMARIES,
    "missing_summaries": SQL_MISSING_SUMMARIES,
    "filled_languages": SQL_FILLED_LANGUAGES,
    "providers_first_wins": SQL_PROVIDERS_FIRST_WINS,
    "book_keywords": SQL_BOOK_KEYWORDS,
    "book_categories": SQL_BOOK_CATEGORIES,
    "keyword_lines": SQL_KEYWORD_LINES,
    "book_summaries": SQL_BOOK_SUMMARIES,
    "retry_schedule": SQL_RETRY_SCHEDULE,
    "eligibility": SQL_ELIGIBILITY,
    "todo_outputs": SQL_TODO_OUTPUTS,
    **derived.ORACLES,
}


def flagship(spark, sf_dir):
    """documents -> repair -> chunk plan -> native compression, one round."""
    return compress_round(spark, sf_dir)
