"""Registered queries whose inputs Spark derives from the driver tables.

The tables hold no page files, folder trees, images, tables in markup, OCR
breaks or summary headings.  These queries build them from every row of
``documents`` (names from ids, markup around the given words), once as Spark
columns and once in the oracle, and run the library's operators over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed
from quire import oracle as O
from quire.functions import text as TX
from quire.operators import evaluate as EV
from quire.operators import generate as GN
from quire.operators.layout import layout_issues, plan_layout
from quire.operators.repair import repair_blocks
from quire.session import shared_dir, ship_package, table_path
from quire.sinks import append_missing_outputs, write_summary_maps, write_table
from quire.sources import corpus
from quire.sources.summaries import scan_summaries


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, "documents"))


# --- S2, S3: page files and their ids ------------------------------------------------

FILE_NAME = ("CASE doc_id % 7 WHEN 0 THEN concat('page_', doc_id, '.md') WHEN 1 THEN concat('X_', doc_id, '.MD') "
             "WHEN 2 THEN concat('merged_', doc_id, '.md') WHEN 3 THEN 'page.md' WHEN 4 THEN concat(doc_id, '.md') "
             "WHEN 5 THEN concat('a_b_000', doc_id, '.md') ELSE concat('page_', doc_id, '.txt') END")


def page_files(spark, sf_dir):
    f = documents(spark, sf_dir).selectExpr("doc_id", f"{FILE_NAME} AS file")
    return corpus.page_files(f).select("doc_id", "file", corpus.page_id("file").alias("page_id"))


SQL_PAGE_FILES = f"""
WITH f AS (SELECT doc_id, {FILE_NAME} AS file FROM documents)
SELECT doc_id, file, TRY_CAST(nullif(regexp_extract(file, '_([0-9]+)\\.md$', 1), '') AS BIGINT) AS page_id
FROM f WHERE lower(file) LIKE '%.md' AND NOT starts_with(file, '{fixed.MERGED_PREFIX}')
"""


# --- S6, S9: summaries of providers in one or two levels -------------------------------

PATHS = ["CASE WHEN doc_id % 17 = 0 THEN 'do_not_use' ELSE lang END AS language", "doc_id % 50 AS book", "source AS entry",
         "CASE WHEN doc_id % 3 > 0 THEN concat('m', doc_id % 5) END AS sub"]


def summary_providers(spark, sf_dir):
    paths = documents(spark, sf_dir).selectExpr(*PATHS).distinct()
    return scan_summaries(paths.where("entry IS NOT NULL")).select("language", "book", "provider")


SQL_SUMMARY_PROVIDERS = f"""
WITH p AS (SELECT DISTINCT {', '.join(PATHS)} FROM documents WHERE source IS NOT NULL)
SELECT language, book, CASE WHEN sub IS NULL THEN entry ELSE entry || '/' || sub END AS provider FROM p
WHERE language <> 'do_not_use' AND (sub IS NULL OR NOT EXISTS (
  SELECT 1 FROM p d WHERE d.language = p.language AND d.book = p.book AND d.entry = p.entry AND d.sub IS NULL))
"""


# --- L1, L2: folder trees --------------------------------------------------------------

FOLDER = "concat('b', doc_id % 400)"
REL_PATH = (f"concat(lang, '/', CASE doc_id % 6 WHEN 0 THEN concat('loose', doc_id, '.pdf') WHEN 1 THEN concat({FOLDER}, '/notes.txt') "
            f"WHEN 2 THEN concat({FOLDER}, '/', {FOLDER}, '.PDF') WHEN 3 THEN concat({FOLDER}, '/other', doc_id, '.pdf') "
            f"WHEN 4 THEN concat({FOLDER}, '/deep/x', doc_id, '.pdf') ELSE concat({FOLDER}, '/deep/deep.pdf') END)")


def _files(spark, sf_dir):
    f = documents(spark, sf_dir).where("lang IS NOT NULL").selectExpr(f"{REL_PATH} AS relpath").distinct()
    return f.withColumn("parts", F.split("relpath", "/"))


def layout_check(spark, sf_dir):
    return layout_issues(_files(spark, sf_dir))


def layout_moves(spark, sf_dir):
    return plan_layout(_files(spark, sf_dir))


_SQL_FILES = f"SELECT DISTINCT {REL_PATH} AS relpath, string_split({REL_PATH}, '/') AS parts FROM documents WHERE lang IS NOT NULL"

SQL_LAYOUT_CHECK = f"""
WITH f AS ({_SQL_FILES}),
i AS (SELECT parts[1] AS language, parts[2] AS folder, CASE WHEN len(parts) = 3 AND lower(parts[3]) LIKE '%.pdf' THEN parts[3] END AS pdf
      FROM f WHERE len(parts) >= 3),
b AS (SELECT language, folder, count(pdf) AS n, max(pdf) AS pdf FROM i GROUP BY ALL)
SELECT parts[1] AS language, parts[2] AS item, 'loose_pdf' AS issue FROM f WHERE len(parts) = 2 AND lower(parts[2]) LIKE '%.pdf'
UNION ALL SELECT language, folder, 'folder_without_pdf' FROM b WHERE n = 0
UNION ALL SELECT language, folder, 'folder_with_several_pdfs' FROM b WHERE n > 1
UNION ALL SELECT language, folder || '/' || pdf, 'pdf_not_named_after_folder' FROM b
          WHERE n = 1 AND regexp_replace(pdf, '\\.[^.]*$', '') <> folder
"""

SQL_LAYOUT_MOVES = f"""
WITH f AS ({_SQL_FILES}),
p AS (SELECT *, parts[-1] AS name, parts[-2] AS parent, regexp_replace(parts[-1], '\\.[^.]*$', '') AS stem FROM f
      WHERE len(parts) >= 2 AND lower(parts[-1]) LIKE '%.pdf')
SELECT parts[1] AS language, relpath AS src, array_to_string(parts[1:len(parts) - 1] || [stem, name], '/') AS dst FROM p WHERE parent <> stem
"""


# --- T1, T2, T2b, T3, T5: texts with the markup that triggers the rules --------------------

BODY = "coalesce(text, '')"
# an image in a div that spans lines, one without a description, one in capitals
# (no sharp s in a description: engines differ in its capital)
DIV_TEXT = (f"concat('<div class=\"a\"><img alt=\"Fig ', doc_id, ' ', replace(substr({BODY}, 1, 12), 'ß', 'ss'), '\">', chr(10), '</div>', {BODY}, "
            f"'<DIV>', doc_id, '</DIV><div ALT=\"é', doc_id, '\">x</div>')")
TABLE_TEXT = (f"concat({BODY}, '<table border=1><tr><th>No</th><th>a|', doc_id, '</th></tr>', chr(10), '<tr><td> <b>', "
              f"replace(replace(substr({BODY}, 1, 30), '<', ' '), '>', ' '), '</b></td><td>', doc_id % 7, '</td></tr></table> end ', "
              f"CASE WHEN doc_id % 3 = 0 THEN '<TABLE></TABLE>' ELSE '' END)")
# a heading, an image line, hyphens at line ends, a word that is repeated over a break
BROKEN_TEXT = (f"concat('Paris', chr(10), 'Paris is', chr(10), '# Head', chr(10), '[IMAGE]', chr(10), "
               f"replace(replace({BODY}, 'the ', concat('the-', chr(10))), '. ', concat('.', chr(10))), chr(10), 'ends', chr(10), 'Ends', chr(10))")
MARKED_SUMMARY = (f"concat(CASE WHEN doc_id % 2 = 0 THEN concat('Book Summary:', chr(10)) ELSE concat('Resumo do livro:', chr(10)) END, {BODY}, chr(10), "
                  "CASE doc_id % 4 WHEN 0 THEN 'Keywords: a' WHEN 1 THEN 'Keywords b Palavras-chave: c' WHEN 2 THEN 'Palavras-chave' ELSE '' END)")


def _built(spark, sf_dir, expr):
    return documents(spark, sf_dir).selectExpr("doc_id", f"{expr} AS text")


def images_replaced(spark, sf_dir):
    return _built(spark, sf_dir, DIV_TEXT).select("doc_id", TX.replace_divs("text").alias("text"))


def tables_replaced(spark, sf_dir):
    return _built(spark, sf_dir, TABLE_TEXT).select("doc_id", TX.replace_tables("text").alias("text"))


def table_cells(spark, sf_dir):
    cells = TX.explode_table_cells(_built(spark, sf_dir, TABLE_TEXT), ["doc_id"], "text")
    return cells.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("table_no", "row_no", "col_no")], "is_header", "cell")


def breaks_repaired(spark, sf_dir):
    return repair_blocks(_built(spark, sf_dir, BROKEN_TEXT)).select("doc_id", "content")


def marked_summaries(spark, sf_dir):
    return _built(spark, sf_dir, MARKED_SUMMARY).select("doc_id", TX.clean_summary("text").alias("summary"))


def _clean_summary_sql(col: str) -> str:
    t = col
    for h in fixed.SUMMARY_HEADINGS:
        t = f"replace({t}, {O.sql_str(h)}, '')"
    a, b = (O.sql_str(m) for m in fixed.KEYWORD_MARKERS)
    k = f"(CASE WHEN strpos({t}, {a}) > 0 THEN strpos({t}, {a}) ELSE strpos({t}, {b}) END)"
    return O.strip(f"CASE WHEN {k} > 0 THEN substr({t}, 1, {k} - 1) ELSE {t} END")


def _sql_built(expr: str) -> str:
    return f"WITH t AS (SELECT doc_id, {expr} AS text FROM documents)"


SQL_IMAGES = f"{_sql_built(DIV_TEXT)} SELECT doc_id, {O.divs_sql('text')} AS text FROM t"
SQL_TABLES = f"{_sql_built(TABLE_TEXT)} SELECT doc_id, {O.tables_sql('text')} AS text FROM t"
_CELL = f"replace({O.strip(f'''regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '[{O.WS_RE2}]+', ' ', 'g')''')}, '|', '\\|')"
SQL_CELLS = f"""
{_sql_built(TABLE_TEXT)},
a AS (SELECT doc_id, regexp_extract_all(text, '(?is)<table[^>]*>.*?</table>') AS x FROM t),
b AS (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS table_no FROM a),
c AS (SELECT doc_id, table_no, regexp_extract_all(x, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS x FROM b),
d AS (SELECT doc_id, table_no, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS row_no FROM c),
e AS (SELECT doc_id, table_no, row_no, regexp_extract_all(x, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1) AS x FROM d),
f AS (SELECT doc_id, table_no, row_no, unnest(x) AS c, generate_subscripts(x, 1) - 1 AS col_no FROM e)
SELECT doc_id, table_no::BIGINT AS table_no, row_no::BIGINT AS row_no, col_no::BIGINT AS col_no, row_no = 0 AS is_header, {_CELL} AS cell FROM f
"""
SQL_BREAKS = f"{_sql_built(BROKEN_TEXT)} {O.repair_sql('t', 'doc_id', 'text')}"
SQL_MARKED = f"{_sql_built(MARKED_SUMMARY)} SELECT doc_id, {_clean_summary_sql('text')} AS summary FROM t"


# --- S10, S11: prompt versions; E2: language codes; E10: open annotations ---------------------

def prompt_versions(spark, sf_dir):
    p = documents(spark, sf_dir).selectExpr("lang AS name", "CAST(doc_id AS INT) AS version", "text AS template")
    return corpus.latest_prompts(p).select("name", "version", F.size("versions").alias("n_versions"), F.length("template").alias("template_chars"))


SQL_PROMPT_VERSIONS = """
SELECT lang AS name, max(doc_id)::INTEGER AS version, count(doc_id)::INTEGER AS n_versions, length(arg_max(text, doc_id))::INTEGER AS template_chars
FROM documents GROUP BY lang
"""

FOLDER_OF_LANG = "CASE lang WHEN 'en' THEN 'English' WHEN 'es' THEN 'SPANISH' WHEN 'fr' THEN 'French' ELSE lang END"


def language_codes(spark, sf_dir):
    d = documents(spark, sf_dir).selectExpr("doc_id", f"{FOLDER_OF_LANG} AS language")
    return d.select("doc_id", EV.language_code("language").alias("code"))


SQL_LANGUAGE_CODES = f"""
SELECT doc_id, coalesce(CASE lower({FOLDER_OF_LANG}) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGE_CODES.items())} END,
                        '{fixed.DEFAULT_LANGUAGE_CODE}') AS code FROM documents
"""


def open_annotations(spark, sf_dir):
    todo = documents(spark, sf_dir).select(F.col("source").alias("provider"), F.concat(F.lit("judge"), F.col("doc_id") % 2).alias("evaluator"), "doc_id")
    ship_package(spark)
    done = spark.read.parquet(table_path(sf_dir, "labels")).select("doc_id", F.concat(F.lit("judge"), F.col("quality")).alias("evaluator"))
    return EV.pending_annotations(todo, done, ["evaluator", "doc_id"]).select("provider", "evaluator", "doc_id")


SQL_OPEN_ANNOTATIONS = """
SELECT source AS provider, 'judge' || (doc_id % 2) AS evaluator, doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND 'judge' || l.quality = 'judge' || (d.doc_id % 2))
"""


# --- G1, G3: generation over a prompt per document ---------------------------------------------

def generated(spark, sf_dir):
    """The first 40 characters of every text, asked of a model; blank ones fail."""
    prompts = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    out = GN.generate(prompts, lambda ps: [p[:40] for p in ps], ["doc_id"])
    return out.select("doc_id", "text", "status", "attempts")


SQL_GENERATED = f"""
WITH a AS (SELECT doc_id, substr({BODY}, 1, 40) AS x FROM documents)
SELECT doc_id, CASE WHEN {O.strip('x')} <> '' THEN x END AS text, CASE WHEN {O.strip('x')} <> '' THEN 'ok' ELSE 'failed' END AS status,
       1 AS attempts FROM a
"""


# --- K1, K3, K5, F7: what the sinks have written -------------------------------------------------

def outputs_sink(spark, sf_dir):
    """Keywords of two providers for every document; those of documents with a
    label exist for one of them and are not written again."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    new = d.select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b/c"))).alias("provider"), F.lit(fixed.KIND_KEYWORDS).alias("kind"), "text")
    lab = spark.read.parquet(table_path(sf_dir, "labels"))
    had = lab.select("doc_id", F.lit("a").alias("provider"), F.lit(fixed.KIND_KEYWORDS).alias("kind"),
                     F.when(F.col("toxic") == 0, "done").otherwise("").alias("text"))
    path = shared_dir(spark, "outputs")
    append_missing_outputs(new, had, path, ["doc_id"])
    return spark.read.parquet(path).select("doc_id", F.col("provider").cast("string").alias("provider"), "kind",
                                           F.length("text").cast("bigint").alias("n_chars"))


SQL_OUTPUTS_SINK = f"""
SELECT doc_id, p AS provider, '{fixed.KIND_KEYWORDS}' AS kind, length(text)::BIGINT AS n_chars FROM documents d, (VALUES ('a'), ('b/c')) ps(p)
WHERE length(text) > 0 AND NOT (p = 'a' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0))
"""


def contents_sink(spark, sf_dir):
    path = shared_dir(spark, "contents")
    write_table(documents(spark, sf_dir).selectExpr("doc_id", "coalesce(lang, 'none') AS language", "text AS content"), path, ["language"], mode="overwrite")
    return spark.read.parquet(path).select("doc_id", F.col("language").cast("string").alias("language"), "content")


SQL_CONTENTS_SINK = "SELECT doc_id, coalesce(lang, 'none') AS language, text AS content FROM documents"


def summary_maps(spark, sf_dir):
    path = shared_dir(spark, "maps")
    write_summary_maps(documents(spark, sf_dir).selectExpr("coalesce(source, 'none') AS provider", "doc_id AS book", "text AS summary"), path)
    rows = spark.read.text(path).select(F.col("provider").cast("string").alias("provider"), F.from_json("value", "map<string,string>").alias("m"))
    return rows.select("provider", F.explode("m").alias("book", "summary"))


SQL_SUMMARY_MAPS = "SELECT coalesce(source, 'none') AS provider, doc_id::VARCHAR AS book, text AS summary FROM documents"


QUERIES = {
    "page_files": page_files,
    "summary_providers": summary_providers,
    "layout_check": layout_check,
    "layout_moves": layout_moves,
    "images_replaced": images_replaced,
    "tables_replaced": tables_replaced,
    "table_cells": table_cells,
    "breaks_repaired": breaks_repaired,
    "marked_summaries": marked_summaries,
    "prompt_versions": prompt_versions,
    "language_codes": language_codes,
    "open_annotations": open_annotations,
    "generated": generated,
    "outputs_sink": outputs_sink,
    "contents_sink": contents_sink,
    "summary_maps": summary_maps,
}

ORACLES = {
    "page_files": SQL_PAGE_FILES,
    "summary_providers": SQL_SUMMARY_PROVIDERS,
    "layout_check": SQL_LAYOUT_CHECK,
    "layout_moves": SQL_LAYOUT_MOVES,
    "images_replaced": SQL_IMAGES,
    "tables_replaced": SQL_TABLES,
    "table_cells": SQL_CELLS,
    "breaks_repaired": SQL_BREAKS,
    "marked_summaries": SQL_MARKED,
    "prompt_versions": SQL_PROMPT_VERSIONS,
    "language_codes": SQL_LANGUAGE_CODES,
    "open_annotations": SQL_OPEN_ANNOTATIONS,
    "generated": SQL_GENERATED,
    "outputs_sink": SQL_OUTPUTS_SINK,
    "contents_sink": SQL_CONTENTS_SINK,
    "summary_maps": SQL_SUMMARY_MAPS,
}
