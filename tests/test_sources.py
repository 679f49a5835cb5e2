"""S1-S5, S7, S8, L1, L2 on folder trees written by the test."""

import os

from pyspark.sql import functions as F

from quire.operators.layout import layout_issues, plan_layout
from quire.sources import corpus
from quire.sources.summaries import discover_providers, scan_summaries


def write(p, text="x"):
    # file scans skip zero-byte files, so every test file gets content
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_pages_and_contents(spark, tmp_path):
    root = str(tmp_path / "books")
    write(f"{root}/pt/b1/paddle_output/page_2.md", "second\r\npart")
    write(f"{root}/pt/b1/paddle_output/page_1.md", "First line")
    write(f"{root}/pt/b1/paddle_output/merged_all.md", "ignored")
    write(f"{root}/pt/b2/paddle_output/page_1.md", "x")
    write(f"{root}/pt/b2/paddle_output/X_2.MD", "bad name")
    write(f"{root}/en/b3/book_content.md", "cached\ntext")
    write(f"{root}/en/b3/paddle_output/p_1.md", "not used")
    write(f"{root}/en/b4/notes.txt", "no ocr")
    books = sorted((r.language, r.book) for r in corpus.scan_books(spark, root).collect())
    assert books == [("en", "b3"), ("en", "b4"), ("pt", "b1"), ("pt", "b2")]
    pages = corpus.scan_pages(spark, root)
    assert {r.file: r.page_id for r in pages.filter(F.col("book") == "b1").collect()} == {"page_1.md": 1, "page_2.md": 2}
    contents, issues = corpus.book_contents(spark, root)
    c = {(r.language, r.book): (r.content, r.origin) for r in contents.collect()}
    assert c[("pt", "b1")] == ("First line second part", "pages")
    assert c[("en", "b3")] == ("cached\ntext", "cached")
    reasons = {(r.book, r.stage) for r in issues.collect()}
    assert ("b2", "pages") in reasons and ("b4", "content") in reasons and ("pt", "b2") not in c


def test_contents_by_page(spark, tmp_path):
    root = str(tmp_path / "books")
    write(f"{root}/pt/b1/paddle_output/page_2.md", "sec-\r\nond <div alt=\"a")
    write(f"{root}/pt/b1/paddle_output/page_1.md", "First line, hyphen-")
    write(f"{root}/pt/b1/paddle_output/page_3.md", "b\"></div>end.")
    write(f"{root}/pt/b1/paddle_output/a_3.md", "tie")
    write(f"{root}/en/b3/book_content.md", "cached\ntext")
    write(f"{root}/en/b3/paddle_output/p_1.md", "not used")
    pieces, issues = corpus.book_contents(spark, root, by_page=True)
    whole, _ = corpus.book_contents(spark, root)
    got = sorted(((r.book, r.start_pos, r.page_id, r.origin, r.content) for r in pieces.collect()))
    assert [x[:4] for x in got] == [("b1", 0, 1, "pages"), ("b1", 18, 2, "pages"), ("b3", 0, None, "cached")]
    # pages 2, 3 and 3 share a div; files of one id follow each other by name
    assert "".join(x[4] for x in got[:2]) == {r.book: r.content for r in whole.collect()}["b1"] == "First line, hyphensecond [A TIE B]end."
    assert issues.count() == 0


def test_page_id_rule(spark):
    names = ["page_001.md", "book_123.md", "page_0042.md", "page_001.txt", "page.md", "001.md", "X_1.MD"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r.i for r in df.select(corpus.page_id("f").alias("i")).collect()]
    assert got == [1, 123, 42, None, None, None, None]


def test_layout(spark, tmp_path):
    root = str(tmp_path / "in")
    write(f"{root}/en/loose.pdf")
    write(f"{root}/en/good/good.pdf")
    write(f"{root}/en/empty/readme.txt")
    write(f"{root}/en/two/a.pdf")
    write(f"{root}/en/two/b.PDF")
    write(f"{root}/en/wrong/other.pdf")
    files = corpus.list_files(spark, root)
    got = sorted((r.item, r.issue) for r in layout_issues(files).collect())
    assert got == [("empty", "folder_without_pdf"), ("loose.pdf", "loose_pdf"),
                   ("two", "folder_with_several_pdfs"),
                   ("wrong/other.pdf", "pdf_not_named_after_folder")]
    plan = sorted((r.src, r.dst) for r in plan_layout(files).collect())
    assert ("en/loose.pdf", "en/loose/loose.pdf") in plan and ("en/good/good.pdf", "en/good/good/good.pdf") not in plan


def test_catalogue_fill_down(spark, tmp_path):
    p = tmp_path / "cat.csv"
    p.write_text('Language,Title\nEN,A\n,B\nFR,"multi\nline"\n,D\n', encoding="utf-8")
    rows = [(r.Language, r.Title) for r in corpus.read_catalogue(spark, str(p)).collect()]
    assert rows == [("EN", "A"), ("EN", "B"), ("FR", "multi\nline"), ("FR", "D")]


def test_summary_discovery(spark):
    rows = [("en", "b1", "human", None), ("en", "b1", "meta", "llama"), ("en", "b1", "meta", "qwen"),
            ("en", "b1", "org", None), ("en", "b1", "org", "sub"), ("do_not_use", "b9", "x", None),
            ("fr", "b0", "meta", "zeta")]
    paths = spark.createDataFrame(rows, "language string, book string, entry string, sub string")
    provs = sorted((r.book, r.provider) for r in scan_summaries(paths).collect())
    assert provs == [("b0", "meta/zeta"), ("b1", "human"), ("b1", "meta/llama"), ("b1", "meta/qwen"), ("b1", "org")]
    first = {r.provider: r.relpath for r in discover_providers(paths).collect()}
    assert first["meta"] == "meta/llama" and first["org"] == "org" and "x" not in first


def test_single_file_branch(spark, tmp_path):
    root = str(tmp_path / "books")
    write(f"{root}/en/b1/out.md", 'Line one\nline two <div alt="fig">x</div>\n<table><tr><th>A</th></tr></table>')
    write(f"{root}/en/b2/book_content.md", "cached wins")
    write(f"{root}/en/b2/out.md", "ignored")
    contents, issues = corpus.book_contents(spark, root, ocr_dir="out.md")
    c = {r.book: (r.content, r.origin) for r in contents.collect()}
    # single file: divs and tables only, no block repair (the line break stays)
    assert c["b1"] == ("Line one\nline two [FIG]\n| A |\n| --- |", "single_file")
    assert c["b2"] == ("cached wins", "cached")
    assert issues.count() == 0


def test_prompt_table(spark):
    from quire.functions.prompts import PROMPTS_DIR
    t = corpus.latest_prompts(corpus.prompt_table(spark, PROMPTS_DIR))
    got = {r.name: (r.versions, r.version) for r in t.collect()}
    assert got["resume"] == ([1], 1) and set(got) == {"resume", "abstract", "keywords", "categories", "annotate"}


def test_read_summaries_from_folders(spark, tmp_path):
    from quire.sources.summaries import read_summaries
    root = str(tmp_path / "results")
    write(f"{root}/english/b1/providers/human/summary.txt", "Reference text.")
    write(f"{root}/english/b1/providers/meta/llama/summary.txt", "Llama text.")
    write(f"{root}/english/b1/providers/org/summary.txt", "Org text.")
    write(f"{root}/english/b1/providers/org/sub/summary.txt", "shadowed")
    write(f"{root}/do_not_use/b9/providers/x/summary.txt", "skipped")
    got = sorted((r.book, r.provider, r.summary) for r in read_summaries(spark, root).collect())
    assert got == [("b1", "human", "Reference text."), ("b1", "meta/llama", "Llama text."), ("b1", "org", "Org text.")]


def test_names_with_blanks_accents_and_signs(spark, tmp_path):
    from quire.sources.summaries import read_summaries
    root, results = str(tmp_path / "my books"), str(tmp_path / "res+ults")
    names = ["Dom Casmurro", "São Bernardo", "100% real", "a+b", "x%20y"]
    for n in names:
        write(f"{root}/pt/{n}/paddle_output/page_1.md", f"text of {n}")
        write(f"{results}/pt/{n}/providers/org/model 1/summary.txt", f"summary of {n}")
    contents, issues = corpus.book_contents(spark, root)
    assert {r.book: r.content for r in contents.collect()} == {n: f"text of {n}" for n in names}
    assert issues.count() == 0
    got = {r.book: (r.provider, r.summary) for r in read_summaries(spark, results).collect()}
    assert got == {n: ("org/model 1", f"summary of {n}") for n in names}


def test_page_number_beyond_bigint_is_an_issue(spark, tmp_path):
    root = str(tmp_path / "books")
    write(f"{root}/pt/b1/paddle_output/page_12345678901234567890.md", "x")
    write(f"{root}/pt/b2/paddle_output/bad name.md", "not looked at")
    write(f"{root}/pt/b2/book_content.md", "cached")
    contents, issues = corpus.book_contents(spark, root)
    assert [r.book for r in contents.collect()] == ["b2"]
    assert [(r.book, r.stage) for r in issues.collect()] == [("b1", "pages")]
