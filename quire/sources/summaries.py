"""Provider discovery over a table of summary paths.

Input rows: ``language, book, entry, sub`` where ``entry`` is the provider
folder and ``sub`` the optional second level (null when the summary sits
directly in ``entry``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import fixed


def provider_key(entry: str = "entry", sub: str = "sub"):
    return F.when(F.col(sub).isNull(), F.col(entry)).otherwise(F.concat_ws("/", F.col(entry), F.col(sub)))


def scan_summaries(paths: DataFrame) -> DataFrame:
    """Per book, a provider folder holding the summary directly gives its
    name; otherwise each sub-folder holding one gives ``entry/sub``.
    Two-level rows are dropped when their entry has a direct file."""
    direct = paths.filter(F.col("sub").isNull()).select("language", "book", "entry")
    nested = paths.filter(F.col("sub").isNotNull()).join(direct, ["language", "book", "entry"], "left_anti")
    both = paths.filter(F.col("sub").isNull()).unionByName(nested)
    return both.filter(~F.col("language").isin(*fixed.SKIP_LANGUAGE_DIRS)).select(
        "language", "book", provider_key().alias("provider"), "entry", "sub")


def discover_providers(paths: DataFrame) -> DataFrame:
    """Short (top-level) provider name -> the relative path of the first
    summary in (language, book, entry, sub) order (first one wins)."""
    p = paths.filter(~F.col("language").isin(*fixed.SKIP_LANGUAGE_DIRS))
    order = F.struct("language", "book", "entry", "sub")
    return p.groupBy(F.col("entry").alias("provider")).agg(F.min_by(provider_key(), order).alias("relpath"))


def summary_paths(spark, root: str):
    """Folder scan for S6/S7 input: every ``summary.txt`` at
    ``<root>/<language>/<book>/providers/<entry>[/<sub>]/summary.txt`` as
    ``language, book, entry, sub, path`` (``sub`` null for one level)."""
    from quire.sources.corpus import list_files

    f = list_files(spark, root)
    n = F.size("parts")
    ok = (F.element_at("parts", -1) == fixed.SUMMARY_FILENAME) & (F.col("parts")[2] == "providers") & n.isin(5, 6)
    return f.filter(ok).select(
        F.col("parts")[0].alias("language"), F.col("parts")[1].alias("book"), F.col("parts")[3].alias("entry"),
        F.when(n == 6, F.col("parts")[4]).alias("sub"),
        F.concat_ws("/", F.lit(root.rstrip("/")), F.col("relpath")).alias("path"))


def read_summaries(spark, root: str):
    """S6 + texts: ``language, book, provider, summary`` for every provider
    discovered by :func:`scan_summaries` (skip folders removed)."""
    from quire.sources.corpus import _rel, read_texts

    provs = scan_summaries(summary_paths(spark, root)).alias("p")
    texts = read_texts(spark, f"{root.rstrip('/')}/*/*/providers/{{*,*/*}}/{fixed.SUMMARY_FILENAME}")
    parts = F.split(_rel("path", root), "/")
    n = F.size(parts)
    t = texts.select(parts[0].alias("language"), parts[1].alias("book"), parts[3].alias("entry"),
                     F.when(n == 6, parts[4]).alias("sub"), F.col("text").alias("summary")).alias("x")
    cond = [F.col("p.language") == F.col("x.language"), F.col("p.book") == F.col("x.book"),
            F.col("p.entry") == F.col("x.entry"), F.col("p.sub").eqNullSafe(F.col("x.sub"))]
    return provs.join(t, cond).select("p.language", "p.book", "p.provider", "x.summary")
