"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_dir, ship_package, table_path

# Words everywhere are maximal runs of characters other than the blank and
# the ASCII controls TAB..CR.
BLANKS = "[\\x20\\x09-\\x0D]+"

# Lower-casing is that of A-Z alone.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A side of a join is broadcast only after it was counted and found to have
# at most this many (narrow) rows; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as a long.  Only the first and last piece of the split
    can be empty (a leading or trailing blank), so nothing is filtered."""
    pieces = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.transform(F.array(pieces), lambda p: (
        F.size(p) - F.when(F.element_at(p, 1) == "", 1).otherwise(0)
        - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)))[0].cast("long")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and the files outlive any executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a stashed table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; the component is
    the smallest node of the connected component.

    Random-order contraction: in a round every node points to the smallest
    node of its closed neighbourhood (by id in the first round, by a salted
    hash afterwards, which shrinks paths by a constant factor), and edges are
    rewritten to the pointed-to nodes until none is left.  Neighbour minima
    are aggregates with map-side combine, so a hub costs one row per task.
    Every round is written to the shared folder.  Nulls and loops are ignored.
    """
    e = stash(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
              .where(F.col("a") < F.col("b")).distinct(), "cc-edges")
    node_type = e.schema["a"].dataType
    roots: DataFrame | None = None
    rnd = 0
    while not e.isEmpty():
        key = (lambda c: F.struct(c.alias("v"))) if rnd == 0 else (
            lambda c, r=rnd: F.struct(F.xxhash64(c, F.lit(r)).alias("h"), c.alias("v")))
        near = (e.select(F.col("a").alias("u"), F.col("b").alias("w"))
                .unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("w")))
                .groupBy("u").agg(F.min(key(F.col("w"))).alias("m")))
        label = stash(near.select("u", F.least(F.col("m"), key(F.col("u")))["v"].alias("root")), "cc-label")
        old_roots, old_e = roots, e
        if roots is None:
            roots = label
        else:
            step = label.select(F.col("u").alias("root"), F.col("root").alias("next"))
            roots = stash(roots.join(step, "root", "left")
                          .select("u", F.coalesce("next", "root").alias("root")), "cc-roots")
            drop_stash(old_roots)
        la = label.select(F.col("u").alias("a"), F.col("root").alias("ra"))
        lb = label.select(F.col("u").alias("b"), F.col("root").alias("rb"))
        e = stash(e.join(la, "a").join(lb, "b").where(F.col("ra") != F.col("rb"))
                  .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        drop_stash(old_e)
        if rnd:
            drop_stash(label)
        rnd += 1
    if roots is None:
        return edges.sparkSession.createDataFrame([], "node long, component long").select(
            F.col("node").cast(node_type), F.col("component").cast(node_type))
    first = roots.groupBy("root").agg(F.min("u").alias("component"))
    return roots.join(first, "root").select(F.col("u").alias("node"), "component")

