"""Two-level scans: neighbours, running totals and fill-down along an order
without one task for a whole key.

Rows of a key are cut into blocks of bounded size (a column that rises with
the order, such as ``page_id div 256``).  The first level are windows inside a
block; every block then leaves one narrow row with its edges and totals, and
the second level scans those rows; a join on (key, block) carries the result
back.  A key that holds a third of all rows is spread over its blocks, and the
second level sees one row a block of it.  All first-level windows and the join
share one exchange on (key, block); chained scans reuse it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def join_same(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on ``cols``, null being equal to null; columns of both sides by
    name, ``cols`` once."""
    names = {c: f"__j_{i}" for i, c in enumerate(cols)}
    right = right.select(*[F.col(c).alias(names[c]) if c in names else c for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(right, same, how).drop(*names.values())


# what a scan can carry; ``prev`` and ``next`` are structs that are null where
# there is no neighbour, so a neighbour's null value can be told from none
KINDS = ("prev", "next", "last_before", "first_after", "sum_before")


def two_level_scan(df: DataFrame, keys: list[str], block: str, order: list[str],
                   specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add one column per entry ``name: (kind, column)`` of ``specs``:

    ``prev`` / ``next``      struct ``v`` of the neighbouring row's value
    ``last_before``          last non-null value of the rows before
    ``first_after``          first non-null value of the rows behind
    ``sum_before``           sum over the rows before (0 for the first)

    ``order`` decides within (keys, block), ``block`` between blocks of a key;
    together they have to be unique.  Null keys are keys like any other.
    """
    unknown = {k for k, _ in specs.values()} - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of scan {sorted(unknown)}; choose from {KINDS}")
    at = [*keys, block]
    up, down = Window.partitionBy(*at).orderBy(*order), Window.partitionBy(*at).orderBy(*[F.desc(c) for c in order])
    before = (Window.unboundedPreceding, -1)
    place = F.struct(*order)
    local, edge = {}, {}
    for name, (kind, col) in specs.items():
        v, there = F.struct(F.col(col).alias("v")), F.when(F.col(col).isNotNull(), place)
        local[name], edge[name] = {
            "prev": lambda: (F.lag(v).over(up), F.max_by(v, place)),
            "next": lambda: (F.lead(v).over(up), F.min_by(v, place)),
            "last_before": lambda: (F.last(col, ignorenulls=True).over(up.rowsBetween(*before)), F.max_by(col, there)),
            "first_after": lambda: (F.last(col, ignorenulls=True).over(down.rowsBetween(*before)), F.min_by(col, there)),
            "sum_before": lambda: (F.coalesce(F.sum(col).over(up.rowsBetween(*before)), F.lit(0)), F.sum(col)),
        }[kind]()
    edges = df.groupBy(*at).agg(*[c.alias(f"__e_{n}") for n, c in edge.items()])
    rise, fall = Window.partitionBy(*keys).orderBy(block), Window.partitionBy(*keys).orderBy(F.desc(block))

    def carried(name: str, kind: str) -> Column:
        c = f"__e_{name}"
        return {"prev": lambda: F.lag(c).over(rise), "next": lambda: F.lead(c).over(rise),
                "last_before": lambda: F.last(c, ignorenulls=True).over(rise.rowsBetween(*before)),
                "first_after": lambda: F.last(c, ignorenulls=True).over(fall.rowsBetween(*before)),
                "sum_before": lambda: F.coalesce(F.sum(c).over(rise.rowsBetween(*before)), F.lit(0))}[kind]()

    edges = edges.select(*at, *[carried(n, k).alias(f"__c_{n}") for n, (k, _) in specs.items()])
    both = join_same(df.select("*", *[c.alias(f"__l_{n}") for n, c in local.items()]), edges, at)
    out = []
    for name, (kind, _) in specs.items():
        a, b = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        out.append((a + b if kind == "sum_before" else F.coalesce(a, b)).alias(name))
    return both.select(*df.columns, *out)
