"""URL filter: a trie over reversed host labels and path segments.

A rule is (verdict, host, path).  It fits its host and all subdomains of it,
if the path of the url starts with the rule's path.  The trie's upper part
has one edge per host label, read from the right (``org`` above ``example``);
a node where rules end carries a second trie with one edge per whole path
segment, whose nodes hold the ends of rules: a rule's last segment may be
just the beginning of the url's (``/en/1`` fits ``/en/17``).  Of the rules
that fit, that with most host labels wins, then that with the longest path;
rules that are equal in host and path block.

A url is walked down its host labels once and then from the deepest node with
rules upwards until a path fits: the work grows with the labels and segments
of the url, not with the number of rules.  The trie is broadcast; it holds at
most ``TRIE_RULES`` rules.  Longer lists are dealt by hash into blocks of that
size; every block judges all urls in a pass of its own, which is written to
the shared folder, and keeps a block's finding where it is longer: results
are the same, at one pass over (id, host, path) a block.  No stage shuffles.

Cases: a null url, or one without ``://``, has empty host and path, which no
rule fits except those with an empty host (they fit every host); a port or
user name stays part of the host.  Rows whose url is not fitted by any rule
get the default verdict and a null rule.  Every row is judged on its own:
repeated rows give repeated results, an empty table gives none, columns of any
other name are ignored, the length of a url is not limited.  Rules that are
null in host or path count as empty there; a verdict other than allow or block
is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ASCII_LOWER, ASCII_UPPER, stash

# rules in one broadcast trie (some 100 MB in a Python worker)
TRIE_RULES = 200_000

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where it has none."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


class UrlTrie:
    """Rules as nested dicts.  A host node is ``[children by label, path node
    or None]``; a path node is ``[children by whole segment, ends]``, ``ends``
    maps the length of a rule's last segment to its spellings."""

    def __init__(self, rules: Iterable[tuple[str, str | None, str | None]]):
        self.root: list = [{}, None]
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict of a rule must be {ALLOW} or {BLOCK}: {verdict}")
            self._add(verdict, (host or "").translate(_LOWER), path or "")

    def _add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, {}]
        *whole, last = path.split("/")
        node = node[1]
        for segment in whole:
            node = node[0].setdefault(segment, [{}, {}])
        ends = node[1].setdefault(len(last), {})
        if ends.get(last, (ALLOW,))[0] == ALLOW:
            ends[last] = (verdict, host + path, len(path))

    def find(self, host: str, path: str) -> tuple[str, str, int, int] | None:
        """(verdict, rule, host labels, length of the path) of the longest fit."""
        node, reached = self.root, [(self.root[1], 0)]
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node[0].get(label)
            if node is None:
                break
            reached.append((node[1], depth))
        segments = path.split("/")
        for paths, depth in reversed(reached):
            best = _longest(paths, segments) if paths is not None else None
            if best is not None:
                return best[0], best[1], depth, best[2]
        return None


_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def _longest(node: list, segments: list[str]) -> tuple[str, str, int] | None:
    best = None
    for segment in segments:
        for length in sorted(node[1], reverse=True):
            end = node[1][length].get(segment[:length]) if length <= len(segment) else None
            if end is not None:
                best = end
                break
        node = node[0].get(segment)
        if node is None:
            break
    return best


def rule_table(spark: SparkSession, allow: Iterable[tuple[str, str]] = (), block: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Rules (verdict, host, path) out of lists of (host, path)."""
    rows = [(ALLOW, h, p) for h, p in allow] + [(BLOCK, h, p) for h, p in block]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = ALLOW, trie_rules: int = TRIE_RULES) -> DataFrame:
    """(id, host, path, rule, verdict, host_labels, path_chars): the longest
    rule that fits each url; see the module."""
    host, path = host_and_path(pages[url_col])
    none = F.lit(None)
    found = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"), none.cast("string").alias("rule"),
                         none.cast("string").alias("verdict"), F.lit(-1).alias("host_labels"), F.lit(-1).alias("path_chars"))
    n = max(1, -(-rules.count() // trie_rules))
    # a block gets all rules of its hosts and paths, so that the tie rule sees them together
    dealt = rules.select("verdict", "host", "path", F.pmod(F.xxhash64(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))),
                                                           F.lit(n)).alias("block"))
    for b in range(n):
        trie = pages.sparkSession.sparkContext.broadcast(
            UrlTrie((r.verdict, r.host, r.path) for r in dealt.where(F.col("block") == b).toLocalIterator()))
        found = found.mapInArrow(_judge(trie), found.schema)
        if b < n - 1:
            found = stash(found, "url-filter")
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _judge(trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            held = batch.to_pydict()
            for i, (host, path) in enumerate(zip(held["host"], held["path"])):
                fit = find(host, path)
                if fit is not None and fit[2:] > (held["host_labels"][i], held["path_chars"][i]):
                    held["verdict"][i], held["rule"][i], held["host_labels"][i], held["path_chars"][i] = fit
            yield pa.RecordBatch.from_pydict(held, batch.schema)
    return run


def oracle_sql(allow: Iterable[tuple[str, str]], block: Iterable[tuple[str, str]], default: str = ALLOW) -> str:
    """DuckDB SQL over ``pages`` for page_id, host, path, rule, verdict."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, side in ((ALLOW, allow), (BLOCK, block)) for h, p in side)
    return f"""
WITH rules(verdict, h, p) AS (VALUES {values}),
rest AS (SELECT row_number() OVER () AS n, page_id,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT n, page_id, translate(regexp_extract(r, '^[^/?#]*'), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host,
               regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
fits AS (SELECT n, concat(h, p) AS rule, verdict,
                row_number() OVER (PARTITION BY n ORDER BY len(string_split(h, '.')) DESC, length(p) DESC, verdict DESC) AS rk
         FROM cut JOIN rules ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict
FROM cut LEFT JOIN (SELECT * FROM fits WHERE rk = 1) f USING (n)
"""
