"""Helpers to write DuckDB oracle SQL that shares our fixed character sets."""

from __future__ import annotations

from quire import fixed

WS_SQL = "'" + fixed.WHITESPACE.replace("'", "''") + "'"        # literal for trim(x, chars)
WS_RE2 = fixed.re2_class_body(fixed.WHITESPACE)
WORD = fixed.WORD_CLASS
LOWER = fixed.HYPHEN_JOIN_LOWER
SENT_CHARS = fixed.re2_class_body(fixed.SENTENCE_END_CHARS)
SENT_QUOTES = fixed.re2_class_body(fixed.SENTENCE_END_QUOTES)
SENT_ALONE = fixed.re2_class_body(fixed.SENTENCE_END_ALONE)
MARK = "chr(1)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def sentences(expr: str) -> str:
    """DuckDB list of non-empty stripped sentences (same rule as Spark)."""
    t = f"regexp_replace({expr}, '([.!?…])[ \\t]+', '\\1' || {MARK}, 'g')"
    t = f"regexp_replace({t}, '[ \\t]*\\n[ \\t\\n]*', {MARK}, 'g')"
    return f"list_filter(list_transform(string_split({t}, {MARK}), lambda s: {strip('s')}), lambda s: s <> '')"


def word_tokens(expr: str) -> str:
    return (f"list_filter(string_split_regex(lower({expr}), '[^{WORD}]+'), lambda x: x <> '')")


def rouge_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[^a-z0-9]+'), lambda x: x <> '')"


def repair_sql(source: str, key: str, text: str) -> str:
    """Block repair over ``source`` (a relation with ``key`` and ``text``) as
    lag/lead window SQL: returns ``key, content``."""
    return f"SELECT k AS {key}, string_agg(piece, '' ORDER BY pos) AS content FROM ({repair_pieces_sql(source, key, text)}) GROUP BY k"


def repair_pieces_sql(source: str, key: str, text: str) -> str:
    """What every block adds to the repaired text: ``k, pos, piece``."""
    return f"""
    WITH raw AS (
      SELECT {key} AS k, string_split_regex({text}, '\\n+') AS arr FROM {source}
    ), blk AS (
      SELECT k, unnest(arr) AS blk, generate_subscripts(arr, 1) - 1 AS pos FROM raw
    ), f AS (
      SELECT k, pos, {strip('blk')} AS b FROM blk
    ), g AS (
      SELECT k, pos, b,
        regexp_extract(b, '[{WORD}]+', 0) AS fw,
        regexp_extract(b, '([{WORD}]+)[^{WORD}]*\\z', 1) AS lw,
        regexp_matches(b, '^#{{1,{fixed.HEADING_MAX_LEVEL}}}[{WS_RE2}]+') AS head,
        regexp_matches(b, '^[^{WORD}]*[{LOWER}]') AS lower_start,
        regexp_matches(b, '(?:[{SENT_CHARS}]+[{SENT_QUOTES}]?|[{SENT_ALONE}])\\z') AS sent_end
      FROM f
    ), h AS (
      SELECT *,
        lag(b) OVER w AS pb, lag(lw) OVER w AS plw, lag(head) OVER w AS phead,
        lag(sent_end) OVER w AS psent
      FROM g WINDOW w AS (PARTITION BY k ORDER BY pos)
    ), r AS (
      SELECT k, pos, b,
        CASE
          WHEN pos = 0 THEN 'start'
          WHEN plw <> '' AND fw <> '' AND lower(plw) = lower(fw)
               AND contains(substr(b, 1, strpos(b, fw) + length(fw) - 1), pb) THEN 'pop'
          WHEN plw <> '' AND fw <> '' AND lower(plw) = lower(fw) THEN 'dup'
          WHEN pb <> '' AND NOT (head OR phead) AND suffix(pb, '-') AND lower_start THEN 'hyphen'
          WHEN pb <> '' AND NOT psent AND NOT (head OR phead)
               AND pb <> '{fixed.IMAGE_MARKER}' AND b <> '{fixed.IMAGE_MARKER}' THEN 'space'
          ELSE 'break'
        END AS rule
      FROM h
    ), e AS (
      SELECT k, pos,
        CASE WHEN rule = 'start' THEN ''
             WHEN rule = 'pop' AND pos = 1 THEN ''
             WHEN rule = 'hyphen' THEN ''
             WHEN rule = 'space' THEN ' '
             ELSE chr(10) || chr(10) END
        || CASE WHEN lead(rule) OVER w2 = 'pop' THEN ''
                WHEN lead(rule) OVER w2 = 'hyphen' THEN substr(b, 1, length(b) - 1)
                ELSE b END AS piece
      FROM r WINDOW w2 AS (PARTITION BY k ORDER BY pos)
    )
    SELECT k, pos, piece FROM e
    """


def splits_sql(source: str, key: str, text: str, max_chunk: str) -> str:
    """Chunk planning as a recursive CTE: ``key, split_index, initial_pos, end_pos``.
    ``max_chunk`` is an SQL expression over ``source``'s columns."""
    nxt = ("CASE WHEN @S + mx >= n THEN n "
           "WHEN strpos(substr(t, @S + mx + 1), chr(10)) = 0 THEN n "
           "ELSE @S + mx + strpos(substr(t, @S + mx + 1), chr(10)) END")
    return f"""
    WITH RECURSIVE src AS (
      SELECT {key} AS k, {text} AS t, length({text}) AS n, CAST({max_chunk} AS BIGINT) AS mx FROM {source}
    ), s(k, t, n, mx, idx, st, en) AS (
      SELECT k, t, n, mx, 0::BIGINT, 0::BIGINT, ({nxt.replace('@S', '0')})::BIGINT FROM src WHERE n > 0
      UNION ALL
      SELECT k, t, n, mx, idx + 1, en, ({nxt.replace('@S', 'en')})::BIGINT FROM s WHERE en < n
    )
    SELECT k AS {key}, idx AS split_index, st AS initial_pos, en AS end_pos FROM s
    """


def extractive_sql(source: str, keys: str, chunk: str, target: str) -> str:
    """Native extractive digest per chunk: ``keys..., abstract``."""
    kl = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"x.{k} = y.{k}" for k in kl)
    return f"""
    WITH c AS (SELECT {keys}, {chunk} AS chunk, {target} AS target FROM {source}),
    s0 AS (SELECT {keys}, target, {sentences('chunk')} AS sl FROM c),
    s AS (SELECT {keys}, target, unnest(sl) AS sent, generate_subscripts(sl, 1) - 1 AS spos FROM s0),
    t0 AS (SELECT {keys}, spos, {word_tokens('sent')} AS tl FROM s),
    t AS (SELECT {keys}, spos, unnest(tl) AS tok FROM t0),
    tf AS (SELECT {keys}, tok, count(*) AS n FROM t GROUP BY ALL),
    tt AS (SELECT t.*, tf.n FROM t JOIN tf USING ({keys}, tok)),
    sc0 AS (SELECT {keys}, spos, avg(n) AS score FROM tt GROUP BY ALL),
    sc AS (SELECT s.*, coalesce(sc0.score, 0.0) AS score FROM s LEFT JOIN sc0 USING ({keys}, spos)),
    rk AS (SELECT *, row_number() OVER w AS rnk,
                  sum(length(sent) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run
           FROM sc WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC, spos ASC)),
    dg AS (SELECT {keys}, string_agg(sent, ' ' ORDER BY spos) AS joined, max(target) AS target
           FROM rk WHERE rnk = 1 OR run <= target GROUP BY ALL)
    SELECT {", ".join(f"x.{k}" for k in kl)},
           coalesce(substr(y.joined, 1, greatest(y.target, 1)), '') AS abstract
    FROM c x LEFT JOIN dg y ON {on}
    """


def interleave_sql(expr: str, pattern: str, repl_lambda: str) -> str:
    """Replace each match of ``pattern`` (dot-all, any case) in ``expr`` by
    ``repl_lambda`` applied to the match (DuckDB lambda text over ``d``)."""
    pieces = f"string_split_regex({expr}, '(?is){pattern}')"
    reps = f"list_transform(regexp_extract_all({expr}, '(?is)({pattern})', 1), lambda d: {repl_lambda})"
    return (f"array_to_string(list_transform(range(1, len({pieces}) + 1), "
            f"lambda i: {pieces}[i] || coalesce({reps}[i], '')), '')")


DIV_RE = "<div[^>]*>.*?</div>"


def divs_sql(expr: str) -> str:
    alt = "regexp_extract(d, '(?i)alt=\"([^\"]+)\"', 1)"
    return interleave_sql(expr, DIV_RE, f"CASE WHEN {alt} <> '' THEN '[' || upper({alt}) || ']' ELSE '' END")


def tables_sql(expr: str) -> str:
    """Markdown pipe tables for each ``<table>`` (same rule as Spark)."""
    cell = (f"replace({strip(f'''regexp_replace(regexp_replace(cc, '<[^>]+>', '', 'g'), '[{WS_RE2}]+', ' ', 'g')''')}, "
            f"'|', '\\|')")
    rows = (f"list_transform(regexp_extract_all(d, '(?is)<tr[^>]*>(.*?)</tr>', 1), "
            f"lambda rr: list_transform(regexp_extract_all(rr, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), lambda cc: {cell}))")
    line = "'| ' || array_to_string({r}, ' | ') || ' |'"
    md = (f"CASE WHEN len({rows}) > 0 THEN array_to_string("
          f"[{line.format(r=f'({rows})[1]')}, '|' || array_to_string(list_transform(({rows})[1], lambda hx: ' --- '), '|') || '|'] "
          f"|| list_transform(({rows})[2:], lambda br: {line.format(r='br')}), chr(10)) ELSE '' END")
    return interleave_sql(expr, "<table[^>]*>.*?</table>", md)
