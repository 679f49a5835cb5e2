"""T3 block repair: join paragraphs that OCR broke across lines.

The text is split on runs of newlines into stripped blocks.  The separator in
front of block *i* depends only on blocks *i-1* and *i*, and the text emitted
for block *i* depends only on the rule chosen at *i+1*, so the whole repair is
a neighbour computation over the block array of one row: no sequential fold,
no shuffle, no window.  Each step is its own projection so the regexes of a
block are evaluated once, not once per neighbour that reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed
from quire.functions.text import WS_CLASS, col_of, first_word, last_word, strip

_LOWER_START = f"^[^{fixed.WORD_CLASS}]*[{fixed.HYPHEN_JOIN_LOWER}]"
_HEADING = f"^#{{1,{fixed.HEADING_MAX_LEVEL}}}[{WS_CLASS}]+"
_SENTENCE_END = (
    f"(?:[{fixed.java_class_body(fixed.SENTENCE_END_CHARS)}]+"
    f"[{fixed.java_class_body(fixed.SENTENCE_END_QUOTES)}]?"
    f"|[{fixed.java_class_body(fixed.SENTENCE_END_ALONE)}])\\z"
)


def blocks(c) -> Column:
    """ARRAY<STRING>: stripped blocks between runs of newlines (empty ends kept)."""
    return F.transform(F.split(col_of(c), "\n+", -1), strip)


def block_features(b: Column) -> Column:
    return F.struct(
        b.alias("b"),
        first_word(b).alias("fw"),
        last_word(b).alias("lw"),
        b.rlike(_HEADING).alias("head"),
        b.rlike(_LOWER_START).alias("lower_start"),
        # only the last two characters can decide the sentence-end pattern
        F.substring(b, -2, 2).rlike(_SENTENCE_END).alias("sent_end"),
    )


def join_rule(feats: Column, x: Column, i: Column) -> Column:
    p = F.get(feats, i - 1)
    same_word = (p["lw"] != "") & (x["fw"] != "") & (F.lower(p["lw"]) == F.lower(x["fw"]))
    prefix = x["b"].substr(F.lit(1), F.position(x["fw"], x["b"]) + F.length(x["fw"]) - 1)
    contained = prefix.contains(p["b"])
    no_heading = ~(x["head"] | p["head"])
    hyphen = (p["b"] != "") & no_heading & p["b"].endswith("-") & x["lower_start"]
    space = ((p["b"] != "") & ~p["sent_end"] & no_heading
             & (p["b"] != fixed.IMAGE_MARKER) & (x["b"] != fixed.IMAGE_MARKER))
    return (F.when(i == 0, "start")
            .when(same_word & contained, "pop")
            .when(same_word, "dup")
            .when(hyphen, "hyphen")
            .when(space, "space")
            .otherwise("break"))


def emit_block(feats: Column, rules: Column, x: Column, i: Column, at_start: Column | bool = True) -> Column:
    """Separator and text of block ``i``; ``at_start``: the array begins with
    the first block of its text."""
    rule = F.get(rules, i)
    sep = (F.when(rule == "start", "")
           .when((rule == "pop") & (i == 1) & at_start, "")
           .when(rule == "hyphen", "")
           .when(rule == "space", " ")
           .otherwise(fixed.BLANK_LINE))
    nxt = F.get(rules, i + 1)
    b = x["b"]
    text = (F.when(nxt == "pop", "")
            .when(nxt == "hyphen", b.substr(F.lit(1), F.length(b) - 1))
            .otherwise(b))
    return F.concat(sep, text)


def repair_blocks(df: DataFrame, text_col: str = "text", out_col: str = "content") -> DataFrame:
    """Add ``out_col`` with the repaired text of ``text_col`` (row-local)."""
    tmp_f, tmp_r = "__blk_feats", "__blk_rules"
    feats = df.withColumn(tmp_f, F.transform(blocks(text_col), block_features))
    ruled = feats.withColumn(tmp_r, F.transform(F.col(tmp_f), lambda x, i: join_rule(F.col(tmp_f), x, i)))
    out = ruled.withColumn(
        out_col,
        F.array_join(F.transform(F.col(tmp_f), lambda x, i: emit_block(F.col(tmp_f), F.col(tmp_r), x, i)), ""))
    return out.drop(tmp_f, tmp_r)


def block_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per block with the rule that joined it to its predecessor
    (diagnostics and tests): ``pos, block, rule``."""
    tmp_f = "__blk_feats"
    feats = df.withColumn(tmp_f, F.transform(blocks(text_col), block_features))
    ruled = feats.withColumn(
        "__rules",
        F.arrays_zip(F.transform(F.col(tmp_f), lambda x: x["b"]).alias("block"),
                     F.transform(F.col(tmp_f), lambda x, i: join_rule(F.col(tmp_f), x, i)).alias("rule")))
    return ruled.select(*[c for c in df.columns if c != text_col],
                        F.posexplode_outer("__rules").alias("pos", "r")).filter(F.col("r").isNotNull()).select(
        "*", F.col("r.block").alias("block"), F.col("r.rule").alias("rule")).drop("r")
