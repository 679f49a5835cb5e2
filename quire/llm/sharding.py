"""Sharding by jump consistent hashing.

The shard of a key is found by a pseudo-random walk over shard numbers: from
``b`` the walk jumps to ``floor((b + 1) * 2**31 / (r + 1))`` with ``r`` the top
31 bits of the next value of a 64-bit linear congruential generator, and the
shard is the last place below the number of shards.  There is no ring table;
with one more shard a key either stays or moves to the new shard.

Everything is built of SQL functions.  The generator works modulo 2**64 in
decimals of 38 digits, which hold the product of two such numbers exactly.

Scale.  A shard's rows get gapless slots without gathering the shard: equal
rows are counted first, (shard, part) groups are numbered in parallel, and the
parts' offsets are a running sum over ``parts`` numbers per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS

# fixed values of the published jump hash
MULTIPLIER = 2862933555777941757
MODULUS = 1 << 64
TOP = 31

OVERHEAD_BYTES = 16
PARTS = 64


def stable_key(key: Column) -> Column:
    """Non-negative 60-bit key: the first 15 hex digits of the MD5 of the
    key as text; a null key is the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")


def jump_shard(key: Column, shards: int) -> Column:
    """Struct of ``shard`` among ``shards`` and ``grown_shard`` among
    ``shards + 1`` of a stable key, found in one walk."""
    big = lambda v: F.lit(str(v)).cast("decimal(20,0)")

    def step(s: Column) -> Column:
        # product below 2**126: 38 digits
        nxt = ((s["key"] * big(MULTIPLIER) + F.lit(1).cast("decimal(1,0)")) % big(MODULUS)).cast("decimal(20,0)")
        # r + 1 = floor(key / 2**33) + 1 is at most 2**31
        rank = F.floor(nxt / big(1 << (64 - TOP))).cast("double") + F.lit(1.0)
        return F.struct(F.floor((s["at"] + F.lit(1.0)) * (F.lit(float(1 << TOP)) / rank)).cast("double").alias("at"),
                        nxt.alias("key"), s["at"].alias("last"),
                        F.when(s["at"] < shards, s["at"]).otherwise(s["keep"]).alias("keep"))

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start,
                           lambda s, _: F.when(s["at"] <= shards, step(s)).otherwise(s))

    start = F.struct(F.lit(0.0).alias("at"), key.cast("decimal(20,0)").alias("key"), F.lit(0.0).alias("last"), F.lit(0.0).alias("keep"))
    # the first jump is from 0, every jump moves on by one at least; few keys need more than 2 ln n of them
    quick = walk(start, min(shards + 2, 24))
    full = F.when(quick["at"] <= shards, walk(quick, shards + 2)).otherwise(quick) if shards + 2 > 24 else quick
    return F.transform(F.array(full), lambda s: F.struct(
        s["keep"].cast("int").alias("shard"), s["last"].cast("int").alias("grown_shard")))[0]


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """(id, size, text_crc32, shard, grown_shard, slot), one row per input row.

    ``size`` is the UTF-8 bytes of the text plus 16 and ``text_crc32`` the
    unsigned CRC-32 of those bytes (a null text has none: 16 and 0).  Only the
    id decides the shard, a null id like an empty one.  Slots of a shard run
    from 0 without gaps in the order of (part, id, crc, size), so reruns agree;
    rows equal in all of these take neighbouring slots.  An empty table gives
    no rows; other columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].alias("id"), (F.length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    # equal rows are one row with a count: a repeated id cannot fill a group below
    rows = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = rows.withColumn("__at", jump_shard(stable_key(F.col("id")), shards)).select(
        "id", "size", "text_crc32", "n", "__at.shard", "__at.grown_shard",
        (F.conv(F.substring(F.md5(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "text_crc32", "size")]).cast("binary")), 1, 8),
                16, 10).cast("long") % parts).alias("part"))
    order = "PARTITION BY shard, part ORDER BY id, text_crc32, size"
    rows = rows.withColumn("before", F.expr(f"sum(n) OVER ({order} ROWS UNBOUNDED PRECEDING) - n"))
    # shards x parts rows
    offsets = rows.groupBy("shard", "part").agg(F.sum("n").alias("rows")).withColumn(
        "offset", F.expr("sum(rows) OVER (PARTITION BY shard ORDER BY part ROWS UNBOUNDED PRECEDING) - rows")).drop("rows")
    if shards * parts <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    first = F.col("offset") + F.col("before")
    rows = rows.join(offsets, ["shard", "part"])
    # repeats are unfolded 4096 at a time
    chunk = F.explode(F.sequence(first, first + F.col("n") - 1, F.lit(4096).cast("long")))
    rows = rows.select("id", "size", "text_crc32", "shard", "grown_shard", (first + F.col("n")).alias("end"), chunk.alias("lo"))
    slot = F.explode(F.sequence("lo", F.least(F.col("lo") + 4096, F.col("end")) - 1))
    return rows.select("id", "size", "text_crc32", "shard", "grown_shard", slot.alias("slot"))


# --- the same in DuckDB ------------------------------------------------------

def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def oracle_sql(docs: str, shards: int, parts: int = PARTS) -> str:
    """The assignment over a SQL expression ``docs`` with doc_id and text."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + {OVERHEAD_BYTES} AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM ({docs})),
 c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
         lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d),
 walk AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::HUGEINT AS k, 0::DOUBLE AS b, 0::DOUBLE AS last
  FROM (SELECT DISTINCT doc_id FROM c)
  UNION ALL
  SELECT doc_id, nk, floor((b + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE)), b
  FROM (SELECT *, (k * {MULTIPLIER}::HUGEINT + 1) % {MODULUS}::HUGEINT AS nk FROM walk WHERE b <= {shards})),
 placed AS (SELECT doc_id, max(b) FILTER (WHERE b < {shards}) AS shard, max(b) FILTER (WHERE b <= {shards}) AS grown FROM walk GROUP BY doc_id)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY
         ('0x' || substr(md5(coalesce(c.doc_id::VARCHAR, '') || '/' || text_crc32 || '/' || size), 1, 8))::BIGINT % {parts},
         c.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard
FROM c JOIN placed ON c.doc_id IS NOT DISTINCT FROM placed.doc_id
"""
