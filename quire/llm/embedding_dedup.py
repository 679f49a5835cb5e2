"""Embedding near-dedup with randomised-rotation binary codes.

Every unit vector is rotated by one random orthogonal matrix and stored as the
signs of its coordinates, with the correction factor ``<o_bar, o>``, the inner
product of the vector and its code.  For another vector ``q`` the value
``<o_bar, q> / <o_bar, o>`` is an unbiased estimate of ``<o, q>``, and its
error stays below ``EPS * sqrt((1 - f**2) / f**2 / (D - 1))`` with ``f`` the
factor, except with a chance of about 1e-9 at ``EPS = 6``.  Pairs whose upper
confidence bound reaches the threshold are computed again in double precision;
all others are decided by their codes.

Scale.  Equal vectors collapse first.  The distinct ones form hash blocks of
``block_rows``, and a task compares two blocks, with memory bounded by the
block.  A block pair returns link counts and a spanning forest, at most a row
for each of its vectors, never its pairs.  The comparison of all pairs is
quadratic in the number of distinct vectors; that is what an exact answer for
all links takes where the vectors have no structure that would allow to skip
blocks (see the README).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import connected_components, stash
from quire.llm.simhash_dedup import spanning_forest

THRESHOLD = 0.9
EPS = 6.0
BLOCK_ROWS = 8192
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors of unit vectors (rows)."""
    turned = unit @ rot.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """Codes as rows of +-1/sqrt(dim)."""
    return (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def linked_pairs(left: np.ndarray, codes: np.ndarray, factors: np.ndarray, right: np.ndarray, rot: np.ndarray,
                 threshold: float, same: bool, rows: int = 1024):
    """Index pairs with cosine >= ``threshold`` in double precision; of a
    block with itself (``same``) each pair once.  Rows are unit vectors."""
    dim = left.shape[1]
    turned = (right @ rot.T).astype(np.float32)
    error = EPS * np.sqrt(np.maximum(0.0, 1 - factors ** 2) / max(1, dim - 1)) / factors
    # estimate + error >= threshold, with room for single precision
    least = ((threshold - error - 1e-4) * factors).astype(np.float32)
    for lo in range(0, len(left), rows):
        est = signs(codes[lo:lo + rows], dim) @ turned.T
        i, j = np.nonzero(est >= least[lo:lo + rows, None])
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 18):
            a, b = i[part:part + (1 << 18)], j[part:part + (1 << 18)]
            keep = np.einsum("ij,ij->i", left[a], right[b]) >= threshold
            yield a[keep], b[keep]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id",
                 vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """(id, n_links, component), one row per input row.

    ``n_links`` counts the other rows at cosine >= ``threshold``, ``component``
    is the smallest id that links reach, the row's own included.  Vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing, vectors of different length neither.  Equal vectors link at 1,
    repeated rows count as rows of their own, null ids never become a
    component's name, an empty table gives no rows.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0),
                       F.lit(False))
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    distinct = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    distinct = stash(distinct.withColumn("node", F.monotonically_increasing_id()), "near-vectors")
    dims = {r.d: r["count"] for r in distinct.groupBy(F.size("v").alias("d")).count().collect()}  # vector lengths
    blocks = {d: -(-n // block_rows) for d, n in dims.items()}
    block = F.coalesce(*[F.when(F.size("v") == d, F.pmod(F.xxhash64("node"), F.lit(b))) for d, b in blocks.items()],
                       F.lit(0)).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        # scaled by the largest component first: squares can neither overflow nor vanish
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        codes, factors = encode(x, rotation(x.shape[1], seed))
        return pd.DataFrame({"dim": [x.shape[1]], "block": [pdf["block"].iloc[0]], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()],
                             "weights": [pdf["n"].to_numpy(np.int64).tobytes()], "unit": [x.tobytes()],
                             "codes": [codes.tobytes()], "factors": [factors.tobytes()]})

    packed = stash(distinct.select(F.size("v").alias("dim"), block.alias("block"), "node", "n", "v").groupBy("dim", "block").applyInPandas(
        pack, "dim int, block int, nodes binary, weights binary, unit binary, codes binary, factors binary"), "near-blocks")
    others = F.coalesce(*[F.when(F.col("dim") == d, F.sequence(F.lit(0), F.lit(b - 1))) for d, b in blocks.items()],
                        F.array(F.lit(0)))
    pairs = packed.select("*", F.explode(others).alias("other")).withColumns({
        "lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        a, b = pdf.iloc[0], pdf.iloc[-1]
        dim = int(a["dim"])
        load = lambda r: (np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["weights"], np.int64),
                          np.frombuffer(r["unit"]).reshape(-1, dim))
        (na, wa, xa), (nb, wb, xb) = load(a), load(b)
        same = a["block"] == b["block"]
        codes = np.frombuffer(a["codes"], np.uint8).reshape(len(na), -1)
        la, lb, found = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64), []

        def links():
            for i, j in linked_pairs(xa, codes, np.frombuffer(a["factors"]), xb, rotation(dim, seed), threshold, same):
                np.add.at(la, i, wb[j])
                np.add.at(la if same else lb, j, wa[i])
                yield i, (j if same else j + len(na))

        nodes = na if same else np.concatenate((na, nb))
        found = spanning_forest(len(nodes), links())
        counts = la if same else np.concatenate((la, lb))
        at = np.flatnonzero(counts)
        e = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate((nodes[at], nodes[e[:, 0]])),
                             "b": np.concatenate((nodes[at], nodes[e[:, 1]])),
                             "links": np.concatenate((counts[at], np.zeros(len(e), np.int64)))})

    found = stash(pairs.groupBy("dim", "lo", "hi").applyInPandas(compare, "a long, b long, links long"), "near-links")
    cc = connected_components(found.where("links = 0"))
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    rooted = distinct.join(cc, "node", "left").join(counts, "node", "left").select(
        "v", "n", "first_id", "links", F.coalesce("component", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    classes = rooted.join(first, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    out = rows.join(classes, "v", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "id").alias("component"))
