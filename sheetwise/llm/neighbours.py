"""Approximate nearest neighbours by largest inner product, over randomly rotated one-bit codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks_for, cut, table

#: Rows that centres are fitted on, at most; every row is indexed.
SAMPLE = 16_384
#: Rows for each centre, and centres at most; they only tighten the codes, and are broadcast (2 MB at 64 dimensions).
CENTRE_ROWS, CENTRES = 512, 4096
#: Standard deviations of the estimate that its error bound spans.
SPAN = 1.9
#: Bits of a rotated query's components; its products with packed codes are sums of bit counts.
PLANES = 8
#: Rows, and queries, that one task compares.
BLOCK, QUERIES = 8192, 16384


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means by Lloyd's steps from evenly spaced rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(8):
        own = np.argmin((c * c).sum(1)[None] - 2 * sample @ c.T, axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def encode(x: np.ndarray, c: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x of cells with centres c -> packed signs of the rotated residuals, their norms, and the codes' own alignment."""
    r = x - c
    norm = np.linalg.norm(r, axis=1)
    unit = (r / np.maximum(norm, 1e-300)[:, None]) @ turn
    bits = unit > 0
    align = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    bits = np.pad(bits, ((0, 0), (0, -x.shape[1] % 64)))
    return np.packbits(bits, axis=1), norm, np.where(norm > 0, align, 1.0)


def estimates(codes: np.ndarray, norm: np.ndarray, align: np.ndarray, base: np.ndarray, q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of a query q with coded rows, from packed bits and scalars alone, and the half-width of their error bounds.

    codes: 64 bits a word, word by word (words, rows); base: the query's products with the rows' centres. The rotated query is
    rounded to PLANES bits a component, so that its product with the signs is a sum of bit counts, one for each plane and word.
    """
    dim = len(q)
    turned = q @ turn
    low = turned.min()
    step = max((turned.max() - low) / (2**PLANES - 1), 1e-300)
    levels = np.rint((turned - low) / step).astype(np.int64)
    bits = np.pad((levels[None] >> np.arange(PLANES)[:, None]) & 1, ((0, 0), (0, -dim % 64))).astype(np.uint8)
    planes = np.packbits(bits, axis=1).view(np.uint64)
    # Levels of the components whose sign is set.
    up = np.zeros(codes.shape[1], np.int64)
    ones = np.zeros(codes.shape[1], np.int64)
    for w, word in enumerate(codes):
        ones += np.bitwise_count(word)
        for k in range(PLANES):
            up += np.bitwise_count(word & planes[k, w]).astype(np.int64) << k
    # Sum over components of sign * (low + step * level).
    got = (step * (2 * up - levels.sum()) + low * (2 * ones - dim)) / np.sqrt(dim)
    off = np.linalg.norm(turned - low - step * levels)
    size = np.linalg.norm(q)
    err = norm * (size * SPAN * np.sqrt(np.maximum(1 / align**2 - 1, 0) / max(dim - 1, 1)) + off / align)
    return norm * got / align + base, err + 1e-9


def _search(dim: int, turn: np.ndarray, cents: np.ndarray, top: int):
    def block(p: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "scored": pd.Series(dtype="int64")})
        if not len(p) or not len(qs):
            return none
        x = np.stack(p["vec"].to_numpy()).astype(np.float64)
        codes = np.ascontiguousarray(np.frombuffer(b"".join(p["code"]), np.uint64).reshape(len(p), -1).T)
        norm, align, cell, ids = (p[c].to_numpy() for c in ("norm", "align", "cell", "vec_id"))
        out = []
        for q, own, line in zip(qs["vec"], qs["query_id"].tolist(), qs["line"].tolist()):
            q = np.asarray(q, np.float64)
            est, err = estimates(codes, norm, align, (cents @ q)[cell], q, turn)
            reach = np.where(ids != own, est + err, -np.inf)
            # The best by estimate are scored first; with rows known from elsewhere they give the score to be reached.
            n = min(2 * top, len(reach))
            near = np.argpartition(-reach, n - 1)[:n]
            near = near[reach[near] > -np.inf]
            score = x[near] @ q
            if len(near) >= top:
                line = max(line, np.partition(score, -top)[-top])
            rest = np.flatnonzero(reach >= line)
            near = np.union1d(near, rest)
            near = near[ids[near] != own]
            score = (x[near] * q).sum(axis=1)
            scored = len(near)
            best = np.lexsort((ids[near], -score))[:top]
            if len(best):
                out.append((np.full(len(best), own), ids[near[best]], score[best], np.full(len(best), scored)))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "scored"), map(np.concatenate, zip(*out))))) if out else none

    return lambda key, p, qs: block(p, qs)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """vectors and queries (vec_id, vec) -> the best rows for each query: query_id, rank, vec_id, score.

    Every row is indexed: coded by the signs of its rotated offset from the nearest centre, with the offset's norm and the
    code's alignment as correction scalars. A query's products with the sample give it a score to be reached. Every block of rows meets every part of the queries; there, bits give estimates
    with error bounds, and only rows whose upper bound reaches that score, or that of the block's best by estimate, are scored on their
    vectors. scored: how many rows of the row's block were.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part. Rows
    with a query's own vec_id are never its candidates; a vec_id that comes several times counts with its best score, and
    a query that comes several times is answered once, for the largest of its vectors; rows without a vec_id neither ask nor are found. Equal scores: smaller vec_id.
    Only vec_id and vec are read, so other columns can have any name. Empty input: no rows.
    """
    spark = vectors.sparkSession
    fine = F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0) & F.col("vec_id").isNotNull()
    tidy = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")).where(fine)
    rows, asked = tidy(vectors), tidy(queries)
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    schema = "query_id long, rank int, vec_id long, score double, scored long"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths["dim"], lengths["n"]
    rows, asked = rows.where(F.size("vec") == dim), asked.where(F.size("vec") == dim)
    k = int(min(CENTRES, max(1, round(n / CENTRE_ROWS))))
    # A bounded sample, the same on every run; only centres come from it.
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * SAMPLE / n)) + 1)
    taken = picked.orderBy("vec_id", F.xxhash64("vec")).select("vec_id", "vec").limit(SAMPLE).collect() or [rows.select("vec_id", "vec").first()]
    sample, known = np.array([r["vec"] for r in taken]), np.array([r["vec_id"] for r in taken])
    # One row of each id, so that the top-th best of them is a score that top different rows reach.
    single = np.unique(known, return_index=True)[1]
    k = min(k, len(sample))
    cents, turn = centres(sample, k), rotation(dim)
    half = (cents * cents).sum(1) / 2

    def index(batches):
        for p in batches:
            if len(p):
                x = np.stack(p["vec"].to_numpy())
                cell = np.argmax(x @ cents.T - half, axis=1)
                codes, norm, align = encode(x, cents[cell], turn)
                yield pd.DataFrame({"vec_id": p["vec_id"], "vec": p["vec"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes], "norm": norm, "align": align})

    def reached(batches):
        few, names = sample[single], known[single]
        for p in batches:
            line = np.full(len(p), -np.inf)
            if len(p) and len(few) > top:
                score = np.stack(p["vec"].to_numpy()) @ few.T
                score[names[None] == p["query_id"].to_numpy()[:, None]] = -np.inf
                line = np.partition(score, -top, axis=1)[:, -top]
                line = line - 1e-9 * np.abs(line)  # products may round otherwise there
            yield p.assign(line=line)

    coded = cut(rows.mapInPandas(index, "vec_id long, vec array<double>, cell int, code binary, norm double, align double"))
    asked = asked.groupBy("vec_id").agg(F.max("vec").alias("vec")).withColumnRenamed("vec_id", "query_id")
    once = cut(asked.mapInPandas(reached, "query_id long, vec array<double>, line double"))
    blocks, parts = blocks_for(n, BLOCK), blocks_for(once.count(), QUERIES)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = coded.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    routed = once.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    found = dealt.groupBy("block", "part").cogroup(routed.groupBy("block", "part")).applyInPandas(_search(dim, turn, cents, top), "query_id long, vec_id long, score double, scored long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("scored").alias("scored"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score", "scored")


def op1_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every 20th row of embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
