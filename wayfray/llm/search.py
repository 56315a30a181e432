"""Exact top-k inner-product search by pivot-table elimination (operator 8).

Components become floor(scale * x), exactly, however large. Vectors of a dimension are
classed by the power of two of their length; one more component makes all candidates of a
class equally long, which turns the largest inner product into the smallest distance. A
table, made once and kept with the vectors, holds their distances to the class's pivots;
the largest difference between a query's and a vector's row bounds their distance from
below. A query evaluates candidates in the order of that bound, a batch at a time, and
stops when the next bound exceeds its k-th best distance: exactly the k best, ties to the
smaller id.

Bounds are floats of vectors scaled to their class, with an allowance of ALLOWED times the
class's length, far above the rounding of distances of such lengths (4e-7). Scores are
integers: 64-bit where a block's lengths prove that they suffice, else of any size. A score
beyond 64 bits is returned as the nearest 64-bit number; ranks go by the true score.

Queries meet vectors in blocks (``query_block`` by ``vector_block`` rows of 64 dimensions,
fewer of more); each pair of blocks is one bounded piece of work whose k best go on to a
per-query merge. Blocks are as large as a task's memory lets them be, as a vector is sent
once for each block of queries and a query once for each block of vectors; smaller tables
are dealt to up to SPREAD blocks of ``least_block`` rows, for work to be shared.

Pivots: the longest of a bounded sample and then, one by one, the vector farthest from those
taken (``sample`` rows, the smallest hashes of id and vector); any pivots give exact results.

Defined cases: vectors that are null, empty or hold a null, NaN or infinite component take
no part; a query meets candidates of its own dimension only; rows that share the query's id
are not its candidates, and the least of their vectors of a dimension is the query; repeated
rows are candidates each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import frozen


#: Share of a class's length by which bounds may be off.
ALLOWED = 1e-6
#: Blocks that vectors are dealt to though they fit fewer.
SPREAD = 32
LONG = 2**63 - 1


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>), d: the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).alias("id"), v.alias("v")).withColumn("d", F.size("v"))


def exact(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers of any size; a float of 2 ** 53 or more is whole already."""
    return np.array([[int(c) * scale if abs(c) >= 2.0**53 else math.floor(c * scale) for c in row] for row in x.tolist()], object).reshape(x.shape)


def scaled(x: np.ndarray, scale: int, c) -> np.ndarray:
    """floor(scale * x) / 2 ** c as floats; c: one number, or one by row."""
    with np.errstate(over="ignore"):
        c = np.broadcast_to(np.asarray(c), len(x))[:, None]
        return np.where(np.abs(x) < 2.0**60, np.ldexp(np.floor(x * scale), -c), np.ldexp(x, scale.bit_length() - 1 - c))


def length_class(x: np.ndarray, scale: int) -> np.ndarray:
    """For each row the c with length of floor(scale * x) under 2 ** c, and no less than half of it unless 0."""
    e = np.maximum(np.frexp(np.abs(x).max(1))[1] + scale.bit_length(), 1)
    return np.maximum(np.frexp(np.sqrt((scaled(x, scale, e) ** 2).sum(1)))[1] + e, 1)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of a sample of augmented vectors."""
    if not len(sample):
        return sample
    at = [int((sample**2).sum(1).argmax())]
    near = np.full(len(sample), np.inf)
    while len(at) < min(n, len(sample)):
        near = np.minimum(near, ((sample - sample[at[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        at.append(int(near.argmax()))
    return sample[at]


def augmented(x: np.ndarray) -> np.ndarray:
    """Rows shorter than 1 with one more component, which makes their length 1."""
    return np.c_[x, np.sqrt(np.maximum(1 - (x**2).sum(1), 0))]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def block_top(q_ids, q, q_scaled, q_table, ids, x, table, k: int, unit: int, batch: int = 256) -> Iterator[tuple]:
    """Each query's k best of a block, as (query, id, score). A score is 2 ** unit times the product of the scaled vectors."""
    allowed = ALLOWED * math.sqrt(2 * max(1.0, x.shape[1] / 64))
    for i in range(len(q_ids)):
        bound = np.abs(table - q_table[i]).max(1)
        order = np.argsort(bound, kind="stable")
        best: list[tuple[int, object]] = []  # (-score, id), best first
        at, base = 0, float((q_scaled[i] ** 2).sum()) + 1
        while at < len(order):
            if len(best) == k:
                s = best[-1][0]
                cut = max(0, s.bit_length() - 60)
                if bound[order[at]] > math.sqrt(max(0.0, base + 2 * math.ldexp(s >> cut, cut - unit))) + allowed:
                    break
            part = order[at : at + batch]
            at += batch
            part = part[ids[part] != q_ids[i]]
            if not len(part):
                continue
            found = x[part] @ q[i]
            if len(found) > k and found.dtype != object:  # ties of the k-th stay
                part, found = (y[found >= np.partition(found, len(found) - k)[len(found) - k]] for y in (part, found))
            best = sorted([*best, *zip((-found).tolist(), ids[part].tolist(), strict=True)])[:k]
        for s, j in best:
            yield q_ids[i], j, -s


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, pivots: int = 32, sample: int = 2000, query_block: int = 8192, vector_block: int = 32768, least_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best. is_query: a condition on ``id``. scale: a power of two."""
    if scale & (scale - 1):
        raise ValueError("scale must be a power of two, so that products with it are exact")
    spark = vectors.sparkSession
    base = taking_part(vectors, id_col, vector_col)
    kind = dict(base.dtypes)["id"]
    few = base.orderBy(F.xxhash64(F.col("id").cast("string"), "v"), "id").limit(sample).collect()
    chosen: dict[tuple[int, int], np.ndarray] = {}  # at most the sample's classes, each of at most ``pivots`` rows
    for d in {r["d"] for r in few}:
        x = np.array([r["v"] for r in few if r["d"] == d], float).reshape(-1, d)
        c = length_class(x, scale)
        for one in np.unique(c).tolist():
            chosen[d, one] = choose_pivots(augmented(scaled(x[c == one], scale, one)), pivots)
    known = spark.sparkContext.broadcast(chosen)

    def pivots_of(d: int, c: int) -> np.ndarray:
        p = known.value.get((d, c))
        return np.zeros((1, d + 1)) if p is None else p

    def tabled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, f in frame.groupby("d"):
                x = np.stack(f["v"].to_numpy())
                c = length_class(x, scale)
                for one in np.unique(c).tolist():
                    t = _distances(augmented(scaled(x[c == one], scale, one)), pivots_of(int(d), one))
                    yield f[c == one].assign(c=one, t=list(t))[["id", "v", "d", "c", "t"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    all_ = frozen(base.mapInPandas(tabled, f"id {kind}, v array<double>, d int, c int, t array<double>"))
    once = all_.where(is_query).groupBy("id", "d").agg(F.min("v").alias("v"))  # a query given twice is one
    wide = F.greatest(F.col("d"), F.lit(64)) / 64
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.count("*") * wide / n)).cast("int")
    n_x = F.greatest(blocks(vector_block), F.least(blocks(least_block), F.lit(SPREAD)))
    grid = all_.groupBy("d", "c").agg(n_x.alias("n_x")).join(once.groupBy("d").agg(blocks(query_block).alias("n_q")), "d")
    grid = frozen(grid)  # a row per dimension and class, of which floats have some 2,100
    place = lambda n: F.pmod(F.xxhash64(F.col("id").cast("string"), "v", F.lit(7)), n).cast("int")
    left = all_.join(F.broadcast(grid), ["d", "c"]).withColumn("xb", place(F.col("n_x"))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1))).select("d", "c", "qb", "xb", "id", "v", "t")
    right = once.join(F.broadcast(grid), "d").withColumn("qb", place(F.col("n_q"))).withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1)))
    right = right.select(*(F.col(c).alias(c) for c in ("d", "c", "qb", "xb", "id", "v")))  # names of its own beside left's

    def meet(key, lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(lhs) and len(rhs):
            d, c = int(key[0]), int(key[1])
            p, ids, table = pivots_of(d, c), lhs["id"].to_numpy(), np.stack(lhs["t"].to_numpy())
            xs, qs = np.stack(lhs["v"].to_numpy()), np.stack(rhs["v"].to_numpy())
            own = length_class(qs, scale)
            integers: dict[bool, np.ndarray] = {}
            for one in np.unique(own).tolist():
                mine = np.flatnonzero(own == one)
                fits = c + one <= 62  # no inner product, nor a part of it, exceeds the product of the lengths
                if fits not in integers:
                    integers[fits] = np.floor(xs * scale).astype(np.int64) if fits else exact(xs, scale)
                q = np.floor(qs[mine] * scale).astype(np.int64) if fits else exact(qs[mine], scale)
                small = scaled(qs[mine], scale, one)
                q_table = _distances(np.c_[small, np.zeros(len(small))], p)
                rows += block_top(rhs["id"].to_numpy()[mine], q, small, q_table, ids, integers[fits], table, k, one + c)
        far = lambda s: (s + (1 << 2200)).to_bytes(288, "big") if abs(s) >= LONG else None
        out = [(a, b, max(-LONG - 1, min(LONG, s)), far(s)) for a, b, s in rows]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "far"])

    near = left.groupBy("d", "c", "qb", "xb").cogroup(right.groupBy("d", "c", "qb", "xb")).applyInPandas(meet, f"query_id {kind}, vec_id {kind}, score long, far binary")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("far").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
