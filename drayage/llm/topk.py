"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length. A query carries a lower bound of its k-th best
score, found on vectors of the greatest length. In a bucket that bound gives a
local cosine threshold: above one, the bucket is skipped; high, the query's
largest coordinates bound the same coordinates of any vector that can still
count; low, length alone prunes. Products of what is left are verified.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm import vectors as V
from drayage.llm.store import cut

#: Classes of length; a class of more vectors is dealt to blocks by hash of id.
CLASSES = 32
#: Local cosines from which coordinates prune better than length, and how many coordinates are used.
BY_COORDINATE, FOCUS = 0.3, 4
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def _products(x: np.ndarray, q: np.ndarray, safe: bool) -> list[int] | np.ndarray:
    """Integer products; in floating point where no partial sum can round."""
    if safe:
        return (x @ q).astype(np.int64)
    qs = [int(c) for c in q]
    return np.array([max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(r, qs)))) for r in x], np.int64)


def candidates(q: np.ndarray, q_norm: float, least: float, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of x, sorted by descending norm, that may reach ``least``."""
    if not (least > 0) or q_norm == 0:
        return np.arange(len(x)) if not (least > 0) else np.zeros(0, np.int64)
    slack = 1 - 1e-9
    t = least / (q_norm * norms[0]) * slack if norms[0] else 2.0
    if t > 1:
        return np.zeros(0, np.int64)
    rows = np.arange(np.searchsorted(-norms, -(least / q_norm) * slack, "right"))
    if t >= BY_COORDINATE:
        u = q / q_norm
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            own = least / (q_norm * norms[rows]) * slack
            reach = np.sqrt(np.maximum(0, 1 - own * own) * max(0, 1 - u[f] * u[f])) + 1e-9
            rows = rows[_within(x[rows, f] / norms[rows], u[f], own, reach)]
    return rows


def _within(p: np.ndarray, u: float, t: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether coordinate p of a unit vector allows a cosine of t or more with one whose coordinate is u.

    The angle between the two is at most arccos t, so p is at most the highest
    coordinate in that cone: one, where the axis itself is inside.
    """
    high = np.where(u >= t, 1.0, u * t + reach)
    low = np.where(-u >= t, -1.0, u * t - reach)
    return (p <= high) & (p >= low)


def _block(k: int):
    def run(left, right):
        q, x, q_id, x_id = V.matrix(left), V.matrix(right), V.longs(left), V.longs(right)
        least = left.column("least").to_numpy(zero_copy_only=False).astype(float)
        norms = np.sqrt((x * x).sum(1))
        order = np.lexsort((x_id, -norms))
        x, x_id, norms = x[order], x_id[order], norms[order]
        q_norms = np.sqrt((q * q).sum(1))
        with np.errstate(all="ignore"):
            safe = float(q_norms.max()) * float(norms.max()) < EXACT
        rows = []
        for i in range(len(q)):
            at = candidates(q[i], q_norms[i], least[i], x, norms) if safe else np.arange(len(x))
            at = at[x_id[at] != q_id[i]]
            s = _products(x[at], q[i], safe)
            top = np.lexsort((x_id[at], -s.astype(object) if not safe else -s))[:k]
            rows.append((np.full(len(top), q_id[i]), x_id[at][top], s[top]))
        return dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c).astype(np.int64) for c in zip(*rows))))

    return run


def search(table: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: its k highest integer products with the other rows.

    Components are floor(scale * x). Null or non-finite vectors take no part;
    zero vectors do. Rows that repeat a vec_id count once; ties go to the
    smaller vec_id; fewer candidates than k gives all; scores beyond a long
    saturate. (query_id, rank, vec_id, score)
    """
    x = V.usable(table, zeros=True).withColumn("v", F.transform("v", lambda c: F.when(F.abs(c) < 1e15, F.floor(c * scale).cast("double")).otherwise(c * scale)))
    x = cut(x.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))))
    spark = table.sparkSession
    cuts = x.agg(F.percentile_approx("norm", [i / CLASSES for i in range(1, CLASSES)], 10_000)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))])
    x = x.withColumn("kind", F.size(F.filter(edges, lambda c: c < F.col("norm"))))
    counts = {r["kind"]: r for r in x.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    dealt = [math.ceil(counts[c]["n"] / V.DATA_BLOCK) if c in counts else 1 for c in range(max(counts) + 1)]
    first = [sum(dealt[:c]) for c in range(len(dealt))]
    n_db, longest = sum(dealt), first[max(counts)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("kind") + 1)
    blocks = of(first) + F.pmod(F.xxhash64("vec_id"), of(dealt)).cast("int")
    n_qb = max(1, math.ceil(sum(r["q"] for r in counts.values()) / V.QUERY_BLOCK))
    data = x.select("vec_id", "v", "dim", blocks.alias("db"))
    queries = x.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim", F.lit(float("-inf")).alias("least"), V.hashed_block(n_qb).alias("qb"))
    schema = "query_id long, vec_id long, score long"
    seed = data.where(F.col("db") == longest).withColumn("db", F.lit(0))
    bound = V.paired(queries, seed, n_qb, 1, _block(k), schema).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    queries = cut(queries.drop("least").join(bound.select(F.col("query_id").alias("vec_id"), F.col("least").cast("double")), "vec_id", "left").fillna(float("-inf"), ["least"]))
    return V.ranked(V.paired(queries, data, n_qb, n_db, _block(k), schema), k)
