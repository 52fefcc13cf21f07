"""Approximate maximum inner product search with score-aware quantisation.

Vectors are product-quantised to four bits per pair of coordinates. Codebooks
and codes minimise an anisotropic loss: the residual's part parallel to the
vector, which changes the scores of the queries that matter, weighs ``eta``
times its orthogonal part. A scan of code tables scores every candidate of a
block; the best go to an exact rerank in double precision.

Codebooks are fitted on a bounded sample (``sample`` vectors, by hash of id);
every vector is indexed and scanned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm import vectors as V
from drayage.llm.store import cut

CENTERS, SUB = 16, 2


def eta(dim: int, t: float = 0.2) -> float:
    """Weight of the parallel residual for an inner-product threshold of t times the norm."""
    return max(1.0, (dim - 1) * t * t / (1 - t * t))


def _cuts(dim: int) -> list[slice]:
    return [slice(a, min(a + SUB, dim)) for a in range(0, dim, SUB)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(x: np.ndarray, u: np.ndarray, books: list[np.ndarray], w: float, codes: np.ndarray, par: np.ndarray, fit: bool = False) -> None:
    """One coordinate descent over the subspaces; ``par``: each row's parallel residual."""
    for m, s in enumerate(_cuts(x.shape[1])):
        xs, us, c = x[:, s], u[:, s], books[m]
        rest = par - ((xs - c[codes[:, m]]) * us).sum(1)
        if fit:
            for k in range(len(c)):
                own = codes[:, m] == k
                if own.any():
                    a = np.eye(xs.shape[1]) * own.sum() + w * us[own].T @ us[own]
                    b = xs[own].sum(0) + w * (us[own] * (rest[own] + (xs[own] * us[own]).sum(1))[:, None]).sum(0)
                    c[k] = np.linalg.solve(a, b)
        r = xs[:, None, :] - c[None]
        p = np.einsum("nkd,nd->nk", r, us)
        codes[:, m] = (np.einsum("nkd,nkd->nk", r, r) + w * (rest[:, None] + p) ** 2).argmin(1)
        par[:] = rest + p[np.arange(len(x)), codes[:, m]]


def _start(x: np.ndarray, u: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, par = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x))
    for m, s in enumerate(_cuts(x.shape[1])):
        r = x[:, s][:, None, :] - books[m][None]
        codes[:, m] = np.einsum("nkd,nkd->nk", r, r).argmin(1)
        par += ((x[:, s] - books[m][codes[:, m]]) * u[:, s]).sum(1)
    return codes, par


def fit(x: np.ndarray, rounds: int = 6) -> list[np.ndarray]:
    """Codebooks for the rows of x, sixteen centres for each pair of coordinates."""
    rng, u, w = np.random.default_rng(7), _unit(x), eta(x.shape[1]) - 1
    books = [x[rng.choice(len(x), CENTERS, replace=len(x) < CENTERS), s].copy() for s in _cuts(x.shape[1])]
    codes, par = _start(x, u, books)
    for _ in range(rounds):
        _assign(x, u, books, w, codes, par, fit=True)
    return books


def encode(x: np.ndarray, books: list[np.ndarray], rounds: int = 2) -> np.ndarray:
    """Four-bit codes, two to a byte."""
    u, w = _unit(x), eta(x.shape[1]) - 1
    codes, par = _start(x, u, books)
    for _ in range(rounds):
        _assign(x, u, books, w, codes, par)
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(x), 1), np.uint8)])
    return codes[:, ::2] << 4 | codes[:, 1::2]


def scan(q: np.ndarray, packed: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Estimated products of every query with every coded vector."""
    tables = [np.zeros((len(q), CENTERS))] * (2 * packed.shape[1])
    for m, s in enumerate(_cuts(q.shape[1])):
        tables[m] = q[:, s] @ books[m].T
    out = np.zeros((len(q), len(packed)), np.float32)
    for p in range(packed.shape[1]):
        both = (tables[2 * p][:, :, None] + tables[2 * p + 1][:, None, :]).reshape(len(q), -1).astype(np.float32)
        out += both.take(packed[:, p], axis=1)
    return out


def _block(books: dict[int, list[np.ndarray]], k: int, short: int):
    def run(left, right):
        right = right.sort_by("vec_id")  # so that ties fall to smaller ids
        q, x, q_id, x_id = V.matrix(left), V.matrix(right), V.longs(left), V.longs(right)
        b = books[q.shape[1]]
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        near = scan(q, codes, b)
        r = min(len(x), short + 1)
        rows = []
        for i in range(len(q)):
            if r < len(x):
                least = np.partition(near[i], len(x) - r)[len(x) - r]
                best = np.flatnonzero(near[i] > least)
                best = np.concatenate([best, np.flatnonzero(near[i] == least)[: r - len(best)]])
            else:
                best = np.arange(len(x))
            best = best[x_id[best] != q_id[i]]
            s = x[best] @ q[i]
            top = np.lexsort((x_id[best], -s))[:k]
            rows.append((np.full(len(top), q_id[i]), x_id[best][top], s[top]))
        return dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*rows))))

    return run


def search(table: DataFrame, every: int = 20, k: int = 20, sample: int = 20_000, short: int = 200) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: its k nearest found (query_id, rank, vec_id, score).

    Null, zero or non-finite vectors take no part; rows that repeat a vec_id
    count once; an empty table, or a lone vector, gives no rows; fewer
    candidates than k gives all. ``short`` candidates of each block of about
    4,096 are reranked, and of equals those with the smaller ids.
    """
    x = cut(V.usable(table, zeros=False))
    spark = table.sparkSession
    sizes = {r["dim"]: (r["n"], r["q"]) for r in x.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = {}
    for dim, (n, _) in sizes.items():
        most = min(sample, max(CENTERS, (1 << 22) // dim))
        got = x.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n)) + 1))
        rows = np.array([r["v"] for r in got.select("v").limit(2 * most).collect()] or [r["v"] for r in x.where(F.col("dim") == dim).select("v").limit(most).collect()], float)
        books[dim] = fit(rows)
    shared = spark.sparkContext.broadcast(books)  # at most 16 centres a coordinate for each length of vector

    @F.pandas_udf("binary")
    def code(v):
        import pandas as pd

        out = [b""] * len(v)
        by: dict[int, list[int]] = {}
        for i, a in enumerate(v):
            by.setdefault(len(a), []).append(i)
        for dim, at in by.items():
            for i, c in zip(at, encode(np.stack([v.iloc[i] for i in at]).astype(float), shared.value[dim])):
                out[i] = c.tobytes()
        return pd.Series(out)

    n, nq = sum(s[0] for s in sizes.values()), sum(s[1] for s in sizes.values())
    n_db, n_qb = math.ceil(n / V.DATA_BLOCK), max(1, math.ceil(nq / V.QUERY_BLOCK))
    data = x.select("vec_id", "v", "dim", code("v").alias("code"), V.hashed_block(n_db).alias("db"))
    queries = x.where(F.col("vec_id") % every == 0).withColumn("qb", V.hashed_block(n_qb))
    run = lambda left, right: _block(shared.value, k, short)(left, right)
    return V.ranked(V.paired(queries, data, n_qb, n_db, run, "query_id long, vec_id long, score double"), k)
