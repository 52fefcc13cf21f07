"""Vector tables in blocks: what the two searches share.

A search pairs blocks of queries with blocks of candidates, each of bounded
size, as cogroups; no task sees more than one block of either. Only vectors of
one length are compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most queries and candidates, on average, in a block.
QUERY_BLOCK, DATA_BLOCK = 1024, 4096


def usable(df: DataFrame, zeros: bool) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part; rows that repeat an id count once, with their least vector.

    Out: null ids, null or empty vectors, vectors with null or non-finite
    components, and zero vectors unless ``zeros``.
    """
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
    ok &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    if not zeros:
        ok &= F.exists(x, lambda c: c != 0)
    df = df.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding")).where(ok)
    return df.groupBy("vec_id").agg(F.min("embedding").alias("v")).withColumn("dim", F.size("v"))


def hashed_block(n: int):
    return F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))).cast("int")


def paired(queries: DataFrame, data: DataFrame, n_qb: int, n_db: int, fn: Callable, schema: str) -> DataFrame:
    """``fn(queries, candidates)`` on every pair of a query block ``qb`` and a candidate block ``db`` of one ``dim``."""
    q = queries.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(n_db - 1))))
    d = data.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))))
    q, d = q.toDF(*q.columns), d.toDF(*d.columns)  # both come of one table: names of their own
    keys = ["dim", "qb", "db"]
    empty = pa.schema([(n, _ARROW[t]) for n, t in (c.strip().split() for c in schema.split(","))]).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right) if left.num_rows and right.num_rows else None
        return empty if out is None else pa.table(out, schema=empty.schema)

    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(run, schema)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}


def matrix(t: pa.Table, name: str = "v") -> np.ndarray:
    a = t.column(name).combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def longs(t: pa.Table, name: str = "vec_id") -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: highest score, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
