"""Similarity of names: guards as columns, the sequence ratio as an Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for p in zip(a, b):
        if None in p:
            out.append(None)
            continue
        if p not in seen:
            seen[p] = SequenceMatcher(None, *p).ratio()
        out.append(seen[p])
    return pd.Series(out, dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal, 0.92 where a long part contains the other, else the sequence ratio of a with b."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (F.contains(a, b) | F.contains(b, a)) & (short >= 6) & (short / long >= 0.55)
    return F.when(short == 0, 0.0).when(a == b, 1.0).when(inside, 0.92).otherwise(_ratio(a, b))


#: Scores that round to the same four decimals differ by less.
_SLACK = 2e-4
#: Names that a machine word has a bit for each character of.
_WORD = 64


def _shared(queries: list[str], names: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each query with each name: what matched blocks are a part of.

    One bit for each character of a name, all pairs at once; names beyond a
    machine word take Python's integers.
    """
    width = max(map(len, names), default=0)
    kind, width = (np.uint64, _WORD) if width <= _WORD else (object, width)
    ids = {c: i + 1 for i, c in enumerate(sorted(set().union(*names)))}
    at = [[0] * len(names) for _ in range(len(ids) + 1)]
    for j, n in enumerate(names):
        for k, c in enumerate(n):
            at[ids[c]][j] |= 1 << k
    bits, full = np.array(at, dtype=kind), (1 << width) - 1
    full = np.uint64(full) if kind is np.uint64 else full
    free = np.full((len(queries), len(names)), full, dtype=kind)
    asked = np.zeros((len(queries), max(map(len, queries), default=0)), dtype=np.int64)
    for i, q in enumerate(queries):
        asked[i, : len(q)] = [ids.get(c, 0) for c in q]
    for column in asked.T:
        hit = free & bits[column]
        free = (free + hit | free ^ hit) & full
    ones = np.bitwise_count(free) if kind is np.uint64 else np.frompyfunc(int.bit_count, 1, 1)(free)
    return width - ones.astype(np.int64)


def _alike(a: str, b: str) -> float:
    """``similarity`` of two texts."""
    short, long = sorted((len(a), len(b)))
    if not short:
        return 0.0
    if a == b:
        return 1.0
    if (a in b or b in a) and short >= 6 and short / long >= 0.55:
        return 0.92
    return SequenceMatcher(None, a, b).ratio()


def _least(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else min(a, b)


def _best(asked: list[dict], names: list[dict]) -> Iterator[tuple[str, int | None, float]]:
    """(own, match, score): for each of ``asked`` (own, query, floor) the names (name, match) that may be its best.

    Names are looked at by the most that their score can be, until none that is
    left reaches the best one found or the floor.
    """
    queries, texts = [a["query"] for a in asked], [n["name"] for n in names]
    shared = _shared(queries, texts)
    a, b = np.array([[len(q)] for q in queries]), np.array([[len(t) for t in texts]])
    short, long = np.minimum(a, b), np.maximum(a, b)
    most = 2.0 * shared / np.maximum(a + b, 1)
    inside = (shared == short) & (short >= 6) & (short / np.maximum(long, 1) >= 0.55)
    most = np.where(inside, np.maximum(most, 0.92), most)
    for i, row in enumerate(asked):
        best, found = row["floor"], {}
        (near,) = np.nonzero(most[i] >= best - _SLACK)
        for j in near[np.argsort(-most[i][near], kind="stable")].tolist():
            if most[i, j] < best - _SLACK:
                break
            score = _alike(queries[i], texts[j])
            if score >= best - _SLACK:
                best = max(best, score)
                found[score] = _least(found[score], names[j]["match"]) if score in found else names[j]["match"]
        for score, match in found.items():
            if score >= best - _SLACK:
                yield row["own"], match, score


def most_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (asked, names), lists as ``_best`` takes them; out: own string, match long, score double.

    Exact: the best name of each row's own list is in it, with all that rounding may make its equals.
    """
    for batch in batches:
        for asked, names in zip(batch.column("asked"), batch.column("names")):
            asked, names = asked.as_py(), names.as_py()
            few, many = [], []
            for n in names:
                (few if len(n["name"]) <= _WORD else many).append(n)
            for some in filter(None, (few, many)):
                rows = list(_best(asked, some))
                if rows:
                    own, match, score = zip(*rows)
                    yield pa.record_batch([pa.array(own, pa.string()), pa.array(match, pa.int64()), pa.array(score, pa.float64())], ["own", "match", "score"])
