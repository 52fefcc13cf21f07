"""Quality scores: histogram gradient-boosted trees over statistics of a text.

Trees are grown on a bounded sample of labelled documents (``sample`` rows, by
hash of id) from histograms of 64 bins a feature, by level, with second-order
gains of the logistic loss. They are flattened into arrays of feature,
threshold and value; a batch of documents goes down all trees level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm import textbuf as tb
from drayage.llm.store import fold

BINS, DEPTH, TREES, RATE, L2 = 64, 4, 80, 0.12, 1.0
#: Most labelled rows that the trees are grown on.
SAMPLE = 20_000
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 newline, 6 sentence marks, 7 other marks, 8 beyond ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
for _c in range(33, 127):
    if _CLASS[_c] == 0:
        _CLASS[_c] = 6 if chr(_c) in ".,;:!?'\"()-" else 7


def _sums(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc, values, docs)


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, times of the most frequent) by document."""
    if not len(h):
        return np.zeros(docs), np.zeros(docs)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    times, of = np.diff(np.r_[new, len(h)]), doc[new]
    most = np.zeros(docs)
    np.maximum.at(most, of, times)
    return np.bincount(of, minlength=docs).astype(float), most


def features(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Statistics of each document; all zero for an empty one."""
    docs = len(starts) - 1
    size = np.diff(starts).astype(float)
    one = np.maximum(size, 1)
    of = np.repeat(np.arange(docs), np.diff(starts))
    cls = _CLASS[buf]
    kinds = np.bincount(of * 9 + cls, minlength=docs * 9).reshape(docs, 9) / one[:, None]
    same = np.zeros(docs)
    if len(buf) > 1:
        twin = (buf[1:] == buf[:-1]) & (of[1:] == of[:-1]) & ((cls[1:] == 6) | (cls[1:] == 7))
        same = np.bincount(of[1:][twin], minlength=docs) / one
    s, e, w = tb.words(buf, starts)
    n = np.bincount(w, minlength=docs).astype(float)
    ones = np.maximum(n, 1)
    length = (e - s).astype(float)
    mean = _sums(length, w, docs) / ones
    spread = np.sqrt(np.maximum(0, _sums(length**2, w, docs) / ones - mean**2))
    first, last = cls[s], cls[e - 1] if len(s) else cls[s]
    up = np.concatenate([[0], np.cumsum(cls == 1)])
    caps = (up[e] - up[s] >= 2) & (up[e] - up[s] >= 0.6 * length)
    h = tb.span_hashes(tb.lowered(buf), s, e)
    unique, most = _distinct(h, w, docs)
    pairs = tb.ngram_hashes(h, 2)
    inside = w[1:] == w[:-1]
    two, two_most = _distinct(pairs[inside], w[1:][inside], docs)
    # lines
    brk = np.flatnonzero(buf == 10)
    ls = np.unique(np.concatenate([starts[:-1][size > 0], brk + 1]))
    ls = ls[ls < len(buf)]
    le = np.r_[ls[1:], len(buf)] if len(ls) else ls
    ld = np.searchsorted(starts, ls, "right") - 1
    lines = np.bincount(ld, minlength=docs).astype(float)
    line_kinds, line_most = _distinct(tb.span_hashes(buf, ls, le), ld, docs)
    many = np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n), mean, spread, kinds, same,
        _sums((first == 1).astype(float), w, docs) / ones, _sums((last == 6).astype(float), w, docs) / ones, _sums((last == 7).astype(float), w, docs) / ones,
        _sums(caps.astype(float), w, docs) / ones, _sums((length <= 3).astype(float), w, docs) / ones, _sums((length >= 15).astype(float), w, docs) / ones,
        unique / ones, most / ones, two / ones, two_most / ones, np.log1p(lines), line_kinds / many, line_most / many, n / many,
    ])


class Trees:
    """Flat trees: node i of a tree has children 2i + 1 and 2i + 2; values at the last level."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def probability(self, x: np.ndarray) -> np.ndarray:
        z, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << DEPTH) - 1
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - inner]
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels y (0 or 1); without rows, or with one label only, a constant."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    fs, ts, vs = [], [], []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        z, cols = np.full(len(y), base), x.shape[1]
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, nodes = (1 << level) - 1, 1 << level
                key = ((at - first)[:, None] * cols + np.arange(cols)) * BINS + binned
                hg = np.bincount(key.ravel(), np.repeat(g, cols), nodes * cols * BINS).reshape(nodes, cols, BINS)
                hh = np.bincount(key.ravel(), np.repeat(h, cols), nodes * cols * BINS).reshape(nodes, cols, BINS)
                gl, hl = hg.cumsum(2), hh.cumsum(2)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < 2) | (ht - hl < 2)] = -1
                best = gain.reshape(nodes, -1).argmax(1)
                for k in range(nodes):
                    c, b = divmod(int(best[k]), BINS)
                    if gain[k, c, b] > 1e-6 and b < len(edges[c]):
                        f[first + k], t[first + k] = c, edges[c][b]
                at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
            sg, sh = np.bincount(at - inner, g, leaves), np.bincount(at - inner, h, leaves)
            v = -RATE * sg / (sh + L2)
            z += v[at - inner]
            fs.append(f), ts.append(t), vs.append(v)
    return Trees(np.array(fs, np.int64).reshape(-1, inner), np.array(ts).reshape(-1, inner), np.array(vs).reshape(-1, leaves), base)


def _stats(batches):
    for b in batches:
        for lo, hi, buf, starts in tb.slices(b, "text"):
            x = features(buf, starts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from labelled rows: ``labels`` (doc_id, quality) with quality 0 or 1, joined to ``docs`` (doc_id, text).

    A doc_id counts once, however often either table repeats it: with its greatest
    label and its least statistics. So about ``sample`` rows come to the driver.
    """
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = labels.count()
    mine = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))
    few = labels.where(mine)
    stats = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id").select("doc_id", "y", "text").mapInArrow(_stats, "doc_id long, y double, x array<double>")
    rows = stats.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).select("y", "x").toArrow()
    y = rows.column("y").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    o = np.lexsort((*x.T, y))  # the same trees however rows arrive
    return grow(x[o], y[o])


def scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    The text alone decides; a null text is empty and scored as such. Where no
    label can be learned every score is one half. Repeated rows are scored alike,
    rows without a doc_id too, which are not learned from. Other columns of
    ``documents`` are left out.
    """
    held = fold(F.col("doc_id"), 3) == 1
    trees = fit(documents.select("doc_id", "text"), labels.where(~held).select("doc_id", "quality"), sample)
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            for lo, hi, buf, starts in tb.slices(b, "text"):
                p = shared.value.probability(features(buf, starts))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("held").slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), held.alias("held"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
