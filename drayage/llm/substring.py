"""Substring deduplication by content-defined chunks.

A gear rolling hash over the bytes cuts a text wherever the hash of the last
sixteen bytes is below a bound, so that an insertion moves only the cuts beside it.
Chunks are known by 64-bit digests. A chunk that two documents hold belongs to
the one of smallest id; a run of consecutive chunks that other documents hold
too, of at least ``min_run`` bytes, is a repeated passage. Later documents lose
it, the first keeps it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm import textbuf as tb
from drayage.llm.store import spare

#: A cut where the hash is below CUT, for about every 26 bytes; a longer stretch without one is cut at MOST bytes.
CUT, MOST = np.uint16((1 << 16) // 26), 1024
#: A chunk's place is one number, start * PLACE + length, as it is shuffled.
PLACE = 2 * MOST
MIN_RUN = 100
_GEAR = np.random.default_rng(11).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of the gears of the last 16, each shifted by its age."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            n = h.copy()
            n[k:] += h[:-k] << np.uint16(k)
            h = n
    return h


def chunks(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every chunk, in order."""
    docs = len(starts) - 1
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.flatnonzero(gear(buf) < CUT) + 1
    doc = np.searchsorted(starts, at - 1, "right") - 1
    at = at[at - starts[doc] >= 16]  # the window lies in the document
    # not inside a character: what is cut stays text
    at = at[(at == len(buf)) | ((buf[np.minimum(at, len(buf) - 1)] & 0xC0) != 0x80)]
    ends = np.unique(np.concatenate([at, starts[1:]]))
    ends = ends[ends > 0]
    s = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - s > MOST)
    if len(long):
        more = []
        for k in long:
            p = int(s[k]) + MOST
            while p < ends[k]:
                while p > s[k] and buf[p] & 0xC0 == 0x80:
                    p -= 1
                more.append(p)
                p += MOST
        ends = np.unique(np.concatenate([ends, more]))
        s = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(starts, s, "right") - 1
    return s, ends, np.minimum(doc, docs - 1)


def _chunk_rows(batches):
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        for lo, hi, buf, starts in tb.slices(b, "text"):
            s, e, doc = chunks(buf, starts)
            h = tb.span_hashes(buf, s, e).view(np.int64)
            at = (s - starts[doc]).astype(np.int64) * PLACE + (e - s)
            for k in range(0, len(s), 100_000):
                c = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[c]), pa.array(ids[lo:hi][doc[c]]), pa.array(at[c])], ["h", "doc_id", "at"])


def repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Repeated passages: (doc_id, start, end, n_chunks, firsts, removable), offsets in UTF-8 bytes.

    ``firsts``: the smallest ids that hold its chunks; ``removable``: whether all
    of the run's chunks have a smaller id than this document's, as (start, end)
    parts. Rows of one id are one document; null ids and empty texts hold nothing.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunk_rows, "h long, doc_id long, at long")
    shared = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    hit = rows.join(shared, "h").groupBy("doc_id").agg(F.collect_set(F.struct("at", "first")).alias("c"))

    def runs(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, c in zip(b.column("doc_id").to_pylist(), b.column("c")):
                v = c.values
                at, f = v.field("at").to_numpy(), v.field("first").to_numpy()
                o = np.argsort(at, kind="stable")
                s, f = at[o] // PLACE, f[o]
                e = s + at[o] % PLACE
                new = np.flatnonzero(np.r_[True, s[1:] != e[:-1]])
                stop = np.r_[new[1:], len(s)]
                for a, z in zip(new, stop):
                    if e[z - 1] - s[a] >= min_run:
                        drop = f[a:z] < doc
                        parts = [(int(x), int(y)) for x, y in zip(s[a:z][drop], e[a:z][drop])]
                        joined: list[list[int]] = []
                        for x, y in parts:
                            if joined and joined[-1][1] == x:
                                joined[-1][1] = y
                            else:
                                joined.append([x, y])
                        out.append((doc, int(s[a]), int(e[z - 1]), int(z - a), np.unique(f[a:z]).tolist(), [{"start": x, "end": y} for x, y in joined]))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _RUN.types)], _RUN.names)

    return hit.mapInArrow(runs, "doc_id long, start int, end int, n_chunks int, firsts array<long>, removable array<struct<start: int, end: int>>")


_PART = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_RUN = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_chunks", pa.int32()), ("firsts", pa.list_(pa.int64())), ("removable", pa.list_(_PART))])


def passages(documents: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row for each document that holds a passage that others hold too.

    (doc_id, n_passages, repeated_bytes, removed_bytes, first_ids, spans);
    ``first_ids``: the documents that keep what it repeats, itself included where
    it is the first; ``spans``: start:end of its passages in bytes.
    """
    r = repeats(documents, min_run)
    removed = F.aggregate("removable", F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["start"])
    return r.groupBy("doc_id").agg(
        F.count("*").alias("n_passages"),
        F.sum(F.col("end") - F.col("start")).alias("repeated_bytes"),
        F.sum(removed).alias("removed_bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_ids"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",").alias("spans"),
    )


def deduplicate(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` without the passages that a document of smaller id holds; columns and other rows stay.

    n_chars, if there, is made to fit. A text of nothing else becomes empty. Rows
    of one doc_id are one document, whose chunks are put together: of repeated
    rows each loses what a smaller id holds, none loses what only they share.
    Rows without a doc_id, and null or empty texts, stay as they are. Of the
    documents that hold a chunk the smallest id keeps it; there are no other ties.
    """
    doc, cuts_ = spare(docs.columns, "doc", "cuts")
    cuts = repeats(docs, min_run).where(F.size("removable") > 0).groupBy(F.col("doc_id").alias(doc)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removable")))).alias(cuts_))
    raw, at = F.encode("text", "UTF-8"), F.col(cuts_)
    # each kept part lies between the end of one cut and the start of the next
    fence = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    stop = F.struct(F.octet_length("text").alias("start"), F.octet_length("text").alias("end"))
    edges = F.concat(F.array(fence), at, F.array(stop))
    kept = F.transform(F.sequence(F.lit(1), F.size(at) + 1), lambda i: F.substring(raw, F.element_at(edges, i)["end"] + 1, F.element_at(edges, i + 1)["start"] - F.element_at(edges, i)["end"]))
    text = F.decode(F.aggregate(kept, F.lit(b""), lambda a, p: F.concat(a, p)), "UTF-8")
    names = docs.columns
    out = docs.join(cuts, F.col("doc_id").cast("long") == F.col(doc), "left").withColumn("text", F.when(at.isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(at.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)
