"""Language identification: multinomial naive Bayes over hashed character n-grams.

Grams are one to four characters of the lower-cased text, hashed to ``BUCKETS``.
Counts by language come from a bounded sample of labelled documents (``per_lang``
of each language, by hash of id), shares of languages from all of them. The
matrix of log probabilities, buckets by languages, is broadcast, ``BLOCK``
languages at a time, so however many there are, each is learned and tried. A
batch is scored sparsely: a document's row of the gram matrix holds only the
grams that occur, and its product with the matrix gathers and sums their rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.llm import textbuf as tb
from drayage.llm.store import cut, fold, spare

BITS = 15
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3, 4)
#: Languages whose probabilities are broadcast at once (128 KB each), and that are summed at once.
BLOCK, COLUMNS = 256, 16
#: Grams whose evidence a score counts at most, so that those of long texts stay calibrated.
EVIDENCE = 200
#: Letters: what `\p{L}` is in Java; a text without any has no language.
NO_LETTER = r"^[^\p{L}]*$"


def characters(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each character of a slice, where documents start among them): A-Z lower-cased, a character's UTF-8 bytes as one number."""
    buf = tb.lowered(buf)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(lead) == len(buf):
        return buf.astype(np.uint32), starts
    c, size = buf[lead].astype(np.uint32), np.diff(np.r_[lead, len(buf)])
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        c[more] = c[more] << np.uint32(8) | buf[lead[more] + k]
    return c, np.searchsorted(lead, starts)


def gram_ids(c: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n characters from each position; ``BUCKETS`` where they reach beyond a document."""
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32)
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ c[k : k + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    out = (h >> np.uint32(32 - BITS)).astype(np.int32)
    for k in range(1, n):
        at = starts[1:-1] - k
        out[at[(at >= 0) & (at < m)]] = BUCKETS
    return out


def _counts(batches):
    """Gram counts by language, as one task sees them: rows (lang, g, n)."""
    total: dict[str, np.ndarray] = {}

    def flush():
        for lang, c in total.items():
            g = np.flatnonzero(c[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(c[g])], ["lang", "g", "n"])
        total.clear()

    for b in batches:
        langs = b.column("lang").to_pylist()
        for lo, hi, buf, starts in tb.slices(b, "text"):
            c, at = characters(buf, starts)
            for i in range(lo, hi):
                doc = c[at[i - lo] : at[i - lo + 1]]
                own = total.setdefault(langs[i], np.zeros(BUCKETS + 1, np.int64))
                for n in GRAMS:
                    own += np.bincount(gram_ids(doc, np.array([0, len(doc)]), n), minlength=BUCKETS + 1)
                if len(total) > COLUMNS:
                    yield from flush()
    yield from flush()


def fit(train: DataFrame, per_lang: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(lang, docs), and (lang, gs) with the grams of its sample and their counts, from rows (doc_id, text, lang)."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = cut(train.groupBy("lang").agg(F.count("*").alias("docs")))
    mine = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < per_lang / F.col("docs")
    of = F.broadcast(shares) if shares.count() <= 100_000 else shares
    parts = train.join(of, "lang").where(mine).select("lang", "text").mapInArrow(_counts, "lang string, g int, n long")
    return shares, cut(parts.groupBy("lang", "g").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("g", "n")).alias("gs")))


def blocks(spark: SparkSession, shares: DataFrame, grams: DataFrame):
    """(names, log share of documents, log P(gram | language) with a row of zeros) of ``BLOCK`` languages at a time, in order."""
    total = shares.agg(F.sum("docs")).first()[0]
    names, prior, rows = [], [], []
    for r in shares.join(grams, "lang", "left").orderBy("lang").toLocalIterator():
        c = np.full(BUCKETS, 0.5)
        for g in r["gs"] or []:
            c[g["g"]] += g["n"]
        names.append(r["lang"])
        prior.append(np.log(r["docs"] / total))
        rows.append(np.r_[np.log(c / c.sum()), 0.0].astype(np.float32))
        if len(names) == BLOCK:
            yield spark.sparkContext.broadcast((names, np.array(prior), np.ascontiguousarray(np.array(rows).T)))
            names, prior, rows = [], [], []
    if names:
        yield spark.sparkContext.broadcast((names, np.array(prior), np.ascontiguousarray(np.array(rows).T)))


def score_slice(buf: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean log probability of a document's grams by document and language, grams); ``table``: buckets, and a row of zeros, by languages."""
    c, at = characters(buf, starts)
    docs = len(at) - 1
    out, grams = np.zeros((docs, table.shape[1])), np.zeros(docs)
    for n in GRAMS:
        ids = gram_ids(c, at, n)
        full = np.flatnonzero(at[:-1] < np.minimum(at[1:], len(ids)))
        if not len(full):
            continue
        first = at[:-1][full]
        ids = ids[: at[full[-1] + 1]]
        grams[full] += np.add.reduceat((ids < BUCKETS).astype(np.int64), first)
        for j in range(0, table.shape[1], COLUMNS):
            out[full, j : j + COLUMNS] += np.add.reduceat(table[ids, j : j + COLUMNS], first, axis=0, dtype=np.float64)
    return out / np.maximum(grams, 1)[:, None], grams


def identify(docs: DataFrame, train: DataFrame, per_lang: int = 4000) -> DataFrame:
    """``docs`` with lang_pred and score, learned from ``train``.

    Text alone decides. A null text, one without a letter, or any text where
    nothing could be learned is ``und`` with score 0. Ties go to the language
    first in order. The score is the winner's posterior, by the languages' shares
    of documents and the evidence of at most ``EVIDENCE`` grams. Repeated rows are
    scored alike; rows without a doc_id are learned from as one. Existing columns
    of those names are replaced, all others stay.
    """
    docs = docs.drop("lang_pred", "score")
    shared = list(blocks(docs.sparkSession, *fit(train, per_lang)))
    if not shared:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    names = docs.columns
    text, best, z, every = spare(names, "plain", "best", "z", "every")

    def scored(block):
        def run(batches):
            langs, prior, table = block.value
            for b in batches:
                found, top, total = b.column(best).to_pylist(), b.column(z).to_numpy().copy(), b.column(every).to_numpy().copy()
                for lo, hi, buf, starts in tb.slices(b, text):
                    mean, grams = score_slice(buf, starts, table)
                    own = mean * np.minimum(grams, EVIDENCE)[:, None] + prior
                    k, high = own.argmax(1), own.max(1)
                    total[lo:hi] = np.logaddexp(total[lo:hi], high + np.log(np.exp(own - high[:, None]).sum(1)))
                    for i in np.flatnonzero(high > top[lo:hi]):
                        found[lo + i], top[lo + i] = langs[k[i]], high[i]
                cols = {c: b.column(c) for c in b.schema.names} | {best: pa.array(found, pa.string()), z: pa.array(top), every: pa.array(total)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        return run

    out = docs.select("*", F.when(F.col("text").rlike(NO_LETTER), None).otherwise(F.col("text")).alias(text), F.lit(None).cast("string").alias(best), F.lit(float("-inf")).alias(z), F.lit(float("-inf")).alias(every))
    schema = out.schema
    for block in shared:
        out = out.mapInArrow(scored(block), schema)
    und = F.col(text).isNull()
    return out.select(*names, F.when(und, "und").otherwise(F.col(best)).alias("lang_pred"), F.when(und, 0.0).otherwise(F.exp(F.col(z) - F.col(every))).alias("score"))


def held_out(docs: DataFrame) -> F.Column:
    """Rows that nothing is learned from."""
    return fold(F.col("doc_id"), 3) == 1


def predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from those not held out."""
    held = held_out(documents)
    out = identify(documents.select("doc_id", "text"), documents.where(~held).select("doc_id", "text", "lang"))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
