"""Language-model scoring from a log-frequency Bloom filter of n-gram counts.

Words and pairs of neighbours of the training texts are counted over the whole
corpus. A count c has level 1 + floor(log_B c); the filter holds (n-gram, 1) to
(n-gram, level), so probing levels until one misses gives the quantised count q.
Every n-gram that occurs is stored, once-seen ones too.

The probability of a word w after v is interpolated, with absolute discounting:

    P(w | v) = max(q(vw) - D, 0) / T(v) + D N(v) / T(v) P(w)

T(v) sums q over what follows v, N(v) counts it, and P(w) is the word's share of
the quantised counts, add one half, with one unknown word. So P(. | v) sums to
one over the words, as far as probes don't err; an error takes a pair that
doesn't occur, or one at its level's end, for the next level, with a chance of
about 0.4 %. After a word that was never followed, P(w) stands alone.

The filter is in segments, one for about 2^21 training tokens, with ``ROOM``
bits for every entry, so it grows with the corpus. The words' filter is
broadcast. The pairs' stays where it is built, with T and N of its contexts:
what texts ask of a segment is shuffled to it, and sums come back. A segment
holds whole contexts, by the context's hash; those of the most frequent words,
of at least 1 / 2^12 of all tokens, are dealt over all segments by pair. The
most frequent pairs, of at least 1 / ``HOT`` of all tokens, are broadcast with
their probabilities, so that no segment is asked much more than others.

Exact counts of at most ``head`` words are broadcast for the base score; all
others are joined. Words are known by 64-bit hashes, in pairs by 32 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm import textbuf as tb
from drayage.llm.store import cut, fold

BASE, PROBES, ROOM, HOT = 1.5, 6, 12, 1 << 20
#: Training tokens of a segment, and the share of all tokens from which a word is a frequent context, as powers of two.
SEGMENT, FREQUENT = 21, 12
#: A text's end, and what stands before its first word, as words.
END, BEGIN = np.uint64(0x5EED0E0D5EED0E0D), np.uint64(0x5EED0B615EED0B61)
#: Tokens that a task counts, and that it asks about, at once.
FLUSH, UNIT = 4_000_000, 2_000_000
#: What is taken from a pair's count for words that don't follow; below the least quantised count, one.
DISCOUNT = 0.75
_LOW = np.uint64(0xFFFFFFFF)


def tokens(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word and, after each document's words, its end."""
    low = tb.lowered(buf)
    s, e, doc = tb.words(low, starts)
    docs = len(starts) - 1
    n = np.bincount(doc, minlength=docs) + 1
    last = np.cumsum(n) - 1
    h = np.empty(len(s) + docs, np.uint64)
    where = np.ones(len(h), bool)
    where[last] = False
    h[where] = tb.span_hashes(low, s, e)
    h[last] = END
    return h, np.repeat(np.arange(docs), n)


def pairs(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each token with the one before it: 32 bits of the context above 32 bits of the word."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    before[first] = BEGIN
    return before & ~_LOW | h & _LOW


def _held(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each x in an ascending array."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == x


def segment(k: np.ndarray, frequent: np.ndarray, shift: int) -> np.ndarray:
    """Segments of pairs: by context, or, for the contexts in ``frequent``, by the pair."""
    spread = _held(frequent, k >> np.uint64(32))[1]
    return (np.where(spread, tb.mix(k), k) >> np.uint64(shift)).astype(np.int32)


def _counter(frequent=None, shift: int = 0):
    """Counts by word, or, with ``frequent`` contexts, by pair with its segment, as one task sees them, in runs of ``FLUSH`` tokens."""

    def run(batches):
        held, n = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            cols = {"h": u.view(np.int64), "n": c} if frequent is None else {"g": segment(u, frequent.value, shift), "k": u.view(np.int64), "n": c}
            for lo in range(0, len(u), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 200_000]) for x in cols.values()], list(cols))

        for b in batches:
            for _, _, buf, starts in tb.slices(b, "text"):
                h, doc = tokens(buf, starts)
                held.append(h if frequent is None else pairs(h, doc))
                n += len(h)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return run


def level(c) -> np.ndarray:
    """Quantised level of counts; 0 for none."""
    return np.where(c > 0, 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def value(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for level 0."""
    return np.where(levels > 0, BASE ** (levels - 1.0) * (1 + BASE) / 2 - (BASE - 1) / 2, 0.0)


def _place(h: np.ndarray, lv, i: int, size) -> np.ndarray:
    """The i-th bit of (n-gram, level) in a segment of ``size`` bits."""
    g = tb.mix(h + np.asarray(lv).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (((g & _LOW) + np.uint64(i) * (g >> np.uint64(32) | np.uint64(1))) % size).astype(np.int64)


def build(h: np.ndarray, lv: np.ndarray) -> bytes:
    """The bits of a segment that holds n-grams at their levels."""
    v = np.zeros(8 * max(1, -(-ROOM * int(lv.sum()) // 8)), bool)
    for k in range(1, int(lv.max(initial=0)) + 1):
        for i in range(PROBES):
            v[_place(h[lv >= k], k, i, np.uint64(len(v)))] = True
    return np.packbits(v, bitorder="little").tobytes()


def probe(bits: np.ndarray, h: np.ndarray, at, size, known=0) -> np.ndarray:
    """Levels of ``h``, each in the segment of ``size`` bits that begins at bit ``at``; at least ``known``."""
    out, at, size = (np.broadcast_to(np.asarray(x), len(h)) for x in (known, at, size))
    out, on = out.astype(np.int64), np.arange(len(h))
    while len(on):
        for i in range(PROBES):
            p = _place(h[on], out[on] + 1, i, size[on]) + at[on]
            on = on[(bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
        out[on] += 1
    return out


class Filter:
    """Level by n-gram; a false positive raises a level, no count is ever lowered."""

    def __init__(self, segments: dict[int, bytes], shift: int):
        self.shift, n = shift, 1 << 64 - shift
        # a segment that holds nothing is a byte of zeros
        self.at, self.size = np.zeros(n, np.int64), np.full(n, 8, np.uint64)
        parts, at = [b"\0"], 1
        for k, raw in segments.items():
            self.at[k], self.size[k] = 8 * at, 8 * len(raw)
            parts.append(raw)
            at += len(raw)
        self.bits = np.frombuffer(b"".join(parts), np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        g = (h >> np.uint64(self.shift)).astype(np.int64)
        return probe(self.bits, h, self.at[g], self.size[g])


def _whole(batches, key: str, group):
    """(segment, keys ascending, counts) of whole segments from all rows of a task."""
    held = [(b.column(key).to_numpy(zero_copy_only=False).view(np.uint64), b.column("n").to_numpy(zero_copy_only=False), group(b)) for b in batches]
    if not held:
        return
    h, c, g = (np.concatenate(x) for x in zip(*held))
    del held
    o = np.lexsort((h, g))
    h, c, g = h[o], c[o], g[o]
    new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
    for lo, hi in zip(new, np.r_[new[1:], len(g)]):
        yield int(g[lo]), h[lo:hi], c[lo:hi]


def _word_segments(batches):
    for g, h, c in _whole(batches, "h", lambda b: b.column("g").to_numpy()):
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([build(h, level(c))], pa.binary())], ["g", "bits"])


#: ``ctx``: contexts of the segment, their T and N; ``parts``: what it has of those of frequent contexts; ``top``: frequent pairs, with T and N of their context, if it is whole.
_SEGMENT = "g int, bits binary, ctx binary, parts array<struct<v: long, t: double, n: long>>, top array<struct<k: long, q: double, t: double, n: long>>"
_PARTS = pa.list_(pa.struct([("v", pa.int64()), ("t", pa.float64()), ("n", pa.int64())]))
_TOP = pa.list_(pa.struct([("k", pa.int64()), ("q", pa.float64()), ("t", pa.float64()), ("n", pa.int64())]))


def _pair_segments(frequent, hot: int):
    """Whole segments from rows (g, k, n), and the pairs seen ``hot`` times or more."""

    def run(batches):
        for g, k, c in _whole(batches, "k", lambda b: b.column("g").to_numpy()):
            lv = level(c)
            raw = build(k, lv)
            bits = np.frombuffer(raw, np.uint8)
            q = value(probe(bits, k, 0, np.uint64(8 * len(raw)), lv))  # as probes find them
            v = k >> np.uint64(32)
            new = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            t, n, own = np.add.reduceat(q, new), np.diff(np.r_[new, len(v)]), v[new]
            part = _held(frequent.value, own)[1]
            of = np.searchsorted(own, v)
            top = np.flatnonzero(c >= hot)
            tt, tn = np.where(part, 0.0, t)[of[top]], np.where(part, 0, n)[of[top]]
            ctx = b"".join(x.tobytes() for x in (own[~part].astype(np.uint32), t[~part].astype(np.float64), n[~part].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g], pa.int32()), pa.array([raw], pa.binary()), pa.array([ctx], pa.binary()),
                    pa.array([[{"v": a, "t": b, "n": m} for a, b, m in zip(own[part].tolist(), t[part].tolist(), n[part].tolist())]], _PARTS),
                    pa.array([[{"k": a, "q": b, "t": m, "n": d} for a, b, m, d in zip(k[top].view(np.int64).tolist(), q[top].tolist(), tt.tolist(), tn.tolist())]], _TOP),
                ],
                ["g", "bits", "ctx", "parts", "top"],
            )

    return run


def conditional(q: np.ndarray, t: np.ndarray, n: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """P(w | v) from a pair's quantised count, its context's T and N, and P(w)."""
    whole = np.maximum(t, 1.0)
    return np.where(t > 0, np.maximum(q - DISCOUNT, 0) / whole + DISCOUNT * n / whole * alone, alone)


def _packed(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, *types) -> list[np.ndarray]:
    """Arrays of ``n`` of each type."""
    raw = pa.decompress(raw, n * sum(np.dtype(t).itemsize for t in types), codec="zstd")
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


_ASKED = (np.uint64, np.uint32, np.uint8)


def _asked(shared, shift: int, mass: float):
    """Rows (slice, g, n, q): what a run of texts asks of each segment; n < 0: the run itself, -n documents."""

    def run(batches):
        words, frequent, top, share, rest = shared.value
        row = TaskContext.get().partitionId() << 32
        segments = 1 << 64 - shift
        keys, scores, asked, docs, size = [], [], [], 0, 0

        def flush(row):
            k, doc, word = (np.concatenate(x) for x in zip(*asked))
            g = segment(k, frequent, shift)
            o = np.argsort(g.astype(np.uint16) if segments <= 1 << 16 else g, kind="stable")
            k, doc, word, g = k[o], doc[o], word[o], g[o]
            new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
            stop = np.r_[new[1:], len(g)].astype(np.int64)
            q = [_packed(np.concatenate(keys), np.concatenate(scores))]
            places = [(row + (row >> 32)) % segments]
            counts = [-docs]
            for x, y in zip(new.tolist(), stop.tolist()):
                q.append(_packed(k[x:y], doc[x:y], word[x:y]))
                places.append(int(g[x]))
                counts.append(y - x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row)), pa.array(places, pa.int32()), pa.array(counts, pa.int64()), pa.array(q, pa.binary())], ["slice", "g", "n", "q"])

        for b in batches:
            own = b.column("ck").to_numpy()
            for lo, hi, buf, starts in tb.slices(b, "text"):
                h, doc = tokens(buf, starts)
                u, at = np.unique(h, return_inverse=True)
                word = words.levels(u)
                alone = (value(word) + 0.5) / mass
                k = pairs(h, doc)
                place, hot = _held(top, k)
                place = place[hot]
                keys.append(own[lo:hi])
                scores.append(np.bincount(doc[hot], np.log10(share[place] + rest[place] * alone[at[hot]]), hi - lo))
                asked.append((k[~hot], (doc[~hot] + docs).astype(np.uint32), word[at[~hot]].astype(np.uint8)))
                docs += hi - lo
                size += len(h)
                if size >= UNIT:
                    yield from flush(row)
                    keys, scores, asked, docs, size, row = [], [], [], 0, 0, row + 1
        if docs:
            yield from flush(row)
        tb.release()

    return run


_ANSWER = pa.schema([("slice", pa.int64()), ("n", pa.int64()), ("q", pa.binary())])


def _answered(shared, mass: float):
    """A segment's sums by document for what runs of texts ask of it; the runs themselves go on as they are."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        raw = held.column("bits")[0].as_py() if held.num_rows else b"\0"
        bits, ctx = np.frombuffer(raw, np.uint8), held.column("ctx")[0].as_py() if held.num_rows else b""
        m = len(ctx) // 16
        own = [np.frombuffer(ctx, np.uint32, m, 0), np.frombuffer(ctx, np.float64, m, 4 * m), np.frombuffer(ctx, np.uint32, m, 12 * m)]
        v, t, n = (np.concatenate([a, b]) for a, b in zip(own, shared.value))
        o = np.argsort(v, kind="stable")
        v, t, n = v[o], t[o], n[o]
        rows = list(zip(asked.column("slice").to_pylist(), asked.column("n").to_pylist(), asked.column("q").to_pylist()))
        out = [r for r in rows if r[1] < 0]
        rows = [(s, *_unpacked(q, c, *_ASKED)) for s, c, q in rows if c >= 0]
        if rows:
            u, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
            place, there = _held(v, (u >> np.uint64(32)).astype(np.uint32))
            q = value(probe(bits, u, 0, np.uint64(8 * len(raw))))
            tt, tn = (np.where(there, x[place], 0) if len(v) else np.zeros(len(u)) for x in (t, n))
            first = 0
            for s, k, doc, word in rows:
                i = at[first : first + len(k)]
                first += len(k)
                p = np.log10(conditional(q[i], tt[i], tn[i], (value(word.astype(np.int64)) + 0.5) / mass))
                sums = np.bincount(doc, p)
                d = np.unique(doc)
                out.append((s, len(d), _packed(sums[d], d)))
        return pa.table([pa.array(list(c), x) for c, x in zip(zip(*out) if out else [[]] * 3, _ANSWER.types)], schema=_ANSWER)

    return run


def _summed(answers: pa.Table) -> pa.Table:
    """(ck, score) of a run's documents."""
    n, q = answers.column("n").to_pylist(), answers.column("q")
    k = next(i for i, m in enumerate(n) if m < 0)
    own, score = _unpacked(q[k].as_py(), -n[k], np.int64, np.float64)
    score = score.copy()
    for i, m in enumerate(n):
        if i != k:
            s, d = _unpacked(q[i].as_py(), m, np.float64, np.uint32)
            score[d] += s
    return pa.table({"ck": own, "score": score})


def score_documents(docs: DataFrame, held: F.Column, head: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    The model learns from the rows that are not ``held``. A null or empty text is
    one end token. Repeated rows are learned, and scored, as often as they occur;
    those of one id and text, a null id among them, are scored alike. Where
    nothing is learned every token is unknown, at the floor that the base formula
    gives. Other columns of ``docs`` are left out. ``docs`` is read several times:
    it comes from files, or was kept, so that its rows are the same each time.
    """
    spark = docs.sparkSession
    train = docs.where(~held).select("text")
    uni = cut(train.mapInArrow(_counter(), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    grades = {r["g"]: r for r in uni.groupBy(F.floor(F.log2("n")).alias("g")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()}
    total, distinct = sum(r["n"] for r in grades.values()), sum(r["words"] for r in grades.values())
    kept, least = 0, 64
    for g in sorted(grades, reverse=True):
        if kept + grades[g]["words"] > head:
            break
        kept, least = kept + grades[g]["words"], g
    frequent = uni.where(F.col("n") >= float(1 << least)).orderBy("h").toArrow() if kept else pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    head_h, head_n = frequent.column("h").to_numpy(), frequent.column("n").to_numpy()

    shift = 64 - max(3, math.ceil(math.log2(total + 1)) - SEGMENT)
    parts = 1 << 64 - shift
    built = uni.select(F.shiftrightunsigned("h", shift).cast("int").alias("g"), "h", "n").repartition(parts, "g").mapInArrow(_word_segments, "g int, bits binary")
    words = Filter({r["g"]: bytes(r["bits"]) for r in built.toLocalIterator()}, shift)
    often = np.array([r["h"] for r in uni.where(F.col("n") >= max(2, total >> FREQUENT)).select("h").collect()], np.int64).view(np.uint64)
    contexts = spark.sparkContext.broadcast(np.unique(np.r_[often, BEGIN] >> np.uint64(32)))  # at most 2^12 + 1
    pairs_ = train.mapInArrow(_counter(contexts, shift), "g int, k long, n long").repartition(parts, "g").groupBy("g", "k").agg(F.sum("n").alias("n"))
    built = cut(pairs_.mapInArrow(_pair_segments(contexts, max(2, total // HOT)), _SEGMENT))
    whole = {r["v"]: (r["t"], r["n"]) for r in built.select(F.explode("parts").alias("p")).groupBy("p.v").agg(F.sum("p.t").alias("t"), F.sum("p.n").alias("n")).collect()}
    spread = (np.array(sorted(whole), np.uint32), np.array([whole[v][0] for v in sorted(whole)], np.float64), np.array([whole[v][1] for v in sorted(whole)], np.uint32))
    top = built.select(F.explode("top").alias("t")).select("t.*").toArrow()  # at most HOT rows
    k, q, t, n = (top.column(c).to_numpy() for c in ("k", "q", "t", "n"))
    k = k.view(np.uint64)
    place, there = _held(spread[0], (k >> np.uint64(32)).astype(np.uint32))
    if len(spread[0]):
        t, n = np.where(there, spread[1][place], t), np.where(there, spread[2][place], n)
    o = np.argsort(k)
    rest, share = DISCOUNT * n[o] / np.maximum(t[o], 1), np.maximum(q[o] - DISCOUNT, 0) / np.maximum(t[o], 1)
    # what the quantised words sum to, so that they are shares of one
    mean = F.pow(F.lit(BASE), F.floor(F.log(F.col("n")) / math.log(BASE) + 1e-9)) * (1 + BASE) / 2 - (BASE - 1) / 2
    mass = (uni.agg(F.sum(mean)).first()[0] or 0.0) + 0.5 * (distinct + 1)
    shared = spark.sparkContext.broadcast((words, contexts.value, k[o], share.astype(np.float32), rest.astype(np.float32)))
    exact = spark.sparkContext.broadcast((head_h, head_n))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("ck"))
    asked = keyed.select("ck", "text").mapInArrow(_asked(shared, shift, mass), "slice long, g int, n long, q binary")
    answers = built.select("g", "bits", "ctx").groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(_answered(spark.sparkContext.broadcast(spread), mass), "slice long, n long, q binary")
    model = answers.groupBy("slice").applyInArrow(_summed, "ck long, score double").groupBy("ck").agg(F.max("score").alias("score"))
    floor = total + 0.5 * (distinct + 1)

    def run(batches):
        hh, hn = exact.value
        for b in batches:
            own = b.column("ck")
            for lo, hi, buf, starts in tb.slices(b, "text"):
                h, doc = tokens(buf, starts)
                m = hi - lo
                u, at = np.unique(h.view(np.int64), return_inverse=True)
                place, there = _held(hh, u)
                c = np.where(there, hn[place], 0) if len(hh) else np.zeros(len(u), np.int64)
                known = c[at] > 0
                base = np.bincount(doc, np.where(known, np.log10((c[at] + 0.5) / floor), 0.0), m)
                got = np.bincount(doc, known, m).astype(np.int64)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([own.slice(lo, m), pa.array(np.bincount(doc, minlength=m)), pa.array(got), pa.array(base), none, none], _ROW.names)
                # words that are not of the frequent: (document, word, times)
                rare = np.flatnonzero(~known)
                if len(rare):
                    d, w = doc[rare], h.view(np.int64)[rare]
                    o = np.lexsort((w, d))
                    d, w = d[o], w[o]
                    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])])
                    none = pa.nulls(len(new), pa.int64())
                    yield pa.RecordBatch.from_arrays([own.slice(lo, m).take(pa.array(d[new])), none, none, pa.nulls(len(new), pa.float64()), pa.array(w[new]), pa.array(np.diff(np.r_[new, len(d)]))], _ROW.names)

    rows = keyed.select("ck", "text").mapInArrow(run, "ck long, n_tokens long, n_known long, base double, h long, times long")
    c = F.coalesce("n", F.lit(0))
    term = F.when(F.col("times").isNotNull(), F.col("times") * F.log10((c + 0.5) / floor)).otherwise(F.col("base"))
    hits = F.when(F.col("times").isNotNull(), F.when(c > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known"))
    # rows of one id and text are summed together and counted
    again = F.count("n_tokens")
    tail = uni.where(F.col("n") < float(1 << least)) if least < 64 else uni
    # rows that are no word's take a key that spreads them; it can't change their sum
    rows = rows.withColumn("h", F.coalesce("h", "ck"))
    base = rows.join(tail, "h", "left").groupBy("ck").agg(F.max("n_tokens").alias("n_tokens"), (F.sum(hits) / again).cast("long").alias("n_known"), (F.sum(term) / again).alias("base_score"))
    out = keyed.select("doc_id", "held_out", "ck").join(base.join(model, "ck"), "ck")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


_ROW = pa.schema([("ck", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("h", pa.int64()), ("times", pa.int64())])


def scores(documents: DataFrame) -> DataFrame:
    return score_documents(documents, fold(F.col("doc_id"), 5) == 1)
