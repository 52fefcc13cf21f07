"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenised and cut: whole sequences first, then one piece that is
shorter. Only the histogram of piece lengths, at most ``size`` numbers, comes to
the driver. Lengths are placed longest first, each into the shortest pack, which
has the most room, or, where that doesn't take it, into packs of their own; packs
of one pattern are counted, never listed. Patterns then go back to the
documents by rank: the k-th piece of a length takes the k-th place of that
length.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drayage.llm import textbuf as tb
from drayage.llm.store import cut, spare

SIZE = 4096
CACHE = 400_000
#: Pieces in a share, on average, within which ranks are counted.
SHARE = 1 << 16
#: Leading letters of what stands between white space, then the rest of it: the tokenizer ends a word at both.
_QUICK = re.compile(r"[^\W\d_]+|\S+")
#: Not lower-cased or split alike by Python and the tokenizer.
_ODD = tb.NUMBER_LETTERS | frozenset("Σİ")


class Words:
    """Ids of texts as the tokenizer file says, remembered by word."""

    def __init__(self, path: str, quick: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.last = np.zeros(self.t.get_vocab_size(), bool)  # tokens that end a word
        for token, i in self.t.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.quick = quick
        # special tokens that stand in a text are found before words are: such texts go to the tokenizer whole
        self.special = [t.content.lower() for t in self.t.get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without special tokens."""
        cache, parts = self.cache, []
        new: set[str] = set()
        for t in texts:
            low = t.lower()
            if not self.quick or any(x in low for x in self.special) or tb.has_any(t, _ODD) or not unicodedata.is_normalized("NFC", t):
                parts.append(None)
                continue
            p = _QUICK.findall(low)
            parts.append(p)
            new.update(p)
        new = [w for w in new if w not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list({w for p in parts if p for w in p})
        plain = [w for w in new if w.isalpha()]  # each is one word to the tokenizer: they go as one text
        ids = np.array(self.t.encode(" ".join(plain), add_special_tokens=False).ids, "<u4")
        raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        cache.update(zip(plain, map(lambda a, b: raw[a:b], [0, *ends[:-1]], ends)))
        for w in new:
            if w not in cache:
                cache[w] = np.array(self.t.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return [np.array(self.t.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if p is None else b"".join([cache[w] for w in p]) for t, p in zip(texts, parts)]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    """One for all tasks of a worker: they share what it remembers."""
    return Words(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = 2, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and ``end``, cut into pieces of ``size`` and a rest."""

    def run(batches):
        words, last = _words(path), np.array([end], "<u4").tobytes()
        for b in batches:
            texts, at = b.column("text"), b.column("doc_id")
            for lo in range(0, b.num_rows, 256):
                rows = []
                for i, e in enumerate(words.encode([t or "" for t in texts[lo : lo + 256].to_pylist()])):
                    e += last
                    for s in range(0, len(e), 4 * size):
                        piece = e[s : s + 4 * size]
                        rows.append((lo + i, s // 4, len(piece) // 4, zlib.crc32(piece), len(e) // 4, piece))
                doc, start, n, crc, total, raw = zip(*rows)
                cols = [at.take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, n, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    cols, names = [*cols, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
            tb.release()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Packs for a histogram of lengths: (how many, the lengths in one), longest lengths first.

    A length goes to the pack with the most room, as long as that room takes it:
    the shortest pack first. Packs that are alike are one entry with a count; as
    many copies go in at once as leave the pack the shortest, or level with the next.
    """
    room: dict[int, list[list]] = {}  # room left -> [count, lengths]
    open_rooms: list[int] = []  # ascending

    def add(left: int, count: int, lengths: tuple) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(open_rooms, left)
        room[left].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count > 0:
            if not open_rooms or open_rooms[-1] < length:
                per = min(size // length, count)  # none takes it: packs of its own
                whole, rest = divmod(count, per)
                add(size - per * length, whole, (length,) * per)
                if rest:
                    add(size - rest * length, 1, (length,) * rest)
                break
            left = open_rooms[-1]
            under = max(open_rooms[-2] if len(open_rooms) > 1 else 0, 0)
            packs = room[left][-1]
            # all of these packs take one each, or, where the next room is far below, as many as keep them above it
            each = max(1, min((left - under) // length, left // length)) if len(room[left]) == 1 else 1
            each = min(each, max(1, count // packs[0]))
            used = min(packs[0], count // each)
            packs[0] -= used
            if not packs[0]:
                room[left].pop()
                if not room[left]:
                    del room[left]
                    open_rooms.pop()
            add(left - each * length, used, packs[1] + (length,) * each)
            count -= used * each
    return [(c, list(ls)) for packs in room.values() for c, ls in packs if c]


def places(packs: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, number of packs, first sequence, first offset), ranks ascending."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for count, lengths in sorted(packs, key=lambda p: (p[1], p[0]), reverse=True):
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((taken.get(n, 0), count, first, offset))
            taken[n] = taken.get(n, 0) + count
            offset += n
        first += count
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut_pieces`` (doc_id, start, length, ...) with sequence_id and offset.

    Ranks follow (doc_id, start) within hashed shares of the pieces, about
    ``SHARE`` to each, so no length and no document is one task's work and the
    same table always packs alike; pieces that repeat those are told apart
    arbitrarily. Columns named sequence_id or offset are replaced, all others
    stay. Input that isn't kept already is kept before it is ranked.
    """
    spark = cut_pieces.sparkSession
    p = cut_pieces.drop("sequence_id", "offset")
    names = p.columns
    share, rank, before, at = spare(names, "share", "rank", "before", "at")
    shares = 1 << max(8, math.ceil(math.log2(1 + p.count() / SHARE)))
    p = p.withColumn(share, F.pmod(F.xxhash64("doc_id", "start"), F.lit(shares)).cast("int"))
    by = p.groupBy("length", share).agg(F.count("*").alias(before))
    counts = by.groupBy("length").agg(F.sum(before).alias("n")).collect()  # at most `size` rows
    where = places(patterns({int(r["length"]): int(r["n"]) for r in counts}, size))
    shared = spark.sparkContext.broadcast(where)  # by `size` lengths, runs of packs of one pattern
    # ranks before each share: at most `size` x shares rows
    own = Window.partitionBy("length").orderBy(share).rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("length", share, F.coalesce(F.sum(before).over(own), F.lit(0)).alias(before))
    ranked = p.withColumn(rank, F.row_number().over(Window.partitionBy("length", share).orderBy("doc_id", "start")))
    ranked = ranked.join(by, ["length", share]).withColumn(rank, F.col(rank) - 1 + F.col(before))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, k = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for v in np.unique(n):
            own, rows = n == v, shared.value[int(v)]
            at = np.searchsorted(rows[:, 0], k[own], "right") - 1
            seq[own] = rows[at, 2] + k[own] - rows[at, 0]
            off[own] = rows[at, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn(at, place("length", rank)).select(*names, f"{at}.sequence_id", f"{at}.offset")


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = 2) -> DataFrame:
    """Every piece of every document and its place; a null or empty text is the end id alone.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)
    """
    return pack(cut(pieces(docs, path or _path(), size, end, ids=False)), size)
