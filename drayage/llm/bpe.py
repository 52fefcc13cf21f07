"""Byte-level BPE encoding with a rank queue of hierarchical bitmaps, and decoding.

A pre-token's bytes form a linked list. For each merge rank a bucket holds the
positions whose pair has that rank; a bitmap of two levels of 256-bit words says
which buckets hold any, and find-first-set over its levels picks the next rank
in constant time. A position whose pair has changed since is stale and is
skipped. Work is linear in the pre-token but for the heap of one bucket's
positions, so a pre-token of a million bytes is no special case.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm import textbuf as tb

#: Chunks whose ids a worker remembers at most; then it starts over.
CACHE = 600_000
_BIT = [1 << k for k in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Where texts hold no number that is a letter to `re`: a space and letters, letters, or white space and all up to the next. Each ends where the pattern must end a match.
_QUICK = re.compile(r" [^\W\d_]+|[^\W\d_]+|\s*\S+|\s+")


class Encoder:
    """Encodes and decodes as the ranks and the pattern say, without special tokens."""

    def __init__(self, path: str, pattern: str, quick: bool = True):
        self.ranks = load_ranks(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.words = [0] * ((max(self.ranks.values(), default=0) >> 8) + 1)  # all zero between pre-tokens
        self.quick = quick
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank is merged, of equals the leftmost."""
        ranks = self.ranks
        got = ranks.get(piece)
        if got is not None:
            return [got]
        n, words, buckets, top = len(piece), self.words, {}, 0
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [None] * n  # of the pair that starts here; None: no such pair, or merged away
        for i in range(n - 1):
            r = rank_at[i] = ranks.get(piece[i : i + 2])
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)  # positions ascend: a heap already
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= _BIT[r & 255]
                    top |= 1 << (r >> 8)
        left = n
        while top:
            j = (top & -top).bit_length() - 1
            w = words[j]
            low = w & -w
            r = (j << 8) + low.bit_length() - 1
            b = buckets[r]
            if len(b) > 1:
                i = heapq.heappop(b)
            else:
                i = b[0]
                del buckets[r]
                words[j] = w = w ^ low
                if not w:
                    top &= top - 1
            if rank_at[i] != r:
                continue  # stale
            m = nxt[i]
            rank_at[m] = None
            k = nxt[i] = nxt[m]
            left -= 1
            if k < n:
                prv[k] = i
                new = rank_at[i] = ranks.get(piece[i : nxt[k]])
                if new is not None:
                    if new in buckets:
                        heapq.heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        words[new >> 8] |= _BIT[new & 255]
                        top |= 1 << (new >> 8)
            else:
                rank_at[i] = None
            p = prv[i]
            if p >= 0:
                new = ranks.get(piece[p:k])
                if new != rank_at[p]:
                    rank_at[p] = new
                    if new is not None:
                        if new in buckets:
                            heapq.heappush(buckets[new], p)
                        else:
                            buckets[new] = [p]
                            words[new >> 8] |= _BIT[new & 255]
                            top |= 1 << (new >> 8)
        out, i = [0] * left, 0
        for at in range(left):
            e = nxt[i]
            out[at] = ranks[piece[i:e]]
            i = e
        return out

    def _chunk(self, s: str) -> bytes:
        if s.isalpha() or s[0] == " " and s[1:].isalpha():
            return np.array(self.merge(s.encode()), "<u4").tobytes()  # one pre-token
        ids: list[int] = []
        for m in self.pattern.findall(s):
            ids += self.merge(m.encode())
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.quick or tb.has_any(text, tb.NUMBER_LETTERS):
            return self._chunk(text)
        parts = _QUICK.findall(text)
        cache = self.cache
        try:
            return b"".join([cache[p] for p in parts])
        except KeyError:
            pass
        if len(cache) > CACHE:
            cache.clear()
        for p in set(parts):
            if p not in cache:
                cache[p] = self._chunk(p)
        return b"".join([cache[p] for p in parts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _pattern_default() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker: they share what it remembers."""
    return Encoder(path, pattern)


def tokenised(docs: DataFrame, path: str, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, unless ``ids`` is false, the ids as an array.

    A null or empty text has no ids. Every row gives a row, repeated ones too.
    ``path`` is a rank file that every executor can read.
    """
    pattern = pattern or _pattern_default()

    def run(batches):
        enc = _encoder(path, pattern)
        for b in batches:
            n, a, d, full = [], [], [], []
            for t in b.column("text").to_pylist():
                e = enc.encode(t or "")
                n.append(len(e) // 4)
                a.append(hashlib.sha256(e).hexdigest())
                d.append(hashlib.sha256(enc.decode(e)).hexdigest())
                if ids:
                    full.append(np.frombuffer(e, "<u4").astype(np.int32))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(full, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
