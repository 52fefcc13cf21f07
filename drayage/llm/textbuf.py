"""Numpy views of Arrow text columns: no Python string is made for a document.

A record batch is cut into slices of whole documents. A slice is a byte buffer
(UTF-8) with ``starts``, the documents' offsets in it, one more than documents.
"""

from __future__ import annotations

import sys
import unicodedata
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    a = batch.column(name)
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if a.null_count:
        a = a.fill_null("")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, off, data = a.buffers()
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o.astype(np.int64)


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) for runs of rows of about ``most`` bytes."""
    data, off = column(batch, name)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    release()


def release() -> None:
    """Gives freed memory back to the system: workers stay from task to task, and an executor's share is bounded."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: glibc keeps what numpy frees; other C libraries have no such call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _pow(base: int, n: int) -> np.ndarray:
    if n > 2 * SLICE_BYTES:  # one very long text: not kept
        return _chain(base, n)
    if base not in _powers:
        _powers[base] = _chain(base, 2 * SLICE_BYTES + 2)
    return _powers[base][:n]


def _chain(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[buf]


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes other than 0x20 and 0x09-0x0D."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ws = _SPACE[buf]
    first, last = np.empty(len(buf), bool), np.empty(len(buf), bool)
    first[0] = last[-1] = True
    first[1:] = ws[:-1]
    last[:-1] = ws[1:]
    cut = starts[(starts > 0) & (starts < len(buf))]
    first[cut] = True
    last[cut - 1] = True
    ws = ~ws
    s, e = np.flatnonzero(first & ws), np.flatnonzero(last & ws) + 1
    return s, e, np.searchsorted(starts, s, "right") - 1


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for each span."""
    n = len(buf)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _pow(_R, n), out=c[1:])
    return mix((c[e] - c[s]) * _pow(_RINV, n + 1)[s] + (e - s).astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of h[i:i+n] for each i, in order of occurrence."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n * 0xA0761D6478BD642F & (1 << 64) - 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * U64(0xE7037ED1A0B428DB)
        out ^= out >> U64(32)
    return mix(out)


#: What `\w` takes for letters though Unicode has them as other numbers.
NUMBER_LETTERS = frozenset(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))
#: White space to Python's ``re``, but not to the tokenizers.
_SEPARATORS = tuple("\x1c\x1d\x1e\x1f")


def has_any(text: str, odd: frozenset[str]) -> bool:
    """Whether a text has a control that Python takes for white space, or a character of ``odd``."""
    return any(c in text for c in _SEPARATORS) or not text.isascii() and not odd.isdisjoint(text)
