"""Vectorised word kernels over Arrow text columns.

Everything works on the UTF-8 bytes of a whole Arrow batch with numpy, so no
Python code runs per word or per byte. Word hashes are 64-bit polynomials over
randomised bytes, finished by a non-linear mix; window hashes are polynomials
over those. A text longer than ``PIECE`` bytes is hashed piece by piece, so the
scratch memory does not depend on the longest text by more than the eight bytes
a word that its result needs.

Python workers are kept between tasks, beside an executor's heap. ``lean`` and
``lean_column`` hand back what a batch took and no longer needs.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once, and bytes of text that are worked on together.
PIECE = 1 << 18
GROUP = 1 << 20
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: Separators as 256-entry masks: ASCII white space, everything that is not an
#: ASCII letter, digit or non-ASCII byte, and the line feed alone.
_codes = np.arange(256)
SPACE = (_codes == 32) | ((_codes >= 9) & (_codes <= 13))
NOT_ALNUM = ~(((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128))
IDENTITY = _codes.astype(np.uint8)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the usual xor-shift-multiply chain)."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F, 2: 0x165667B19E3779F9}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, ``n`` at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        base = _BASES[which]
        size = max(n, PIECE + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            out.append(p)
        have = (out[0], out[1])
        if size <= 4 * PIECE:
            _POWERS[which] = have
    return have


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


class Words:
    """Words of some adjacent texts.

    ``hash``, ``start`` and ``end`` (byte places in ``buf``) have an entry per
    word; text ``i`` owns words ``ptr[i]`` to ``ptr[i + 1]``.
    """

    __slots__ = ("buf", "hash", "start", "end", "ptr")

    def __init__(self, buf, hash_, start, end, ptr):
        self.buf, self.hash, self.start, self.end, self.ptr = buf, hash_, start, end, ptr

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def place(self) -> np.ndarray:
        """The number of each word within its text."""
        return np.arange(len(self.hash)) - np.repeat(self.ptr[:-1], np.diff(self.ptr))


def words(buf: np.ndarray, at: np.ndarray, separators: np.ndarray, fold: np.ndarray = IDENTITY) -> Words:
    """Splits texts ``buf[at[i]:at[i + 1]]`` at separator bytes and hashes each word after folding its bytes."""
    lo, hi = int(at[0]), int(at[-1])
    inner = ~separators
    edges = np.unique(at)
    starts, ends, hashes = [], [], []
    table = np.where(separators, U64(0), _TABLE[fold])
    done = lo
    while done < hi:
        upto = min(hi, done + PIECE)
        if upto < hi:  # a piece ends where a word does, or at the end of a text
            k = int(np.searchsorted(edges, upto, "right")) - 1
            gaps = np.flatnonzero(separators[buf[done:upto]])
            best = max(int(edges[k]), done + int(gaps[-1]) + 1 if len(gaps) else 0)
            while best <= done:
                upto = min(hi, upto + PIECE)
                k = int(np.searchsorted(edges, upto, "right")) - 1
                gaps = np.flatnonzero(separators[buf[done:upto]])
                best = hi if upto == hi else max(int(edges[k]), done + int(gaps[-1]) + 1 if len(gaps) else 0)
            upto = best
        part = buf[done:upto]
        is_word = inner[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[edges[np.searchsorted(edges, done) : np.searchsorted(edges, upto, "right")] - done] = True
        before = np.empty(len(part), bool)
        before[0], before[1:] = False, is_word[:-1]
        s = np.flatnonzero(is_word & (~before | cut[:-1]))
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = False, is_word[1:]
        e = np.flatnonzero(is_word & (~after | cut[1:])) + 1
        if len(s):
            up, down = powers(0, len(part) + 1)
            h = np.add.reduceat(table[part] * up[: len(part)], s)
            h *= down[s]
            h += (e - s).astype(U64) * _M1
            hashes.append(mix(h))
            starts.append(s + done)
            ends.append(e + done)
        done = upto
    if starts:
        start, end, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    else:
        start = end = np.zeros(0, np.int64)
        h = np.zeros(0, U64)
    return Words(buf, h, start, end, np.searchsorted(start, at))


def groups(at: np.ndarray, size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def window_hash(h: np.ndarray, length: int, which: int = 1) -> np.ndarray:
    """Hash of ``h[i:i + length]`` for each i (windows may span texts; the caller picks those that don't)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(which, len(h) + 1)
    v = mix(h ^ U64(_BASES[which])) * up[: len(h)]
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(v, out=c[1:])
    out = (c[length:] - c[:-length]) * down[:n]
    return mix(out)


_CACHES: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What an operator keeps in a worker between tasks. Workers are reused, so those of others are dropped."""
    for other in [k for k in _CACHES if k != owner]:
        del _CACHES[other]
    return _CACHES.setdefault(owner, {})


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Returns free memory of Arrow and of the C library to the machine."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(run: Callable) -> Callable:
    """A ``mapInArrow`` function that tidies up after each batch."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                tidy()

        yield from run(each())
        tidy()

    return tidied


def lean_column(run: Callable) -> Callable:
    """A column function that tidies up after each batch."""

    @functools.wraps(run)
    def tidied(*columns: pa.Array) -> pa.Array:
        out = run(*columns)
        tidy()
        return out

    return tidied


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by ``keys``, across batches."""
    parts: list[pa.RecordBatch] = []  # of the group that is open, joined once when it ends
    last = None

    def joined() -> pa.Table:
        return pa.Table.from_batches(parts).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != [c[0] for c in cols]
        last = [c[-1] for c in cols]
        at = 0
        for cut in np.flatnonzero(new):
            if cut > at:
                parts.append(batch.slice(at, cut - at))
            yield joined()
            parts.clear()
            at = cut
        parts.append(batch.slice(at))
    if parts:
        yield joined()


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges overlapping or touching intervals given in order of their starts."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + l)`` for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    jump[first] = s
    jump[first[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(jump)
