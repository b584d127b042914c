"""Packing documents into sequences with best-two-fit.

A document is its token ids and one end id. Documents longer than a sequence
are cut into pieces of its length (the last may be shorter).

Lengths are at most ``capacity``, so the packing is solved on the histogram of
lengths, which has that many rows however large the corpus is. A sequence is
filled with the largest length that fits, again and again. Then its smallest
piece is replaced by the two unpacked pieces that fill the gap it leaves most
tightly, if they leave less than before. A fill depends only on which lengths
are left, so it is repeated as one pattern as long as the counts last. Pieces
find their place by their rank among those of their length.

Tokenizing works a word at a time, with the ids of known words kept: the
tokenizer splits at white space anyway. Pieces are written once, so nothing is
tokenized twice; texts are never shuffled.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed each; a null id is kept; other columns are ignored; without documents
there are no sequences.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from . import kernel as K
from .alignment import byte_characters
from .ranking import buckets_for, ranked

CACHE_WORDS = 400_000
_SEGMENT = 1 << 20
#: How the tokenizer's pattern cuts a lower-case ASCII word.
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(rb"[!-~]*")
#: The same for words with accented Latin letters (U+00C0 to U+017F but the two signs and the dotted capital I), each of which is one letter in either case.
_LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
_LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
_BYTE_CHARACTERS = {b: c for c, b in byte_characters().items()}


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """From a white-space-free word (bytes, ASCII lower-cased unless it holds ``<|``) to its ids as little-endian 32-bit integers.

    Words of ASCII and accented Latin letters take the model's own tokenize; all others,
    and those that may hold a special token, take the tokenizer as a whole.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.parts = tokenizer, tokenizer.model, {}

    def __missing__(self, word: bytes) -> bytes:
        if _PLAIN.fullmatch(word) and b"<|" not in word:
            out = b"".join([self.parts.get(p) or self._part(p) for p in _PARTS.findall(word)])
        elif b"<|" not in word and _LATIN.fullmatch(text := word.decode("utf-8", "replace")):
            out = b"".join([self.parts.get(p) or self._latin(p) for p in _LATIN_PARTS.findall(text.lower())])
        else:
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            out = _bytes(ids)
        self[word] = out
        return out

    def _part(self, part: bytes) -> bytes:
        out = _bytes([t.id for t in self.model.tokenize(part.decode())])
        self.parts[part] = out
        return out

    def _latin(self, part: str) -> bytes:
        known = "".join([_BYTE_CHARACTERS[b] for b in part.encode()])
        out = _bytes([t.id for t in self.model.tokenize(known)])
        self.parts[part] = out
        return out

    def text(self, raw: bytes) -> bytearray:
        out, at = bytearray(), 0
        while at < len(raw):
            end = len(raw)
            if end - at > _SEGMENT:
                cut = max(raw.rfind(b" ", at, at + _SEGMENT), raw.rfind(b"\n", at, at + _SEGMENT))
                if cut <= at:
                    nexts = [x for x in (raw.find(b" ", at + _SEGMENT), raw.find(b"\n", at + _SEGMENT)) if x > 0]
                    cut = min(nexts, default=end)
                end = cut
            part = raw[at:end].replace(b"\n", b" ")
            # special tokens are matched before the tokenizer folds case
            words = part.lower().split(b" ") if b"<|" not in part else [w if b"<|" in w else w.lower() for w in part.split(b" ")]
            out += b"".join(map(self.__getitem__, words))
            at = end
            if len(self) > CACHE_WORDS or len(self.parts) > CACHE_WORDS:
                self.clear()
                self.parts.clear()
        return out


def word_ids(path: str) -> WordIds:
    known = K.cache("packing")
    if path not in known:
        from tokenizers import Tokenizer

        known[path] = WordIds(Tokenizer.from_file(path))
    return known[path]


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    tail = int(end).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids = known.text(raw)
                ids += tail
                view = memoryview(ids)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ()))
                if len(rows) >= 4096:
                    yield pa.record_batch(_columns(rows, with_ids), names)
                    rows = []
            if rows:
                yield pa.record_batch(_columns(rows, with_ids), names)

    return run


def _columns(rows: list[tuple], with_ids: bool) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Fills sequences from ``counts[length]``; returns (lengths, how many such sequences).

    ``len(counts) - 1`` is a sequence's capacity.
    """
    left, capacity, out = counts.astype(np.int64).copy(), len(counts) - 1, []
    left[0] = 0
    top = capacity
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if not top:
            return out
        used: dict[int, int] = {}

        def spare(n: int, used=used) -> int:
            return int(left[n]) - used.get(n, 0)

        lengths, gap, n = [], capacity, top
        have = np.flatnonzero(left[: top + 1])
        k = len(have) - 1
        while gap > 0 and k >= 0:
            n = int(have[k])
            if n > gap:
                k = int(np.searchsorted(have, gap, "right")) - 1
                continue
            if spare(n) <= 0:
                k -= 1
                continue
            lengths.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap and len(lengths) > 1:
            small = lengths[-1]
            room, best, pair = gap + small, small, None
            lo, hi = 0, int(np.searchsorted(have, room, "right")) - 1
            while lo <= hi:
                a, b = int(have[lo]), int(have[hi])
                if spare(a) < 1 + (a == b):
                    lo += 1
                elif spare(b) < 1 or a + b > room:
                    hi -= 1
                else:
                    if a + b > best:
                        best, pair = a + b, (b, a)
                    lo += 1
            if pair:
                lengths.pop()
                used[small] -= 1
                for x in pair:
                    lengths.append(x)
                    used[x] = used.get(x, 0) + 1
        times = min(int(left[x]) // c for x, c in used.items() if c)
        for x, c in used.items():
            left[x] -= c * times
        out.append((lengths, times))


def _places(patterns: list[tuple[list[int], int]], capacity: int):
    """For each length, ranges of ranks and what they stand for: sorted keys, first sequence, offset."""
    taken = np.zeros(capacity + 1, np.int64)
    keys, firsts, offsets, sequence = [], [], [], 0
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            keys.append((n << 44) + int(taken[n]))
            firsts.append(sequence)
            offsets.append(at)
            taken[n] += times
            at += n
        sequence += times
    keys, firsts, offsets = (np.array(x, np.int64) for x in (keys, firsts, offsets))
    order = np.argsort(keys)
    return keys[order], firsts[order], offsets[order]


def _placed(keys: np.ndarray, firsts: np.ndarray, offsets: np.ndarray):
    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        key = (length.to_numpy(zero_copy_only=False).astype(np.int64) << 44) + rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, key, "right") - 1
        return pa.StructArray.from_arrays([pa.array(firsts[at] + key - keys[at]), pa.array(offsets[at])], ["sequence_id", "offset"])

    return F.arrow_udf(K.lean_column(run), "struct<sequence_id: long, offset: long>")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``
    and, if wanted, ``ids``. ``tokenizer`` is the path of a tokenizer file that every worker can read."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    pieces = scratch.table(base.mapInArrow(K.lean(_pieces(tokenizer, capacity, end_id, with_ids)), schema))
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():  # capacity rows at most
        counts[n] = c
    patterns = best_two_fit(counts)
    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    out = ranked(pieces, ["length"], order, buckets=buckets_for(int(counts.sum())), ties=[F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    out = out.withColumn("__at", _placed(*_places(patterns, capacity))("length", "rank"))
    return scratch.finish(out.select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset", *["ids"] * with_ids))
