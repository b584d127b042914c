"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words of one document. A word goes if a
window that covers it also starts in a document with a smaller id.

Positions whose remainder modulo ``PERIOD`` is in ``COVER`` carry an anchor, a
hash of the next ``window - PERIOD + 1`` words. The cover is a perfect
difference set: any two places in any two documents have a common shift below
the period that puts both on cover positions. So two equal windows always share
an anchor at the same distance from their starts, wherever they stand, while
only a fifth of all positions is hashed and shuffled.

1. Anchors are aggregated (per batch, per task, then globally) to the smallest
   and the largest id; those of one document alone are dropped.
2. The anchors that are left go back to their documents. Only windows around
   them can repeat. Of equal texts one stands for all.
3. Those windows (extension of the anchors to the full length) are aggregated by
   a 128-bit hash to the smallest id that has them, and return as covered words
   to documents with larger ids.

A passage that a third of the documents share is one key with partial
aggregates, and joins against written tables of keys, whose other side can be
split at such a key; nothing collects or pairs the members of a group.

Defined cases: null and empty texts have no words; documents with fewer words
than a window keep all; a null id neither gives nor takes (all words kept);
repeated rows with one id and text get the same result each; rows of one id with
different texts do not remove from one another (only smaller ids count); other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from ..plans.scratch import Scratch

#: The perfect difference set for period 31 (Singer).
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def _anchors(batch: pa.RecordBatch, window: int):
    """Per group of texts: anchor hash, document number in the batch, place."""
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    length = window - PERIOD + 1
    buf, at = K.text_bytes(batch.column("text"))
    for i, j in K.groups(at):
        w = K.words(buf, at[i : j + 1], K.SPACE)
        count = np.diff(w.ptr)
        h = K.window_hash(w.hash, length)
        place, owner = w.place()[: len(h)], w.owner()[: len(h)]
        at_ = np.flatnonzero(on[place % PERIOD] & (place + length <= count[owner]) & (count[owner] >= window))
        yield K.signed(h[at_]), owner[at_] + i, place[at_]


def _summed_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            hs, ds = [], []
            for h, doc, _ in _anchors(batch, window):
                hs.append(h)
                ds.append(ids[doc])
            if hs:
                h, d = np.concatenate(hs), np.concatenate(ds)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
                last = np.append(first[1:], len(h)) - 1
                if len(first):
                    yield pa.record_batch([pa.array(h[first]), pa.array(d[first]), pa.array(d[last])], ["h", "lo", "hi"])

    return run


def _placed_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "t"))
            for h, doc, place in _anchors(batch, window):
                if len(h):
                    yield pa.record_batch([pa.array(h), pa.array(ids[doc]), pa.array(keys[doc]), pa.array(place.astype(np.int32))], ["h", "doc_id", "t", "pos"])

    return run


def kept_pieces(w: K.Words, lo: int, hi: int, keep: np.ndarray, step: int = 200_000) -> Iterator[bytes]:
    """Kept words among ``lo`` to ``hi``, joined by one space, in pieces."""
    chosen = np.flatnonzero(keep) + lo
    for k in range(0, len(chosen), step):
        part = chosen[k : k + step]
        size = w.end[part] - w.start[part] + 1
        index = K.ranges(w.start[part], size)
        out = w.buf[np.minimum(index, len(w.buf) - 1)]
        out[np.cumsum(size) - 1] = 32
        yield out[: -1 if k + step >= len(chosen) else None].tobytes()


def _result(w: K.Words, i: int, keep: np.ndarray, digest: bool) -> str:
    pieces = kept_pieces(w, int(w.ptr[i]), int(w.ptr[i + 1]), keep)
    if digest:
        h = hashlib.sha256()
        for p in pieces:
            h.update(p)
        return h.hexdigest()
    return b"".join(pieces).decode("utf-8", "replace")


_SCHEMA = "doc_id long, t long, n_words long, n_removed long, kept string, todo string, starts array<int>"


def _sorted_out(window: int, digest: bool):
    """Finishes the texts that can't lose words, or are copies; the others keep their text and candidate window starts."""
    reach = PERIOD - 1
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("todo", pa.string()), ("starts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, first = (batch.column(c) for c in ("doc_id", "t", "first"))
            places = batch.column("places")
            buf, at = K.text_bytes(batch.column("text"))
            for i, j in K.groups(at):
                w = K.words(buf, at[i : j + 1], K.SPACE)
                rows = []
                for k in range(i, j):
                    n = int(w.ptr[k - i + 1] - w.ptr[k - i])
                    doc = ids[k].as_py()
                    copy = doc is not None and first[k].as_py() is not None and first[k].as_py() < doc
                    if n >= window and not copy and places[k].is_valid:
                        p = np.sort(places[k].values.to_numpy().astype(np.int64))
                        lo, hi = np.maximum(p - reach, 0), np.minimum(p, n - window) + 1
                        lo, hi = K.spans(lo, np.maximum(hi, lo))
                        rows.append((doc, keys[k].as_py(), n, None, None, bytes(buf[at[k] : at[k + 1]]).decode(), K.ranges(lo, hi - lo).astype(np.int32)))
                    else:
                        gone = n >= window and copy
                        rows.append((doc, keys[k].as_py(), n, n if gone else 0, _result(w, k - i, np.full(n, not gone), digest), None, None))
                yield pa.record_batch([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(7)], schema=schema)

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "t"))
            starts = batch.column("starts")
            buf, at = K.text_bytes(batch.column("todo"))
            for i, j in K.groups(at):
                w = K.words(buf, at[i : j + 1], K.SPACE)
                a, b = K.window_hash(w.hash, window, 1), K.window_hash(w.hash, window, 2)
                each = [starts[k].values.to_numpy() for k in range(i, j)]
                owner = np.repeat(np.arange(i, j), [len(x) for x in each])
                place = np.concatenate(each) if each else np.zeros(0, np.int32)
                at_ = place + w.ptr[owner - i]
                yield pa.record_batch([pa.array(K.signed(a[at_])), pa.array(K.signed(b[at_])), pa.array(ids[owner]), pa.array(keys[owner]), pa.array(place.astype(np.int32))], ["a", "b", "doc_id", "t", "pos"])

    return run


def _cut(window: int, digest: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, hits = (batch.column(c) for c in ("doc_id", "t", "hits"))
            buf, at = K.text_bytes(batch.column("todo"))
            for i, j in K.groups(at):
                w = K.words(buf, at[i : j + 1], K.SPACE)
                rows = []
                for k in range(i, j):
                    n = int(w.ptr[k - i + 1] - w.ptr[k - i])
                    keep = np.ones(n, bool)
                    if hits[k].is_valid:
                        s = np.sort(hits[k].values.to_numpy().astype(np.int64))
                        lo, hi = K.spans(s, s + window)
                        keep[K.ranges(lo, hi - lo)] = False
                    rows.append((ids[k].as_py(), keys[k].as_py(), n, int(n - keep.sum()), _result(w, k - i, keep, digest)))
                yield pa.record_batch([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(5)], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, *, window: int = 50, digest: bool = False) -> DataFrame:
    """Removes words covered by a repeated window (see the module's text).

    ``docs`` needs ``doc_id`` and ``text``. Returns a row per input row:
    ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words that stay
    joined by one space, or with ``digest`` the SHA-256 of that in hex.
    """
    if window < PERIOD + 4:
        raise ValueError(f"a window needs {PERIOD + 4} words at least")
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("t", F.xxhash64("text"))
    known = base.where("doc_id is not null")

    sums = known.select("doc_id", "text").mapInArrow(K.lean(_summed_anchors(window)), "h long, lo long, hi long")
    # written, so that the join's large side is a shuffle of its own, which Spark can split at a frequent anchor
    shared = scratch.table(sums.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("h"))
    placed = known.mapInArrow(K.lean(_placed_anchors(window)), "h long, doc_id long, t long, pos int")
    places = scratch.table(placed.join(shared, "h", "left_semi").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("places")))

    key = F.sha2("text", 256).alias("k")
    first = known.select(key, "doc_id").groupBy("k").agg(F.min("doc_id").alias("first"))
    ranked = known.select(key, "doc_id", "t").distinct().join(first, "k").where("first < doc_id").select("doc_id", "t", "first")
    notes = ranked.join(places, ["doc_id", "t"], "full_outer")
    sorted_out = scratch.table(base.join(notes, ["doc_id", "t"], "left").select("doc_id", "t", "text", "first", "places").mapInArrow(K.lean(_sorted_out(window, digest)), _SCHEMA))

    todo = sorted_out.where("todo is not null").select("doc_id", "t", "todo", "starts")
    found = todo.mapInArrow(K.lean(_windows(window)), "a long, b long, doc_id long, t long, pos int")
    least = scratch.table(found.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "b", "lo"))
    hits = scratch.table(found.join(least, ["a", "b"]).where("doc_id > lo").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("hits")))
    cut = todo.drop("starts").join(hits, ["doc_id", "t"], "left").select("doc_id", "t", "todo", "hits").mapInArrow(K.lean(_cut(window, digest)), "doc_id long, t long, n_words long, n_removed long, kept string")
    ended = sorted_out.where("todo is null").select("doc_id", "t", "n_words", "n_removed", "kept")
    return scratch.finish(ended.unionByName(cut).select("doc_id", "n_words", "n_removed", "kept"))
