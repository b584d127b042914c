"""Line dedup with overlapping three-line windows.

Lines are the non-empty runs between line feeds. Each ``window`` consecutive
lines of a document are hashed together (128 bits). Of all places of one window
the first, by document id and then by place, stays; the lines that the others
cover are merged and removed. A frequent line alone removes nothing: all lines
of the window have to repeat in order.

The windows are aggregated to their first place with partial sums, and only the
repeated ones return to their documents, so a passage that a third of the
documents share is never gathered.

Defined cases: null and empty texts have no lines and stay as they are, as does
a text of which nothing is removed; of others the remaining lines are joined by
one line feed. Documents of fewer lines than a window stay. Rows of a null id
neither give nor take. Repeated rows (id and text) count once and get the same
result each; of different texts with one id the earlier place wins. Other
columns are kept; ``n_lines`` and ``n_removed`` replace input columns of those
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import Scratch
from . import kernel as K
from .rows import unwrapped, wrapped

_LINE_FEED = np.arange(256) == 10


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "t"))
            buf, at = K.text_bytes(batch.column("text"))
            for i, j in K.groups(at):
                w = K.words(buf, at[i : j + 1], _LINE_FEED)
                a = K.window_hash(w.hash, window, 1)
                if not len(a):
                    continue
                b = K.window_hash(w.hash, window, 2)
                place, owner = w.place()[: len(a)], w.owner()[: len(a)]
                ok = np.flatnonzero(place + window <= np.diff(w.ptr)[owner])
                doc = owner[ok] + i
                yield pa.record_batch([pa.array(K.signed(a[ok])), pa.array(K.signed(b[ok])), pa.array(ids[doc]), pa.array(keys[doc]), pa.array(place[ok].astype(np.int64))], ["a", "b", "doc_id", "t", "pos"])

    return run


def _kept(window: int):
    def run(text: pa.Array, hits: pa.Array) -> pa.Array:
        buf, at = K.text_bytes(text)
        texts, lines, gone = [], np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for i, j in K.groups(at):
            w = K.words(buf, at[i : j + 1], _LINE_FEED)
            for k in range(i, j):
                lo, hi = int(w.ptr[k - i]), int(w.ptr[k - i + 1])
                lines[k] = hi - lo
                if not hits[k].is_valid:
                    texts.append(text[k].as_py())
                    continue
                s = np.sort(hits[k].values.to_numpy())
                keep = np.ones(hi - lo, bool)
                a, b = K.spans(s, s + window)
                keep[K.ranges(a, b - a)] = False
                gone[k] = (~keep).sum()
                chosen = np.flatnonzero(keep) + lo
                texts.append("\n".join(buf[w.start[x] : w.end[x]].tobytes().decode("utf-8", "replace") for x in chosen))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(lines), pa.array(gone)], ["text", "n_lines", "n_removed"])

    return F.arrow_udf(K.lean_column(run), T.StructType().add("text", "string").add("n_lines", "long").add("n_removed", "long"))


def dedup_lines(docs: DataFrame, *, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes lines covered by a window of lines that occurred before (see the module's text).

    Returns the input's rows and columns with the remaining text, and
    ``n_lines`` (before) and ``n_removed``.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col).cast("string")
    work = wrapped(docs, doc_id=F.col(id_col).cast("long"), text=text, t=F.xxhash64(text))
    found = work.where("doc_id is not null").select("doc_id", "t", "text").mapInArrow(K.lean(_windows(window)), "a long, b long, doc_id long, t long, pos long")
    place = F.struct("doc_id", "pos", "t")
    # written, so that the join's large side is a shuffle of its own, which Spark can split at a frequent window
    first = scratch.table(found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("a", "b", "first"))
    later = found.join(first, ["a", "b"]).where(place > F.col("first"))
    hits = scratch.table(later.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("hits")))
    # A merge join at every size: the hits grow with the corpus, so no plan may rest on their being few.
    out = work.join(hits.hint("merge"), ["doc_id", "t"], "left").withColumn("__new", _kept(window)("text", "hits"))
    new = F.col("__new")
    return unwrapped(out, docs.columns, {text_col: new["text"], "n_lines": new["n_lines"], "n_removed": new["n_removed"]})
