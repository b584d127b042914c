"""Benchmark decontamination with a generalised suffix automaton.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
A window is ``window`` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window. Document words inside any occurrence of a
window are hits.

The items' words go into one generalised suffix automaton. Document words are
streamed through it, which yields the longest match that ends at each word and
the state it ends in; from the state follow the items that have the window. A
stretch of words can only match where each pair of neighbours is a pair of
neighbours in some item too, so numpy finds those stretches first and just they
are streamed.

The work is local to a row: no shuffle, whatever the documents hold. The
benchmark is read in blocks of at most ``BLOCK_BYTES`` of text (or one item, if
that is longer); each block is one automaton and one pass, and only documents
with hits in it are written between passes.

Defined cases: null and empty texts have no words; empty items have no window;
items of a null id mark hits but are not listed; equal ids count as one item;
repeated rows get the same result each; an empty benchmark hits nothing; other
columns are ignored by ``find_contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import Scratch, ready
from . import kernel as K
from .rows import unwrapped, wrapped

#: Text of the benchmark that one automaton holds at most.
BLOCK_BYTES = 1 << 20
_MASK = K.U64((1 << 20) - 1)


class Automaton:
    """A generalised suffix automaton of token sequences.

    State 0 is the root. ``items[s]`` names the sequences with a window whose
    longest common state is ``s``; ``short[(s, m)]`` the whole sequences of
    ``m`` tokens, shorter than a window.
    """

    def __init__(self, sequences: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.length, self.link, self.step = [0], [-1], [{}]
        for _, tokens in sequences:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        self.base = [self._holding(s, window) for s in range(len(self.length))]
        self.items: dict[int, set] = {}
        self.short: dict[tuple[int, int], set] = {}
        for name, tokens in sequences:
            s = 0
            for k, t in enumerate(tokens):
                s = self.step[s][t]
                if k + 1 >= window:
                    self.items.setdefault(self.base[s], set()).add(name)
            if 0 < len(tokens) < window:
                self.short.setdefault((self._holding(s, len(tokens)), len(tokens)), set()).add(name)
        self.lengths = sorted({m for _, m in self.short})

    def _holding(self, s: int, n: int) -> int:
        """The state of the suffix of ``n`` tokens of what ``s`` holds (``s`` if that is shorter)."""
        while s > 0 and self.length[self.link[s]] >= n:
            s = self.link[s]
        return s

    def _split(self, p: int, q: int, t: int) -> int:
        copy = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.step.append(dict(self.step[q]))
        self.link[q] = copy
        while p != -1 and self.step[p].get(t) == q:
            self.step[p][t] = copy
            p = self.link[p]
        return copy

    def _extend(self, p: int, t: int) -> int:
        q = self.step[p].get(t)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, t)
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        self.step.append({})
        while p != -1 and t not in self.step[p]:
            self.step[p][t] = new
            p = self.link[p]
        if p != -1:
            q = self.step[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, t)
        return new

    def stream(self, tokens: list[int], lo: list[int], hi: list[int], names: set, at: int) -> None:
        """Adds the spans (from ``at`` on) and the sequences of all windows in ``tokens``."""
        s, n, step, link, length = 0, 0, self.step, self.link, self.length
        for k, t in enumerate(tokens):
            while s and t not in step[s]:
                s = link[s]
                n = length[s]
            to = step[s].get(t)
            if to is None:
                s = n = 0
                continue
            s, n = to, n + 1
            if n >= self.window:
                lo.append(at + k + 1 - n)
                hi.append(at + k + 1)
                names |= self.items[self.base[s]]
            for m in self.lengths:
                if m > n:
                    break
                if found := self.short.get((self._holding(s, m), m)):
                    lo.append(at + k + 1 - m)
                    hi.append(at + k + 1)
                    names |= found


class Matcher:
    """The automaton of a block and the words and pairs that its items have."""

    def __init__(self, names: list[str | None], texts: list[str | None], window: int):
        buf, at = K.text_bytes(pa.array(texts, pa.string()))
        w = K.words(buf, at, K.NOT_ALNUM, K.LOWER)
        sequences = [(name, w.hash[w.ptr[i] : w.ptr[i + 1]].tolist()) for i, name in enumerate(names)]
        self.automaton = Automaton(sequences, window)
        self.least = min((min(len(s), window) for _, s in sequences if s), default=0)
        self.known = np.unique(w.hash)
        inner = np.flatnonzero(w.place() > 0)
        self.pairs = np.unique(self._pair(w.hash[inner - 1], w.hash[inner]))
        self.maps = [self._map(x) for x in (self.known, self.pairs)]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.mix(a * K.U64(3) + b)

    @staticmethod
    def _map(x: np.ndarray) -> np.ndarray:
        out = np.zeros(int(_MASK) + 1, bool)
        out[(x & _MASK).astype(np.int64)] = True
        return out

    @staticmethod
    def _among(x: np.ndarray, have: np.ndarray, bits: np.ndarray) -> np.ndarray:
        out = bits[(x & _MASK).astype(np.int64)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(have, x[some]), len(have) - 1)
            out[some] = have[at] == x[some]
        return out

    def stretches(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words that have a chance to hold a window."""
        n = len(w.hash)
        if not n or not self.least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = np.zeros(n + 1, bool)  # word k continues a run with word k - 1
        joined[1:n] = self._among(self._pair(w.hash[:-1], w.hash[1:]), self.pairs, self.maps[1])
        joined[w.ptr[:-1]] = False
        if self.least > 1:
            first = np.flatnonzero(joined[1:] & ~joined[:-1])
            last = np.flatnonzero(joined[:-1] & ~joined[1:])
            return self._long(first, last + 1)
        known = self._among(w.hash, self.known, self.maps[0])
        first = np.flatnonzero(known & ~joined[:n])
        last = np.flatnonzero(known & ~joined[1:])
        return self._long(first, last + 1)

    def _long(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = end - first >= self.least
        return first[ok], end[ok]


_FOUND = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("starts", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType()))


def _finder(names: list, texts: list, window: int):
    """A column function: words, hits, items, and the hit spans as byte ranges of the text."""
    token = hash((tuple(names), tuple(texts), window))

    def run(text: pa.Array) -> pa.Array:
        known = K.cache("benchmark")
        if token not in known:
            known.clear()
            known[token] = Matcher(names, texts, window)
        m = known[token]
        buf, at = K.text_bytes(text)
        n_words, n_hit = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        items, starts, ends = [[]] * len(text), [[]] * len(text), [[]] * len(text)
        for i, j in K.groups(at):
            w = K.words(buf, at[i : j + 1], K.NOT_ALNUM, K.LOWER)
            n_words[i:j] = np.diff(w.ptr)
            first, end = m.stretches(w)
            if not len(first):
                continue
            doc = np.searchsorted(w.ptr, first, "right") - 1
            for d in np.unique(doc):
                lo, hi, got = [], [], set()
                for k in np.flatnonzero(doc == d):
                    m.automaton.stream(w.hash[first[k] : end[k]].tolist(), lo, hi, got, int(first[k]))
                if lo:
                    order = np.argsort(lo, kind="stable")
                    a, b = K.spans(np.array(lo)[order], np.array(hi)[order])
                    n_hit[i + d] = (b - a).sum()
                    items[i + d] = sorted(x for x in got if x is not None)
                    starts[i + d], ends[i + d] = w.start[a] - at[i + d], w.end[b - 1] - at[i + d]
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], [f.name for f in _FOUND])

    # so marked, a filter and a projection on the result share one evaluation
    return F.arrow_udf(K.lean_column(run), _FOUND).asNondeterministic()


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of ``BLOCK_BYTES`` of text at most (or one item), one at a time; at least one."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.orderBy("item", "text")
    names, texts, size = [], [], 0
    for name, text in ordered.toLocalIterator() if total > BLOCK_BYTES else ordered.collect():
        n = len(text.encode())
        if names and size + n > BLOCK_BYTES:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(name)
        texts.append(text)
        size += n
    yield names, texts


def _merged_spans(lists: pa.Array) -> pa.Array:
    out = []
    for row in lists:
        pairs = np.array(sorted(tuple(x.values()) for x in row.as_py()), np.int64).reshape(-1, 2)
        a, b = K.spans(pairs[:, 0], pairs[:, 1])
        out.append((a, b))
    return pa.StructArray.from_arrays([pa.array([a for a, _ in out], pa.list_(pa.int64())), pa.array([b for _, b in out], pa.list_(pa.int64()))], ["starts", "ends"])


def _found(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    ready(docs.sparkSession)
    text = F.col(text_col).cast("string")
    work = wrapped(docs, doc_id=F.col(id_col), text=text)
    blocks = _blocks(benchmark, item_col, item_text)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return work.withColumn("found", _finder(*block, window)("text"))
    scratch = Scratch(docs.sparkSession)
    keyed = work.withColumn("t", F.xxhash64("text"))
    parts = None
    for block in chain((block, following), blocks):
        hit = keyed.select("doc_id", "t", _finder(*block, window)("text").alias("f")).where("f.n_hit > 0").distinct()
        part = scratch.table(hit.select("doc_id", "t", "f"))
        parts = part if parts is None else parts.unionByName(part)
    merge = F.arrow_udf(K.lean_column(_merged_spans), T.StructType().add("starts", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType())))
    each = F.flatten(F.transform("fs", lambda f: F.arrays_zip(f["starts"].alias("s"), f["ends"].alias("e"))))
    names = F.sort_array(F.array_distinct(F.flatten(F.transform("fs", lambda f: f["items"]))))
    grouped = parts.groupBy("doc_id", "t").agg(F.collect_list("f").alias("fs"))  # a row per block at most
    both = grouped.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), merge(each).alias("m"), names.alias("items"))
    joined = keyed.join(both, [F.col("doc_id").eqNullSafe(F.col("d")), F.col("t") == F.col("u")], "left")
    recount = F.arrow_udf(K.lean_column(_recount), "struct<n_words: long, n_hit: long>")
    joined = joined.withColumn("n", recount("text", "m.starts", "m.ends"))
    none = F.array().cast("array<bigint>")
    return joined.withColumn("found", F.struct(F.col("n.n_words").alias("n_words"), F.col("n.n_hit").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("m.starts", none).alias("starts"), F.coalesce("m.ends", none).alias("ends")))


def _recount(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    buf, at = K.text_bytes(text)
    n_words, n_hit = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    for i, j in K.groups(at):
        w = K.words(buf, at[i : j + 1], K.NOT_ALNUM, K.LOWER)
        n_words[i:j] = np.diff(w.ptr)
        for k in range(i, j):
            if starts[k].is_valid:
                s = w.start[w.ptr[k - i] : w.ptr[k - i + 1]] - at[k]
                n_hit[k] = (np.searchsorted(s, ends[k].values.to_numpy()) - np.searchsorted(s, starts[k].values.to_numpy())).sum()
    return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_hit)], ["n_words", "n_hit"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: its id, ``n_words``, ``n_hit``, ``items`` (ids as text, sorted) and hit ``spans`` in bytes of the text."""
    out = _found(docs, benchmark, window, id_col, text_col, item_col, item_text)
    spans = F.arrays_zip(F.col("found.starts").alias("start"), F.col("found.ends").alias("end"))
    return out.select(F.col("doc_id").alias(id_col), "found.n_words", "found.n_hit", "found.items", spans.alias("spans"))


def _without(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for t, a, b in zip(text, starts, ends, strict=True):
        if not t.is_valid or not len(a):
            out.append(t.as_py())
            continue
        raw, done, parts = t.as_py().encode(), 0, []
        for s, e in zip(a.as_py(), b.as_py(), strict=True):
            parts.append(raw[done:s])
            done = e
        parts.append(raw[done:])
        out.append(b"".join(parts).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Cuts hit spans out of the texts; a document with more than ``max_coverage`` of its words hit goes."""
    out = _found(docs, benchmark, window, id_col, text_col, item_col, item_text)
    out = out.where(F.col("found.n_hit") <= max_coverage * F.col("found.n_words"))
    new: Column = F.arrow_udf(K.lean_column(_without), "string")("text", "found.starts", "found.ends")
    return unwrapped(out, docs.columns, {text_col: new})
