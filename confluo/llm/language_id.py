"""Language identification: script ranges, then Viterbi over words.

A word's score for a language is the sum of its byte n-gram log-probabilities
(two to four bytes, word ends included, hashed to ``SLOTS``). The script of its
first letter narrows the languages that may take it to those seen with that
script in training. Viterbi with a penalty for each switch labels every word,
so that a text of several languages falls into spans; the language with the
most letters, each word of a mixed text taken once, is the document's.

Viterbi is exact but mostly free: where no stretch of words gains more than the
penalty in any other language, nor the first and the last together, the best
path stays in one, which running sums over all words of a batch decide at once. Only texts that may switch are walked
word by word.

The model is trained on at most about ``max_train`` labelled documents, drawn by
a hash of their id and text (all, if there are fewer), and of a rare language at
least about ``LEAST_TRAIN`` (or all): its size and cost grow with the number of
languages, not with the corpus. Everything else sees every document as a whole, row by
row and without a shuffle.

Defined cases: null texts and texts without a letter are ``und``, score 0; a
word in a script that no language has is open to all; rows without a language
don't train; repeated rows get equal results; with no training rows all is
``und``; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import Scratch
from . import kernel as K

SLOTS = 1 << 16
SWITCH = 12.0
#: Documents that a rare language is learned from at least, as far as it has them.
LEAST_TRAIN = 200
#: What one word can count for or against a language at most, and how far a summed margin is trusted.
WORD_LIMIT = 6.0
UNDETERMINED = "und"

_LETTERS = K.NOT_ALNUM | ((np.arange(256) >= 48) & (np.arange(256) <= 57))  # separators: all but letters and non-ASCII

#: Scripts by the leading byte of a UTF-8 character.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")


def _script_table() -> np.ndarray:
    t = np.zeros(256, np.int8)
    for name, ranges in {"latin": [(65, 90), (97, 122), (0xC3, 0xC9)], "greek": [(0xCD, 0xCF)], "cyrillic": [(0xD0, 0xD4)], "hebrew": [(0xD6, 0xD7)], "arabic": [(0xD8, 0xDB)], "indic": [(0xE0, 0xE0)], "other": [(0xE1, 0xE2), (0xF0, 0xF7), (0xC2, 0xC2), (0xCA, 0xCC), (0xD5, 0xD5), (0xDC, 0xDF)], "kana": [(0xE3, 0xE3)], "han": [(0xE4, 0xE9)], "hangul": [(0xEA, 0xED)]}.items():
        for lo, hi in ranges:
            t[lo : hi + 1] = SCRIPTS.index(name)
    return t


_SCRIPT = _script_table()


def _grams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Folded bytes, hashed n-grams that end at each byte, and which bytes count (letters and the byte after a word)."""
    lo, hi = int(at[0]), int(at[-1])
    b = K.LOWER[buf[lo:hi]].astype(np.uint32)
    b[_LETTERS[buf[lo:hi]]] = 32
    first = np.unique(at[:-1][np.diff(at) > 0]) - lo
    value, out, prev = b.copy(), [], b
    for n in (1, 2, 3):
        moved = np.empty_like(prev)
        moved[0], moved[1:] = 32, prev[:-1]
        moved[first] = 32
        prev = moved
        value = value | (prev << np.uint32(8 * n))
        out.append(((value * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(16)).astype(np.int64))
        if n == 1:
            counts = (b != 32) | (prev != 32)
    return b, out, counts


def _counter(langs: list[str]):
    def run(batches):
        total = {x: np.zeros(SLOTS, np.int64) for x in langs}
        scripts = {x: np.zeros(len(SCRIPTS), np.int64) for x in langs}
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            buf, at = K.text_bytes(batch.column("text"))
            for i in range(batch.num_rows):
                for lo in range(int(at[i]), int(at[i + 1]), K.PIECE):
                    piece = np.array([lo, min(lo + K.PIECE, int(at[i + 1]))])
                    _, grams, counts = _grams(buf, piece)
                    for g in grams:
                        total[lang[i]] += np.bincount(g[counts], minlength=SLOTS)
                    scripts[lang[i]] += np.bincount(_SCRIPT[buf[piece[0] : piece[1]]], minlength=len(SCRIPTS))
        yield pa.record_batch([pa.array(langs), pa.array([total[x].astype("<i8").tobytes() for x in langs], pa.binary()), pa.array([scripts[x].astype("<i8").tobytes() for x in langs], pa.binary())], ["lang", "grams", "scripts"])

    return run


def _added(table: pa.Table) -> pa.Table:
    out = [np.sum([np.frombuffer(x, "<i8") for x in table.column(c).to_pylist()], axis=0).astype("<i8").tobytes() for c in ("grams", "scripts")]
    return pa.table({"lang": [table.column("lang")[0].as_py()], "grams": pa.array([out[0]], pa.binary()), "scripts": pa.array([out[1]], pa.binary())})


class Model:
    """Languages, their n-gram log-probabilities and the scripts that each may take."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        weight = grams + 0.2
        self.logp = np.log(weight / weight.sum(1, keepdims=True)).astype(np.float32).T.copy()
        self.logp -= self.logp.mean(1, keepdims=True)
        letters = scripts.astype(float)
        letters[:, 0] = 0
        share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
        # non-ASCII symbols (quotes, dashes) occur in every script
        self.allowed = share.T >= 0.02
        self.allowed[~self.allowed.any(1)] = True
        self.allowed[SCRIPTS.index("none")] = True


def train(labelled: DataFrame, scratch: Scratch, *, max_train: int) -> Model | None:
    """``labelled`` has ``text`` and ``lang``; the rows of a hash below the wanted share of their language are used."""
    rows = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a number per language
    count = sum(counts.values())
    if count > max_train:
        below = [F.lit(x) for k, n in counts.items() for x in (k, int(1_000_003 * min(1.0, max(max_train / count, LEAST_TRAIN / n))))]
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < F.create_map(*below)[F.col("lang")])
    rows = scratch.table(rows.select("lang", "text"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    schema = "lang string, grams binary, scripts binary"
    parts = rows.coalesce(16).mapInArrow(K.lean(_counter(langs)), schema)
    got = {r["lang"]: r for r in parts.groupBy("lang").applyInArrow(_added, schema).collect()}
    return Model(langs, np.array([np.frombuffer(got[x]["grams"], "<i8") for x in langs]), np.array([np.frombuffer(got[x]["scripts"], "<i8") for x in langs]))


def _may_switch(scores: np.ndarray, ptr: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """Texts whose best path may switch: no other's does.

    Gains are against the best single language. A path that has it somewhere
    leaves it for stretches that pay a penalty each at least, so one of them has
    to gain more. A path without it pays one penalty less than it has stretches;
    if none gains more than one, the first and the last together have to.
    """
    n = np.diff(ptr)
    owner = np.repeat(np.arange(len(n)), n)
    out = np.zeros(len(n), bool)
    if not len(owner):
        return out
    base = scores[np.arange(len(owner)), best[owner]]
    far = 1e7 * owner
    some = np.flatnonzero(n)
    first, last = np.full(len(some), -np.inf), np.full(len(some), -np.inf)
    for k in range(scores.shape[1]):
        c = np.cumsum(scores[:, k].astype(np.float64) - base)
        before = c - (scores[:, k] - base)
        start = before[ptr[some]]
        c -= np.repeat(start, n[some])
        before -= np.repeat(start, n[some])
        gain = c - (np.minimum.accumulate(before - far) + far)
        out[some] |= np.maximum.reduceat(gain, ptr[some]) > penalty
        other = best[some] != k
        np.maximum(first, np.maximum.reduceat(c, ptr[some]), out=first, where=other)
        np.maximum(last, c[ptr[some] + n[some] - 1] - np.minimum.reduceat(before, ptr[some]), out=last, where=other)
    out[some] |= first + last > penalty
    return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, a switch costing ``penalty``."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int32)
    v = scores[0].astype(np.float64)
    own = np.arange(k)
    for t in range(1, n):
        b = int(v.argmax())
        stay = v >= v[b] - penalty
        back[t] = np.where(stay, own, b)
        v = np.where(stay, v, v[b] - penalty) + scores[t]
    path = np.zeros(n, np.int32)
    path[-1] = int(v.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


class Labeller:
    """Word labels of whole texts under a model."""

    def __init__(self, model: Model, penalty: float = SWITCH):
        self.m, self.penalty = model, penalty

    def words(self, buf: np.ndarray, at: np.ndarray) -> tuple[K.Words, np.ndarray]:
        w = K.words(buf, at, _LETTERS)
        scores = np.zeros((len(w.hash), len(self.m.langs)), np.float32)
        lo, hi = int(at[0]), int(at[-1])
        done = lo
        while done < hi and len(w.start):
            upto = min(hi, done + K.PIECE // 2)
            if upto < hi:  # to the start of a word
                k = int(np.searchsorted(w.start, upto))
                upto = int(w.start[k]) if k < len(w.start) else hi
            a, b = np.searchsorted(w.start, [done, upto])
            if b > a:
                inner = at[(at > done) & (at < upto)]
                _, grams, counts = _grams(buf, np.concatenate(([done], inner, [upto])))
                s = self.m.logp[grams[0]]
                s += self.m.logp[grams[1]]
                s += self.m.logp[grams[2]]
                s[~counts] = 0
                scores[a:b] = np.add.reduceat(s, w.start[a:b] - done, axis=0)
            done = upto
        if len(scores):
            scores -= scores.max(1, keepdims=True)
            np.maximum(scores, -WORD_LIMIT, out=scores)
            scores[~self.m.allowed[_SCRIPT[buf[w.start]]]] = -2 * WORD_LIMIT
        return w, scores

    def __call__(self, text: pa.Array, spans: bool) -> list:
        buf, at = K.text_bytes(text)
        out = []
        for i, j in K.groups(at):
            w, scores = self.words(buf, at[i : j + 1])
            n, size = np.diff(w.ptr), (w.end - w.start).astype(np.float64)
            total = np.zeros((j - i, scores.shape[1]))
            some = np.flatnonzero(n)
            if len(some):
                total[some] = np.add.reduceat(scores.astype(np.float64), w.ptr[some], axis=0)
            best = total.argmax(1)
            walk = _may_switch(scores, w.ptr, best, self.penalty)
            for k in range(j - i):
                a, b = int(w.ptr[k]), int(w.ptr[k + 1])
                if not text[i + k].is_valid or a == b or not _has_letter(buf[at[i + k] : at[i + k + 1]]):
                    out.append((UNDETERMINED, 0.0, []))
                    continue
                path = viterbi(scores[a:b], self.penalty) if walk[k] else np.full(b - a, best[k], np.int32)
                letters = np.bincount(path, size[a:b], scores.shape[1])
                if walk[k]:  # a repeated word counts once, so that one line many times over isn't the language of a text
                    once = np.unique(w.hash[a:b], return_index=True)[1]
                    letters = np.bincount(path[once], size[a:b][once], scores.shape[1])
                first = int(letters.argmax())
                # of the words that the path gives to the label: it has no smaller sum over them than any other language
                own = scores[a:b][path == first].sum(0, dtype=np.float64)
                others = np.delete(own, first)
                margin = own[first] - (others.max() if len(others) else -30.0)
                sure = 1 / (1 + np.exp(-min(max(margin, -30), 30)))
                cuts = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [b - a])) if spans else []
                marks = [(self.m.langs[path[x]], int(w.start[a + x] - at[i + k]), int(w.end[a + y - 1] - at[i + k])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                out.append((self.m.langs[first], float(letters[first] / letters.sum() * sure), marks))
        return out


def _has_letter(raw: np.ndarray) -> bool:
    return bool((~_LETTERS[raw] & (raw < 128)).any()) or any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


_KIND = T.StructType().add("lang", "string").add("score", "double").add("spans", T.ArrayType(T.StructType().add("lang", "string").add("start", "long").add("end", "long")))


def labels(model: Model | None, text: Column, *, spans: bool = True, penalty: float = SWITCH) -> Column:
    """A struct column of ``lang``, ``score`` and ``spans`` (language, first and last byte) of a text column."""
    packed = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(column: pa.Array) -> pa.Array:
        K.cache("language")
        got = Labeller(model, penalty)(column, spans) if model else [(UNDETERMINED, 0.0, [])] * len(column)
        return pa.array([{"lang": a, "score": b, "spans": [{"lang": x, "start": y, "end": z} for x, y, z in c]} for a, b, c in got], packed)

    # so marked, a filter and a projection on the result share one evaluation
    return F.arrow_udf(K.lean_column(run), _KIND).asNondeterministic()(text)


def fit(docs: DataFrame, *, held_out: Column | None = None, max_train: int = 8000) -> Model | None:
    """Trains on ``text`` and ``lang`` of the documents that aren't held out."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("out"))
    model = train(rows.where("not out"), scratch, max_train=max_train)
    scratch.drop()
    return model


def fold(id_col: str, n: int) -> Column:
    """CRC-32 of an id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))
