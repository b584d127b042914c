"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its
features; the document's is the noisy-or of its sentences, 1 - prod(1 - p). Only
documents have labels; the noisy-or decides during training which sentences
carry them, and so finds the offending ones.

Features are words and the byte n-grams (4 to 6) inside words, lower-cased.
Their document frequencies in toxic and other training documents give a
likelihood-ratio statistic; those above ``MIN_G2`` are kept, at most
``MAX_FEATURES``.

The classifier is trained on at most about ``max_train`` labelled documents,
drawn by a hash of the id (all, if there are fewer). Scoring sees every whole
text, row by row, without a shuffle.

Defined cases: null, empty and wordless texts have one sentence without
features (the base rate); labels without a document, or null, don't train; of
several labels of an id the largest holds; repeated documents get equal scores;
without both labels in training every score is their mean (0 without any);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import Scratch
from . import kernel as K

GRAMS = (4, 5, 6)
MAX_FEATURES = 4096
MIN_G2 = 30.0

_codes = np.arange(256)
_BREAK = np.isin(_codes, [10, 33, 46, 63])  # line feed ! . ?


def features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All features of adjacent texts: hash and the byte where each starts."""
    w = K.words(buf, at, K.NOT_ALNUM, K.LOWER)
    hashes, places = [w.hash], [w.start]
    lo = int(at[0])
    raw = K.LOWER[buf[lo : int(at[-1])]].astype(np.uint64)
    for n in GRAMS:
        count = np.maximum(w.end - w.start - n + 1, 0)
        p = K.ranges(w.start, count)
        value = np.zeros(len(p), K.U64)
        for k in range(n):
            value = (value << K.U64(8)) | raw[p - lo + k]
        hashes.append(K.mix(value ^ K.U64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
        places.append(p)
    return np.concatenate(hashes), np.concatenate(places)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: how many toxic and other documents have each feature."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        buf, at = K.text_bytes(batch.column("text"))
        for i, j in K.groups(at):
            h, p = features(buf, at[i : j + 1])
            doc = np.searchsorted(at[i : j + 1], p, "right") - 1
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, y = h[new], label[i + doc[new]]
            u, first = np.unique(h, return_index=True)
            if len(u):
                toxic = np.add.reduceat(y, first)
                yield pa.record_batch([pa.array(K.signed(u)), pa.array(toxic.astype(np.int64)), pa.array(np.diff(np.append(first, len(h))) - toxic)], ["h", "pos", "neg"])


class Model:
    """Sorted feature hashes, their weights and the base."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, base: float):
        self.hashes, self.weights, self.base = hashes, weights, base

    def sentences(self, buf: np.ndarray, at: np.ndarray):
        """For adjacent texts: feature numbers, their sentence (counted over all texts), each text's first sentence, and the sentence starts."""
        lo, hi = int(at[0]), int(at[-1])
        breaks = np.flatnonzero(_BREAK[buf[lo:hi]]) + lo + 1
        starts = np.unique(np.concatenate((breaks[breaks < hi], at[:-1][np.diff(at) > 0]))) if hi > lo else np.zeros(0, np.int64)
        h, p = features(buf, at)
        number = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        hit = self.hashes[number] == h if len(self.hashes) else np.zeros(len(h), bool)
        s = np.searchsorted(starts, p[hit], "right") - 1
        both = np.unique(s * (len(self.hashes) + 1) + number[hit]) if hit.any() else np.zeros(0, np.int64)
        return both % (len(self.hashes) + 1), both // (len(self.hashes) + 1), np.searchsorted(starts, at), starts

    def logits(self, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return self.base + np.bincount(sentence, self.weights[feature], n)


def _bags(hashes: np.ndarray):
    """Feature numbers per sentence; sentences without features are only counted."""
    model = Model(hashes, np.zeros(len(hashes)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = K.text_bytes(batch.column("text"))
            for i, j in K.groups(at):
                f, s, first, starts = model.sentences(buf, at[i : j + 1])
                cut = np.searchsorted(s, first)
                yield pa.record_batch(
                    [batch.column("label").slice(i, j - i), pa.array(np.maximum(np.diff(first), 1)), pa.array([f[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())), pa.array([s[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64()))],
                    ["label", "n", "f", "s"],
                )

    return run


def noisy_or_fit(y: np.ndarray, empty: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int, *, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and base by gradient steps (Adam) on the documents' log loss.

    ``doc`` gives each sentence's document; ``sentence`` and ``feature`` are the
    non-zero entries; ``empty`` counts each document's sentences without any.
    """
    n = len(y)
    theta = np.zeros(n_features + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, theta[feature], len(doc))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        log_q = -np.bincount(doc, np.logaddexp(0, z), n) - empty * np.logaddexp(0, theta[-1])
        q = np.exp(log_q)
        pull = np.where(y > 0, -q / np.maximum(1 - q, 1e-9), 1.0) / n
        dz = pull[doc] * p
        grad = np.append(np.bincount(feature, dz[sentence], n_features), dz.sum() + (pull * empty).sum() * p0)
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, *, held_out: Column | None = None, max_train: int = 16000) -> Model:
    """Trains on ``labels`` (``doc_id``, ``toxic``) whose id isn't held out."""
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.coalesce(~held_out, F.lit(False)) if held_out is not None else F.lit(True)).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("label"))
    count = known.count()
    if count > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * max_train / count))
    known = scratch.table(known)  # about max_train rows at most
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "text"])
    sample = scratch.table(sample.select("label", "text"), partitions=12)
    pos, n = sample.agg(F.sum("label"), F.count("*")).first()
    pos = pos or 0
    if not pos or pos == n:
        scratch.drop()
        rate = (pos + 0.0) / max(n, 1)
        return Model(np.zeros(0, K.U64), np.zeros(0), 20.0 if rate else -20.0)
    found = sample.mapInArrow(K.lean(_frequencies), "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).where("a >= 5")
    P, N = F.lit(float(pos)), F.lit(float(n - pos))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def part(x: Column, whole: Column) -> Column:
        expected = whole * (a + b) / (P + N)
        rest, other = whole - x, whole - expected
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0) + F.when((rest > 0) & (other > 0), rest * F.log(rest / other)).otherwise(0)

    g2 = 2 * (part(a, P) + part(b, N))
    best = found.withColumn("g", g2).where(F.col("g") >= MIN_G2).orderBy(F.desc("g"), "h").limit(MAX_FEATURES).select("h").collect()
    hashes = np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))
    bags = sample.mapInArrow(K.lean(_bags(hashes)), "label long, n long, f array<long>, s array<long>").collect()  # feature numbers of the bounded sample
    y = np.array([r[0] for r in bags], float)
    entries = np.array([len(r[2]) for r in bags])
    owner = np.repeat(np.arange(len(bags)), entries)
    f = np.array([x for r in bags for x in r[2]], np.int64)
    s = np.array([x for r in bags for x in r[3]], np.int64)
    keys, sentence = np.unique(owner * (1 << 40) + s, return_inverse=True)
    doc = keys >> 40
    empty = np.array([r[1] for r in bags], float) - np.bincount(doc, minlength=len(bags))
    weights, base = noisy_or_fit(y, np.maximum(empty, 0), doc, sentence, f, len(hashes))
    scratch.drop()
    return Model(hashes, weights, base)


_KIND = T.StructType().add("score", "double").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("score", "double")))


def scores(model: Model, text: Column, *, offending: float = 0.5) -> Column:
    """A struct column of a text's ``score`` and the ``spans`` of sentences scored ``offending`` or more."""
    packed = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])

    def run(column: pa.Array) -> pa.Array:
        buf, at = K.text_bytes(column)
        out = []
        for i, j in K.groups(at):
            f, s, first, starts = model.sentences(buf, at[i : j + 1])
            z = model.logits(f, s, len(starts))
            p = 1 / (1 + np.exp(-z))
            loss = np.append(0.0, np.cumsum(np.logaddexp(0, z)))
            for k in range(j - i):
                a, b = int(first[k]), int(first[k + 1])
                score = -np.expm1(-(loss[b] - loss[a])) if b > a else 1 / (1 + np.exp(-model.base))
                spans = []
                for x in np.flatnonzero(p[a:b] >= offending) + a:
                    end = starts[x + 1] if x + 1 < b else at[i + k + 1]
                    spans.append({"start": int(starts[x] - at[i + k]), "end": int(end - at[i + k]), "score": float(p[x])})
                out.append({"score": float(min(max(score, 0.0), 1.0)), "spans": spans})
        return pa.array(out, packed)

    # so marked, a filter and a projection on the result share one evaluation
    return F.arrow_udf(K.lean_column(run), _KIND).asNondeterministic()(text)
