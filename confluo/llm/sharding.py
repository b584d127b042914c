"""A uniform shuffle into shards of exact sizes.

Rows are dealt into source blocks by a hash of their content. How many rows of
each block go to each shard is drawn once, from the multivariate hypergeometric
distribution, with the shard sizes as margins: the communication matrix of a
uniform random permutation. Then each block is permuted and cut by its row of
the matrix, the rows are exchanged, and each shard is permuted again. Every
arrangement is equally likely, and shard sizes differ by one at most.

The matrix has at most ``MATRIX`` numbers. Blocks and shards are ranked in
buckets (see ``ranking``), so no task holds a whole shard. All random keys are
hashes of content and seed: a task that runs again after a lost executor makes
the same rows.

Defined cases: null and empty texts are rows like others; repeated rows have
equal keys and are interchangeable, each gets its own slot; with no rows the
result is empty; other columns stay, ``shard`` and ``slot`` replace input
columns of those names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ready
from .ranking import buckets_for, ranked
from .rows import ROW, unwrapped, wrapped

MATRIX = 1_000_000
_NUMPY = 10**9  # numpy takes populations below this
_FEW = 30.0  # a mean from which rejection is used


def _grown(a: int, d: int) -> float:
    """``log((a + d)!) - log(a!) - d * log(a)`` for a > 0 and d > -a, without large terms that cancel."""
    t = d / a
    if abs(t) < 1e-2:
        curve, term = 0.0, t
        for k in range(2, 12):
            term *= t
            curve += term / (k * (k - 1)) if k % 2 == 0 else -term / (k * (k - 1))
    else:
        curve = (1 + t) * math.log1p(t) - t
    return a * curve + 0.5 * math.log1p(t) + (1 / (a + d) - 1 / a) / 12 - (1 / (a + d) ** 3 - 1 / a**3) / 360 + (1 / (a + d) ** 5 - 1 / a**5) / 1260


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """The exact law for populations of any size, on whole numbers of Python.

    By symmetry the smaller side is counted. A small mean is drawn by adding up
    probabilities from zero, a larger one by ratio-of-uniforms rejection, whose
    logarithms are taken relative to the mode.
    """
    n = good + bad
    if 2 * draws > n:
        return good - _large_hypergeometric(rng, good, bad, n - draws)
    if 2 * good > n:
        return draws - _large_hypergeometric(rng, bad, good, draws)
    g, k = max(good, draws), min(good, draws)  # both roles are symmetric
    whole, rest = divmod(g * k, n)
    if g * k < _FEW * n:
        u, x = rng.random(), 0
        # log((n-g)! (n-k)! / (n! (n-g-k)!))
        p = math.exp(k * math.log1p(-g / n) + _grown(n, -k) - _grown(n - g, -k))
        while u > p and x < k:
            u -= p
            p *= (g - x) * (k - x) / ((x + 1) * (n - g - k + x + 1))
            x += 1
        return x
    mode = (g + 1) * (k + 1) // (n + 2)
    parts = (mode, n - g - k + mode, g - mode, k - mode)
    tilt = math.log1p((parts[0] * parts[1] - parts[2] * parts[3]) / (parts[2] * parts[3]))
    away = whole - mode + rest / n + 0.5
    spread = math.sqrt(g * k / n * ((n - g) / n) * ((n - k) / (n - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        d = math.floor(away + width * (v - 0.5) / u)
        if not -mode < d < k - mode:  # the ends have probabilities below 1e-12 here
            continue
        log_ratio = -d * tilt - _grown(parts[0], d) - _grown(parts[1], d) - _grown(parts[2], -d) - _grown(parts[3], -d)
        if 2 * math.log(u) <= log_ratio:
            return mode + d


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not good or not draws:
        return 0
    if good + bad < _NUMPY:
        return int(rng.hypergeometric(good, bad, draws))
    return _large_hypergeometric(rng, good, bad, draws)


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, as of a uniform permutation."""
    rng = np.random.default_rng(seed)
    left = list(shards)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for b, size in enumerate(blocks):
        rest, total = size, sum(left)
        for s in range(len(shards)):
            total -= left[s]
            x = _hypergeometric(rng, left[s], total, rest)
            out[b, s] = x
            left[s] -= x
            rest -= x
    return out


def shuffle_into_shards(df: DataFrame, *, shards: int = 40, seed: int = 20) -> DataFrame:
    """Adds ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard) in a uniformly random arrangement."""
    spark = ready(df.sparkSession)
    total = df.count()
    n_blocks = max(1, min(-(-total // 50_000), MATRIX // shards))
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if any(k.startswith("map") for _, k in df.dtypes) else F.struct(*[F.col(f"`{c}`") for c in df.columns])
    work = wrapped(df, k=F.xxhash64(content))
    work = work.withColumn("block", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(n_blocks)).cast("int"))
    sizes = {b: n for b, n in work.groupBy("block").count().collect()}  # n_blocks rows at most
    blocks = [sizes.get(b, 0) for b in range(n_blocks)]
    margin = [total // shards + (s < total % shards) for s in range(shards)]
    upto = np.cumsum(communication_matrix(blocks, margin, seed), axis=1)
    cuts = spark.createDataFrame([(b, [int(x) for x in upto[b]]) for b in range(n_blocks)], "block int, upto array<long>")
    ties = [F.xxhash64(ROW, F.lit(1))]
    first = ranked(work, ["block"], F.xxhash64("k", F.lit(seed + 1)), buckets=buckets_for(total // n_blocks), ties=ties)
    dealt = first.join(F.broadcast(cuts), "block")  # MATRIX numbers at most
    dealt = dealt.withColumn("shard", F.aggregate("upto", F.lit(0), lambda n, x: n + F.when(x <= F.col("rank"), 1).otherwise(0))).drop("upto", "rank", "block")
    second = ranked(dealt, ["shard"], F.xxhash64("k", F.lit(seed + 2)), buckets=buckets_for(total), ties=ties, name="slot")
    return unwrapped(second, df.columns, {"shard": F.col("shard"), "slot": F.col("slot")})
