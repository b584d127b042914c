"""Centroids against a plain version in Python's integers, beyond float64 and long too."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from confluo.llm import centroids as C
from confluo.llm.queries import _clustering_sql

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v int, distance int"


def plain(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    hashed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=hashed)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    long = lambda n: n if n is not None and n < 2**63 else None
    total = lambda ds: None if any(d >= 2**63 for d in ds) else sum(ds)
    out = []
    for (i, _), (d, j) in zip(kept, found, strict=True):
        digest = hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
        out.append((i, j, long(d), long(total([e for e, at in found if at == j])), long(total([e for e, _ in found])), digest))
    return out


def vectors(rng, n, dims, spread):
    rows = [(i, [rng.gauss(rng.choice([-3, 0, 3]), 1) * spread for _ in range(dims)]) for i in range(n)]
    return [*rows, (3, rows[3][1]), (n, rows[5][1]), (n + 1, rows[5][1])]


ODD = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 2.0, 3.0]), (904, [float("nan")] * 4), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [0.0] * 4), (907, [-0.0] * 4), (908, [-0.001, 0.5, -0.5, 0.015625])]


@pytest.mark.parametrize("case", ["plain", "ties", "long", "huge", "few", "none"])
def test_against_integers(spark, monkeypatch, case):
    rng = random.Random(7)
    rows = vectors(rng, 60, 4, 1.0) + ODD
    k = 6
    if case == "ties":
        rows = [(i, [float(rng.randrange(2)) for _ in range(4)]) for i in range(80)]
    if case == "long":  # some rows beyond float64's exact range, some not
        rows += [(700 + i, [rng.choice([-1, 1]) * rng.uniform(1e6, 5e6) for _ in range(4)]) for i in range(20)]
    if case == "huge":
        rows += [(800 + i, [rng.choice([-1, 1]) * 10.0 ** rng.choice([3, 7, 9, 12, 300, 307.5]) for _ in range(4)]) for i in range(20)]
    if case == "few":
        rows = rows[:4]
    if case == "none":
        rows = ODD[:6]
    df = spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in rows], SCHEMA)
    out = C.cluster(df.repartition(3), k=k, rounds=3, dims=4, scale=64)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain(rows, k, 3, 4, 64)))


def test_the_three_ways_agree():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 40, (500, 64))
    centres = [C.integers(r, 64) for r in x[:16]]
    ways = []
    for float_exact, long_exact in ((1 << 53, 1 << 63), (1, 1 << 63), (1, 1)):
        C.FLOAT_EXACT, C.LONG_EXACT = float_exact, long_exact
        try:
            ((at, _, to, far),) = C.nearest(x, centres, 64)
        finally:
            C.FLOAT_EXACT, C.LONG_EXACT = 1 << 53, 1 << 63
        ways.append((at.tolist(), to.tolist(), [int(d) for d in far]))
    assert ways[0] == ways[1] == ways[2]


def test_sql_says_the_same(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(70)] + ODD
    embeddings = spark.createDataFrame(rows, "vec_id long, embedding array<double>").toArrow()
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    got = con.sql(_clustering_sql(5, 3, 4, 64)).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows, 5, 3, 4, 64)))
