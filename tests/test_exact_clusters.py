"""Components by exact keys against a plain search, and how much of it is a graph."""

import random

from pyspark.sql import functions as F

from confluo.operators import resolve
from confluo.plans.scratch import Scratch


def _clusters(rows):
    of = {s: s for s, *_ in rows}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for k in (1, 2):
        first = {}
        for r in rows:
            if r[k]:
                a, b = top(first.setdefault(r[k], r[0])), top(r[0])
                of[max(a, b)] = min(a, b)
    return {s: top(s) for s in of}


def _records(spark, rows):
    return spark.createDataFrame(rows, "seq long, email_key string, phone string")


def test_clusters_are_those_of_a_plain_search(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(s, rng.choice([None, "", *[f"m{k}" for k in range(60)]]), rng.choice([None, "", *[f"m{k}" for k in range(60)]])) for s in rng.sample(range(1000), 120)]
        got = {r.seq: r.cluster_id for r in resolve.exact_clusters(_records(spark, rows), Scratch(spark)).collect()}
        assert got == _clusters(rows)


def test_records_of_one_key_are_no_edges(spark, monkeypatch):
    seen = []
    inner = resolve.connected_components
    monkeypatch.setattr(resolve, "connected_components", lambda edges, scratch: seen.append(edges.count()) or inner(edges, scratch))
    rows = [(s, f"m{s % 7}" if s < 7 else None, f"p{s % 5}") for s in range(3000)]
    got = resolve.exact_clusters(_records(spark, rows), Scratch(spark))
    assert {r.seq: r.cluster_id for r in got.collect()} == _clusters(rows)
    assert sum(seen) <= 7


def test_means_that_lie_on_half_a_digit(spark):
    from confluo.operators import merge

    rows = [(0, 9 if s else 0, "Resume" if s else "CSV", f"t{s}", "+15") for s in range(10)]
    for parts in (1, 3, 7):
        df = spark.createDataFrame([(c, k, t, g, p) for k, (c, _, t, g, p) in enumerate(rows)], "cluster_id long, seq long, source_type string, source_tag string, phone string")
        df = df.withColumns({"priority": F.lit(60), "experience_yrs": F.lit(None).cast("double")}).withColumns({c: F.lit(None).cast("string") for c in ("full_name", "email", "country", "date_of_birth")})
        long = merge.evidence(df.orderBy(F.desc("seq")).repartition(parts))
        assert [r.trust_score for r in merge.field_confidence(long, merge.survivors(long)).collect()] == [0.94]
