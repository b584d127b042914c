"""Profiles of large clusters: no row and no table grows with the records of a cluster more than they do."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from confluo import queries
from confluo.operators import merge, resolve
from confluo.plans.scratch import Scratch

SCHEMA = "seq long, cluster_id long, source_type string, source_tag string, priority int, full_name string, email string, phone string, country string, skills array<string>, experience_yrs double, date_of_birth string, aliases array<string>"


def _records(n, clusters, seed, mixed):
    rng = random.Random(seed)
    kinds = ["CSV", "ATS", "Resume", "Notes", "Other"]
    out = []
    for k in range(n):
        kind = rng.choice(kinds) if mixed else kinds[k * 5 // n]
        name = rng.choice(["Mira", "mira", "Bob", "Robert"]) + rng.choice([" Quill", " Ashby", ""])
        skills = rng.choice([None, [], ["SQL"], ["sql", "Go"], [None]])
        out.append((k, k % clusters, kind, rng.choice([f"{kind}:{k}", None, "x"]), rng.choice([40, 60]), rng.choice([name, None, ""]), rng.choice([None, f"p{rng.randrange(4)}@example.org", "A@example.org"]), rng.choice([None, "+49301234567", "+4930123456"]), rng.choice([None, "DE", "FR"]), skills, rng.choice([None, 2.0, 2.5, 9.0]), rng.choice([None, "1990-01-01"]), []))
    return out


@pytest.mark.parametrize("mixed", [True, False])
def test_scores_are_those_of_profiles(spark, monkeypatch, mixed):
    monkeypatch.setattr(merge, "pairwise_signals", lambda rows, _: rows.select("cluster_id", F.lit(0.5).alias("match_probability")).distinct())
    rows = spark.createDataFrame(_records(240, 40, 8, mixed), SCHEMA).withColumn("cluster_id", F.expr("if(seq % 2 = 0, 100, cluster_id)"))
    weights = None if mixed else {"CSV": 0.7, "ATS": 0.1, "Resume": 0.3}
    got = merge.scores(rows, Scratch(spark), weights)
    want = merge.profiles(rows, Scratch(spark), weights).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_trusts_are_added_one_after_another(monkeypatch):
    monkeypatch.setattr(merge, "ADDED", 7)
    parts = [(5, "email", 0.1, 1000), (5, "email", 0.7, 15), (5, "phone", 0.3, 1), (6, "phone", 0.95, 8)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("cluster_id", "field", "trust", "n"), p, strict=True)) for p in some]) for some in (parts[:1], parts[1:])]
    total = 0.0
    for t in [0.1] * 1000 + [0.7] * 15:
        total += t
    got = [tuple(r.values()) for b in merge._added(iter(batches)) for r in b.to_pylist()]
    eight = 0.0
    for _ in range(8):
        eight += 0.95
    assert got == [(5, "email", total, 1015), (5, "phone", 0.3, 1), (6, "phone", eight, 8)]


def test_name_orders_are_counted_across_stretches(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2]), k, [rng.choice("abcdefg")]) for k in range(600)]
    df = spark.createDataFrame(rows, "cluster_id long, seq long, names array<string>")
    at = {}
    for c, k, n in rows:
        at.setdefault((c, n[0]), k)
    odd = [(c, at[c, x], at[c, y], [x], [y]) for c in (1, 2) for x in "abcdefg" for y in "abcdefg" if at[c, x] < at[c, y]]
    pairs = spark.createDataFrame(odd, "cluster_id long, ax long, ay long, x array<string>, y array<string>")
    want = {(c, p, q): sum(1 for i in range(600) for j in range(i + 1, 600) if rows[i][0] == rows[j][0] == c and rows[i][2] == x and rows[j][2] == y) for c, p, q, x, y in odd}
    assert {tuple(r)[:3]: r.fore for r in resolve._fore_counts(df, pairs, Scratch(spark)).collect()} == {k: v for k, v in want.items() if v}
    # the same from stretches of few lists and rows
    monkeypatch.setattr(resolve, "STRETCH_NAMES", 3)
    monkeypatch.setattr(resolve, "STRETCH_ROWS", 10)
    ordered = sorted((c, k, at[c, n[0]]) for c, k, n in rows)
    batches = [pa.record_batch([pa.array([r[i] for r in ordered[p : p + 37]]) for i in range(3)], ["cluster_id", "seq", "at"]) for p in range(0, 600, 37)]
    found = [r for b in resolve._stretches(iter(batches)) for r in b.to_pylist()]
    held, got = [r for r in found if r["y"] is None], {}
    for r in found:
        if r["y"] is not None:
            got[r["cluster_id"], r["x"], r["y"]] = got.get((r["cluster_id"], r["x"], r["y"]), 0) + r["n"]
    for p in held:
        for q in held:
            if p["cluster_id"] == q["cluster_id"] and p["start"] < q["start"]:
                key = (p["cluster_id"], p["x"], q["x"])
                got[key] = got.get(key, 0) + p["n"] * q["n"]
    assert {k: got.get(k, 0) for k in want} == want
    assert sum(r["n"] for r in held) == 600


def test_no_row_grows_with_its_cluster(spark, monkeypatch):
    """One cluster of 600 records: a table with their sources in one row would have one of more than 10,000 characters."""
    rows = [(k, "Resume", f"Resume:{k}", 60, "Mira Q. Quill", None, "+49301234567", None, ["SQL"], None, None, []) for k in range(600)]
    people = spark.createDataFrame(rows, SCHEMA.replace(" cluster_id long,", ""))
    monkeypatch.setattr(queries, "people", lambda *_: people)
    widest, table = [], Scratch.table

    def measured(self, df, **options):
        out = table(self, df, **options)
        widest.append(out.agg(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] or 0)
        return out

    monkeypatch.setattr(Scratch, "table", measured)
    got = queries.golden_profiles(spark, "").collect()
    assert [r.n_records for r in got] == [600]
    assert max(widest) < 10_000
