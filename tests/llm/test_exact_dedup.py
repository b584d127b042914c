"""The extendible-hash index against a plain dictionary, with forced collisions and splits."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from confluo.llm.exact_dedup import directory, exact_duplicates, normalised, without_exact_duplicates


def plain(rows):
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in texts:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in texts:
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted(map(repr, rows))


@pytest.fixture(scope="module")
def rows(corpus):
    extra = [(100, " a  b"), (101, "\ta\nb"), (102, "a b"), (103, "a\x0bb "), (104, "a\x00b"), (105, "a b"), (106, "a b"), (107, None), (None, "lone"), (None, "lone"), (108, " ")]
    return corpus + extra


@pytest.mark.parametrize(("bits", "capacity", "depth"), [(64, 1 << 10, 16), (64, 1, 8), (3, 2, 5), (1, 4, 0), (2, 1, 16)])
def test_index(make, rows, bits, capacity, depth):
    """With few key bits, different texts share keys and are told apart by their bytes."""
    out = exact_duplicates(make(rows), key_bits=bits, capacity=capacity, max_depth=depth)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert in_order(map(tuple, out.collect())) == in_order(plain(rows))


def test_directory_splits_until_buckets_fit(spark):
    keys = [k << 61 for k in range(-4, 4) for _ in range(3)] + [(5 << 57) + j for j in range(4)]
    entries = spark.createDataFrame([(k,) for k in keys], "key long")
    got = {(r.leaf, r.bucket, r.depth) for r in directory(entries, capacity=7, max_depth=4).collect()}
    # 28 keys; the half with a leading 0 holds 16, its quarters 10 and 6, the eighth 000 holds 7; patterns without a key have no entry
    assert got == {(0, 0, 3), (2, 2, 3), (4, 4, 2), (6, 4, 2), (8, 8, 2), (10, 8, 2), (12, 12, 2), (14, 12, 2)}


def test_large_group_and_empty_table(spark, make):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same  text")).otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"))
    found = exact_duplicates(many, capacity=64)
    assert found.where("kept").count() == 4000 - 1334 + 1
    assert found.where("keep_id = 0").select("group_size").distinct().collect()[0][0] == 1334
    empty = exact_duplicates(make([]))
    assert empty.count() == 0 and empty.columns == found.columns


def test_rows_that_stay_keep_their_columns(make, rows):
    df = make(rows)
    out = without_exact_duplicates(df)
    assert out.schema == df.schema
    assert in_order((r.doc_id, r.text) for r in out.collect()) == in_order((i, t) for (i, t), p in zip(rows, plain(rows), strict=True) if p[3])


def test_normalising_is_the_plain_rule(spark):
    cases = ["", " ", "  ", "\n", "a b", "a  b", " a\t\x0b\x0c\r\nb ", "x\x1cy", "é  ñ"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "text string").select(normalised(F.col("text"))).collect()]
    assert got == [re.sub(r"[\x20\x09-\x0D]+", " ", c) for c in cases]
