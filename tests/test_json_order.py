"""The JSON query numbers its records through, in the order of one file."""

from pathlib import Path

import pytest

from confluo import source_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_places_and_tags(spark):
    rows = source_queries.json_records(spark, DATA).orderBy("seq").select("seq", "source_tag", "email").collect()
    suppliers = sorted(r.s_suppkey for r in spark.read.parquet(f"{DATA}/supplier.parquet").collect())
    assert [(r.seq, r.source_tag) for r in rows] == [(2 * n + 1, f"ATS:people.json#{2 * n + 2}") for n in range(len(suppliers))]
    assert [r.email.split("@")[0].endswith(str(k * 7)) for r, k in zip(rows, suppliers, strict=True)] == [True] * len(suppliers)
