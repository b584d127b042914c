"""The near-duplicates stage with repeated and null ids."""

import random

import corpus_pipeline


def test_rows_of_one_id_or_none_are_judged_apart(spark):
    rng = random.Random(8)

    def text():
        return " ".join("w%d" % rng.randrange(5000) for _ in range(150))

    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (None, a), (None, c), (None, c + " end"), (None, d), (3, e), (3, e + " end"), (4, ""), (None, ""), (5, f)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.remove_near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) == 8
    once = [x for x in got if x[1] not in (c, c + " end", e, e + " end")]
    assert set(once) == {(1, a), (2, b), (None, d), (4, ""), (None, ""), (5, f)}
    assert sum(x in ((None, c), (None, c + " end")) for x in got) == 1 and sum(x in ((3, e), (3, e + " end")) for x in got) == 1
