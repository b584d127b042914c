"""Scores of mixed texts rest on the words that gave the label."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from confluo.llm import language_id

WORDS = {"en": "the and thing with that from have they would there".split(), "de": "und der nicht eine auch für sich werden über schön".split(), "ru": "это как его быть который весь она год".split()}


def test_mixed_texts_pass_the_language_stage(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang, "s", 1) for i in range(400) for lang in [rng.choice(list(WORDS))]]
    # as many letters of the repeated line as make English the largest sum of all words
    repeated = " ".join(WORDS["de"] * 2) + "\n" + "they would have that thing\n" * 100
    balanced = " ".join(rng.choice(WORDS["en"]) for _ in range(60)) + " " + " ".join(rng.choice(WORDS["ru"]) for _ in range(45))
    odd = [(1000, repeated, "de", "s", 1), (1001, balanced, "ru", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    model = language_id.fit(spark.createDataFrame(rows, schema))
    got = {r[0]: r[1] for r in spark.createDataFrame(odd, schema).select("doc_id", language_id.labels(model, F.col("text"))).collect()}
    assert got[1000].lang == "de" and got[1000].score > 0.5
    assert got[1001].lang == "ru" and got[1001].score > 0.3
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows + odd, schema), "")
    assert {r.doc_id for r in kept.where("doc_id >= 1000").collect()} == {1000, 1001}
