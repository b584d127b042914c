"""Rare languages are learned however large the input is."""

from confluo.llm import language_id


def test_rare_languages_are_drawn(spark):
    rows = [(i, f"the and thing {i}", "en") for i in range(3000)] + [(9000 + i, f"это как его {i}", "ru") for i in range(3)] + [(9100, None, "xx"), (9101, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs, max_train=50)
    assert model.langs == ["en", "ru"]
