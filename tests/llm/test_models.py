"""Trained operators: held-out accuracy, spans and edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from confluo.llm import language_id, toxicity
from confluo.llm.html_extract import decode, extract_pages, extracted, parse, trained
from confluo.llm.html_samples import sample_page

WORDS = {"en": "the and thing with that from have they would there".split(), "de": "und der nicht eine auch für sich werden über schön".split(), "ru": "это как его быть который весь она год".split()}


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, _text(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 60)), lang) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language_id.fold("doc_id", 5) == 0
    model = language_id.fit(docs, held_out=held)
    got = docs.where(held).select("lang", language_id.labels(model, F.col("text"))["lang"].alias("p")).collect()
    assert np.mean([r.lang == r.p for r in got]) > 0.97
    mixed = _text(rng, "en", 40) + " " + _text(rng, "ru", 90)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 – !"), (4, mixed), (5, "漢字"), (6, "the and " * 60_000)], "doc_id int, text string")
    out = {r[0]: r[1] for r in odd.select("doc_id", language_id.labels(model, F.col("text"))).collect()}
    assert [out[k].lang for k in (1, 2, 3)] == ["und"] * 3 and all(out[k].score == 0 for k in (1, 2, 3))
    assert [s.lang for s in out[4].spans] == ["en", "ru"] and out[4].lang == "ru"
    assert out[5].lang in WORDS and out[6].lang == "en" and 0 <= out[6].score <= 1
    none = language_id.fit(docs.limit(0))
    assert odd.select(language_id.labels(none, F.col("text"))["lang"]).distinct().collect()[0][0] == "und"


def test_viterbi_shortcut_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        scores = rng.normal(0, 3, (int(rng.integers(1, 40)), 3)).astype(np.float32)
        ptr = np.array([0, len(scores)])
        best = scores.sum(0).argmax()[None]
        if not language_id._may_switch(scores, ptr, best, 12.0)[0]:
            assert (language_id.viterbi(scores, 12.0) == best[0]).all()


def test_toxicity(spark):
    rng = random.Random(2)

    def doc(bad):
        s = [_text(rng, "en", 9).capitalize() + "." for _ in range(rng.randint(1, 12))]
        if bad:
            s[rng.randrange(len(s))] = rng.choice(["You vequ%s there." % rng.choice(["ta", "ille", "on"]), "Such an idiot with that."])
        return " ".join(s)

    rows = [(i, doc(i % 5 == 0), int(i % 5 == 0)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = language_id.fold("doc_id", 4) == 2
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), held_out=held)
    got = docs.where(held).select("toxic", "text", toxicity.scores(model, F.col("text")).alias("s")).collect()
    assert all((r.s.score >= 0.3) == bool(r.toxic) for r in got)
    for r in got:
        for s in r.s.spans:
            assert "vequ" in r.text.encode()[s.start : s.end].decode() or "idiot" in r.text.encode()[s.start : s.end].decode()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "an idiot. " + "the thing. " * 50_000)], "doc_id int, text string")
    out = {r[0]: r[1] for r in odd.select("doc_id", toxicity.scores(model, F.col("text"))["score"]).collect()}
    assert all(0 <= out[k] < 0.3 for k in (1, 2, 3)) and out[4] >= 0.3
    one = toxicity.fit(docs.select("doc_id", "text"), docs.where("toxic = 0").select("doc_id", "toxic"))
    assert docs.limit(3).select(toxicity.scores(one, F.col("text"))["score"]).first()[0] < 0.01
    assert toxicity.fit(docs.select("doc_id", "text"), docs.limit(0).select("doc_id", "toxic")).base < 0


def test_html_samples_held_out():
    model, right, found, wrong, all_ = trained(), 0, 0, 0, 0
    from confluo.llm.html_extract import _PARENT, _Y, node_features

    for k in range(60):
        nodes, blocks = parse(sample_page(np.random.default_rng([99, k])))
        keep = decode([x[_PARENT] for x in nodes], model.predict(node_features(nodes)))
        for node, _ in blocks:
            want = nodes[node][_Y] == "1"
            right, found, wrong, all_ = right + (want and keep[node]), found + keep[node], wrong + (keep[node] and not want), all_ + want
        assert all(keep[x[_PARENT]] for i, x in enumerate(nodes) if i and keep[i])
    assert right / all_ > 0.95 and right / found > 0.95


def test_html_pages(spark):
    page = '<html><head><title>no</title></head><body><nav><ul><li><a href="/a">menu</a></ul></nav><div class="ad">Buy this now.</div><article><h1>Big  news &amp; more</h1><p>First line<br>and more text here.<p>Second one, with <b>bold</b>&nbsp;words. It goes on.</article><div class="comments"><p>I agree. Nice one.</p></div><script>x("</p>")</script><footer>&copy; us</footer>'
    rows = [(1, "u", page, "old"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", page, "old")]
    out = extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string, text string")).collect()
    got = {r.page_id: r.text for r in out}
    assert got[1] == "Big news & more\n\nFirst line and more text here.\n\nSecond one, with bold words. It goes on."
    assert got[2] == got[3] == "" and got[4] == got[1]
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract_pages(spark.createDataFrame([], "page_id int, html string")).count() == 0
    for broken in ("<p", "<p><div></p></div>", "<!-- open", "<script>", "</x></p><td>", "<a><p>x</a>y"):
        extracted(trained(), [broken])


@pytest.mark.parametrize("n", [0, 1, 5])
def test_scores_of_batches(n):
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -4.0)
    buf, at = toxicity.K.text_bytes(pa.array(["a. b"] * n, pa.string()))
    assert len(model.sentences(buf, at)[2]) == n + 1
