"""Small corpora with the cases that every operator has to bear."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, hits int, row string, found string, shard int"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns whose names operators use themselves."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "t", 1, "r", "f", 9) for i, t in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, nulls, empties, a long text, repeated and tied rows."""
    rng = random.Random(5)
    words = ["w%d" % k for k in range(400)] + ["Éa,", "ñ", "日本", "x" * 300]

    def text(n):
        return " ".join(rng.choice(words) + ("\n" if rng.random() < 0.08 else "") for _ in range(n))

    passage, rows = text(90), []
    for i in range(40):
        t = text(rng.choice([3, 30, 120, 300]))
        if i % 4 == 0:
            t = f"{t} {passage} {text(10)}"
        rows.append((i, t))
    base = text(200).split(" ")
    for i in range(40, 60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 5])):
            copy[rng.randrange(len(copy))] = "edit%d" % i
        rows.append((i, " ".join(copy)))
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "one"), (64, text(30_000)), (3, rows[3][1]), (5, "other text of a known id"), (None, passage), (None, rows[6][1]), (65, rows[4][1]), (66, rows[4][1].upper())]
    return rows
