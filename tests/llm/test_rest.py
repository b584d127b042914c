"""Decontamination, packing, sharding, image copies, and the pipeline's shape."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import decontaminate as D
from confluo.llm.media_copies import _scaled, decode_image, image_copies
from confluo.llm.packing import best_two_fit, pack_documents
from confluo.llm.queries import tokenizer_path
from confluo.llm.ranking import ranked
from confluo.llm.sharding import communication_matrix, shuffle_into_shards

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _brute(docs, items):
    windows = {}
    for name, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    out = []
    for i, t in docs:
        w, hit, names = WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination(spark, make, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rng = random.Random(8)
    vocabulary = ["Ab", "c", "dé", "e1", "f", "漢"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "--", "\n"]) for _ in range(n))

    items = [(i, text(rng.choice([0, 2, 9, 10, 14, 40]))) for i in range(25)] + [(3, text(12)), (None, text(11)), (90, None), (91, "!!")]
    docs = [(i, text(rng.choice([0, 5, 40, 200])) + (items[i % 25][1] + " tail") * (i % 3 == 0)) for i in range(60)] + [(60, None), (61, ""), (None, items[5][1]), (1, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.find_contamination(make(docs), bench).collect()]
    assert sorted(got, key=repr) == _brute(docs, items)


def test_decontaminate(spark, make):
    passage = " ".join("item%d" % k for k in range(12))
    docs = [(1, f"Clean words before. {passage}, and after it " + "more " * 20), (2, passage), (3, "clean"), (4, None)]
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    out = D.decontaminate(make(docs), bench)
    assert out.columns == make(docs).columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "Clean words before. , and after it " + "more " * 20, 3: "clean", 4: None}
    assert D.decontaminate(make(docs), bench.limit(0)).count() == 4


def test_packing(spark, make):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer, rng = Tokenizer.from_file(path), random.Random(4)
    words = ["Hello", "WORLD's", "don't", "naïve", "漢字", "x\ty", "a1b22", "<|endoftext|>", "É́", "!!??", "...", "İ", "é", "ﬁ"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 300, 2500])))) for i in range(80)] + [(80, None), (81, ""), (81, ""), (None, "x"), (82, "y" * 3000), (83, "a  b\n\nc \n")]
    rows = pack_documents(make(docs), path, capacity=512, with_ids=True).collect()
    whole = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 512
        whole.setdefault((r.doc_id, r.piece == 0 and r.length), []).append(r)
    want = sorted(repr((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in docs)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    got = []
    for i, parts in by_doc.items():
        if i == 81:
            got += [repr((i, list(p.ids))) for p in parts]
            continue
        parts.sort(key=lambda r: r.piece)
        assert [p.start for p in parts] == [512 * k for k in range(len(parts))] and all(p.length == 512 for p in parts[:-1])
        got.append(repr((i, [x for p in parts for x in p.ids])))
    assert sorted(got) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in rows) // 512) + 2
    assert pack_documents(make([]), path).count() == 0


def test_best_two_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = rng.integers(0, 40, 101) * (rng.random(101) < 0.3)
        counts[0] = 0
        got = np.zeros(101, np.int64)
        for lengths, times in best_two_fit(counts):
            assert sum(lengths) <= 100 and times > 0
            for n in lengths:
                got[n] += times
        assert (got == counts).all()


def test_sharding(make):
    rows = [(i, "t%d" % i) for i in range(1003)] + [(5, "t5")] * 4 + [(None, None), (2000, "")]
    out = shuffle_into_shards(make(rows), shards=7)
    assert out.columns == [*make([]).columns, "slot"]
    got = out.collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(len, slots.values())) == sorted([len(rows) // 7 + (k < len(rows) % 7) for k in range(7)])
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == sorted((i, t) for i, t in rows if i is not None)
    assert shuffle_into_shards(make([]), shards=3).count() == 0
    m = communication_matrix([10, 0, 25], [12, 12, 11], 1)
    assert m.sum(1).tolist() == [10, 0, 25] and m.sum(0).tolist() == [12, 12, 11]


def test_ranks(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    for buckets in (1, 16):
        got = ranked(df, ["g"], F.xxhash64("id"), buckets=buckets).collect()
        for g in range(3):
            assert sorted(r["rank"] for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def _pgm(a):
    a = np.clip(a, 0, 255).astype(np.uint8)
    return b"P5\n# c\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def _png(a):
    a = np.clip(a, 0, 255).astype(np.uint8)
    raw = b"".join(b"\x02" + (row - (a[y - 1] if y else 0)).astype(np.uint8).tobytes() for y, row in enumerate(a))

    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    head = a.shape[1].to_bytes(4, "big") + a.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_copies(spark):
    rng = np.random.default_rng(6)
    scenes = [_scaled(rng.uniform(0, 255, (16, 16)), 1 / 8) for _ in range(12)]
    rows = [(k, _pgm(s)) for k, s in enumerate(scenes)]
    rows += [(20, _pgm(scenes[0][10:112, 12:118])), (21, _pgm(scenes[1] * 0.8 + 25 + rng.normal(0, 2, scenes[1].shape))), (22, _png(scenes[2])), (23, _pgm(scenes[3].T[::-1])), (24, None), (25, b"junk"), (26, _pgm(np.full((40, 40), 9.0))), (0, _pgm(scenes[0])), (None, _pgm(scenes[4])), (27, b"")]
    got = {r.id: r for r in image_copies(spark.createDataFrame(rows, "id long, data binary, c int".replace(", c int", "")), id_col="id", image=F.col("data")).collect()}
    assert (got[20].component_id, got[21].component_id, got[22].component_id, got[22].class_id) == (0, 1, 2, 2)
    assert got[23].component_id == 3  # turned by a right angle
    assert all(got[k].component_id == k and got[k].kept for k in [*range(12), 24, 25, 26, 27])
    assert got[None].component_id == 4
    assert image_copies(spark.createDataFrame([], "id long, data binary"), id_col="id", image=F.col("data")).count() == 0
    assert np.abs(decode_image(_png(scenes[5])) - np.clip(scenes[5], 0, 255).astype(np.uint8)).max() == 0


def test_pipeline_stages(spark, make, corpus, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, "nothing of this is in the documents at all or is it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make([(i, t) for i, t in corpus if i is not None] + [(500, "12 34")])
    sizes = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append({r[0] for r in docs.select("doc_id").collect()})
    assert 500 not in sizes[0] and {60, 61, 62}.isdisjoint(sizes[0])
    assert sizes[-1] == sizes[3] and {1, 2, 3}.issubset(sizes[-1]) and 65 not in sizes[-1]



def test_nested_lists_take_time_in_proportion():
    """Elements that end others look them up; none walks what is open."""
    import time

    from confluo.llm.html_extract import parse

    for page in ("<li><ul>" + "<span>" * 40_000 + "<li></li>" * 40_000, "<table><tr>" + "<td><div>" * 30_000 + "<tr><td>" * 30_000):
        began = time.process_time()
        parse(page)
        assert time.process_time() - began < 10
