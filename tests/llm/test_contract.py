"""The registered queries over whole tables at the smallest scale: columns, types, and brute-force versions."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from confluo.llm import media_copies as M
from confluo.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_media_copies": "vec_id bigint, class_id bigint, component_id bigint, kept boolean",
    "op5_minhash_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "pipeline": "doc_id bigint, piece int, sequence_id bigint, offset bigint",
}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def result(spark):
    """Rows of a query, once; with its columns and types checked."""
    known = {}

    def get(name):
        if name not in known:
            df = QUERIES[name](spark, DATA)
            kinds = dict(df.dtypes)
            for column in COLUMNS[name].split(", "):
                field, kind = column.split()
                assert kinds[field] == kind, (name, field)
            known[name] = df.collect()
        return known[name]

    return get


@pytest.fixture(scope="module")
def documents():
    t = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in t}


def test_every_query_is_here():
    assert set(COLUMNS) == set(QUERIES)


def test_op1(result, documents):
    words = {i: WORDS.findall(r["text"] or "") for i, r in documents.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    assert len(result("op1_substring_dedup")) == len(documents)
    removed = 0
    for r in result("op1_substring_dedup"):
        w = words[r.doc_id]
        gone = {k + x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < r.doc_id for x in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        removed += len(gone)
    assert removed


def test_op2(result):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op2_line_dedup"]).fetchall()
    assert sorted(want) == sorted(tuple(r[c] for c in ("doc_id", "n_lines", "n_removed", "kept_sha256")) for r in result("op2_line_dedup"))


def test_op3(result, documents):
    rows = result("op3_toxicity")
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(toxic[r.doc_id], r.score) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    if {y for y, _ in held} == {0, 1}:
        assert np.mean([s for y, s in held if y]) > np.mean([s for y, s in held if not y])


def test_op4(result):
    """Classes and components are those of all pairs that share a key and are linked."""
    t = pq.read_table(f"{DATA}/embeddings.parquet")
    ids = t.column("vec_id").to_pylist()
    feats = M.describe([M.decode_image(x) for x in M.picture(t.column("embedding").combine_chunks()).to_pylist()])
    assert _components(ids, feats) == {r.vec_id: r.component_id for r in result("op4_media_copies")}


def _components(ids, feats):
    keys = [set(M.table_keys(f).tolist()) for f in feats]
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            p, q = root(ids[a]), root(ids[b])
            if p != q and (keys[a] & keys[b] or feats[a].tobytes() == feats[b].tobytes()) and M.linked(feats[a], feats[b]):
                top[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_op4_recall_by_edit():
    """Candidates and links of edited copies of the query's own pictures."""
    t = pq.read_table(f"{DATA}/embeddings.parquet").column("embedding").combine_chunks()
    pictures = [M.decode_image(x) for x in M.picture(t).to_pylist()][:40]
    feats, rng = M.describe(pictures), np.random.default_rng(2)

    def crop(p, share):
        n = round(len(p) * share)
        y, x = rng.integers(0, len(p) - n + 1, 2)
        return p[y : y + n, x : x + n]

    edits = {
        "noise": lambda p: p + rng.normal(0, 6, p.shape),
        "light": lambda p: p * 0.8 + 25,
        "larger": lambda p: M._scaled(p, 1 / 1.5),
        "crop 84": lambda p: crop(p, 0.84),
        "crop 70": lambda p: crop(p, 0.7),
        "crop 60": lambda p: crop(p, 0.6),
        **{f"shrunk to {by}": lambda p, by=by: M._scaled(p, 1 / by) for by in (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6)},
        "shrunk and noise": lambda p: M._scaled(p, 1 / 0.77) + rng.normal(0, 4, M._scaled(p, 1 / 0.77).shape),
        "turned": lambda p: p.T[::-1],
    }
    for name, edit in edits.items():
        found = M.describe([np.rint(edit(p)).clip(0, 255).astype(np.float32) for p in pictures])
        caught = [bool(len(np.intersect1d(M.table_keys(a), M.table_keys(b)))) and M.linked(a, b) for a, b in zip(feats, found, strict=True)]
        assert np.mean(caught) >= 0.9, name


def test_op4_large_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(M, "BLOCK", 3)
    rng = np.random.default_rng(4)
    detail = M._scaled(rng.uniform(0, 255, (7, 7)).astype(np.float32), 1 / 8)
    rows, images = [], []
    for k in range(14):
        a = M._scaled(rng.uniform(0, 255, (16, 16)).astype(np.float32), 1 / 8)
        if k < 9:  # a detail that otherwise unrelated pictures share
            a[10 : 10 + len(detail), 10 : 10 + len(detail)] = detail
        images.append(np.rint(a).clip(0, 255).astype(np.uint8))
    images += [images[0][:100, :110], images[12]]
    for k, a in enumerate(images):
        rows.append((k, b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.tobytes()))
    feats = M.describe([a.astype(np.float32) for a in images])
    out = M.image_copies(spark.createDataFrame(rows, "id long, image binary"), id_col="id", image=F.col("image")).collect()
    assert {r.id: r.component_id for r in out} == _components(list(range(len(images))), feats)


def test_op5(result, documents):
    sets = {}
    for i, r in documents.items():
        w = WORDS.findall((r["text"] or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        met = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                met[j] += 1
            holders[s].append(i)
        for j, both in met.items():
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    for r in result("op5_minhash_dedup"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert any(root(i) != i for i in sets)


def test_op6(result, documents):
    rows = result("op6_language_id")
    assert {r.doc_id for r in rows} == set(documents)
    right = []
    for r in rows:
        d = documents[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r.lang_pred == "und"
        elif r.held_out and d["lang"] is not None and len(d["text"]) > 100:
            right.append(r.lang_pred == d["lang"])
    assert np.mean(right) >= 0.9


def test_op7(result, documents):
    windows = defaultdict(set)
    for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist():
        w = LETTERS.findall((r["text"] or "").translate(LOWER))
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
    sizes, seen = {len(k) for k in windows}, 0
    for r in result("op7_decontamination"):
        w = LETTERS.findall((documents[r.doc_id]["text"] or "").translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        seen += bool(hit)
    assert seen


def test_op8(result, documents):
    from tokenizers import Tokenizer

    tokenizer, parts, places = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in result("op8_best_fit_packing"):
        parts[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == set(documents)
    for i, rows in parts.items():
        ids = np.array(tokenizer.encode(documents[i]["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in result("op8_best_fit_packing")) // 2048) + 2


def test_op9(result):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    rows = result("op9_html_extraction")
    assert sorted((r.page_id, r.url) for r in rows) == sorted((p["page_id"], p["url"]) for p in pages)
    assert all(r.n_chars == len(r.text) and r.text == r.text.strip() and "<p" not in r.text for r in rows)
    assert np.mean([bool(r.text) for r in rows]) > 0.9


def test_op10(result, documents):
    slots = defaultdict(list)
    for r in result("op10_sharding"):
        raw = (documents[r.doc_id]["text"] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and sum(map(len, slots.values())) == len(documents)
    counts = [len(slots[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline(result, documents):
    rows = result("pipeline")
    assert rows and {r.doc_id for r in rows} <= set(documents)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
