"""Substring, line and near-duplicate removal against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from confluo.llm import kernel as K
from confluo.llm.line_dedup import dedup_lines
from confluo.llm.minhash_dedup import SIZE, estimate, minima, near_duplicates, packed
from confluo.llm.substring_dedup import COVER, PERIOD, dedup_substrings

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_words_of_any_piece_size(monkeypatch):
    texts = ["", "a", "  b c ", "é" * 50 + " x", "ab" * 100, "\n\n", "a b c d e f g " * 20]
    raw = [t.encode() for t in texts]
    buf, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    whole = K.words(buf, at, K.SPACE)
    for size in (7, 16, 64):
        monkeypatch.setattr(K, "PIECE", size)
        part = K.words(buf, at, K.SPACE)
        assert (part.hash == whole.hash).all() and (part.ptr == whole.ptr).all()
    assert [[buf[s:e].tobytes().decode() for s, e in zip(whole.start[a:b], whole.end[a:b], strict=True)] for a, b in zip(whole.ptr[:-1], whole.ptr[1:], strict=True)] == [t.split() for t in texts]


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_substring_dedup(make, corpus):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus]
    first = {}
    for i, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i if i is not None else 1 << 60), i if i is not None else 1 << 60)
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in dedup_substrings(make(corpus)).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(n for _, _, n, _ in want)
    digests = {r.kept for r in dedup_substrings(make(corpus), digest=True).collect()}
    assert digests == {hashlib.sha256(k.encode()).hexdigest() for *_, k in want}


def test_empty_tables(make):
    none = make([])
    assert dedup_substrings(none).count() == 0
    assert dedup_lines(none).count() == 0
    assert near_duplicates(none).count() == 0


def test_line_dedup(make):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nz"), (4, "q\nq\nq\nq\nq"), (5, None), (6, ""), (7, "b\n\n\nc\nd"), (1, "a\nb\nc\nd"), (None, "a\nb\nc"), (8, "one line")]
    out = dedup_lines(make(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "t", "hits", "row", "found", "shard", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=repr)
    want = [(1, "a\nb\nc\nd", 0), (1, "a\nb\nc\nd", 0), (2, "x\ny", 3), (3, "a\nb\nz", 0), (4, "q", 4), (5, None, 0), (6, "", 0), (7, "", 3), (8, "one line", 0), (None, "a\nb\nc", 0)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(make, corpus, percent):
    sets = []
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    owners = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            owners[x].append(k)
    shared = Counter((a, b) for o in owners.values() for a in o for b in o if a < b)
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * len(sets[a][1] | sets[b][1]):
            top[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    want = [(i, len(s), least.get(root(k), i)) for k, (i, s) in enumerate(sets)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(make(corpus), percent=percent).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_large_group_of_near_copies(make):
    """A hot bucket: hundreds of near copies, in one component, and look-alikes below the limit that are in none."""
    rng = np.random.default_rng(3)
    base = ["w%d" % k for k in range(150)]
    rows = []
    for i in range(300):
        t = list(base)
        for k in rng.choice(150, int(rng.choice([0, 1, 2, 6])), replace=False):
            t[k] = "e%d_%d" % (i, k)
        rows.append((i, " ".join(t)))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(146)) for w in (t.split() for _, t in rows)]
    top = list(range(300))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                top[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in near_duplicates(make(rows), percent=85).collect()}
    assert got == {k: root(k) for k in range(300)}


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for same in (1.0, 0.85, 0.5):
        b = a.copy()
        b[int(2000 * same) :] = rng.integers(0, 1 << 63, 2000 - int(2000 * same)).astype(np.uint64)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        bits = packed(minima([a, b]))
        assert bits.shape == (2, SIZE // 4)
        assert abs(float(estimate(bits[0], bits[1])) - true) < 0.15
