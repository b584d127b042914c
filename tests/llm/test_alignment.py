"""Alignment against whole encodings, plain loops over byte ranges and a plain union-find."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from confluo.llm import alignment as L

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "\n", "  ", "a  b", " lead", "\n lead", "trail ", "trail\n", "trail \n x", "two\n\nlines", "a\n b", "a \nb", "tab\tb", "x▁y", "x ▁ y", "▁",
    "<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk> <0x41>", "café naïve", "日本語 の", "\U0001f600 \U0001f468‍\U0001f469", "nul\x00x", "a\x1cb c", "a b c", "it's 's 'S we'll", "x" * 5000, " " * 3000, "1234567 89", "a\r\nb", "﻿bom", "é c",
]


@pytest.fixture(scope="module")
def sides():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    table = L.byte_characters()
    spell_a = lambda i: bytes(table[c] for c in one.id_to_token(i))
    spell_b = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()

    def encode(text):
        """Ids and byte ranges of both sides, or nothing."""
        if not text:
            return None
        out = []
        for ids, spell in ((one.encode(" " + text, add_special_tokens=False).ids, spell_a), (two.encode(text), spell_b)):
            spelled = [spell(i) for i in ids]
            if b"".join(spelled) != (" " + text).encode():
                return None
            ends = np.cumsum([len(x) for x in spelled]).tolist()
            out.append((ids, list(zip([0, *ends], ends, strict=False))))
        return out

    return encode


def plain(rows, encode):
    count, docs = Counter(), []
    for i, text in rows:
        found = encode(text)
        if found is None:
            docs.append((i, None))
            continue
        (a, at_a), (b, at_b) = found
        links, lo = [], 0
        for x, (s, e) in enumerate(at_a):
            while at_b[lo][1] <= s:
                lo += 1
            y = lo
            while y < len(b) and at_b[y][0] < e:
                links.append((x, y))
                y += 1
        parent = {}

        def find(n):
            while parent.setdefault(n, n) != n:
                n = parent[n]
            return n

        for x, y in links:
            parent[find(("b", y))] = find(("a", x))
        groups = {}
        for x in range(len(a)):
            groups.setdefault(find(("a", x)), ([], []))[0].append(a[x])
        for y in range(len(b)):
            groups[find(("b", y))][1].append(b[y])
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups.values())
        ids = [(a[x], b[y]) for x, y in links]
        count.update(ids)
        docs.append((i, (len(a), len(b), len(groups), ids, text)))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, ids, text = d
            out.append((i, n_a, n_b, n_groups, len(ids), sum(count[p] == best[p[1]] for p in ids), sum(count[p] for p in ids), text))
    return out, count


@pytest.fixture(scope="module")
def rows(corpus):
    short = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in corpus]
    return short + [(200 + k, t) for k, t in enumerate(ODD)] + [(300, "trail\n"), (None, "it's so"), (301, " ".join(ODD))]


def test_against_plain_loops(make, rows, sides):
    want, count = plain(rows, sides)
    df = make(rows)
    got = [tuple(r) for r in L.align_tokens(df, A, B).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    digests = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in want]
    out = L.align_tokens(df, A, B, digest=True)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, digests))
    pairs = {(r.a_id, r.b_id): r["count"] for r in L.pair_counts(df, A, B).collect()}
    assert pairs == dict(count)


def test_small_blocks_and_slices(monkeypatch, rows, sides):
    """In this process, with every limit small, so that all borders are crossed."""
    import pyarrow as pa

    for name, value in (("BLOCK", 3000), ("SLICE", 64), ("QUEUE", 100), ("LONG", 50), ("CACHE", 500)):
        monkeypatch.setattr(L, name, value)

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 1)

    monkeypatch.setattr(L, "TaskContext", Context)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    table = [r for part in L._encode(A, B, False)(iter([batch.slice(0, 20), batch.slice(20)])) for r in part.to_pylist()]
    assert len({r["block"] for r in table}) > 5
    want, count = plain(rows, sides)
    docs = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) for r in table if r["pair"] is None]
    assert sorted(map(repr, docs)) == sorted(repr((*r[:5], r[7])) for r in want)
    got = Counter()
    for r in table:
        if r["pair"] is not None:
            got[divmod(r["pair"], L.STRIDE)] += r["n"]
    assert got == count


def test_union_find_is_connectivity():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 40)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(60))]
        root = list(range(n))
        for _ in range(n):
            for u, v in edges:
                root[u] = root[v] = min(root[u], root[v])
        u, v = (np.array(x, np.int64) for x in (zip(*edges, strict=True) if edges else ([], [])))
        assert L.components(u, v, n).tolist() == root


def test_empty_table(make):
    assert L.align_tokens(make([]), A, B).count() == 0 and L.pair_counts(make([]), A, B).count() == 0


def test_faster_library_reads_every_character_alike():
    one = L.ByteLevel(A)
    assert one.fast is not None
    rng = random.Random(2)
    for _ in range(400):
        text = " " + "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x2000, 0x3100), rng.randrange(0x10000, 0x20000)])) + rng.choice(["", " ", "a", "1", "."]) for _ in range(30))
        assert one.encode(text) == one.whole.encode(text, add_special_tokens=False).ids
