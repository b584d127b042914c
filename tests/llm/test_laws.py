"""Random draws against exact probabilities, labels against plain Viterbi, packing against a plain version, and large groups."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from confluo.llm import decontaminate as D
from confluo.llm import minhash_dedup as H
from confluo.llm import sharding as S
from confluo.llm.html_extract import parse
from confluo.llm.language_id import _may_switch, viterbi
from confluo.llm.packing import WordIds, best_two_fit
from confluo.llm.queries import tokenizer_path


@pytest.mark.parametrize(("good", "bad", "draws"), [(2, 78, 3), (5, 5, 4), (50, 3000, 100), (400, 1600, 1000), (3000, 500, 2900), (120, 4680, 1500), (7, 0, 3)])
def test_large_draws_have_the_exact_law(good, bad, draws):
    """The branch for populations beyond numpy's, on populations whose probabilities can be added up."""
    rng, n = np.random.default_rng(3), 4000
    lo, hi = max(0, draws - bad), min(good, draws)
    p = np.array([math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws) for x in range(lo, hi + 1)])
    got = np.bincount([S._large_hypergeometric(rng, good, bad, draws) - lo for _ in range(n)], minlength=len(p))
    some = p * n >= 5
    rest = n - got[some].sum()
    chi = ((got - p * n)[some] ** 2 / (p * n)[some]).sum()
    assert chi < some.sum() + 5 * math.sqrt(2 * some.sum()) + 5 and rest <= 5 + 3 * p[~some].sum() * n


def test_draws_from_huge_populations():
    rng = np.random.default_rng(5)
    x = np.array([S._hypergeometric(rng, 2, 39 * 2, 1) for _ in range(4000)])
    assert abs(x.mean() - 2 / 80) < 0.01
    # two draws, one good in forty: at least one with 1 - (39/40)**2
    x = np.array([S._hypergeometric(rng, 10**9 // 40, 39 * 10**9 // 40 + 10, 2) for _ in range(40_000)])
    assert abs((x >= 1).mean() - 0.049375) < 0.004
    for good, draws, n in ((25 * 10**9, 50_000, 10**12), (10**9, 4 * 10**7, 10**12)):
        x = np.array([S._hypergeometric(rng, good, n - good, draws) for _ in range(4000)], float)
        mean = draws * good / n
        spread = math.sqrt(mean * (1 - good / n) * (n - draws) / (n - 1))
        assert abs(x.mean() - mean) < 4 * spread / math.sqrt(4000) and 0.9 < x.std() / spread < 1.1


def test_matrix_is_that_of_a_uniform_permutation():
    """Counts of one cell over many seeds follow the hypergeometric law."""
    blocks, shards = [7, 5, 8], [10, 10]
    cell = np.bincount([S.communication_matrix(blocks, shards, seed)[0, 0] for seed in range(3000)], minlength=8)
    want = np.array([math.comb(10, x) * math.comb(10, 7 - x) / math.comb(20, 7) for x in range(8)]) * 3000
    assert ((cell - want) ** 2 / want).sum() < 30


def test_shortcut_is_exact():
    """Texts that aren't walked have their best path in one language: built and random ones, three to five languages."""
    rng, walked = np.random.default_rng(7), 0
    built = np.array([[0.0, -5.0, -0.7]] * 10 + [[-5.0, 0.0, -0.7]] * 10)
    for case in range(1500):
        if case == 0:
            scores = built
        else:
            k, n = rng.integers(3, 6), rng.integers(4, 40)
            scores = -rng.random((n, k)) * rng.choice([0.3, 1.0])
            for _ in range(rng.integers(1, 4)):
                a, b = np.sort(rng.integers(0, n + 1, 2))
                scores[a:b, rng.integers(k)] += rng.random() * 1.2
            scores -= scores.max(1, keepdims=True)
        penalty = rng.choice([3.0, 6.0]) if case else 6.0
        best = scores.sum(0, keepdims=True).argmax(1)
        may = _may_switch(scores.astype(np.float32), np.array([0, len(scores)]), best, penalty)[0]
        path = viterbi(scores.astype(np.float32), penalty)
        walked += bool(may)
        if not may:
            assert len(set(path.tolist())) == 1 and scores.sum(0)[path[0]] >= scores.sum(0).max() - 1e-3
        elif case == 0:
            assert path.tolist() == [0] * 10 + [1] * 10
    assert 0 < walked < 1500
    assert _may_switch(built.astype(np.float32), np.array([0, 20]), np.array([2]), 6.0)[0]


def test_special_tokens_and_case():
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(tokenizer_path()), random.Random(2)
    known, words = WordIds(tokenizer), ["<|ENDOFTEXT|>", "<|endoftext|>", "A<|startoftext|>B", "<|StartOfText|>", "X<|", "Plain", "<|endoftext|><|endoftext|>", "É<|endoftext|>"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
        assert np.frombuffer(known.text(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def _plain_best_two_fit(items, capacity):
    left, out = sorted(items, reverse=True), []
    while left:
        bin_, gap = [], capacity
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        if gap and len(bin_) > 1:
            room, small = gap + bin_[-1], bin_[-1]
            # of pairs of unpacked pieces (the one to be replaced is packed) the fullest, then the one with the smallest piece
            pairs = [(a + b, -min(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= room]
            if pairs:
                total, a = max(pairs)
                for x in (-a, total + a):
                    left.remove(x)
                bin_ = bin_[:-1] + [-a, total + a]
                left = sorted([*left, small], reverse=True)
        out.append(sorted(bin_))
    return out


def test_histogram_packing_is_the_plain_one():
    rng = np.random.default_rng(8)
    for _ in range(60):
        items = rng.integers(1, 41, rng.integers(1, 60)).tolist()
        got = [sorted(x) for x, times in best_two_fit(np.bincount(items, minlength=41)) for _ in range(times)]
        assert sorted(got) == sorted(_plain_best_two_fit(items, 40))


def test_parsing_long_and_deep_pages():
    for part in ("<div>", "<b></div>", "<td>", "<a ", "<!--", "<i><div><b></i>", "<p class=\"a", "</"):
        parse(part * 60_000)
    assert parse("<p>a</p><!-- x > y")[1] == [(1, "a")]
    assert parse("a<script>'<!--'</script><p>b</p>c")[1] == [(0, "a"), (1, "b"), (0, "c")]


def test_benchmark_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 50)
    items = spark.createDataFrame([(k, "w" * n) for k, n in enumerate([10, 49, 3, 200, 50, 1, 1])] + [(9, None)], "item_id long, text string")
    blocks = list(D._blocks(items, "item_id", "text"))
    assert sorted(x for names, _ in blocks for x in names) == [str(k) for k in range(7)]
    assert all(len(texts) == 1 or sum(map(len, texts)) <= 50 for _, texts in blocks) and len(blocks) > 3
    assert list(D._blocks(items.limit(0), "item_id", "text")) == [([], [])]


def test_large_buckets_in_blocks(spark, make, monkeypatch):
    """Near copies around many centres, with buckets of more classes than a block."""
    rng = random.Random(6)
    base = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 2, 6, 12])):
            words[rng.randrange(120)] = "e%d" % rng.randrange(10**6)
        rows.append((k, " ".join(words)))
    plain = {r.doc_id: r.component_id for r in H.near_duplicates(make(rows), percent=85).collect()}
    monkeypatch.setattr(H, "BLOCK", 4)
    in_blocks = {r.doc_id: r.component_id for r in H.near_duplicates(make(rows), percent=85).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    top = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = [x if t == y else t for t in top]
    assert plain == in_blocks == dict(enumerate(top)) and len(set(top)) > 2


def test_runs_across_batches():
    from confluo.llm.kernel import runs

    def batch(*keys):
        return pa.record_batch([pa.array([k for k, _ in keys]), pa.array([v for _, v in keys])], ["k", "v"])

    got = [(t.column("k")[0].as_py(), t.column("v").to_pylist()) for t in runs(iter([batch((1, 1), (1, 2)), batch((1, 3)), batch((2, 4), (3, 5)), batch(), batch((3, 6))][:3] + [batch((3, 6))]), ["k"])]
    assert got == [(1, [1, 2, 3]), (2, [4]), (3, [5, 6])]
    assert not list(runs(iter([]), ["k"]))
