"""Keys of pictures move packed, and pictures without corners have none."""

import numpy as np
import pyarrow as pa

from confluo.llm import media_copies as M


def test_a_picture_without_corners_has_no_keys():
    (flat,) = M.describe([np.full((40, 40), 9.0, np.float32)])
    assert len(flat) == 0 and len(M.table_keys(flat)) == 0


def test_shared_keys_are_those_of_a_plain_search():
    rng = np.random.default_rng(3)
    top = 1 << M.KEY_BITS
    pool = np.append(rng.integers(0, top, 400), [0, top - 1])
    classes = rng.integers(-(1 << 63), 1 << 63, 30).tolist()
    keys = [np.unique(rng.choice(pool, 60)) for _ in classes]
    rows = [r for lo in (0, 10, 5) for r in M._ranged(classes[lo : lo + 15], keys[lo : lo + 15], 7)]  # some classes twice
    rows += list(M._ranged(classes[25:], keys[25:], 7))
    rows.sort(key=lambda r: r[0])
    batch = pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], ["part", "keys", "owners", "classes"])
    got = [tuple(r.values()) for out in M._shared(iter([batch.slice(0, 9), batch.slice(9)])) for r in out.to_pylist()]
    holders = {}
    for c, own in zip(classes, keys, strict=True):
        for k in own.tolist():
            holders.setdefault(k, set()).add(c)
    want = [(k, c, len(h), min(h), max(h)) for k, h in holders.items() if len(h) > 1 for c in h]
    assert len(got) == len(set(got)) and set(got) == set(want)
    assert sum(len(r[1]) + len(r[2]) for r in rows) == 8 * sum(len(np.frombuffer(r[2], "<u2")) for r in rows)


def test_pairs_of_buckets_are_made_in_tasks_and_only_between_components():
    """A bucket of near copies that hang together costs no comparison, and every pair of other members is made once."""
    rng = np.random.default_rng(5)
    parts, block = 3, 6
    classes = np.unique(rng.integers(-(1 << 63), 1 << 63, 40))
    buckets = [np.sort(rng.choice(classes, n, False)) for n in (2, 3, 5, 6, 7, 9, 4, 4)]
    rows = [(b, c, len(own), own[0], own[-1]) for b, own in enumerate(buckets) for c in own]
    shared = pa.record_batch([pa.array([int(x) for x in col], pa.int64()) for col in zip(*rows, strict=True)], ["b", "c", "n", "y", "z"])
    out = [r for batch in M._dealt(iter([shared]), parts, block) for r in batch.to_pylist()]
    assert [(r["b"], r["c"], r["y"], r["z"]) for r in out if r["b"] is not None] == [(r[0], r[1], r[3], r[4]) for r in rows if r[2] > block]
    made = {1: set(), 2: set()}
    for r in out:
        if r["pairs"]:
            two = np.frombuffer(r["pairs"], "<i8").reshape(-1, 2)
            assert all({x % parts, y % parts} == {r["i"], r["j"]} for x, y in two.tolist())
            made[r["round"]] |= set(map(tuple, two.tolist()))
        if r["heads"]:
            head, own = (np.frombuffer(r[k], "<i8") for k in ("heads", "members"))
            for b in set(head.tolist()):
                some = own[head == b].tolist()
                made[2] |= {(max(x, y), min(x, y)) for x in some for y in some if x % parts == r["i"] and y % parts == r["j"] and x != y}
    stars = {(int(c), int(own[0])) for own in buckets for c in own[1:]}
    others = {(int(x), int(y)) for own in buckets if len(own) <= block for x in own[1:] for y in own[1:] if x > y}
    others |= {(int(own[-1]), int(c)) for own in buckets if len(own) > block for c in own[:-1]}
    assert made[1] == stars and made[2] == others


def test_members_that_hang_together_are_not_compared(monkeypatch):
    asked = []
    monkeypatch.setattr(M, "linked", lambda a, b: asked.append((len(a), len(b))) or False)
    c = np.arange(0, 40, 2)  # all of part 0 of two
    feats = [np.zeros(k + 1, M._CORNER).tobytes() for k in range(len(c))]
    comp = np.where(c < 36, 0, c)  # the last two stand alone
    n = len(c) + 1
    head = [None] * (n - 1) + [np.zeros(len(c), "<i8").tobytes()]
    batch = pa.record_batch([pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([*c.tolist(), None], pa.int64()), pa.array([*comp.tolist(), None], pa.int64()), pa.array([*feats, None], pa.binary()), pa.nulls(n, pa.binary()), pa.array(head, pa.binary()), pa.array([None] * (n - 1) + [c.astype("<i8").tobytes()], pa.binary())], ["i", "j", "c", "component", "feats", "pairs", "heads", "members"])
    assert list(M._compared(iter([batch]), 2)) == []
    assert len(asked) == len(set(asked)) == 18 * 2 + 1  # not the 190 of all pairs
