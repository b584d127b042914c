"""Cropped or edited copies of images by local descriptors.

1. One scan describes the images (PGM, PPM or PNG bytes). Images of equal pixels
   are one class from there on, however many there are.
2. Corners are the Harris maxima on levels that shrink by ``STEP`` each and, for keys
   alone, on ``FINE - 1`` levels between, so that a copy of any size is near one. Of those the
   strongest ``PER_CELL`` of each cell of ``CELL`` pixels a side: their number
   grows with the picture, which is worked on at ``SIDE`` pixels a side at most.
   A corner has a place between pixels, an orientation (intensity centroid) and
   128 binary tests turned by it: brightness comparisons that changes of light
   and small edits keep. Beyond its edges a picture is taken as mirrored.
3. Hamming tables: two words of the tests have a table each. A table's key is that word
   of a corner and of its two nearest corners on the level, and the sector in
   which those lie, seen from the corner. Copies agree exactly in some word of
   many corner triples; unrelated images hardly ever do. Keys of one range move together,
   packed, to the task that finds those of several classes: their buckets.
4. Each bucket is first a star around its smallest class. Then those of up to ``BLOCK``
   classes give their other pairs of different components; larger ones are
   a star around their largest class, as one picture may be poorer than others. A pair is a link if enough
   corners match (mutually nearest, few tests differing) and agree in one similarity transform: rotation, scale and shift,
   fitted to all that agree. Classes are dealt into parts of about ``PART``; a task has the corners and components of two of
   them and the buckets' members among those, makes the pairs itself, and compares those that don't hang together yet.
   Parts meet in turns, each of which moves about twice the corners that the pictures have.
5. Larger buckets whose classes are in one component then are done. In others, cut into
   blocks of about ``BLOCK`` classes, those of different components are compared
   within a task for each pair of blocks. A bucket's largest component has blocks of its
   own, which meet only those of the others. Only a forest of the links found leaves
   the task, so no link between components is lost.

So a picture with thousands of copies costs a star. A detail that many unrelated
pictures share, too small to link them, costs their comparison: such pairs grow
with the square of the number of pictures, in time but not in memory or on disk.

Defined cases: a null or undecodable image, or one without corners, is its own
component (null class for the first two); repeated rows share a class; equal
images under different ids are linked; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import joined_components
from ..plans.scratch import Scratch
from . import kernel as K

#: A picture's longer side when it is worked on, and the shorter side of its last level.
SIDE, LEAST_SIDE = 256, 16
STEP, FINE = 1.2, 3
CELL, PER_CELL = 16, 4
RADIUS, DISC = 11, 8
TESTS, TABLES, WORD_BITS, SECTORS = 128, 2, 20, 8
NEAR = 14  # differing tests of a match at most
INLIERS = 8  # matches that have to agree, and their share of all matches
SHARE = 0.5
SHIFT = 3.0  # pixels of the level
BLOCK = 512
#: Bits of a key, pictures whose keys are packed together, and for how many pictures there is a range of keys.
KEY_BITS, PACKED, RANGED = 48, 2048, 2000
#: Classes of a part, and how many parts there are at least.
PART, LEAST_PARTS = 8192, 4

_pattern = np.random.default_rng(11).normal(0, RADIUS / 2.2, (TESTS, 4)).clip(-0.7 * RADIUS, 0.7 * RADIUS)
_d = np.arange(-DISC, DISC + 1)
_DY, _DX = (x[np.add.outer(_d * _d, _d * _d) <= DISC * DISC].astype(float) for x in np.meshgrid(_d, _d, indexing="ij"))


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM, PPM or 8-bit PNG image; None if it is none."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            m = re.match(rb"P[56](?:\s+|#[^\n]*\n)+(\d+)\s+(\d+)\s+(\d+)\s", data)
            w, h, k = int(m[1]), int(m[2]), 1 if data[:2] == b"P5" else 3
            a = np.frombuffer(data, np.uint8, w * h * k, m.end()).reshape(h, w, k)
            return a.astype(np.float32).mean(2)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, TypeError, zlib.error, IndexError, KeyError):
        return None
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, body, palette = 8, b"", None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, bits, color, _, _, interlaced = (int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big"), *part[8:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if bits != 8 or interlaced:
        return None
    k = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * k)
    out, up = np.zeros((h, w * k), np.uint8), np.zeros(w * k, np.uint8)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:].copy()
        if f == 2:
            line = line + up
        elif f in (1, 3, 4):
            for x in range(w * k):
                a, b, c = (int(line[x - k]) if x >= k else 0), int(up[x]), (int(up[x - k]) if x >= k else 0)
                if f == 1:
                    add = a
                elif f == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    add = a if da <= db and da <= dc else b if db <= dc else c
                line[x] = (int(line[x]) + add) & 255
        out[y] = up = line
    a = out.reshape(h, w, k)
    if color == 3:
        return palette[a[:, :, 0]].astype(np.float32).mean(2)
    return a[:, :, : 3 if k > 2 else 1].astype(np.float32).mean(2)


def _smooth(a: np.ndarray) -> np.ndarray:
    """Binomial smoothing of the last two axes."""
    p = np.concatenate((a[..., :1], a[..., :1], a, a[..., -1:], a[..., -1:]), -1)
    p = (p[..., :-4] + 4 * p[..., 1:-3] + 6 * p[..., 2:-2] + 4 * p[..., 3:-1] + p[..., 4:]) / 16
    p = np.concatenate((p[..., :1, :], p[..., :1, :], p, p[..., -1:, :], p[..., -1:, :]), -2)
    return (p[..., :-4, :] + 4 * p[..., 1:-3, :] + 6 * p[..., 2:-2, :] + 4 * p[..., 3:-1, :] + p[..., 4:, :]) / 16


def _scaled(a: np.ndarray, by: float) -> np.ndarray:
    """The last two axes shrunk ``by`` times, between pixels."""
    if by == 1.0:
        return a
    h, w = (max(1, int(n / by)) for n in a.shape[-2:])
    y, x = np.minimum(np.arange(h) * by, a.shape[-2] - 1), np.minimum(np.arange(w) * by, a.shape[-1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[-2] - 1), np.minimum(x0 + 1, a.shape[-1] - 1)
    fy, fx = (y - y0)[:, None].astype(a.dtype), (x - x0).astype(a.dtype)
    up, low = a[..., y0, :], a[..., y1, :]
    return (up[..., x0] * (1 - fx) + up[..., x1] * fx) * (1 - fy) + (low[..., x0] * (1 - fx) + low[..., x1] * fx) * fy


def _working(image: np.ndarray) -> np.ndarray:
    a = image.astype(np.float32)
    while max(a.shape) >= 2 * SIDE:
        a = _smooth(a)[::2, ::2]
    return _scaled(a, max(a.shape) / SIDE) if max(a.shape) > SIDE else a


def _levels(base: np.ndarray) -> Iterator[tuple[int, float, np.ndarray]]:
    """Number, scale and pictures of each level, ``FINE`` to a step; from twice the scale on, of a picture halved before."""
    octave, k = 1.0, 0
    while True:
        by = STEP ** (k / FINE)
        while by / octave >= 2:
            base, octave = _smooth(base)[..., ::2, ::2], octave * 2
        a = _scaled(base, by / octave)
        if min(a.shape[-2:]) < LEAST_SIDE or k > 255:
            return
        yield k, by, a
        k += 1


def _corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picture, row and column (between pixels) of the corners of a stack of pictures."""
    gy, gx = np.gradient(a, axis=(1, 2))
    xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = r[:, 2:-2, 2:-2]
    h, w = inner.shape[1:]
    rows = np.maximum.reduce([r[:, :, k : k + w] for k in range(5)])
    top = np.maximum.reduce([rows[:, k : k + h] for k in range(5)])
    n, y, x = np.nonzero((inner >= top) & (inner > 1.0))
    y, x = y + 2, x + 2
    cell = (n * 4096 + y // CELL) * 4096 + x // CELL
    order = np.lexsort((x, y, -r[n, y, x], cell))
    first = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    order = np.sort(order[rank < PER_CELL])
    n, y, x = n[order], y[order], x[order]

    def peak(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
        bend = np.minimum(low - 2 * mid + high, -1e-9)
        return ((low - high) / (2 * bend)).clip(-0.5, 0.5)

    mid = r[n, y, x]
    return n, y + peak(r[n, y - 1, x], mid, r[n, y + 1, x]), x + peak(r[n, y, x - 1], mid, r[n, y, x + 1])


def _tests(a: np.ndarray, n: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orientation and packed tests of corners."""
    edge = RADIUS + 5
    q = _smooth(np.pad(a, ((0, 0), (edge, edge), (edge, edge)), mode="reflect" if min(a.shape[1:]) > edge else "symmetric"))
    w, flat = q.shape[2], q.ravel()
    at, y, x = (n * q.shape[1] * w)[:, None], (y + edge)[:, None], (x + edge)[:, None]

    def sample(v: np.ndarray, u: np.ndarray) -> np.ndarray:
        v0, u0 = v.astype(np.int64), u.astype(np.int64)
        fv, fu = (v - v0).astype(np.float32), (u - u0).astype(np.float32)
        k = at + v0 * w + u0
        return (flat[k] * (1 - fu) + flat[k + 1] * fu) * (1 - fv) + (flat[k + w] * (1 - fu) + flat[k + w + 1] * fu) * fv

    patch = sample(y + _DY, x + _DX)
    angle = np.arctan2((patch * _DY).sum(1), (patch * _DX).sum(1))
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]

    def turned(px: np.ndarray, py: np.ndarray) -> np.ndarray:
        return sample(y + s * px + c * py, x + c * px - s * py)

    return angle, np.packbits(turned(_pattern[:, 0], _pattern[:, 1]) < turned(_pattern[:, 2], _pattern[:, 3]), axis=1)


#: A corner as it is kept: place in sixteenths of a pixel, level, angle in 256 steps, tests.
_CORNER = np.dtype([("x", "<u2"), ("y", "<u2"), ("level", "u1"), ("angle", "u1"), ("tests", "u1", TESTS // 8)])


def describe(images: list[np.ndarray]) -> list[np.ndarray]:
    """The corners of each image; those of equal size are worked on together."""
    out = [np.zeros(0, _CORNER)] * len(images)
    small = [_working(a) for a in images]
    shapes: dict[tuple, list[int]] = {}
    for i, a in enumerate(small):
        if a.size:
            shapes.setdefault(a.shape, []).append(i)
    for (h, w), every in shapes.items():
        step = max(1, (1 << 18) // (h * w))
        for lo in range(0, len(every), step):
            own = every[lo : lo + step]
            owners, corners = [], []
            for level, by, a in _levels(_smooth(np.stack([small[i] for i in own]))):
                n, y, x = _corners(a)
                for k in range(0, len(n), 2048):
                    part = slice(k, k + 2048)
                    angle, tests = _tests(a, n[part], y[part], x[part])
                    c = np.zeros(len(angle), _CORNER)
                    c["x"], c["y"], c["level"] = np.rint(x[part] * by * 16), np.rint(y[part] * by * 16), level
                    c["angle"] = np.rint(angle * 128 / np.pi).astype(int) & 255
                    c["tests"] = tests
                    owners.append(n[part])
                    corners.append(c)
            if corners:
                owner, c = np.concatenate(owners), np.concatenate(corners)
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(len(own) + 1))
                for k, i in enumerate(own):
                    out[i] = c[order[cut[k] : cut[k + 1]]]
    return out


def _near_two(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), 2), np.int64)
    for k in range(0, len(x), 512):
        d = (x[k : k + 512, None] - x) ** 2 + (y[k : k + 512, None] - y) ** 2
        d[np.arange(len(d)), np.arange(k, k + len(d))] = np.iinfo(d.dtype).max
        first = d.argmin(1)
        d[np.arange(len(d)), first] = np.iinfo(d.dtype).max
        out[k : k + 512, 0], out[k : k + 512, 1] = first, d.argmin(1)
    return out


def table_keys(corners: np.ndarray) -> np.ndarray:
    """Distinct keys per table and corner: the table's word of the corner and of its two nearest on the same level, and where those lie."""
    x, y = corners["x"].astype(np.int64), corners["y"].astype(np.int64)
    words = np.ascontiguousarray(corners["tests"]).view("<u4").reshape(len(corners), TESTS // 32)[:, :TABLES].astype(K.U64) & K.U64((1 << WORD_BITS) - 1)
    out, level = [], corners["level"]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1, [len(level)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 2:
            near = _near_two(x[a:b], y[a:b]) + a
            pair = np.sort(words[near], axis=1)
            towards = np.arctan2(y[near].sum(1) - 2 * y[a:b], x[near].sum(1) - 2 * x[a:b]) / (2 * np.pi) - corners["angle"][a:b] / 256
            sector = np.floor(towards % 1 * SECTORS).astype(K.U64)[:, None]
            out.append(K.mix(K.mix(K.mix(words[a:b] + (sector + K.U64(1)) * K.U64(1 << 40)) ^ pair[:, 0]) ^ (pair[:, 1] * K.U64(TABLES) + np.arange(TABLES, dtype=K.U64))).ravel())
    return np.unique(K.signed(np.concatenate(out) >> K.U64(64 - KEY_BITS))) if out else np.zeros(0, np.int64)


def whole_levels(corners: np.ndarray) -> np.ndarray:
    """Those that are compared; the others have only given keys."""
    return corners[corners["level"] % FINE == 0]


def consensus(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Matching corners, and how many of them agree in the best similarity transform."""
    a, b = whole_levels(a), whole_levels(b)
    if not len(a) or not len(b):
        return 0, 0
    s, t = (np.ascontiguousarray(c["tests"]).view("<u8").reshape(len(c), -1).T.copy() for c in (a, b))
    to, least = np.empty(len(a), np.int64), np.empty(len(a), np.uint8)
    back, nearest = np.zeros(len(b), np.int64), np.full(len(b), 255, np.uint8)
    for k in range(0, len(a), 256):
        d = np.bitwise_count(s[0, k : k + 256, None] ^ t[0])
        d += np.bitwise_count(s[1, k : k + 256, None] ^ t[1])
        there, here = d.argmin(1), d.argmin(0)
        to[k : k + 256], least[k : k + 256] = there, d[np.arange(len(d)), there]
        low = d[here, np.arange(len(b))]
        better = low < nearest
        back[better], nearest[better] = here[better] + k, low[better]
    ok = np.flatnonzero((least <= NEAR) & (back[to] == np.arange(len(a))))
    if len(ok) < INLIERS:
        return len(ok), 0
    u, v = a[ok], b[to[ok]]
    p, q = (c["x"] / 16 + 1j * (c["y"] / 16) for c in (u, v))
    size = STEP ** ((v["level"].astype(float) - u["level"]) / FINE)
    turn = size * np.exp(1j * np.pi / 128 * (v["angle"].astype(float) - u["angle"]))
    allowed = SHIFT * STEP ** (v["level"].astype(float) / FINE)
    best = np.zeros(0, np.int64)
    for k in range(0, len(ok), 256):  # from each match: loosely, as level and angle are coarse
        away = p[None] - p[k : k + 256, None]
        off = np.abs(turn[k : k + 256, None] * away - (q[None] - q[k : k + 256, None]))
        good = off <= allowed[None] + 0.12 * np.abs(away) * size[k : k + 256, None]
        row = good.sum(1).argmax()
        if good[row].sum() > len(best):
            best = np.flatnonzero(good[row])
    for _ in range(3):  # fitted to those that agree
        if len(best) < 3:
            break
        x, y = p[best] - p[best].mean(), q[best] - q[best].mean()
        m = (np.conj(x) * y).sum() / max((np.abs(x) ** 2).sum(), 1e-9)
        off = np.abs(m * (p - p[best].mean()) + q[best].mean() - q)
        best = np.flatnonzero(off <= allowed)
    return len(ok), len(best)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    matched, agree = consensus(a, b)
    return agree >= INLIERS and agree >= SHARE * matched


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _CORNER)


def _described(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Class of each image, with the corners where it is the first of its class in the batch, and rows with the keys of such classes, packed by range."""
    for whole in batches:
        seen: set[int] = set()
        for at in range(0, whole.num_rows, PACKED):
            batch = whole.slice(at, PACKED)
            keys: list[int | None] = []
            new: dict[int, np.ndarray] = {}
            for data in batch.column("image"):
                a = decode_image(data.as_py())
                if a is None:
                    keys.append(None)
                    continue
                keys.append(int.from_bytes(hashlib.sha256(np.array(a.shape).tobytes() + a.tobytes()).digest()[:8], "little", signed=True))
                if keys[-1] not in seen:
                    new.setdefault(keys[-1], _working(a))
            found = dict(zip(new, describe(list(new.values())), strict=True))
            seen.update(found)
            own = {c: whole_levels(f).tobytes() for c, f in found.items()}
            n = len(keys)
            yield pa.record_batch([batch.column("id"), pa.array(keys, pa.int64()), pa.array([own.pop(k, None) for k in keys], pa.binary()), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3], _FOUND)
            rows = list(_ranged(list(found), [table_keys(f) for f in found.values()], ranges))
            if rows:
                n, (part, *packed) = len(rows), zip(*rows, strict=True)
                yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(part, pa.int32()), *[pa.array(x, pa.binary()) for x in packed]], _FOUND)


_FOUND = ["id", "c", "feats", "part", "keys", "owners", "classes"]


def _ranged(classes: list[int], keys: list[np.ndarray], ranges: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Per range of keys: those of some classes, which of the range's classes has each, and these."""
    own, every = np.repeat(np.arange(len(classes)), [len(k) for k in keys]), np.concatenate([np.zeros(0, np.int64), *keys])
    order = np.argsort(every, kind="stable")
    own, every = own[order], every[order]
    part = every * ranges >> KEY_BITS
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some, which = np.unique(own[a:b], return_inverse=True)
        yield int(part[a]), every[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes(), which.astype("<u2").tobytes(), np.array(classes, "<i8")[some].tobytes()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of several classes with each of these, their number, the smallest and the largest."""
    for part in K.runs(batches, ["part"]):
        keys, own = [], []
        for k, w, c in zip(*(part.column(x).to_pylist() for x in ("keys", "owners", "classes")), strict=True):
            wide = np.zeros((len(w) // 2, 8), np.uint8)
            wide[:, : KEY_BITS // 8] = np.frombuffer(k, np.uint8).reshape(len(wide), -1)
            keys.append(wide.view("<i8").ravel())
            own.append(np.frombuffer(c, "<i8")[np.frombuffer(w, "<u2")])
        key, c = np.concatenate(keys), np.concatenate(own)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        order = order[np.append(False, same) | np.append(same, False)]
        key, c = key[order], c[order]
        order = np.lexsort((c, key))
        key, c = key[order], c[order]
        once = np.append(True, (key[1:] != key[:-1]) | (c[1:] != c[:-1]))[: len(key)]  # equal images of several batches give their keys each
        key, c = key[once], c[once]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(first, append=len(key))
        keep = np.repeat(n > 1, n)
        yield pa.record_batch([pa.array(x[keep]) for x in (key, c, np.repeat(n, n), np.repeat(c[first], n), np.repeat(c[first + n - 1], n))], ["b", "c", "n", "y", "z"])


_DEALT = ["b", "c", "y", "z", "round", "i", "j", "pairs", "heads", "members"]


def _dealt(batches: Iterator[pa.RecordBatch], parts: int, block: int) -> Iterator[pa.RecordBatch]:
    """What ``_shared`` finds, packed for each pair of parts (``i <= j``): ``pairs`` of stars, and of buckets of up to ``block``
    classes the ``members`` besides their star's with the bucket that each is of (``heads``); larger buckets' members as rows, too."""
    for batch in batches:
        b, c, n, y, z = (batch.column(k).to_numpy() for k in ("b", "c", "n", "y", "z"))
        rows: list[tuple] = []

        def star(number: int, own: np.ndarray, hub: np.ndarray, rows: list[tuple] = rows, c: np.ndarray = c) -> None:
            own = own & (c != hub)
            two = np.unique(np.stack((np.maximum(c, hub), np.minimum(c, hub)), 1)[own], axis=0)
            p, q = two[:, 0] % parts, two[:, 1] % parts
            for i, j, at in _cut(np.minimum(p, q), np.maximum(p, q)):
                rows.append((number, i, j, two[at].astype("<i8").tobytes(), None, None))

        star(1, n > 1, y)
        star(2, n > block, z)
        few = (n > 2) & (n <= block) & (c != y)
        head, of, own = b[few], c[few] % parts, c[few]
        order = np.lexsort((of, head))
        head, of, own = head[order], of[order], own[order]
        first = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (of[1:] != of[:-1]))[: len(head)])
        size = np.diff(first, append=len(head))  # of a bucket's members in one part
        opens = np.flatnonzero(np.append(True, np.diff(head[first]) != 0))[: len(first)]
        bucket = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(first)))
        # a member goes to where its part meets each of its bucket's parts
        meets = np.diff(opens, append=len(first))[np.repeat(bucket, size)]
        other = K.ranges(opens[np.repeat(bucket, size)], meets)
        me = np.repeat(np.arange(len(own)), meets)
        useful = (of[first][other] != of[me]) | (size[other] > 1)
        other, me = other[useful], me[useful]
        p, q = of[me], of[first][other]
        for i, j, at in _cut(np.minimum(p, q), np.maximum(p, q)):
            rows.append((2, i, j, None, head[me[at]].astype("<i8").tobytes(), own[me[at]].astype("<i8").tobytes()))
        large = pa.array(np.flatnonzero(n > block))
        if len(large):
            k = len(large)
            yield pa.record_batch([*[batch.column(x).take(large) for x in ("b", "c", "y", "z")], *[pa.nulls(k, pa.int32())] * 3, *[pa.nulls(k, pa.binary())] * 3], _DEALT)
        if rows:
            number, i, j, *packed = zip(*rows, strict=True)
            yield pa.record_batch([*[pa.nulls(len(rows), pa.int64())] * 4, *[pa.array(x, pa.int32()) for x in (number, i, j)], *[pa.array(x, pa.binary()) for x in packed]], _DEALT)


def _cut(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Places of each pair of parts, in order."""
    order = np.lexsort((j, i))
    if not len(order):
        return
    cuts = np.flatnonzero(np.concatenate(([True], (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0), [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(i[order[a]]), int(j[order[a]]), order[a:b]


def _compared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Links between components that the stars and buckets of two parts give: a forest of them."""
    for some in K.runs(batches, ["i", "j"]):
        i, j = some.column("i")[0].as_py(), some.column("j")[0].as_py()
        known = some.filter(some.column("c").is_valid()).select(["c", "component", "feats"]).sort_by("c")
        packed = {k: [np.frombuffer(x, "<i8") for x in some.column(k).drop_null().to_pylist()] for k in ("pairs", "heads", "members")}
        c, feats = known.column("c").to_numpy(), known.column("feats")
        top = np.unique(known.column("component").to_numpy(), return_inverse=True)[1].tolist()  # of each class, its component's number
        up = list(range(len(top)))
        xs, ys = [], []

        def root(k: int, top: list[int] = top, up: list[int] = up) -> int:
            x = top[k]
            while up[x] != x:
                up[x] = x = up[up[x]]
            top[k] = x
            return x

        def pairs(packed: dict = packed, c: np.ndarray = c, i: int = i, j: int = j, root=root) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if packed["pairs"]:
                two = np.searchsorted(c, np.unique(np.concatenate(packed["pairs"]).reshape(-1, 2), axis=0))
                yield two[:, 0], two[:, 1]
            for head, own in zip(packed["heads"], packed["members"], strict=True):
                at = np.searchsorted(c, own)
                cuts = np.flatnonzero(np.append(True, np.diff(head) != 0))
                for a, b in zip(cuts, np.append(cuts[1:], len(head)), strict=True):
                    group = np.array([root(k) for k in at[a:b].tolist()])
                    if (group == group[0]).all():
                        continue
                    left, right = (np.flatnonzero(own[a:b] % parts == k) for k in (i, j))
                    p, q = np.nonzero((group[left, None] != group[right]) & ((left[:, None] < right) | (i != j)))
                    yield at[a:b][left[p]], at[a:b][right[q]]

        tried: set[int] = set()
        for p, q in pairs():
            for a, b in zip(np.maximum(p, q).tolist(), np.minimum(p, q).tolist(), strict=True):
                u, v, pair = root(a), root(b), a * len(c) + b
                if u != v and pair not in tried:
                    tried.add(pair)
                    if linked(_unpacked(feats[a].as_py()), _unpacked(feats[b].as_py())):
                        up[max(u, v)] = min(u, v)
                        xs.append(int(c[a]))
                        ys.append(int(c[b]))
        if xs:
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components within a bucket, or a pair of its blocks: a forest of them."""
    for part in K.runs(batches, ["b", "i", "j"]):
        c, comp, side = (part.column(k).to_numpy() for k in ("c", "component", "side"))
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        centre = (c == part.column("y")[0].as_py()) | (c == part.column("z")[0].as_py())
        feats = [_unpacked(x) for x in part.column("feats").to_pylist()]
        top: dict[int, int] = {}

        def root(x: int, top: dict[int, int] = top) -> int:
            while (up := top.get(x, x)) != x:
                x = up
            return x

        xs, ys = [], []
        right = np.flatnonzero(side == j)
        for k in np.flatnonzero(side == i).tolist():
            for r in right.tolist():
                if (i == j and r >= k) or centre[k] or centre[r]:  # the bucket's stars have been tried
                    continue
                p, q = root(int(comp[k])), root(int(comp[r]))
                if p != q and linked(feats[k], feats[r]):
                    top[max(p, q)] = min(p, q)
                    xs.append(int(c[k]))
                    ys.append(int(c[r]))
        if xs:
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])


def _blocks(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets of several components, per pair of blocks (``i <= j``) that they take part in."""
    named = members.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = scratch.table(named)
    of = named.groupBy("b", "component").agg(F.count("*").alias("m"))
    parts = of.groupBy("b").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    one, own = F.col("m") <= BLOCK, F.ceil(F.col("top.m") / BLOCK).cast("int")
    others = F.ceil((F.col("m") - F.col("top.m")) / BLOCK).cast("int")
    parts = parts.select("b", F.col("top.component").alias("major"), F.when(one, 0).otherwise(own).alias("own"), F.when(one, 1).otherwise(others).alias("others"))
    major = (F.col("component") == F.col("major")) & (F.col("own") > 0)
    side = F.when(major, F.pmod(F.xxhash64("c"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("c"), F.col("others"))).cast("int")
    meets = F.sequence(F.when(major, F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("others") - 1)
    met = named.join(parts, "b").withColumn("side", side).withColumn("other", F.explode(meets))
    return met.select("b", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "c", "component", "y", "z")


def image_copies(images: DataFrame, *, id_col: str, image: Column) -> DataFrame:
    """A row per input row: its id, ``class_id`` (smallest id of equal pixels), ``n_points``, ``component_id`` and ``kept``."""
    scratch = Scratch(images.sparkSession)
    return scratch.finish(_copies(images, scratch, id_col, image))


def _copies(images: DataFrame, scratch: Scratch, id_col: str, image: Column) -> DataFrame:
    base = images.select(F.col(id_col).cast("long").alias("id"), image.cast("binary").alias("image"))
    rows = base.count()
    ranges, parts, block = min(1 << 14, 16 + rows // RANGED), max(LEAST_PARTS, -(-rows // PART)), BLOCK
    found = scratch.table(base.mapInArrow(K.lean(lambda batches: _described(batches, ranges)), "id long, c long, feats binary, part int, keys binary, owners binary, classes binary"))
    packed = found.where("part is not null").select("part", "keys", "owners", "classes").repartition("part").sortWithinPartitions("part")
    dealt = scratch.table(packed.mapInArrow(K.lean(lambda batches: _dealt(_shared(batches), parts, block)), "b long, c long, y long, z long, round int, i int, j int, pairs binary, heads binary, members binary"))
    rows = found.where("part is null")
    classes = scratch.table(rows.where("c is not null").groupBy("c").agg(F.min("id").alias("class_id"), F.first("feats", ignorenulls=True).alias("feats")))
    named = scratch.table(rows.select("id", "c"))
    scratch.discard(found)
    feats = classes.select("c", "feats")
    labels = feats.limit(0).select(F.col("c").alias("node"), F.col("c").alias("component"))

    def confirmed(number: int) -> DataFrame:
        """Links of a round's pairs, of the parts that meet in one turn after those of another."""
        turns = -(-parts // 2)
        known = feats.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c")).withColumn("own", F.pmod("c", F.lit(parts)).cast("int"))
        asked = dealt.where(F.col("round") == number).select("i", "j", *[F.lit(None).cast(t).alias(k) for k, t in (("c", "long"), ("component", "long"), ("feats", "binary"))], "pairs", "heads", "members")

        def turn(k: int) -> DataFrame:
            others = F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda other: (other + F.col("own")) % turns == k)
            sent = known.withColumn("other", F.explode(others)).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "component", "feats", *[F.lit(None).cast("binary").alias(x) for x in ("pairs", "heads", "members")])
            met = sent.unionByName(asked.where((F.col("i") + F.col("j")) % turns == k))
            return met.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(K.lean(lambda batches: _compared(batches, parts)), "x long, y long")

        return scratch.in_turns(turn(k) for k in range(turns))

    def joined(found: DataFrame) -> DataFrame:
        return scratch.table(joined_components(labels, found, scratch, src="x", dst="y"))

    labels = joined(confirmed(1))
    labels = joined(confirmed(2))
    large = dealt.where("b is not null").select("b", "c", "y", "z")
    blocks = _blocks(large, labels, scratch).join(feats, "c")
    labels = joined(scratch.table(blocks.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "c").mapInArrow(K.lean(_joining), "x long, y long")))

    group = classes.select("c", "class_id", (F.octet_length("feats") / _CORNER.itemsize).cast("int").alias("n_points")).join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = group.groupBy("component").agg(F.min("class_id").alias("component_id"))
    group = group.join(least, "component").select("c", "class_id", "component_id", "n_points")
    out = named.join(group, "c", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: Pixels between the components of a vector in its picture.
APART = 7


def picture(vector: pa.Array) -> pa.Array:
    """A grey picture (PGM) of each vector: its components on a square grid, interpolated, ``APART`` pixels apart."""
    out: list[bytes | None] = []
    for v in vector:
        if not v.is_valid or not len(v):
            out.append(None)
            continue
        x = np.nan_to_num(np.array(v.as_py(), float))
        side = int(np.ceil(np.sqrt(len(x))))
        grid = np.zeros(side * side)
        grid[: len(x)] = np.tanh(x / (np.sqrt((x * x).mean()) + 1e-12))
        a = _scaled(grid.reshape(side, side) * 100 + 128, 1 / APART)
        out.append(b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + np.rint(a).clip(0, 255).astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())
