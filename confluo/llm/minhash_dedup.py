"""Near-duplicate documents with b-bit MinHash.

A document's set is its distinct word shingles (with fewer words than a shingle
has, the whole sequence as one). Two documents are linked where
``100 * |A and B| >= percent * |A or B|``.

1. One scan hashes the shingles and keeps per document the set's size and
   128-bit hash, the minima of ``BANDS * ROWS`` permutations folded to a key per
   band, and the low ``BITS`` bits of each minimum, packed.
2. Documents of equal sets are one class from here on, however many there are.
3. Each bucket (band, key) is first a star: every class against the bucket's
   smallest. The packed bits give an estimate of the similarity, corrected for
   chance collisions; what lies six standard deviations below the limit goes.
   The rest is confirmed on the full sets from the texts.
4. Buckets whose classes are in one component by then are done. In others, those
   of different components are compared within a task: by packed bits first, and what
   may be linked by full sets, unless it has been joined meanwhile. A pair that meets in
   several buckets is looked at in one. Only the links found leave the task, a forest
   of them, so no link between components is lost and no pair is ever a row.
5. A bucket of more than ``BLOCK`` classes is cut into blocks, and each pair of blocks is a
   task's work. Its largest component, within which nothing is left to find, has blocks of its own, which
   meet only those of the others: a bucket that the star has mostly joined costs its size
   and, for the few others, a copy per block.

With 32 bands of five rows a pair of similarity 0.85 meets in no bucket with a
probability of 1e-8, one of 0.8 with 3e-6.

Defined cases: null, empty and wordless texts have an empty set and are linked
with nothing; repeated rows get the same result each; rows of one id with
different texts are separate documents with the same number; a null id takes
part, but isn't a component's number unless it is alone (then null, not kept);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, joined_components
from ..plans.scratch import Scratch
from . import kernel as K

BANDS, ROWS, BITS = 32, 5, 2
SIZE = BANDS * ROWS
#: Classes, and shingles of all of them, in a block at most (a larger document is a block of its own).
BLOCK = 1024
BLOCK_SHINGLES = 1_500_000
_U = K.U64
_A = K.mix(np.arange(1, SIZE + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
_B = K.mix(np.arange(1, SIZE + 1, dtype=_U) * _U(0xA0761D6478BD642F))
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingles(w: K.Words, i: int, width: int) -> np.ndarray:
    """The distinct shingle hashes of text ``i``, sorted."""
    h = w.hash[w.ptr[i] : w.ptr[i + 1]]
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.unique(K.window_hash(h, n))
    return out if n == width else K.mix(out ^ _U(n))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SIZE minima for each (not empty) set."""
    out = np.empty((len(sets), SIZE), _U)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 15):
            n += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[i:j]])[:-1]))
        for k in range(SIZE):
            out[i:j, k] = np.minimum.reduceat(flat * _A[k] + _B[k], at)
        i = j
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS (2) bits of each minimum, taken above the ones an odd factor leaves weak, four to a byte."""
    low = (low >> _U(40)).astype(np.uint8) & 3
    return low[:, 0::4] | (low[:, 1::4] << 2) | (low[:, 2::4] << 4) | (low[:, 3::4] << 6)


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity from packed bits: the share of equal places less those equal by chance (one in 2**BITS)."""
    x = left ^ right
    differ = _ONES[(x | (x >> 1)) & 0x55].sum(-1, dtype=np.int32)
    chance = 0.5**BITS
    return ((SIZE - differ) / SIZE - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    s = percent / 100
    p = s + (1 - s) * 0.5**BITS
    return s - 6 * (p * (1 - p) / SIZE) ** 0.5 / (1 - 0.5**BITS)


def _signatures(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = K.text_bytes(batch.column("text"))
            for i, j in K.groups(at):
                w = K.words(buf, at[i : j + 1], K.SPACE, K.LOWER)
                sets = [shingles(w, k, width) for k in range(j - i)]
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                least = minima([sets[k] for k in some])
                c, s2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                c[some] = K.signed(K.mix(np.array([s.sum(dtype=_U) for s in (sets[k] for k in some)], _U) ^ K.mix(size[some].astype(_U)))) if len(some) else 0
                s2[some] = [np.bitwise_xor.reduce(K.mix(sets[k] ^ _U(0x5851F42D4C957F2D))).astype(np.int64) for k in some]
                bits = packed(least)
                keys = np.zeros((len(some), BANDS), _U)
                for r in range(ROWS):
                    keys = K.mix(keys ^ least[:, r::ROWS])
                keys = K.signed(K.mix(keys + np.arange(1, BANDS + 1, dtype=_U) * _M))
                sig, bands = [None] * (j - i), [None] * (j - i)
                for row, k in enumerate(some):
                    sig[k], bands[k] = bits[row].tobytes(), keys[row]
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), batch.column("t").slice(i, j - i), pa.array(size), pa.array(c, mask=size == 0), pa.array(s2, mask=size == 0), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return run


_M = _U(0xE7037ED1A0B428DB)


def _confirmed(width: int, percent: int):
    """Pairs of classes with their texts that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            sides = [K.text_bytes(batch.column(c)) for c in ("tx", "ty")]
            good, last, have = np.zeros(len(x), bool), None, [None, None]
            for k in range(len(x)):
                for side, (buf, at) in enumerate(sides):
                    if side == 0 or last != y[k]:
                        have[side] = shingles(K.words(buf, at[k : k + 2], K.SPACE, K.LOWER), 0, width)
                last = y[k]
                a, b = have
                both = len(np.intersect1d(a, b, assume_unique=True))
                good[k] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.record_batch([pa.array(x[good]), pa.array(y[good])], ["x", "y"])

    return run


def _pairs(part: pa.Table, percent: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each class of a pair of blocks with its likely partners in other components, best first.

    A pair that meets in several buckets counts in the first of their bands only.
    """
    b = part.column("b")[0].as_py()
    c, comp, n, side, i, j = (part.column(k).to_numpy() for k in ("c", "component", "n", "side", "i", "j"))
    sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(c), -1)
    bands = part.column("bands").combine_chunks()
    bands = (bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands).flatten().to_numpy().reshape(len(c), -1)
    right = np.flatnonzero(side == j)
    for k in np.flatnonzero(side == i):
        r = right[comp[right] != comp[k]]
        r = r[100 * np.minimum(n[r], n[k]) >= percent * np.maximum(n[r], n[k])]
        if i[0] == j[0]:
            r = r[c[r] < c[k]]
        if not len(r):
            continue
        e = estimate(sig[k], sig[r])
        r, e = r[e >= least], e[e >= least]
        if not len(r):
            continue
        first = bands[k][(bands[r] == bands[k]).argmax(1)] == b
        r, e = r[first], e[first]
        if len(r):
            yield k, r[np.argsort(-e, kind="stable")]


def _open(percent: int):
    """The classes that have a likely partner in another component, per pair of blocks."""
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.runs(batches, ["b", "i", "j"]):
            wanted = np.zeros(part.num_rows, bool)
            for k, r in _pairs(part, percent, least):
                wanted[k] = True
                wanted[r] = True
            if wanted.any():
                yield from part.filter(pa.array(wanted)).combine_chunks().to_batches()

    return run


def _linking(width: int, percent: int):
    """Links between components within a pair of blocks, confirmed on full sets; a spanning forest of them."""
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.runs(batches, ["b", "i", "j"]):
            c, comp = part.column("c").to_numpy(), part.column("component").to_numpy()
            top: dict[int, int] = {}

            def root(x: int, top: dict[int, int] = top) -> int:
                while (up := top.get(x, x)) != x:
                    x = up
                return x

            buf, at = K.text_bytes(part.column("text"))
            sets: dict[int, np.ndarray] = {}

            def full(k: int, sets=sets, buf=buf, at=at) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(K.words(buf, at[k : k + 2], K.SPACE, K.LOWER), 0, width)
                return sets[k]

            xs, ys = [], []
            for k, partners in _pairs(part, percent, least):
                a = full(k)
                for r in partners.tolist():
                    p, q = root(comp[k]), root(comp[r])
                    if p == q:
                        continue
                    b = full(r)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        top[max(p, q)] = min(p, q)
                        xs.append(c[k])
                        ys.append(c[r])
            if xs:
                yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return run


def _likely(percent: int):
    """Pairs whose sizes and packed bits allow a link."""
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sx, sy = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in ("sx", "sy"))
            good = np.flatnonzero(estimate(sx, sy) >= least)
            yield pa.record_batch([batch.column(k).take(pa.array(good)) for k in ("x", "y")], ["x", "y"])

    return run


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Classes and components of near-duplicate documents (see the module's text).

    ``docs`` needs ``doc_id`` and ``text``. Returns a row per input row:
    ``doc_id``, ``n_shingles``, ``class_id`` (smallest id of an equal set),
    ``component_id`` (smallest id that can be reached), ``kept``, ``text_hash``
    and ``leads``: whether id and text are the first of their component (null
    ids last), which tells apart rows of one id or of none.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    signed = scratch.table(base.mapInArrow(K.lean(_signatures(width)), "doc_id long, t long, n long, c long, s2 long, sig binary, bands array<long>"))
    rows = signed.select("doc_id", "t", "n", "c")
    some = signed.where("c is not null")
    classes = scratch.table(some.groupBy("c", "s2", "n").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.min("doc_id").alias("class_id"), F.min(_order()).alias("lead"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).select("c", "n", "at", "class_id", "lead", "sig", "bands"))
    sigs = classes.select("c", "n", "sig")

    member = classes.select(F.explode("bands").alias("b"), "c")
    members = scratch.table(_shared(member, scratch))
    near = members.select("c").distinct()
    wanted = classes.join(near, "c", "left_semi").select("c", "at.doc_id", "at.t")
    texts = scratch.table(base.join(wanted.withColumnRenamed("doc_id", "d"), [F.col("doc_id").eqNullSafe(F.col("d")), base["t"] == wanted["t"]]).select("c", "text").dropDuplicates(["c"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = pairs.join(texts.select(F.col("c").alias("x"), F.col("text").alias("tx")), "x")
        two = one.join(texts.select(F.col("c").alias("y"), F.col("text").alias("ty")), "y")
        return two.select("x", "y", "tx", "ty").mapInArrow(K.lean(_confirmed(width, percent)), "x long, y long")

    stars = scratch.table(members.where("c != y").select(F.col("c").alias("x"), "y").distinct())
    likely = scratch.table(_with_bits(stars, sigs, percent).mapInArrow(K.lean(_likely(percent)), "x long, y long"))
    labels = scratch.table(connected_components(scratch.table(confirmed(likely)), scratch, src="x", dst="y"))
    met = _blocks(members, labels, classes, scratch).join(classes.select("c", "sig", "bands"), "c")
    fields = ["b", "i", "j", "side", "c", "component", "n", "sig", "bands"]
    opened = met.select(*fields).repartition("b", "i", "j").sortWithinPartitions("b", "i", "j").mapInArrow(K.lean(_open(percent)), "b long, i int, j int, side int, c long, component long, n long, sig binary, bands array<long>")
    opened = scratch.table(opened)
    met = opened.join(texts, "c").select(*fields, "text").repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")
    links = scratch.table(met.mapInArrow(K.lean(_linking(width, percent)), "x long, y long"))
    labels = scratch.table(joined_components(labels, links, scratch, src="x", dst="y"))

    group = classes.select("c", "class_id", "lead").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = group.groupBy("component").agg(F.min("class_id").alias("component_id"), F.min("lead").alias("lead"))
    group = group.drop("lead").join(least, "component").select("c", "class_id", "component_id", "lead")
    out = rows.join(group, "c", "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return scratch.finish(out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.col("t").alias("text_hash"), (F.col("lead").isNull() | (_order() == F.col("lead"))).alias("leads")))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "t")


def _blocks(members: DataFrame, labels: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets of several components, per pair of blocks (``i <= j``) that they take part in."""
    sized = classes.select("c", "n").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = scratch.table(members.where("k > 2").select("b", "c", "k").join(sized, "c"))
    of = named.groupBy("b", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    share = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    parts = of.groupBy("b").agg(F.max(F.struct("m", "s", "component")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("parts")).where("parts > 1")
    own, others = share(F.col("top.m"), F.col("top.s")), share(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s"))
    # a bucket that is one block as a whole isn't cut
    one = share(F.col("m"), F.col("s")) <= 1
    parts = parts.select("b", F.col("top.component").alias("major"), F.when(one, 0).otherwise(own).alias("own"), F.when(one, 1).otherwise(others).alias("others"))
    mixed = named.join(parts, "b")
    # blocks of the largest component come first; they don't meet each other
    major = (F.col("component") == F.col("major")) & (F.col("own") > 0)
    side = F.when(major, F.pmod(F.xxhash64("c"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("c"), F.col("others"))).cast("int")
    meets = F.sequence(F.when(major, F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("others") - 1)
    met = mixed.withColumn("side", side).withColumn("other", F.explode(meets))
    return met.select("b", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "c", "component", "n")


def _shared(member: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets of several classes, with the bucket's smallest class and size.

    The buckets are written, so that the join's large side is a shuffle of its
    own, which Spark can split at a frequent bucket.
    """
    stars = scratch.table(member.groupBy("b").agg(F.min("c").alias("y"), F.count("*").alias("k")).where("k > 1"))
    return member.join(stars, "b").select("b", "c", "y", "k")


def _with_bits(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    one = pairs.join(sigs.select(F.col("c").alias("x"), F.col("n").alias("nx"), F.col("sig").alias("sx")), "x")
    two = one.join(sigs.select(F.col("c").alias("y"), F.col("n").alias("ny"), F.col("sig").alias("sy")), "y")
    return two.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).select("x", "y", "sx", "sy")
