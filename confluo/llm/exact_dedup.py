"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are after each run of ASCII white space has become
one space. All is DataFrame expressions:

1. **Fold.** Rows are grouped by a 64-bit key and the bytes of the text, so
   equality is that of bytes, never of hashes. Spark folds within each scan task
   first: a text that a third of all rows hold is a row per task when it moves.
2. **Directory.** An entry is a leading bit pattern of the key. An overfull bucket
   is split by its next bit, which doubles the directory, until its different texts are at
   most ``capacity`` or the directory has ``2 ** max_depth`` entries (then
   buckets grow; no entry is lost). It is made of the counts of the
   ``2 ** max_depth`` finest patterns, so it has a fixed bound, and is broadcast.
3. **Index.** Each bucket, a range of keys, goes to one owner task. The owner
   numbers the different texts of one key (the chain of a collision) and writes the
   bucket in the order of its keys to the shared folder.
4. **Lookup.** A row finds its bucket through the directory and its key there.
   Where a chain has one text, the fold has already compared the bytes. Rows
   whose key has more compare theirs with each text of the chain.

Rows that look a frequent key up are split by Spark's skew join.

Defined cases: a null text counts as empty, and empty texts equal each other;
a text of white space alone equals one space. Ids of a group that are null
count after all others; where all are null, ``keep_id`` is null and each such row is
kept. Rows that repeat the smallest id all count as the row that stays. Other columns,
whatever their names, are carried by ``without_exact_duplicates`` and ignored
by ``exact_duplicates``. Without rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .rows import ROW

#: Different texts in a bucket, and the logarithm of the largest directory.
CAPACITY = 1 << 10
MAX_DEPTH = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space (single spaces are left as they are); null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def hash_key(text: Column, bits: int = 64) -> Column:
    """The leading ``bits`` of a 64-bit hash; fewer make collisions, for tests."""
    key = F.xxhash64(text)
    return key if bits >= 64 else key.bitwiseAND(F.lit(-(1 << (64 - bits))).cast("long"))


def _leaf(max_depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - max_depth) if max_depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """From each of the finest bit patterns in use to the bucket it belongs to (``leaf, bucket, depth``).

    A bucket is named by its first pattern; ``depth`` is the number of bits its keys share.
    """
    leaves = entries.groupBy(_leaf(max_depth).alias("leaf")).agg(F.count("*").alias("n"))
    doubled = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    doubled = doubled.withColumn("bucket", F.expr(f"shiftleft(shiftright(leaf, {max_depth} - depth), {max_depth} - depth)"))
    sizes = doubled.groupBy("depth", "bucket").agg(F.sum("n").alias("size"))
    # a pattern's bucket is the first, on the way from the whole, that need not be split
    fits = doubled.join(sizes, ["depth", "bucket"]).where((F.col("size") <= capacity) | (F.col("depth") == max_depth))
    return fits.groupBy("leaf").agg(F.min(F.struct("depth", "bucket")).alias("b")).select("leaf", "b.bucket", "b.depth")


def build_index(entries: DataFrame, scratch: Scratch, *, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The directory and the index (``bucket, key, chain, chains, keep_id, group_size, text_sha256``) of rows ``doc_id, key, t``."""
    folded = entries.groupBy("key", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    folded = scratch.table(folded.select("key", "keep_id", "group_size", F.sha2("t", 256).alias("text_sha256")))
    places = scratch.table(directory(folded, capacity, max_depth))
    owned = folded.withColumn("leaf", _leaf(max_depth)).join(F.broadcast(places.select("leaf", "bucket")), "leaf").repartition("bucket")
    chain = Window.partitionBy("bucket", "key")
    numbered = owned.select(
        "bucket",
        "key",
        (F.row_number().over(chain.orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256")) - 1).alias("chain"),
        F.count("*").over(chain).alias("chains"),
        "keep_id",
        "group_size",
        "text_sha256",
    )
    return places, scratch.table(numbered.sortWithinPartitions("bucket", "key", "chain"))


def _looked_up(df: DataFrame, carried: Column | None, id_col: str, text_col: str, key_bits: int, capacity: int, max_depth: int, scratch: Scratch) -> DataFrame:
    columns = {} if carried is None else {ROW: carried}
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("t"), *[c.alias(n) for n, c in columns.items()])
    rows = rows.withColumn("key", hash_key(F.col("t"), key_bits))
    places, index = build_index(rows.select("doc_id", "key", "t"), scratch, capacity=capacity, max_depth=max_depth)
    placed = rows.withColumn("leaf", _leaf(max_depth)).join(F.broadcast(places.select("leaf", "bucket")), "leaf")
    found = ["doc_id", *columns, "keep_id", "group_size", "text_sha256"]
    out = placed.drop("t", "leaf").join(index.where("chains = 1"), ["bucket", "key"]).select(*found)
    collided = index.where("chains > 1").select("bucket", "key").distinct()
    if not collided.isEmpty():  # else no row needs its text again
        chained = placed.drop("leaf").join(collided, ["bucket", "key"], "left_semi")
        texts = chained.groupBy("bucket", "key", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        texts = texts.withColumn("text_sha256", F.sha2("t", 256))
        out = out.unionByName(chained.join(texts, ["bucket", "key", "t"]).select(*found))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256`` (of the normalised text)."""
    scratch = Scratch(df.sparkSession)
    out = _looked_up(df, None, id_col, text_col, key_bits, capacity, max_depth, scratch)
    return scratch.finish(out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def without_exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    scratch = Scratch(df.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = _looked_up(df, whole, id_col, text_col, 64, CAPACITY, MAX_DEPTH, scratch).where("kept")
    return scratch.finish(out.select(*[F.col(ROW).getField(c).alias(c) for c in df.columns]))
