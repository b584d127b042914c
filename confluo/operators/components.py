"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


#: Edges at most that one task takes on (a few dozen bytes each); more are worked on in rounds over the whole cluster.
FEW = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task: roots are hooked to smaller ones and paths halved until no edge joins two."""
    parts = [[b.column(k).to_numpy() for k in ("hi", "lo")] for b in batches]
    hi, lo = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    nodes = np.unique(np.concatenate((hi, lo)))
    a, b = np.searchsorted(nodes, hi), np.searchsorted(nodes, lo)
    top = np.arange(len(nodes))
    while True:
        p, q = top[a], top[b]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(top, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (up := top[top]).tobytes() != top.tobytes():
            top = up
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[top])], ["node", "component"])


def _rounded(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``(hi, lo)``, hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = large.join(low, "hi").where("lo != m").select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
    return moved.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """Labels every node that has an edge with the smallest node of its component.

    Up to ``FEW`` edges are one task's work. For more there are alternating
    large-star and small-star steps: each replaces the neighbours of a node by
    links to the smallest one, so the number of edges never grows and a
    logarithmic number of rounds suffices. A hub is one key of a min()
    aggregate and of a join that can be split; nothing goes to the driver but
    a count and a checksum. Self-loops label their node with itself. Returns
    ``node``, ``component``.
    """
    pairs = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct()
    pairs = scratch.table(pairs, release=False)
    if pairs.count() <= FEW:
        return pairs.select(F.col("hi").cast("long").alias("hi"), F.col("lo").cast("long").alias("lo")).coalesce(1).mapInArrow(_united, "node long, component long")
    alone = pairs.where("hi = lo").select(F.col("hi").alias("node"), F.col("hi").alias("component"))
    now, mark = pairs.where("hi != lo"), None
    while True:
        now = scratch.table(_rounded(now))
        found = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
    roots = now.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    out = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
    return out.unionByName(alone.join(out, "node", "left_anti")).distinct()


def joined_components(labels: DataFrame, edges: DataFrame, scratch: Scratch, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """``labels`` (``node``, ``component``) after further edges: only the graph between components is worked on."""
    found = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    for side in ("a", "b"):
        found = found.join(labels.select(F.col("node").alias(side), "component"), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    up = scratch.table(connected_components(found.where("a != b"), scratch, src="a", dst="b"), release=False)
    moved = labels.join(up.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return moved.select("node", F.coalesce("top", "component").alias("component")).unionByName(up.join(labels, "node", "left_anti").select("node", "component"))
