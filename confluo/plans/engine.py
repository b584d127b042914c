"""The whole way from source files to projected profiles."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import run_metrics
from ..operators.merge import in_order, profiles
from ..operators.project import Config, project
from ..operators.resolve import resolve
from ..sources.files import KIND_SPAN, KINDS, load_config, parse_many
from .scratch import Scratch


class Engine:
    """Reads records, resolves them to people, merges, and projects.

    ``trust_weights`` are other trusts of the source types; ``keys`` further exact keys that join records
    (names of columns, or expressions over them). Tables that results read stay until ``close``, or the end of a ``with``.
    """

    def __init__(self, spark: SparkSession, *, trust_weights: dict[str, float] | None = None, keys: Iterable[str | Column] = ()):
        self.spark, self.trust_weights, self.keys = spark, trust_weights, list(keys)
        self.tables: list[Scratch] = []

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        """Deletes what results of this engine read; they can't be used after it."""
        while self.tables:
            self.tables.pop().drop()

    def _scratch(self) -> Scratch:
        self.tables.append(Scratch(self.spark))
        return self.tables[-1]

    def read(self, *, csv: Iterable[str] = (), ats: Iterable[str] = (), resume: Iterable[str] = (), notes: Iterable[str] = ()) -> DataFrame:
        """All records; ``seq`` numbers them in the order of sources, files and rows. Paths may be folders."""
        scratch, out = self._scratch(), None
        for k, (kind, paths) in enumerate(zip(KINDS, (csv, ats, resume, notes), strict=True)):
            part = parse_many(self.spark, paths, kind, k * KIND_SPAN, scratch)
            out = part if out is None else out.unionByName(part)
        return out

    def profiles(self, records: DataFrame) -> DataFrame:
        """One row per person, with metadata per field; independent of temporary tables but its own."""
        scratch = self._scratch()
        resolved = scratch.table(resolve(scratch.table(records), scratch, self.keys))
        return scratch.finish(profiles(resolved, scratch, self.trust_weights))

    def run(self, config: dict | str | None = None, **paths: Iterable[str]) -> DataFrame:
        """Projected profiles in output order."""
        checked = Config(load_config(config) if not isinstance(config, dict) else config)
        return project(in_order(self.profiles(self.read(**paths))), checked)

    def run_with_metrics(self, config: dict | str | None = None, **paths: Iterable[str]) -> tuple[DataFrame, DataFrame]:
        """Projected profiles and the one row of run metrics, from one resolution; records are counted as they are read."""
        checked = Config(load_config(config) if not isinstance(config, dict) else config)
        seen = Observation()
        found = self.profiles(self.read(**paths).observe(seen, F.count(F.lit(1)).alias("records")))
        return project(in_order(found), checked), run_metrics(seen.get["records"], found)


def run_transform(spark: SparkSession, config: dict | str | None = None, **paths: Iterable[str]) -> DataFrame:
    """``Engine.run`` in one call."""
    return Engine(spark).run(config, **paths)


def run_transform_with_metrics(spark: SparkSession, config: dict | str | None = None, **paths: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """``Engine.run_with_metrics`` in one call."""
    return Engine(spark).run_with_metrics(config, **paths)


def _rows(df: DataFrame, omit: bool) -> Iterator[dict]:
    for row in df.toLocalIterator():
        full = row.asDict(recursive=True)
        yield {k: v for k, v in full.items() if v is not None} if omit else full


def write_json_array(df: DataFrame, path: str, *, pretty: bool = False, omit_null: bool = False) -> None:
    """One local JSON file with an array of all rows, a partition in memory at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        first = True
        for row in _rows(df, omit_null):
            text = json.dumps(row, indent=2 if pretty else None)
            if pretty:
                text = "\n".join("  " + line for line in text.split("\n"))
            f.write(("[" if first else ",") + ("\n" if pretty else "" if first else " ") + text)
            first = False
        f.write("[]\n" if first else "\n]\n" if pretty else "]\n")


def write_json_lines(df: DataFrame, path: str, *, omit_null: bool = False) -> None:
    """A folder of JSON lines, written in parallel; the sink for large results."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(omit_null).lower()}).alias("value")).write.text(path)
