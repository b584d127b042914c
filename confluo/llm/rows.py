"""Keeping the columns of an input beside those that an operator works with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "__row"


def wrapped(df: DataFrame, **working: Column) -> DataFrame:
    """The whole input row as one struct beside the working columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW) if df.columns else F.lit(None).alias(ROW), *[c.alias(name) for name, c in working.items()])


def unwrapped(df: DataFrame, names: list[str], replaced: dict[str, Column]) -> DataFrame:
    """The input's columns in order, some replaced; new ones follow (an input column of such a name gives way)."""
    out = [replaced[c].alias(c) if c in replaced else F.col(ROW).getField(c).alias(c) for c in names]
    return df.select(*out, *[c.alias(name) for name, c in replaced.items() if name not in names])
