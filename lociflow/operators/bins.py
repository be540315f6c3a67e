"""Joins of points and intervals with intervals that meet in bins of the coordinate, so that a sequence with all rows spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 4096


def in_bins(stretches: DataFrame, left: str, right: str, width: int = WIDTH) -> DataFrame:
    """stretches (half-open) with _bin: a row for each bin that they touch."""
    last = F.greatest(F.col(right) - 1, F.col(left))
    return stretches.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(left) / width), F.floor(last / width))))


def within(items: DataFrame, at: Column, stretches: DataFrame, keys: Sequence[str], left: str, right: str, width: int = WIDTH) -> DataFrame:
    """items with the columns of each stretch (keys, left, right, ...) that holds the place `at`. An item lies in one bin, so it meets only the stretches there."""
    placed = items.withColumns({"_at": at, "_bin": F.floor(at / width)})
    return placed.join(in_bins(stretches, left, right, width), [*keys, "_bin"]).where((F.col("_at") >= F.col(left)) & (F.col("_at") < F.col(right))).drop("_at", "_bin")
