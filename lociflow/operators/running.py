"""Running aggregates that don't gather a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: Sequence[str], bin_by: Column, order: Sequence[str], value: Column, how: str, name: str, with_own: bool = True) -> DataFrame:
    """df with `name`: the running max or sum of value within keys, in `order`; without the row's own value if not with_own.

    `bin_by` is a column that never falls along the order (a coordinate over a bin's width). Rows are windowed within a bin, bins carry
    their totals on, so a key with a large share of all rows spreads over its bins.
    """
    f = {"max": F.max, "sum": F.sum}[how]
    rows = df.withColumns({"_bin": bin_by, "_value": value})
    window = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)
    carried = rows.groupBy(*keys, "_bin").agg(f("_value").alias("_total"))
    carried = carried.withColumn("_carry", f("_total").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))).drop("_total")
    both = rows.withColumn("_here", f("_value").over(window)).join(carried, [*keys, "_bin"])
    value_now = F.greatest("_here", "_carry") if how == "max" else F.coalesce("_here", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return both.select(*df.columns, value_now.alias(name))


def look_back(df: DataFrame, keys: Sequence[str], bin_by: Column, order: Sequence[str], value: Column, how: str, name: str, rows: int, chunk: int = 10_000) -> DataFrame:
    """df with `name`: the max or min of value over the `rows` rows before each within keys, in `order`; null for the first.

    Rows are numbered by running() and windowed in chunks of numbers, each with the last rows of the chunk before it.
    """
    f = {"max": F.max, "min": F.min}[how]
    numbered = running(df.withColumn("_v", value), keys, bin_by, order, F.lit(1), "sum", "_n")
    own = F.floor((F.col("_n") - 1) / chunk)
    halo = (F.col("_n") - 1) % chunk >= chunk - rows
    spread = numbered.withColumn("_chunk", F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_n").rowsBetween(-rows, -1)
    return spread.withColumn(name, f("_v").over(w)).where(F.col("_chunk") == own).select(*df.columns, name)


def following(df: DataFrame, keys: Sequence[str], bin_by: Column, order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with `name`: value of the next row within keys, in `order`, null for the last; cut into bins as in running()."""
    rows = df.withColumn("_bin", bin_by)
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    first = rows.groupBy(*keys, "_bin").agg(F.min(F.struct(*order, F.col(value).alias("_value"))).alias("_first"))
    first = first.withColumn("_next", F.lead("_first").over(by_bin)).select(*keys, "_bin", F.col("_next._value").alias("_next"))
    here = rows.withColumn("_here", F.lead(value).over(Window.partitionBy(*keys, "_bin").orderBy(*order)))
    return here.join(first, [*keys, "_bin"]).select(*df.columns, F.coalesce("_here", "_next").alias(name))
