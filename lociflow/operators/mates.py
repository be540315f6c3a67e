"""Mate pairing, linked reads, and fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_mates(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The n-th row of left with the n-th of right for equal keys, so that each is paired once at most; right's other columns come as mate_*."""
    ranked = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    mates = ranked(right, right_order).select(*keys, "_n", *[F.col(c).alias(f"mate_{c}") for c in right.columns if c not in keys])
    return ranked(left, left_order).join(mates, [*keys, "_n"]).drop("_n")


def link_chain(rows: DataFrame, keys: Sequence[str], order: Sequence[str], own: str, name: str) -> DataFrame:
    """rows with `name`: `own` of the next row with equal keys; the last of a chain, and rows that are alone, are left out."""
    return rows.withColumn(name, F.lead(own).over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name).isNotNull())


def best_by_distance(candidates: DataFrame, keys: Sequence[str], length: str, target: Column, ties: Sequence[str]) -> DataFrame:
    """The candidate of each key whose length is nearest to target; the first by `ties` if several are, of those the shortest."""
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col(length) - target), *ties, length)
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def flank_clusters(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, drift: float) -> DataFrame:
    """rows with cluster: numbers of runs, in order, whose neighbours' values differ by at most `drift`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cut = F.when(F.abs(F.col(value) - F.lag(value).over(w)) > drift, 1).otherwise(0)
    return rows.withColumn("_cut", cut).withColumn("cluster", F.sum("_cut").over(w)).drop("_cut")


def merge_overlapping(v1: Column, v2: Column) -> Column:
    """Mate 1's vertices with the rest of mate 2's, if mate 1 ends with mate 2's start up to its last vertex; else null."""
    at = F.array_position(v2, F.element_at(v1, -1)).cast("int")
    fits = (at > 0) & (at <= F.size(v1)) & (F.slice(v1, F.greatest(F.size(v1) - at + 1, F.lit(1)), F.greatest(at, F.lit(1))) == F.slice(v2, 1, F.greatest(at, F.lit(1))))
    return F.when(fits, F.concat(v1, F.slice(v2, at + 1, F.size(v2))))


def insert_size_stats(sizes: DataFrame, low: float = 0.005, high: float = 0.998, mass: float = 0.999) -> DataFrame:
    """median, low, high, mean, std of a column size: percentiles by running counts, mean and std over the bins up to `mass` of all.

    Sizes are counted first; only bins are put in order, as many as there are sizes.
    """
    bins = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    run = bins.withColumns({"upto": F.sum("n").over(Window.orderBy("size")), "of": F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    at = lambda p: F.min(F.when(F.col("upto") >= F.col("of") * p, F.col("size")))
    inside = F.col("upto") - F.col("n") < F.col("of") * mass
    n, s, q = (F.sum(F.when(inside, x)) for x in (F.col("n"), F.col("n") * F.col("size"), F.col("n") * F.col("size") * F.col("size")))
    return run.agg(at(0.5).alias("median"), at(low).alias("low"), at(high).alias("high"), (s / n).alias("mean"), F.sqrt(q / n - (s / n) * (s / n)).alias("std"))


def capped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], per_key: int = 1000, least: int = 50, total: int = 1_000_000) -> DataFrame:
    """A bounded sample: the first `per_key` rows of each key that has `least` or more, and of those the first `total` in order of key."""
    big = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_of")).where(F.col("_of") >= least).drop("_of")
    ranked = rows.join(big, list(keys)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= per_key).drop("_n")
    return ranked.orderBy(*keys, *order).limit(total)


def infer_library(rows: DataFrame, per_strand: int = 50_000, least: int = 10_000, ratio: float = 0.85) -> DataFrame:
    """first, second, sampled, library from rows (xs, predicted, order columns i): balanced samples of both strands, the first `per_strand` of each.

    Which library type most of them fit, if that is more than `ratio`, and 'unstranded' otherwise or where a strand has less than `least`.
    """
    known = rows.where(F.col("xs").isin("+", "-") & F.col("predicted").isin("+", "-"))
    first = known.where("xs = '+'").orderBy("i").limit(per_strand).unionByName(known.where("xs = '-'").orderBy("i").limit(per_strand))  # each task keeps its own first ones
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("xs").orderBy("i")))
    sizes = ranked.agg(F.least(F.count_if(F.col("xs") == "+"), F.count_if(F.col("xs") == "-")).alias("each"))
    taken = ranked.crossJoin(F.broadcast(sizes)).where("n <= each")
    out = taken.agg(F.count_if(F.col("xs") == F.col("predicted")).alias("first"), F.count_if(F.col("xs") != F.col("predicted")).alias("second"), F.coalesce(F.max("each"), F.lit(0)).alias("sampled"))
    kind = F.when(F.col("sampled") < least, "unstranded").when(F.col("first") > ratio * 2 * F.col("sampled"), "first").when(F.col("second") > ratio * 2 * F.col("sampled"), "second").otherwise("unstranded")
    return out.withColumn("library", kind)
