"""Coverage: split intervals by a sweep line, and statistics of stretches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators.bins import WIDTH, within
from lociflow.operators.running import following, running

BIN = 4096


def segments(intervals: DataFrame, keys: Sequence[str] = ("tid",), left: str = "pos", right: str = "rpos", bin_width: int = BIN, weight: Column | None = None) -> DataFrame:
    """keys, p, q, cov: the stretches between neighbouring ends of intervals that some cover, and how many do, or the sum of their weights (whole numbers above 0)."""
    by = F.lit(1) if weight is None else weight
    ends = intervals.select(*keys, F.explode(F.array(F.struct(F.col(left).alias("p"), by.alias("d")), F.struct(F.col(right).alias("p"), (-by).alias("d")))).alias("e"))
    points = ends.groupBy(*keys, F.col("e.p").alias("p")).agg(F.sum("e.d").cast("long").alias("d"))
    swept = running(points, keys, F.floor(F.col("p") / bin_width), ["p"], F.col("d"), "sum", "cov")
    return following(swept, keys, F.floor(F.col("p") / bin_width), ["p"], "p", "q").where("cov > 0 AND q IS NOT NULL").select(*keys, "p", "q", F.col("cov").cast("long").alias("cov"))


def stretch_stats(stretches: DataFrame, segs: DataFrame, keys: Sequence[str], left: str = "lpos", right: str = "rpos", bin_width: int = WIDTH) -> DataFrame:
    """stretches with max, area, covered, ave and dev of the segments wholly inside; gaps add nothing to the variance; without any, ave 0 and dev 1."""
    own = [*keys, left, right]
    inside = within(segs, F.col("p"), stretches.select(*own).distinct(), keys, left, right, bin_width).where(F.col("q") <= F.col(right))
    width = F.col("q") - F.col("p")
    sums = inside.groupBy(*own).agg(F.max("cov").alias("max"), F.sum(width * F.col("cov")).alias("area"), F.sum(width).alias("covered"), F.sum(width * F.col("cov") * F.col("cov")).alias("_squares"))
    length = (F.col(right) - F.col(left)).cast("double")
    ave = F.col("area") / length
    spread = (F.col("_squares") - 2 * ave * F.col("area") + ave * ave * F.col("covered")) / length
    known = sums.select(*own, "max", "area", "covered", ave.alias("ave"), F.when(F.col("area").isNotNull(), F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("dev"))
    return stretches.join(known, own, "left").fillna({"max": 0, "area": 0, "covered": 0, "ave": 0.0, "dev": 1.0})


def islands(segs: DataFrame, keys: Sequence[str] = ("tid",), gap: int = 0, left: str = "p", right: str = "q", bin_width: int = BIN) -> DataFrame:
    """keys, l, r: segments joined where at most `gap` lies between them."""
    bins = F.floor(F.col(left) / bin_width)
    reached = running(segs, keys, bins, [left, right], F.col(right), "max", "_reached", with_own=False)
    new = F.when(F.col("_reached").isNull() | (F.col(left) > F.col("_reached") + gap), 1).otherwise(0)
    cut = running(reached, keys, bins, [left, right], new, "sum", "_k")
    return cut.groupBy(*keys, "_k").agg(F.min(left).alias("l"), F.max(right).alias("r")).drop("_k")


def covering(points: DataFrame, segs: DataFrame, keys: Sequence[str], point: str = "x", bin_width: int = BIN) -> DataFrame:
    """points with cov, the coverage where they lie (0 outside segments): the last segment that starts at or before each, by one pass in bins of the order."""
    tagged = segs.select(*keys, F.col("p").alias("_at"), F.lit(0).alias("_point"), F.struct("q", "cov").alias("_seg")).unionByName(points.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_point")), allowMissingColumns=True)
    seg = F.when(F.col("_point") == 0, F.struct(F.col("_at").alias("p"), F.col("_seg.q").alias("q"), F.col("_seg.cov").alias("cov")))
    found = running(tagged, keys, F.floor(F.col("_at") / bin_width), ["_at", "_point"], seg, "max", "_last").where("_point = 1")
    return found.select(*keys, F.col("_at").alias(point), F.when(F.col("_at") < F.col("_last.q"), F.col("_last.cov")).otherwise(F.lit(0).cast("long")).alias("cov"))


def split(segs: DataFrame, points: DataFrame, keys: Sequence[str] = ("tid",), point: str = "x", bin_width: int = WIDTH) -> DataFrame:
    """segs cut at the points (keys, point) that lie strictly inside them: keys, p, q, cov."""
    cuts = within(points.select(*keys, point).distinct(), F.col(point), segs.select(*keys, "p", "q"), keys, "p", "q", bin_width).where(F.col(point) > F.col("p"))
    inner = cuts.groupBy(*keys, "p", "q").agg(F.array_sort(F.collect_list(point)).alias("_at"))
    ends = segs.join(inner, [*keys, "p", "q"], "left").withColumn("_at", F.coalesce("_at", F.array().cast(inner.schema["_at"].dataType)))
    parts = F.zip_with(F.concat(F.array("p"), "_at"), F.concat("_at", F.array("q")), lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    return ends.select(*keys, "cov", F.explode(parts).alias("e")).select(*keys, "e.p", "e.q", "cov")


def line_fit(segs: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """keys, slope, intercept of the least-squares line through the segments' middles."""
    middle = (F.col("p") + F.col("q")) / 2.0
    return segs.groupBy(*keys).agg(F.regr_slope(F.col("cov").cast("double"), middle).alias("slope"), F.regr_intercept(F.col("cov").cast("double"), middle).alias("intercept"))
