"""Loci: grouping alignments by gaps, their strands, and where alignments go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators.bins import within
from lociflow.operators.running import following, running
from lociflow.sources.tables import ORDER

BIN = 4096


def mate_extended(pos: str = "pos", rpos: str = "rpos", mpos: str = "mpos", reach: int = 100_000) -> Column:
    """An alignment's right end, drawn out to its mate's start where that lies at most `reach` behind it."""
    return F.greatest(F.col(rpos), F.when((F.col(mpos) > F.col(rpos)) & (F.col(mpos) <= F.col(rpos) + reach), F.col(mpos)))


def assign_loci(aln: DataFrame, gap: int = 100, keys: Sequence[str] = ("tid",), order: Sequence[str] = ORDER, end: str = "rpos", bin_width: int = BIN) -> DataFrame:
    """aln with bid: numbers, from 1 within keys, of the loci. A row starts a new one if it lies more than `gap` behind all before it."""
    bins = F.floor(F.col(order[0]) / bin_width)
    reached = running(aln, keys, bins, order, F.col(end), "max", "_reached", with_own=False)
    new = F.when(F.col("_reached").isNull() | (F.col(order[0]) > F.col("_reached") + gap), 1).otherwise(0)
    return running(reached, keys, bins, order, new, "sum", "bid").drop("_reached")


def loci(assigned: DataFrame, keys: Sequence[str] = ("tid",), end: str = "rpos", least: int = 5) -> DataFrame:
    """Bounds and number of alignments of each locus with `least` of them: keys, bid, lpos, rpos, n."""
    return assigned.groupBy(*keys, "bid").agg(F.min("pos").alias("lpos"), F.max(end).alias("rpos"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def locus_strand(assigned: DataFrame, keys: Sequence[str] = ("tid",)) -> DataFrame:
    """Each locus's strand by majority of its alignments' strands: keys, bid, strand ('.' on a tie)."""
    votes = assigned.groupBy(*keys, "bid").agg(F.count_if(F.col("xs") == "+").alias("p"), F.count_if(F.col("xs") == "-").alias("q"))
    return votes.select(*keys, "bid", F.when(F.col("p") > F.col("q"), "+").when(F.col("p") < F.col("q"), "-").otherwise(".").alias("strand"))


def next_block(aln: DataFrame, order: Sequence[str] = ORDER, bin_width: int = BIN) -> DataFrame:
    """aln with nxt: where the next alignment of its sequence and strand starts, if that leaves an intron behind this one, else null."""
    after = following(aln, ["tid", "xs"], F.floor(F.col(order[0]) / bin_width), order, "pos", "nxt")
    return after.withColumn("nxt", F.when(F.col("nxt") > F.col("rpos"), F.col("nxt")))


def route_strands(aln: DataFrame, strand: str = "xs", spliced: str = "spliced") -> DataFrame:
    """aln with stream: rows of a strand go to its stream, unspliced ones without a strand to both, spliced ones without a strand to none."""
    to = F.when(F.col(strand) != ".", F.array(strand)).when(~F.col(spliced), F.array(F.lit("+"), F.lit("-"))).otherwise(F.array().cast("array<string>"))
    return aln.withColumn("stream", F.explode(to))


def settled_strand(strand: Column, xs: Column) -> Column:
    """The strand of a stranded library's row: the flags' one, where they show none the tag's; null (not admitted) where both are known and differ."""
    return F.when((strand != ".") & (xs != ".") & (strand != xs), None).when(strand == ".", xs).otherwise(strand)


def touching_coverage(hits: DataFrame, segs: DataFrame, keys: Sequence[str] = ("tid",), bin_width: int = BIN) -> DataFrame:
    """hits (keys, pos, rpos) with inside: whether one of their ends lies in a covered segment (keys, p, q)."""
    rows = hits.withColumn("_row", F.struct(*hits.columns))
    ends = rows.select(*keys, "_row", F.explode(F.array(F.col("pos"), F.col("rpos") - 1)).alias("_x"))
    held = within(ends, F.col("_x"), segs.select(*keys, "p", "q"), keys, "p", "q", bin_width).select("_row").distinct()
    return rows.join(held.withColumn("_in", F.lit(True)), "_row", "left").select(*hits.columns, F.coalesce("_in", F.lit(False)).alias("inside"))


def admission(tid: str = "tid", flag: str = "flag", n_cigar: str = "n_cigar", mapq: str = "mapq", nh: str = "nh", max_cigar: int = 1000, min_mapq: int = 1, secondary: bool = False, unique: bool = False) -> Column:
    """Why a row is not admitted: the first reason that holds, or 'admitted'."""
    reason = F.when(F.col(tid) < 0, "no sequence").when(F.col(flag).bitwiseAND(0x4) > 0, "unmapped")
    if not secondary:
        reason = reason.when(F.col(flag).bitwiseAND(0x100) > 0, "secondary")
    reason = reason.when((F.col(n_cigar) < 1) | (F.col(n_cigar) > max_cigar), "cigar").when(F.col(mapq) < min_mapq, "mapping quality")
    if unique:
        reason = reason.when(F.col(nh) != 1, "not unique")
    return reason.otherwise("admitted")
