"""Alignment-shaped projections of generic tables: input for the operators where no alignment file is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.sources.shared import shuffled_unions, true_sizes

#: A total order of alignments within a reference sequence.
ORDER = ["pos", "rpos", "qid", "ln", "hid"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shuffled_unions(spark)
    true_sizes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as alignments: tid, pos, rpos (half-open), qid, ln, hid, xs (strand)."""
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date"))
    strand = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(".")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("tid"), day.cast("int").alias("pos"), (day + F.col("l_quantity")).cast("int").alias("rpos"), F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("hid"), strand.alias("xs")
    )


ALN_SQL = """aln AS (SELECT l_partkey AS tid, CAST(d AS INT) AS pos, CAST(d + l_quantity AS INT) AS rpos, l_orderkey AS qid, l_linenumber AS ln, l_suppkey AS hid,
  CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '.' END AS xs
  FROM (SELECT *, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem))"""
