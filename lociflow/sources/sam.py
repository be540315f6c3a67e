"""SAM text as alignment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import alignments as A


def _tag(name: str, kinds: str):
    value = F.regexp_extract("value", rf"\t{name}:[{kinds}]:([^\t]*)", 1)
    return F.when(value != "", value)


def headers(lines: DataFrame) -> DataFrame:
    """tid, chrm, length from the @SQ lines. Line order gives the numbers, by file and place within it."""
    from pyspark.sql import Window

    sq = lines.where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrm"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"), F.monotonically_increasing_id().alias("_i"))
    return sq.select((F.row_number().over(Window.orderBy("_i")) - 1).alias("tid"), "chrm", "length")  # a row for each reference sequence


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of SAM files: fields, tags, and what their CIGARs say.

    chrm, pos (0-based), rpos, qname, flag, mapq, cigar, n_cigar, qlen, mchrm, mpos, isize, tags, matches, insertions, deletions, splices, xs.
    """
    return parse_sam(spark.read.text(path))


def parse_sam(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11)).select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("chrm"), (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("mchrm"), (f[7].cast("int") - 1).alias("mpos"), f[8].cast("int").alias("isize"),
        F.struct(_tag("ts", "A").alias("ts"), _tag("XS", "A").alias("XS"), _tag("HI", "cCsSiI").cast("int").alias("HI"), _tag("NH", "cCsSiI").cast("int").alias("NH"), F.coalesce(_tag("NM", "cCsSiI"), _tag("nM", "cCsSiI"), F.lit("0")).cast("int").alias("nm"), _tag("UB", "ZH").alias("UB")).alias("tags"),
    )
    return with_alignment(rows)


def with_alignment(rows: DataFrame) -> DataFrame:
    """Fields and tags of alignments, with what their CIGARs (as text) say."""
    rows = rows.withColumn("cigar", A.cigar(F.col("cigar")))
    rows = rows.withColumns({"n_cigar": F.size("cigar"), "rpos": F.col("pos") + A.reference_length(F.col("cigar")), "qlen": A.query_length(F.col("cigar")), "_at": A.placed(F.col("pos"), F.col("cigar"))})
    at = F.col("_at")
    rows = rows.withColumns({"matches": A.match_intervals(at), "insertions": A.insertion_intervals(at), "deletions": A.deletion_intervals(at), "splices": A.splices(at), "xs": A.transcript_strand(F.col("tags.XS"), F.col("tags.ts"), F.col("flag"))})
    return rows.drop("_at")
