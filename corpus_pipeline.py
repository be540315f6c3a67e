"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from lociflow.sources.shared import written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of `like`, n_chars counted anew."""
    return df.select([F.length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in like.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is not above their language's threshold."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than a tenth of their source's texts have."""
    return _as_documents(line_dedup.drop_boilerplate_lines(docs, ratio=0.1, min_pages=20, counts=False), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard_join.one_of_each(docs, shingle=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no copy of a benchmark item, with or without an id: texts go by their hash."""
    key = F.md5(F.col("text")).alias("key")
    leaks = decontaminate.find_leaks(docs.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key)
    return rows.join(leaks.select("key").distinct(), "key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_boilerplate), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("best-fit packing", pack)]

#: SQL can't express perplexities, components, alignments or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder, the last one's is returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
