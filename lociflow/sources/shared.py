"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a local session gets a folder of this machine (tests, benches), a cluster an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def shuffled_unions(spark: SparkSession) -> None:
    """From now on what groups a union shuffles it first. Spark 4.1 takes a union of joins that are dealt alike for dealt like them, also where they no longer are once joins change at run time; then a group's rows lie in several tasks."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: How many bytes a byte of a compressed table is in memory, about: 5.7 million edges take 17 MB, three bytes each, and a broadcast of them 805 MB.
COMPRESSED = "16"


def true_sizes(spark: SparkSession) -> None:
    """From now on tables are judged by about their size in memory: by the size of their compressed files, Spark broadcasts tables of hundreds of MB through the driver."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", COMPRESSED)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a table in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes tables that written() returned, once all that needs them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
