"""What only larger tables show: joins that change at run time, ties, and what a round or a task holds."""

import pytest
from pyspark.sql import functions as F

from lociflow.operators import bridging, cleaning, mates
from lociflow.plans import catalog
from lociflow.sources.shared import true_sizes, written


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with 6,000 lines of 200 parts."""
    drawn = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    rows = spark.range(0, 6000, 1, 2).select(
        drawn(1, 1500).alias("l_orderkey"), drawn(2, 200).alias("l_partkey"), drawn(3, 50).alias("l_suppkey"), (drawn(4, 7) + 1).cast("int").alias("l_linenumber"), (drawn(5, 50) + 1).cast("double").alias("l_quantity"),
        F.element_at(F.array(*map(F.lit, "ARN")), (drawn(6, 3) + 1).cast("int")).alias("l_returnflag"), F.date_add(F.lit("1995-01-02").cast("date"), drawn(7, 2400).cast("int")).cast("timestamp").alias("l_shipdate"),
    )
    d = str(tmp_path_factory.mktemp("lines"))
    rows.write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["spliced_region_list", "spliced_fragments"])
def test_lists_are_whole_whatever_the_joins(spark, lines, name):
    """Regions are broadcast, alignments aren't, as on larger tables: the union of block ends used to be grouped without a shuffle."""
    known, got = "spark.sql.autoBroadcastJoinThreshold", {}
    before = spark.conf.get(known)
    try:
        for most in ("10m", "30k"):
            spark.conf.set(known, most)
            got[most] = sorted(map(tuple, catalog.queries()[name](spark, lines).collect()))
    finally:
        spark.conf.set(known, before)
    assert got["10m"] == got["30k"] and len(got["10m"]) > 100


def candidates(spark):
    """Two candidates of a key as far from the target on either side and equal in what orders them, in both orders of rows."""
    rows = [(k, 1, 2, n) for k in range(4) for n in ((50, 70) if k % 2 else (70, 50))]
    return spark.createDataFrame(rows, "qid int, ln int, mate_ln int, length int").coalesce(1)


def test_nearest_of_equal_candidates_is_the_shortest(spark):
    got = mates.best_by_distance(candidates(spark), ["qid"], "length", F.lit(60), ["ln", "mate_ln"]).collect()
    assert sorted((r.qid, r.length) for r in got) == [(k, 50) for k in range(4)]


def test_chosen_of_equal_paths_is_the_shortest(spark):
    got = bridging.chosen_paths(candidates(spark).withColumn("type", F.lit(0)), ["qid"], 20, 60, 90, ["ln", "mate_ln"]).collect()
    assert sorted((r.qid, r.length, r.kind) for r in got) == [(k, 50, 1) for k in range(4)]


@pytest.mark.parametrize("name", ["inner_boundaries", "cleaned_graph"])
def test_compressed_tables_are_not_broadcast(spark, name):
    """250,000 loci of five vertices: their edges are a table of less than 10 MB, but of more in memory."""
    true_sizes(spark)
    kinds = F.array(*map(F.lit, ["start", "junction", "adjacent", "junction", "adjacent", "end"]))
    steps = spark.range(0, 250000, 1, 2).select(F.xxhash64("id").alias("tid"), F.lit(1).alias("bid"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s"))
    e = written(steps.select("*", (F.col("s") + 1).alias("t"), (F.pmod(F.xxhash64("tid", "s"), F.lit(1000)) / 8).alias("w"), F.element_at(kinds, F.col("s") + 1).alias("kind")), "edges")
    v = written(e.where("s > 0").select("tid", "bid", F.col("s").alias("v"), (10 * F.col("s")).alias("l"), (10 * F.col("s") + 10).alias("r"), F.lit(2.0).alias("w"), F.lit(0.5).alias("dev")), "vertices")
    sinks = v.groupBy("tid", "bid").agg((F.max("v") + 1).alias("sink"))
    out = {"inner_boundaries": lambda: cleaning.inner_boundaries(v, e, sinks, ["tid", "bid"], flat=0.6), "cleaned_graph": lambda: cleaning.rule_actions(v, e, sinks, ["tid", "bid"], 20, 2.0, 0.01)}[name]()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
