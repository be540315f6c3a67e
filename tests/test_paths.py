"""Paths between all vertices by doubling, and vertices on every path, against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lociflow.operators import graphs


def made_graphs():
    r = random.Random(21)
    edges = []
    for g in range(12):
        n = r.randint(3, 9)
        edges += [(g, s, t, float(r.randint(1, 9))) for s in range(n) for t in range(s + 1, n) for _ in range(r.choice([0, 0, 1, 1, 2]))]
    return edges


def walks(edges):
    """All paths: (g, s, t) to a list of (vertices, smallest weight)."""
    out, onward = defaultdict(list), defaultdict(list)
    for g, s, t, w in edges:
        onward[g, s].append((t, w))
    todo = [(g, s, (s, t), w) for g, s, t, w in edges]
    while todo:
        g, s, path, w = todo.pop()
        out[g, s, path[-1]].append((path, w))
        todo += [(g, s, (*path, t), min(w, x)) for t, x in onward[g, path[-1]]]
    return out


def test_pairs_and_unavoidable_vertices_by_brute_force(spark):
    edges = made_graphs()
    want = walks(edges)
    pairs = graphs.all_paths(spark.createDataFrame(edges, "g int, s int, t int, w double").repartition(3), ["g"])
    got = {(r.g, r.s, r.t): (r.hops, r.depth, r.paths, r.widest) for r in pairs.collect()}
    assert got == {k: (min(len(p) for p, _ in v) - 1, max(len(p) for p, _ in v) - 1, len(v), max(w for _, w in v)) for k, v in want.items()}
    ends = spark.createDataFrame([k for k in want if k[0] % 2], "g int, s int, t int")
    told = {tuple(r) for r in graphs.on_every_path(pairs, ends, ["g"]).collect()}
    assert told == {(*k, v) for k, paths in want.items() if k[0] % 2 for v in set.intersection(*(set(p[1:-1]) for p, _ in paths))} and told
    assert graphs.all_paths(spark.createDataFrame([], "g int, s int, t int, w double"), ["g"]).count() == 0


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    """2,000 vertices in a row: 12 rounds or fewer, beside a small graph that ends early; numbers of paths stop at the most."""
    rounds, keep = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, name: (rounds.append(name), keep(df, name))[1])
    chain = spark.range(1999).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("s"), (F.col("id") + 1).cast("int").alias("t"), F.lit(1.0).alias("w"))
    twice = spark.range(60).select(F.lit(2).alias("g"), F.col("id").cast("int").alias("s"), (F.col("id") + 1).cast("int").alias("t"), F.lit(2.0).alias("w"))
    starts = spark.createDataFrame([(1, 0), (2, 0)], "g int, v int")
    got = {(r.g, r.v): r for r in graphs.layers(starts, chain.unionByName(twice).unionByName(twice), ["g"]).where("v IN (0, 30, 60, 1999)").collect()}
    assert rounds.count("longer") <= 12
    assert got[1, 1999].hops == got[1, 1999].depth == 1999 and got[1, 1999].paths == 1 and got[2, 30].paths == 2**30 and got[2, 60].paths == graphs.MOST_PATHS and got[2, 0].widest is None
