"""False boundaries by fragments, graphs of reference transcripts and consensus by introns, against hand-made cases and brute force."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lociflow.operators import bridging, cleaning, fragments, graphs, transcripts
from lociflow.plans import boundary_queries
from lociflow.sources import gtf


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


#: v, l, r, ltype, rtype: the second ends (2) where the third starts (1) behind a gap.
EXONS = [(1, 1, 1, 0, 20, 1, 3), (1, 1, 2, 40, 60, 4, 2), (1, 1, 3, 80, 100, 1, 3), (1, 1, 4, 150, 190, 4, 2)]
FRAGMENTS = [
    (1, 1, 1, 5, 95, 2, 70, 50, 85, [(5, 20), (40, 95)]),  # passes the gap between 2 and 3
    (1, 1, 2, 5, 95, 2, 45, 50, 85, [(5, 20), (40, 95)]),  # as long by its bridge
    (1, 1, 3, 0, 55, 2, 99, 15, 45, [(0, 20), (40, 55)]),  # no boundary between its exons
    (1, 1, 4, 5, 70, 2, 99, 15, 45, [(5, 20), (40, 70)]),  # ends in no exon
    (1, 1, 5, 5, 18, 2, 99, 15, 10, [(5, 18)]),  # one exon
    (1, 1, 6, 5, 95, 1, 99, 55, 85, [(5, 20), (40, 95)]),  # of a fitting length
    (1, 1, 7, 5, 95, 2, 99, 55, 85, None),
    (1, 1, 8, 50, 95, 2, 36, 55, 82, [(50, 95)]),  # 25 on exons
]


@pytest.fixture(scope="module")
def lists(spark):
    exons = spark.createDataFrame(EXONS, "tid int, bid int, v int, l int, r int, ltype int, rtype int")
    frags = spark.createDataFrame(FRAGMENTS, "tid int, bid int, fid int, lpos int, rpos int, kind int, length int, e1 int, s2 int, blocks array<struct<l:int,r:int>>")
    frags = frags.withColumns({"m1": F.struct(F.col("e1").alias("rpos")), "m2": F.struct(F.col("s2").alias("pos"))})
    return fragments.exon_lists(frags, exons), exons


def test_exons_along_a_fragment(lists):
    got = {r.fid: (r.exons, r.on_exons) for r in lists[0].collect()}
    assert got == {1: ([1, 2, 3], 50), 2: ([1, 2, 3], 50), 3: ([1, 2], 35), 6: ([1, 2, 3], 50), 8: ([2, 3], 25)}


def test_votes_against_boundaries(lists):
    """Short: the first, and the last unless it is too short itself; the gap: all of no fitting length, of mates in different exons."""
    at = ["v", "n"]
    assert rows_of(fragments.short_votes(*lists, 40, 60), *at) == [(2, 2), (3, 2)]
    assert rows_of(fragments.short_votes(*lists, 60, 60), *at) == [(2, 1), (3, 1)]
    assert rows_of(fragments.short_votes(*lists, 40, 10), *at) == []
    assert rows_of(fragments.gap_votes(*lists), "side", *at) == [("end", 1, 1), ("end", 2, 3), ("start", 2, 1), ("start", 3, 3)]


def test_only_light_vertices_lose_a_boundary(spark):
    v = spark.createDataFrame([(1, 1, 4.0), (1, 2, 30.0), (1, 3, 4.0)], "g int, v int, w double")
    e = spark.createDataFrame([(1, 0, 1, "start"), (1, 1, 4, "end"), (1, 2, 4, "end"), (1, 1, 3, "junction")], "g int, s int, t int, kind string")
    votes = spark.createDataFrame([(1, x, 1) for x in (1, 2, 3)], "g int, v int, n int")
    assert math.log(5) - math.log(2) <= 1.5 < math.log(31) - math.log(2)
    assert rows_of(cleaning.false_boundaries(votes, v, e, ["g"]), "v", "side") == [(1, "end"), (1, "start")]
    assert rows_of(cleaning.false_boundaries(votes.withColumn("side", F.lit("end")), v, e, ["g"]), "v", "side") == [(1, "end")]
    assert cleaning.false_boundaries(votes.limit(0), v, e, ["g"]).isEmpty()


@pytest.mark.parametrize("bin_width", [16, 4096])
def test_annotation_graph_by_brute_force(spark, bin_width):
    r = random.Random(5)
    rows, want_v, want_e = [], set(), {}
    for g in range(12):
        depth, ways = {}, []
        for i in range(r.randint(1, 5)):
            ends, c = sorted(r.sample(range(0, 90), 2 * r.randint(1, 4))), r.choice([0.2, 1.0, 1.9, 3.5, 6.0])
            exons = list(zip(ends[::2], ends[1::2]))
            rows += [(g, i, a, b, c) for a, b in exons]
            ways.append((exons, max(int(c), 1)))
        cuts = {x for exons, _ in ways for e in exons for x in e}
        for exons, c in ways:
            for a, b in exons:
                for x in range(a, b):
                    depth[x] = depth.get(x, 0) + c
        starts = [x for x in sorted(depth) if x in cuts or x - 1 not in depth]
        parts = [(x, min(y for y in cuts if y > x)) for x in starts]
        want_v |= {(g, k + 1, a, b, float(depth[a])) for k, (a, b) in enumerate(parts)}
        for exons, c in ways:
            path = [k + 1 for k, (a, _) in enumerate(parts) if any(x <= a < y for x, y in exons)]
            for s, t in zip([0, *path], [*path, len(parts) + 1]):
                kind = "start" if s == 0 else "end" if t == len(parts) + 1 else "adjacent" if parts[s - 1][1] == parts[t - 1][0] else "junction"
                want_e[g, s, t, kind] = want_e.get((g, s, t, kind), 0) + c
    v, e = graphs.annotation_graph(spark.createDataFrame(rows, "g int, id int, l int, r int, coverage double"), ["g"], bin_width)
    assert rows_of(v, "g", "v", "l", "r", "w") == sorted(want_v)
    assert {tuple(x[:4]): x[4] for x in rows_of(e, "g", "s", "t", "kind", "w")} == want_e


def test_landmarks(spark):
    v = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 10, 20), (1, 3, 30, 40)], "g int, v int, l int, r int")
    e = spark.createDataFrame([(1, 0, 1, "start"), (1, 1, 2, "adjacent"), (1, 2, 3, "junction"), (1, 3, 4, "end")], "g int, s int, t int, kind string")
    own = graphs.landmarks(v, e, ["g"])
    assert rows_of(own, "kind", "l", "r") == [("end", 40, -1), ("junction", 20, 30), ("start", -1, 5)]
    assert rows_of(transcripts.compare(own, own.where("kind <> 'end'"), ["g", "kind", "l", "r"], ["kind"]), "kind", "tp", "fp", "fn") == [("end", 0, 0, 1), ("junction", 1, 0, 0), ("start", 1, 0, 0)]


def test_consensus_of_intron_chains(spark):
    """Chains agree whole: one that is the beginning of another is a different one; bounds widen and coverages add up over the number of runs."""
    a, b = (10, 20), (30, 40)
    rows = [("+", [a, b], 2.0, 0, 50), ("+", [a, b], 4.0, 3, 60), ("+", [a], 8.0, 0, 25), ("-", [a, b], 1.0, 0, 50), ("+", [], 5.0, 100, 200), ("+", [], 3.0, 110, 190), ("+", [], 3.0, 40_000, 40_100)]
    runs = spark.createDataFrame(rows, "strand string, introns array<struct<l:int,r:int>>, coverage double, start int, end int").withColumn("run", F.lit(1))
    got = transcripts.consensus(runs, ["strand"], least_multi=2, least_single=2, n_runs=10)
    assert rows_of(got.withColumn("n", F.size("introns")), "strand", "n", "cnt", "coverage", "start", "end") == [("+", 0, 2, 3.0, 100, 200), ("+", 2, 2, 0.6, 0, 60)]


def test_intron_consensus_holds_orders_without_introns(spark, tmp_path):
    """Orders without introns are merged by overlap beside the chains of the others, from five on, as the SQL says; four are too few, and another strand's are apart."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(4)
    lines = [(30 * k, 1, 100 + k % 2, 40) for k in range(1, 6)] + [(30 * k + 1, 1, 100, 40) for k in range(1, 5)] + [(30 * k, n, 1000 * n, 20) for k in range(10, 13) for n in (1, 2)]
    lines += [(1000 + k, n, r.randint(300, 420), r.randint(1, 30)) for k in range(150) for n in range(1, r.randint(2, 3))]
    rows = [(k, n, 7, k % 4 + 1, float(length), date(1995, 1, 1) + timedelta(at), "N") for k, n, at, length in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate date, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    query, sql = boundary_queries.QUERIES["intron_consensus"]
    names = ["strand", "chain", "cnt", "coverage", "start", "end"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(db.execute(sql).fetchall())
    got = rows_of(query(spark, str(tmp_path)), *names)
    assert got == want and (0, "", 5, 1.0, 100, 141) in got and sum(x[1] == "" for x in got) > 3
    assert any(x[1] and x[2] == 3 for x in got) and not [x for x in got if x[0] == 1 and x[4] == 100]


def one_by_one(rows, ratio):
    """The items of one key, from rows (run, start, end, coverage) taken in order."""
    items = []
    for _, s, e, c in sorted(rows, key=lambda x: x[:3]):
        for k, (a, b, n, d) in enumerate(items):
            over = min(b, e) - max(a, s)
            if over >= ratio * (b - a) or over >= ratio * (e - s):
                items[k] = (min(a, s), max(b, e), n + 1, min(c, d))
                break
            if (a, b) > (s, e):
                items.insert(k, (s, e, 1, c))
                break
        else:
            items.append((s, e, 1, c))
    return items


def test_single_exons_merge_by_overlap(spark):
    """Six of [100, 300) and six of [4000, 4500) are two transcripts; random ones agree with adding them one by one, with repeated rows and bins cut anywhere."""
    rows = [("a", k, s, e, 1.0) for k in range(6) for s, e in ((100, 300), (4000, 4500))]
    r = random.Random(7)
    for key in "bcdef":
        rows += [(key, r.randint(0, 4), s, s + r.randint(1, 40), float(r.randint(1, 9))) for s in (r.randint(0, 120) for _ in range(r.randint(1, 60)))]
    rows += rows[20:30]
    df = spark.createDataFrame(rows, "tid string, run int, start int, end int, coverage double").repartition(4)
    got = rows_of(transcripts.merged_singles(df, ["tid"], bin_width=16), "tid", "start", "end", "cnt", "coverage")
    want = sorted((key, *x) for key in "abcdef" for x in one_by_one([y[1:] for y in rows if y[0] == key], 0.9))
    assert got == want and [x[1:4] for x in got if x[0] == "a"] == [(100, 300, 6), (4000, 4500, 6)]
    assert transcripts.merged_singles(df.limit(0), ["tid"]).count() == 0


def test_phased_ways(spark):
    """A mate that the path doesn't hold whole, a second one before the first's end, and another key's path show nothing; equal ways count together."""
    paths = spark.createDataFrame([(1, [1, 2, 3, 5, 6]), (1, [0, 1, 2, 3, 5, 6, 9]), (1, [1, 2, 4, 5, 6]), (2, [1, 2, 7])], "k int, path array<int>")
    mates = spark.createDataFrame([(1, [1, 2], [5, 6]), (1, [1, 2, 3], [3, 5]), (1, [1, 3], [6]), (2, [1], [7]), (2, [1, 2], [9]), (1, [], [5])], "k int, v1 array<int>, v2 array<int>")
    got = {(r.k, tuple(r.v1), tuple(r.way)): r.cnt for r in bridging.phased(mates, paths, ["k"]).collect()}
    assert got == {(1, (1, 2), (1, 2, 3, 5, 6)): 2, (1, (1, 2), (1, 2, 4, 5, 6)): 1, (2, (1,), (1, 2, 7)): 1}


def test_linked_reads_keep_near_lengths(spark):
    rows = [(1, 0, 1, 500), (1, 0, 2, 900), (2, 1, 1, 500), (3, 1, 1, 79), (3, 1, 2, 80), (3, 1, 3, 240), (4, 0, 1, 90), (4, 0, 2, 110), (5, 1, 1, 241)]
    got = bridging.chosen_paths(spark.createDataFrame(rows, "fid int, type int, k int, length int"), ["fid"], 100, 100, 200, ["k"])
    assert rows_of(got, "fid", "k", "kind") == [(1, 1, 2), (3, 2, 2), (4, 1, 2)]


def test_full_length_transcripts_and_the_rest(spark, tmp_path):
    t = spark.createDataFrame([("c", "+", "g", f"t{i}", 1.0, [(0, 10), (20, 30)], full) for i, full in enumerate([True, False, None])], "seqname string, strand string, gene_id string, transcript_id string, coverage double, exons array<struct<l:int,r:int>>, full boolean")
    gtf.write_split_gtf(t, str(tmp_path / "full"), str(tmp_path / "rest"))
    ids = lambda name: rows_of(gtf.read_gtf(spark, str(tmp_path / name)), "transcript_id")
    assert ids("full") == [("t0",)] and ids("rest") == [("t1",), ("t2",)]


def test_layers_by_brute_force(spark):
    """Two edges between the same vertices are two paths; a vertex that nothing reaches has no row."""
    r = random.Random(3)
    rows, want = [(0, 1, 2, 1.0), (0, 1, 2, 4.0)], {(0, 1): (0, 0, 1, None), (0, 2): (1, 1, 2, 4.0)}
    for g in range(1, 15):
        n = r.randint(2, 8)
        e = [(s, t, float(r.randint(1, 9))) for s in range(n) for t in range(s + 1, n) if r.random() < 0.5]
        rows += [(g, *x) for x in e]
        found, at = {}, [(0, 0, None)]
        while at:
            v, k, x = at.pop()
            found.setdefault(v, []).append((k, x))
            at += [(t, k + 1, w if x is None else min(x, w)) for s, t, w in e if s == v]
        want |= {(g, v): (min(k for k, _ in f), max(k for k, _ in f), len(f), None if v == 0 else max(x for _, x in f)) for v, f in found.items()}
    starts = spark.createDataFrame([(g, 0 if g else 1) for g in range(15)], "g int, v int")
    got = graphs.layers(starts, spark.createDataFrame(rows, "g int, s int, t int, w double"), ["g"])
    assert {(x.g, x.v): (x.hops, x.depth, x.paths, x.widest) for x in got.collect()} == want


def test_the_number_of_paths_is_bounded(spark):
    e = [(1, k, k + 1, 1.0) for k in range(40) for _ in range(2)]
    got = graphs.layers(spark.createDataFrame([(1, 0)], "g int, v int"), spark.createDataFrame(e, "g int, s int, t int, w double"), ["g"])
    counts = {x.v: x.paths for x in got.collect()}
    assert counts[33] == 2**33 and counts[34] == counts[40] == graphs.MOST_PATHS


def test_components_become_graphs(spark):
    v = spark.createDataFrame([(1, x, 10 * x, 10 * x + 5, 1.0) for x in (1, 2, 3, 4)], "g int, v int, l int, r int, w double")
    e = spark.createDataFrame([(1, 0, 1, "start"), (1, 1, 3, "junction"), (1, 3, 5, "end"), (1, 0, 2, "start"), (1, 2, 5, "end"), (1, 0, 4, "start"), (1, 4, 5, "end")], "g int, s int, t int, kind string").withColumn("w", F.lit(1.0))
    labels = spark.createDataFrame([(1, 1, 1), (1, 3, 1)], "g int, v int, label int")
    own, parts = graphs.split_components(v, e, labels, ["g"])
    assert rows_of(own, "label", "v", "n") == [(1, 1, 1), (1, 3, 2), (2, 2, 1), (4, 4, 1)]
    assert rows_of(parts, "label", "s", "t", "kind") == [(1, 0, 1, "start"), (1, 1, 2, "junction"), (1, 2, 3, "end"), (2, 0, 1, "start"), (2, 1, 2, "end"), (4, 0, 1, "start"), (4, 1, 2, "end")]
