"""Operators against hand-made cases and brute force on small random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lociflow.operators import coverage, graphs, junctions, loci, mates, transcripts
from lociflow.operators.components import components
from lociflow.operators.running import running
from lociflow.streaming.loci import close_on_gap, flush_rows, stream_loci


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def random_rows():
    r = random.Random(5)
    return [(r.randint(0, 2), p := r.randint(0, 3000), p + r.randint(1, 60), i, 0, 0, r.choice("+-.")) for i in range(400)]


SCHEMA = "tid long, pos int, rpos int, qid int, ln int, hid int, xs string"


def test_gap_of_exactly_the_limit_stays(spark):
    df = spark.createDataFrame([(0, 0, 10, 0, 0, 0, "+"), (0, 110, 120, 1, 0, 0, "+"), (0, 221, 230, 2, 0, 0, "+")], SCHEMA)
    assert rows_of(loci.assign_loci(df, 100), "qid", "bid") == [(0, 1), (1, 1), (2, 2)]


@pytest.mark.parametrize("bin_width", [16, 4096])
def test_loci_by_brute_force(spark, random_rows, bin_width):
    got = rows_of(loci.loci(loci.assign_loci(spark.createDataFrame(random_rows, SCHEMA), 5, bin_width=bin_width), least=1), "tid", "lpos", "rpos", "n")
    want = []
    for tid in range(3):
        now = None
        for _, p, q, *_ in sorted(r for r in random_rows if r[0] == tid):
            if now and p <= now[1] + 5:
                now = [now[0], max(now[1], q), now[2] + 1]
            else:
                want += [(tid, *now)] if now else []
                now = [p, q, 1]
        want.append((tid, *now))
    assert got == sorted(want)


def test_running_sum_over_bins(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    got = rows_of(running(df, ["k"], F.floor(F.col("x") / 7), ["x"], F.col("x"), "sum", "s"), "x", "s")
    assert got == [(x, sum(y for y in range(x + 1) if y % 3 == x % 3)) for x in range(100)]


def test_coverage_area_is_the_intervals_length(spark, random_rows):
    df = spark.createDataFrame(random_rows, SCHEMA)
    segs = coverage.segments(df, bin_width=32)
    assert segs.agg(F.sum((F.col("q") - F.col("p")) * F.col("cov"))).first()[0] == sum(r[2] - r[1] for r in random_rows)
    depth = {}
    for tid, p, q, *_ in random_rows:
        for x in range(p, q):
            depth[tid, x] = depth.get((tid, x), 0) + 1
    assert all(depth[t, x] == c for t, p, q, c in rows_of(segs, "tid", "p", "q", "cov") for x in range(p, q))


def test_split_map_case(spark):
    df = spark.createDataFrame([(0, a, b) for a, b, n in ((6, 7, 3), (1, 3, 3), (1, 2, 1), (2, 5, 2)) for _ in range(n)], "tid int, pos int, rpos int")
    assert rows_of(coverage.segments(df), "p", "q", "cov") == [(1, 2, 4), (2, 3, 5), (3, 5, 2), (6, 7, 3)]


def test_stretch_without_segments(spark):
    s = coverage.stretch_stats(spark.createDataFrame([(0, 5, 9)], "tid int, lpos int, rpos int"), spark.createDataFrame([], "tid int, p int, q int, cov long"), ["tid"]).first()
    assert (s["max"], s["ave"], s["dev"]) == (0, 0.0, 1.0)


def test_junction_with_both_strands_has_none(spark):
    df = spark.createDataFrame([(0, 5, 9, "+"), (0, 5, 9, "-"), (0, 6, 9, "-")], "tid int, lpos int, rpos int, xs string")
    assert rows_of(junctions.junctions(df), "lpos", "cnt", "strand") == [(5, 2, "."), (6, 1, "-")]


def test_regions_tile_their_stretch(spark):
    b = spark.createDataFrame([(0, 1, 0, 100)], "tid int, bid int, lpos int, rpos int")
    cuts = spark.createDataFrame([(0, 1, 20, 50), (0, 1, 50, 70)], "tid int, bid int, lpos int, rpos int")
    assert rows_of(junctions.regions(b, cuts), "l", "r", "ltype", "rtype") == [(0, 20, 1, 3), (20, 50, 3, 3), (50, 70, 4, 4), (70, 100, 4, 2)]


def test_mates_pair_once(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "q string, x int")
    right = spark.createDataFrame([("a", 7)], "q string, x int")
    assert rows_of(mates.pair_mates(left, right, ["q"], ["x"], ["x"]), "q", "x", "mate_x") == [("a", 1, 7)]


def test_overlapping_mates_merge(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    r = spark.range(1).select(mates.merge_overlapping(a(1, 2, 3), a(2, 3, 4)).alias("y"), mates.merge_overlapping(a(1, 2, 3), a(9, 3, 4)).alias("n")).first()
    assert r.y == [1, 2, 3, 4] and r.n is None


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "label"))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_propagate_counts_and_widths(spark):
    e = spark.createDataFrame([("s", "a", 5), ("s", "b", 3), ("a", "t", 2), ("b", "t", 9)], "s string, t string, w long")
    one = spark.createDataFrame([("s", 1)], "v string, value long")
    assert dict(rows_of(graphs.propagate(one, e, 2, "count"), "v", "value"))["t"] == 2
    wide = one.withColumn("value", F.lit(99).cast("long"))
    assert dict(rows_of(graphs.propagate(wide, e, 2, "widest"), "v", "value"))["t"] == 3


def test_phased_path_is_reported():
    edges = {(0, 1): 9.0, (1, 2): 3.0, (1, 3): 6.0, (2, 4): 3.0, (3, 4): 6.0, (4, 5): 9.0}
    paths = graphs.peel(dict(edges), [[1, 2, 4]], 5, 1.5)
    assert paths == [([0, 1, 2, 4, 5], 3.0), ([0, 1, 3, 4, 5], 6.0)]


def test_paths_are_walks_and_within_the_outflow():
    r = random.Random(8)
    for _ in range(50):
        n = r.randint(3, 9)
        edges = {(s, t): float(r.randint(1, 20)) for s in range(n) for t in range(s + 1, n + 1) if r.random() < 0.5 and (s, t) != (0, n)}
        left = dict(edges)
        paths = graphs.peel(left, [], n, 1.5)
        for path, w in paths:
            assert path[0] == 0 and path[-1] == n and all(step in edges for step in zip(path, path[1:])) and w >= 1.5
        assert sum(w for _, w in paths) <= sum(w for (s, _), w in edges.items() if s == 0)


def test_decompose_does_not_depend_on_row_order(spark):
    rows = [(1, s, t, w) for (s, t), w in {(0, 1): 9.0, (1, 2): 3.0, (1, 3): 6.0, (2, 4): 3.0, (3, 4): 6.0, (4, 5): 9.0}.items()]
    kinds = "g int, s int, t int, w double"
    ph = spark.createDataFrame([(1, [1, 2, 4], 3)], "g int, path array<int>, cnt long")
    a, b = (graphs.decompose(spark.createDataFrame(x, kinds), ["g"], ph).collect() for x in (rows, rows[::-1]))
    assert a == b and a[0].path == [0, 1, 2, 4, 5]


def test_linked_paths_by_brute_force(spark):
    r = random.Random(11)
    exons, pairs = [], []
    for bid in (1, 2):
        at = 0
        for v in range(1, 9):
            at += r.choice((0, 0, 40))
            exons.append((0, bid, v, at, at := at + r.randint(8, 60)))
        for _ in range(300):
            a = r.randint(0, at)
            b = a + r.randint(1, 120)
            c = b + r.randint(1, 100)
            pairs += [(0, bid, a, b, c, c + r.randint(1, 120))] * r.randint(1, 2)
    of = {bid: [(v, x, y) for _, k, v, x, y in exons if k == bid] for bid in (1, 2)}

    def ends(bid, a, b):
        first = [v + (a - x > 3 and y - a < 3) for v, x, y in of[bid] if x <= a < y]
        last = [v - (y - b > 3 and b - x <= 3) for v, x, y in of[bid] if x <= b - 1 < y]
        return (first[0], last[0]) if first and last and first[0] <= 8 and last[0] >= 1 else None

    want = {}
    for _, bid, a, b, c, e in pairs:
        if (x := ends(bid, a, b)) and (y := ends(bid, c, e)) and x[0] <= x[1] < y[0] <= y[1]:
            path = (*range(x[0], x[1] + 1), *range(y[0], y[1] + 1))
            if len(path) >= 3:
                want[bid, path] = want.get((bid, path), 0) + 1
    made = junctions.linked_paths(spark.createDataFrame(pairs, "tid int, bid int, pos int, rpos int, next_pos int, next_rpos int"), spark.createDataFrame(exons, "tid int, bid int, v int, l int, r int"), bin_width=64)
    assert len(want) > 10 and {(x.bid, tuple(x.path)): x.cnt for x in made.collect()} == want


def test_phased_lists_come_before_wider_paths(spark):
    edges = [(1, 0, 1, 9.0), (1, 1, 2, 3.0), (1, 1, 3, 6.0), (1, 2, 4, 3.0), (1, 3, 4, 6.0), (1, 4, 5, 9.0)]
    frame = spark.createDataFrame(edges, "g int, s int, t int, w double")
    seen = spark.createDataFrame([(1, [1, 2, 4], 3), (2, [1, 2, 3], 1)], "g int, path array<int>, cnt long")
    paths = lambda ph: [tuple(x.path) for x in graphs.decompose(frame, ["g"], ph).orderBy("k").collect()]
    assert paths(None) == [(0, 1, 3, 4, 5), (0, 1, 2, 4, 5)] and paths(seen) == [(0, 1, 2, 4, 5), (0, 1, 3, 4, 5)]


def test_a_low_middle_splits_its_region(spark):
    regs = spark.createDataFrame([(1, 1, 0, 200), (1, 2, 300, 500), (1, 3, 600, 690), (1, 4, 700, 900), (1, 5, 1000, 1200)], "tid int, bid int, l int, r int")
    cov = [(0, 60, 20), (60, 80, 1), (90, 150, 30), (150, 190, 2), (300, 400, 20), (400, 420, 2), (420, 500, 20), (600, 640, 20), (650, 690, 20), (710, 800, 20), (820, 900, 20), (1000, 1030, 20), (1100, 1200, 20)]
    segs = spark.createDataFrame([(1, *x) for x in cov], "tid int, p int, q int, cov int")
    got = rows_of(junctions.low_middles(regs, segs, bin_width=64), "bid", "left", "right", "left_ave", "right_ave")
    # 2 is covered throughout, 3 too short, 4 not covered at its start, 5 left of its gap too short
    assert got == [(1, 60, 90, 20.0, (60 * 30 + 40 * 2) / 110)]


def test_length_filter_of_two_exons(spark):
    ok = transcripts.long_and_covered(F.lit(2), F.col("length"), F.lit(2.0))
    df = spark.createDataFrame([(249,), (250,)], "length int")
    assert [r[0] for r in df.orderBy("length").select(ok).collect()] == [False, True]


def test_nested_by_brute_force(spark):
    r = random.Random(3)
    introns = [(i, 0, p := r.randint(0, 900), p + r.randint(2, 300), float(r.randint(1, 5))) for i in range(60)]
    inner = [(0, p := r.randint(0, 1000), p + r.randint(1, 40), float(r.randint(1, 5))) for _ in range(60)]
    got = rows_of(transcripts.nested(spark.createDataFrame(inner, "tid int, l int, r int, cov double"), spark.createDataFrame(introns, "id int, tid int, l int, r int, cov double"), ["tid"], bin_width=64), "id")
    assert got == sorted((i,) for i, _, a, b, c in introns if any(l > a and x < b and v >= c for _, l, x, v in inner))


def test_stream_equals_batch(spark, random_rows, tmp_path):
    rows = spark.createDataFrame([r for r in random_rows], SCHEMA).select("tid", "xs", "pos", "rpos")
    source = str(tmp_path / "in")
    for k, part in enumerate((rows.where("pos < 1500"), rows.where("pos >= 1500"), flush_rows(rows))):
        part.coalesce(1).write.mode("append").parquet(f"{source}/part={k}")
    stream = stream_loci(spark.readStream.schema("tid long, xs string, pos int, rpos int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/part=*"), gap=5)
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = rows_of(spark.table("closed").where("NOT late"), "tid", "xs", "lpos", "rpos", "n")
    batch = loci.loci(loci.assign_loci(rows, 5, ["tid", "xs"], ["pos", "rpos"]), ["tid", "xs"], least=1)
    assert got == rows_of(batch, "tid", "xs", "lpos", "rpos", "n")


def test_late_rows_are_told():
    import pandas as pd

    class State:
        exists, get = True, (100, 120, 2)

        def update(self, x):
            self.now = x

    state = State()
    out = pd.concat(close_on_gap(5)((1, "+"), iter([pd.DataFrame({"pos": [50, 200], "rpos": [60, 210]})]), state))
    assert out.values.tolist() == [[1, "+", 50, 60, 1, True], [1, "+", 100, 120, 2, False]] and state.now == (200, 210, 1)


def test_bridges_by_brute_force(spark):
    from lociflow.operators import bridging

    r = random.Random(12)
    edges = {(s, t): float(r.randint(1, 9)) for s in range(8) for t in range(s + 1, 8) if r.random() < 0.6}
    length = {v: r.randint(1, 50) for v in range(8)}

    def walk(path):
        if path[-1] == 7:
            yield path
        for s, t in edges:
            if s == path[-1] and t <= 7:
                yield from walk([*path, t])

    scored = sorted(((sorted([*(edges[e] for e in zip(p, p[1:])), *[bridging.UNLIMITED] * 5])[:5], sum(length[v] for v in p), p) for p in walk([0])), key=lambda x: ([-y for y in x[0]], x[1], x[2]))[:10]
    one = spark.createDataFrame([(1, 0, 7)], "g int, s int, t int")
    e = spark.createDataFrame([(1, s, t, w) for (s, t), w in edges.items()], "g int, s int, t int, w double")
    v = spark.createDataFrame([(1, k, n) for k, n in length.items()], "g int, v int, length int")
    got = bridging.widest_bridges(one, e, v, 7, ["g"]).orderBy("rank").collect()
    assert [(list(x.stack), x.length, list(x.path)) for x in got] == scored
    fragments = spark.createDataFrame([(1, 0, 7, k, 0) for k in range(3)], "g int, s int, t int, fragment int, extra int")
    won = bridging.vote(bridging.widest_bridges(one, e, v, 7, ["g"]), fragments, ["g", "s", "t"], scored[1][1], scored[1][1]).first()
    assert won.votes == 3 and won.rank <= 2
    nobody = bridging.vote(bridging.widest_bridges(one, e, v, 7, ["g"]), fragments, ["g", "s", "t"], -9, -8).first()
    assert (nobody.rank, nobody.votes) == (1, 0)


def test_bridges_of_long_loci_are_whole(spark, monkeypatch):
    from lociflow.plans import graph_queries

    exons = [(1, b, v, 10 * v, 10 * v + 5) for b in (1, 2) for v in range(1, 13)]
    ways = [(1, b, v, v + 1, 9.0, "adjacent") for b in (1, 2) for v in range(1, 12)] + [(1, 2, 1, 12, 2.0, "junction"), (1, 2, 1, 13, 99.0, "end")]
    graph = spark.createDataFrame(exons, "tid int, bid int, v int, l int, r int"), spark.createDataFrame(ways, "tid int, bid int, s int, t int, w double, kind string")
    monkeypatch.setattr(graph_queries, "_graph", lambda s, d: graph)
    whole = ">".join(map(str, range(1, 13)))
    got = [tuple(x) for x in graph_queries.bridge_paths(spark, "").orderBy("bid", "rank").collect()]
    assert got == [(1, 1, 1, whole, 60), (1, 2, 1, whole, 60), (1, 2, 2, "1>12", 10)]


def test_disconnected_vertices(spark):
    e = spark.createDataFrame([("s", "a", 1), ("a", "t", 1), ("s", "b", 1), ("c", "t", 1)], "s string, t string, w int")
    v = spark.createDataFrame([(x,) for x in "sabct"], "v string")
    assert rows_of(graphs.disconnected(e, v, 3, "s", "t"), "v") == [("b",), ("c",)]


def test_random_dag_is_seeded(spark):
    a, b = (rows_of(graphs.random_dag(spark, 20, 60, 5), "s", "t", "w") for _ in range(2))
    assert a == b and all(s < t for s, t, _ in a)
