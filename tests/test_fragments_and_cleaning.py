"""Fragments from mates to coverage, exon kinds, lookups and rounds of cleaning, against hand-made cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lociflow.operators import bins, cleaning, coverage, fragments, graphs, junctions, loci
from lociflow.operators.running import look_back


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


REGIONS = [(1, 1, 0, 0, 10), (1, 1, 1, 10, 20), (1, 1, 2, 40, 50), (1, 1, 3, 50, 60), (1, 1, 4, 90, 120)]


@pytest.fixture(scope="module")
def bridged(spark):
    regs = spark.createDataFrame(REGIONS, "tid int, bid int, rid int, l int, r int")
    hits = spark.createDataFrame(
        [(1, 1, 2, 15, 1, 1, 0, "+", 1, 0, 1), (1, 1, 52, 100, 1, 2, 0, "+", 0, 3, 4), (1, 1, 5, 18, 2, 1, 0, "-", 2, 0, 1), (1, 1, 12, 45, 2, 2, 0, "-", 0, 1, 2), (1, 1, 3, 9, 3, 1, 0, ".", 0, 0, 0), (1, 1, 110, 119, 3, 2, 0, ".", 0, 4, 4)],
        "tid int, bid int, pos int, rpos int, qid int, ln int, hid int, xs string, nm int, first_rid int, last_rid int",
    )
    own = fragments.with_offsets(hits, regs)
    mate = F.struct("pos", "rpos", "qid", "ln", "hid", "xs", "nm", "kl", "kr", "outer_l", "outer_r", "v", "size")
    pairs = own.where("ln = 1").select("tid", "bid", "qid", mate.alias("m1")).join(own.where("ln = 2").select("tid", "bid", "qid", mate.alias("m2")), ["tid", "bid", "qid"])
    frags = fragments.fragments(pairs).withColumns({"fid": F.col("qid"), "type": F.lit(0)})
    ways = spark.createDataFrame([(1, 1, 0, 1, 5), (1, 1, 1, 2, 7), (1, 1, 2, 3, 4), (1, 1, 3, 4, 6), (1, 1, 0, 4, 1)], "tid int, bid int, s int, t int, w int")
    return frags, fragments.bridged(frags, regs, ways, 40, 75, ["tid", "bid"]), hits


def test_offsets_and_shortenable_mates(bridged):
    frags = bridged[0]
    assert rows_of(frags, "qid", "k1l", "k1r", "k2l", "k2r", "b1", "b2") == [(1, 2, 5, 2, 20, True, True), (2, 5, 2, 2, 5, True, True), (3, 3, 1, 20, 1, False, False)]
    assert rows_of(fragments.grouped(frags.unionByName(frags)), "k1l", "cnt", "lpos", "rpos") == [(2, 2, 2, 100), (3, 2, 3, 119), (5, 2, 5, 45)]


def test_bridges_make_blocks(bridged):
    """The first is bridged over region 2, the second's mates overlap, the third's way is too long."""
    got = {r.qid: r for r in bridged[1].collect()}
    assert list(got[1].path) == [0, 1, 2, 3, 4] and got[1].length == 70 - 2 - 20 and got[1].kind == 1
    assert [tuple(b) for b in got[1].splices] == [(20, 40), (60, 90)] and [tuple(b) for b in got[1].blocks] == [(2, 20), (40, 60), (90, 100)]
    assert list(got[2].path) == [0, 1, 2] and got[2].length == 30 - 5 - 5 and got[2].kind == 2 and [tuple(b) for b in got[2].blocks] == [(5, 20), (40, 45)]
    assert list(got[3].path) == [0, 1, 2, 3, 4] and got[3].kind == 1 and got[3].length == 70 - 3 - 1
    assert rows_of(fragments.bridge_counts(bridged[1]), "type", "n", "bridged", "in_range") == [(0, 3, 3, 2)]


def test_bridged_coverage_and_junctions(bridged):
    _, out, hits = bridged
    alone = hits.where("qid = 2").withColumnsRenamed({"pos": "a", "rpos": "b"})
    segs = coverage.segments(fragments.blocks_of(out, hits.where("qid = 2").select("tid", "pos", "rpos")))
    depth = {}
    for l, r in [(2, 20), (40, 60), (90, 100), (3, 20), (40, 60), (90, 119), (5, 18), (12, 45)]:
        for x in range(l, r):
            depth[x] = depth.get(x, 0) + 1
    assert {x: c for p, q, c in rows_of(segs, "p", "q", "cov") for x in range(p, q)} == depth
    introns = fragments.introns_of(out, alone.select("tid", F.col("a").alias("lpos"), F.col("b").alias("rpos"), "xs", "nm").where("a = 12"))
    assert rows_of(junctions.junctions(introns), "lpos", "rpos", "cnt", "nm", "strand") == [(12, 45, 1, 0, "-"), (20, 40, 2, 1, "+"), (60, 90, 2, 1, "+")]


def test_stubs_stand_at_uncovered_splices(spark):
    regs = spark.createDataFrame([(1, 1, 0, 100, 4, 3), (1, 1, 200, 300, 4, 3), (1, 1, 400, 500, 1, 3), (1, 1, 600, 700, 4, 2)], "tid int, bid int, l int, r int, ltype int, rtype int")
    segs = spark.createDataFrame([(1, 20, 80, 5), (1, 200, 300, 2), (1, 400, 402, 1), (1, 601, 605, 1)], "tid int, p int, q int, cov long")
    got = rows_of(junctions.typed_exons(regs, segs), "l", "r", "ltype", "rtype", "w", "empty", "stub")
    assert got == [(0, 1, 4, 2, 0.01, False, True), (20, 80, 1, 2, 5.0, False, False), (99, 100, 1, 3, 0.01, False, True), (200, 300, 4, 3, 2.0, False, False), (400, 402, 1, 2, 1.0, True, False), (499, 500, 1, 3, 0.01, False, True), (600, 605, 4, 2, 0.8, False, False)]


def test_one_sequence_with_all_rows(spark):
    """100,000 loci on one sequence: joins in bins meet what is near only, and agree with plain arithmetic."""
    b = spark.range(100_000).select(F.lit(0).alias("tid"), (F.col("id") * 50).cast("int").alias("lpos"), (F.col("id") * 50 + 30).cast("int").alias("rpos"))
    segs = spark.range(100_000).select(F.lit(0).alias("tid"), (F.col("id") * 50 + 5).cast("int").alias("p"), (F.col("id") * 50 + 9).cast("int").alias("q"), (F.col("id") % 7).alias("cov"))
    s = coverage.stretch_stats(b, segs, ["tid"]).agg(F.sum("area"), F.count(F.lit(1)), F.max("covered")).first()
    assert tuple(s) == (4 * sum(i % 7 for i in range(100_000)), 100_000, 4)
    regs = b.select("tid", F.lit(1).alias("bid"), F.col("lpos").alias("l"), F.col("rpos").alias("r"), (F.col("lpos") / 50).cast("int").alias("rid"))
    hits = b.select("tid", F.lit(1).alias("bid"), (F.col("lpos") + 1).alias("pos"), (F.col("lpos") + 55).alias("rpos"))
    assert junctions.locate(hits, regs).where("last_rid = first_rid + 1").count() == 99_999


def test_within_by_brute_force(spark):
    r = random.Random(4)
    points = [(r.randint(0, 1), r.randint(0, 400)) for _ in range(200)]
    spans = [(k, r.randint(0, 1), a := r.randint(0, 390), a + r.randint(1, 80)) for k in range(60)]
    got = rows_of(bins.within(spark.createDataFrame(points, "t int, x int"), F.col("x"), spark.createDataFrame(spans, "k int, t int, a int, b int"), ["t"], "a", "b", 16), "t", "x", "k")
    assert got == sorted((t, x, k) for t, x in points for k, u, a, b in spans if t == u and a <= x < b)


def test_look_back_over_chunks(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 1), k, r.randint(0, 99)) for k in range(300)]
    got = rows_of(look_back(spark.createDataFrame(rows, "t int, k int, x int"), ["t"], F.floor(F.col("k") / 50), ["k"], F.col("x"), "max", "far", 4, chunk=7), "t", "k", "far")
    want = []
    for t in (0, 1):
        own = [x for x in rows if x[0] == t]
        want += [(t, k, max(x for _, _, x in own[max(0, i - 4) : i]) if i else None) for i, (_, k, _) in enumerate(own)]
    assert got == sorted(want)


def test_strands_and_exon_slack(spark):
    s = spark.createDataFrame([("+", "-"), ("+", "+"), (".", "-"), ("-", "."), (".", ".")], "a string, b string")
    assert [r[0] for r in s.select(loci.settled_strand(F.col("a"), F.col("b"))).collect()] == [None, "+", "-", "-", "."]
    exons = spark.createDataFrame([(1, 1, 1, 0, 10), (1, 1, 2, 10, 20), (1, 1, 3, 30, 40)], "tid int, bid int, v int, l int, r int")
    blocks = spark.createDataFrame([(1, 1, 8, 32), (1, 1, 5, 15), (1, 1, 5, 12), (1, 1, 22, 35), (1, 1, 38, 40)], "tid int, bid int, pos int, rpos int")
    assert rows_of(junctions.align_blocks(blocks, exons), "pos", "rpos", "first", "last") == [(5, 12, 1, 1), (5, 15, 1, 2), (8, 32, 2, 2)]


def plain_rules(v, e, sink):
    """What one round does to one graph (v: {v: (l, r, w, dev)}, e: {(s, t, kind): w}), by loops; None if no rule fires."""
    ins = lambda x: [k for k in e if k[1] == x]
    outs = lambda x: [k for k in e if k[0] == x]
    without = lambda gone: ({x: y for x, y in v.items() if x not in gone}, {k: w for k, w in e.items() if k[0] not in gone and k[1] not in gone})
    if gone := {x for x in v if bool(ins(x)) != bool(outs(x))}:
        return without(gone)
    gone = set()
    for x, (_, _, _, dev) in v.items():
        if len(ins(x)) == len(outs(x)) == 1 and dev < 0.01:
            s, t = ins(x)[0][0], outs(x)[0][1]
            if (s == 0 or t == sink) and (s == 0 or len(outs(s)) > 1) and (t == sink or len(ins(t)) > 1):
                gone.add(x)
    if gone:
        return without(gone)
    touch = lambda x: any(k[2] == "adjacent" and x in k[:2] for k in e)
    if gone := {x for x, (a, b, *_) in v.items() if b - a < 20 and not touch(x) and any(k[2] == "start" for k in ins(x)) or b - a < 20 and not touch(x) and any(k[2] == "end" for k in outs(x))}:
        return without(gone)
    for x, (_, _, w, _) in v.items():
        if len(ins(x)) == len(outs(x)) == 1 and ins(x)[0][2] == outs(x)[0][2] == "adjacent" and w <= 2 and e.get((ins(x)[0][0], outs(x)[0][1], "junction"), -1) >= w:
            gone.add(x)
    if gone:
        return without(gone)
    into = lambda x: max((w for k, w in e.items() if k[1] == x and k[2] == "adjacent"), default=-1)
    out = lambda x: max((w for k, w in e.items() if k[0] == x and k[2] == "adjacent"), default=-1)
    if weak := {k for k, w in e.items() if k[2] == "junction" and into(k[0]) >= 2 * w * w + 18 and out(k[1]) >= 2 * w * w + 18}:
        return v, {k: w for k, w in e.items() if k not in weak}
    for kind in ("start", "end"):
        more = {}
        for x, (_, _, w, _) in v.items():
            total = sum(e[k] for k in (ins(x) if kind == "start" else outs(x)))
            if (ins(x) or outs(x)) and not any(k[2] == kind for k in (ins(x) if kind == "start" else outs(x))) and w >= 10 * total * total + 10 and w >= total:
                more[(0, x, kind) if kind == "start" else (x, sink, kind)] = w - total
        if more:
            return v, e | more
    for s, t, kind in sorted(e):
        if kind == "junction":
            limit = 10 * e[s, t, kind] ** 2 + 10
            one, other = len(outs(s)) == 1, len(ins(t)) == 1
            if one and v[s][2] >= limit or other and v[t][2] >= limit:
                rest = {k: w for k, w in e.items() if k != (s, t, kind)}
                return v, rest | ({(s, sink, "end"): v[s][2]} if one else {}) | ({(0, t, "start"): v[t][2]} if other else {})
    return None


def test_cleaning_by_brute_force(spark):
    r = random.Random(21)
    vertices, edges, want, fired = [], [], {}, 0
    for g in range(40):
        n = r.randint(2, 8)
        at, v = 0, {}
        for x in range(1, n + 1):
            at += r.choice([0, 0, 30])
            v[x] = (at, at := at + r.choice([5, 15, 40]), float(r.choice([1, 2, 20, 100, 500])), r.choice([0.0, 0.5]))
        e = {(x, x + 1, "adjacent"): float(r.choice([1, 5, 30])) for x in range(1, n) if v[x][1] == v[x + 1][0]}
        e |= {(x, y, "junction"): float(r.randint(1, 4)) for x in range(1, n) for y in range(x + 1, n + 1) if v[x][1] < v[y][0] and r.random() < 0.4}
        e |= {(0, x, "start"): v[x][2] for x in v if not any(k[1] == x for k in e)}
        e |= {(x, n + 1, "end"): v[x][2] for x in v if not any(k[0] == x for k in e)}
        vertices += [(g, x, *y) for x, y in v.items()]
        edges += [(g, s, t, w, k) for (s, t, k), w in e.items()]
        while (after := plain_rules(v, e, n + 1)) is not None:
            (v, e), fired = after, fired + 1
        want[g] = (set(v), {(*k, w) for k, w in e.items()})
    cv, ce = cleaning.clean(spark.createDataFrame(vertices, "g int, v int, l int, r int, w double, dev double"), spark.createDataFrame(edges, "g int, s int, t int, w double, kind string"), ["g"])
    got_v, got_e = cv.collect(), ce.collect()
    assert fired > 60
    for g, (v, e) in want.items():
        assert {x.v for x in got_v if x.g == g} == v and {(x.s, x.t, x.kind, x.w) for x in got_e if x.g == g} == e, g


def test_surviving_edges_by_brute_force(spark):
    r = random.Random(9)
    rows, sinks, want = [], [], {}
    for g in range(25):
        n = r.randint(2, 7)
        e = {(s, t): float(r.randint(1, 30)) / 10 for s in range(1, n) for t in range(s + 1, n + 1) if r.random() < 0.5}
        kinds = {k: "junction" for k in e}
        for x in range(1, n + 1):
            if not any(t == x for _, t in e):
                e[0, x], kinds[0, x] = r.randint(1, 30) / 10, "start"
            if not any(s == x for s, _ in e):
                e[x, n + 1], kinds[x, n + 1] = r.randint(1, 30) / 10, "end"
        rows += [(g, s, t, w, kinds[s, t]) for (s, t), w in e.items()]
        sinks.append((g, n + 1))
        kept = {k for k, w in e.items() if w >= 1.6}
        label = {x: x for k, kind in kinds.items() if kind == "junction" for x in k}
        for _ in range(n):
            for (s, t), kind in kinds.items():
                if kind == "junction":
                    label[s] = label[t] = min(label[s], label[t])
        for c in set(label.values()):
            w, s, t = max((e[k], *k) for k, kind in kinds.items() if kind == "junction" and label[k[0]] == c)
            kept |= {(s, t)} if w >= 1.5 else set()
        while True:
            entered, left = {t for _, t in kept}, {s for s, _ in kept}
            more = {max((w, *k) for k, w in e.items() if k[0] == x)[1:] for x in entered - left if x != n + 1} | {max((w, *k) for k, w in e.items() if k[1] == x)[1:] for x in left - entered if x}
            if more <= kept:
                break
            kept |= more
        want[g] = kept
    got = cleaning.surviving_edges(spark.createDataFrame(rows, "g int, s int, t int, w double, kind string"), spark.createDataFrame(sinks, "g int, sink int"), ["g"]).collect()
    assert {g: {(x.s, x.t) for x in got if x.g == g} for g in want} == want


def test_graph_text_round_trip(spark):
    v = spark.createDataFrame([(1, 1, 0, 10, 2.5), (1, 2, 10, 30, 0.25)], "g int, v int, l int, r int, w double")
    e = spark.createDataFrame([(1, 0, 1, 2.5, "start"), (1, 1, 2, 0.25, "adjacent"), (1, 2, 3, 0.25, "end")], "g int, s int, t int, w double, kind string")
    lines = graphs.graph_lines(v, e, ["g"])
    assert [x.value for x in lines.orderBy("line_no").collect()] == ["4", "v0 0.0000 0", "v1 2.5000 10", "v2 0.2500 20", "v3 0.0000 0", "0 1 2.5000 1", "1 2 0.2500 1", "2 3 0.2500 1"]
    pv, pe = graphs.parse_graph(lines, ["g"])
    assert rows_of(pv, "v", "w", "length") == [(0, 0.0, 0), (1, 2.5, 10), (2, 0.25, 20), (3, 0.0, 0)] and rows_of(pe, "s", "t", "w") == [(0, 1, 2.5), (1, 2, 0.25), (2, 3, 0.25)]
