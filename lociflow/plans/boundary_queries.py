"""Queries over false boundaries, graphs of reference transcripts, and what runs agree on, each with its SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators import bridging, cleaning, coverage, fragments, graphs, junctions, transcripts, typed_graphs
from lociflow.operators.bins import within
from lociflow.operators.components import components
from lociflow.plans.fragment_queries import HIGH, LOW, _bridged, _typed
from lociflow.plans.graph_queries import BASE, PEX, _graph
from lociflow.plans.locus_queries import BIN, ORD, PAIRS, _assigned, _junctions, _loci, mate_pairs
from lociflow.sources.shared import written
from lociflow.sources.tables import ALN_SQL, alignments, read

KEYS = ["tid", "bid"]


def _typed_exons(spark, d) -> tuple[DataFrame, DataFrame]:
    """The loci's exons with kinds of boundaries, numbered (v, from 1), and the junctions between them."""
    typed = written(_typed(spark, d).where("NOT empty"), "typed")
    exons = written(junctions.numbered(typed).withColumn("v", F.col("rid") + 1), "exons")
    spans = exons.groupBy(*KEYS).agg(F.min("l").alias("_l"), F.max("r").alias("_r"))
    jun = within(_junctions(spark, d), F.col("lpos") - 1, spans, ["tid"], "_l", "_r", BIN).where("rpos < _r").select(*KEYS, "lpos", "rpos", "cnt")
    return exons, jun


def false_boundaries(spark, d):
    """Starts and ends of graphs of typed exons that bridged fragments of no fitting length speak against, by rule: short (by the bridge longer than on exons), gap (between the mates)."""
    exons, jun = _typed_exons(spark, d)
    v, e = typed_graphs.typed_graph(exons, jun, KEYS)
    v, e = written(v, "vertices"), written(e, "edges")
    bridged = _bridged(spark, d)[0]
    fitting = bridged.where("kind = 1").select("tid", F.col("m1.qid").alias("name")).distinct()
    open_ = bridged.where("kind = 2").withColumn("name", F.col("m1.qid")).join(fitting, ["tid", "name"], "left_anti")
    lists = written(fragments.exon_lists(open_, exons, KEYS, bin_width=BIN), "lists")
    short = cleaning.false_boundaries(fragments.short_votes(lists, exons, LOW, HIGH, KEYS), v, e, KEYS)
    gap = cleaning.false_boundaries(fragments.gap_votes(lists, exons, KEYS, BIN), v, e, KEYS)
    return short.withColumn("rule", F.lit("short")).unionByName(gap.withColumn("rule", F.lit("gap")))


def _annotated(spark, d) -> tuple[DataFrame, DataFrame]:
    """Graphs of the loci as genes: the alignments of equal line number modulo 3 are a reference transcript."""
    rows = written(_assigned(spark, d).join(_loci(spark, d).select(*KEYS), KEYS, "left_semi").withColumn("id", F.col("ln") % 3).select(*KEYS, "id", "pos", "rpos"), "rows")
    parts = written(coverage.segments(rows, [*KEYS, "id"], bin_width=8 * BIN), "parts")
    exons = coverage.islands(parts, [*KEYS, "id"], bin_width=8 * BIN)
    covered = rows.groupBy(*KEYS, "id").agg((F.count(F.lit(1)) * 0.75).alias("coverage"))
    v, e = graphs.annotation_graph(written(exons.join(covered, [*KEYS, "id"]), "exons"), KEYS, 8 * BIN)
    return v, written(e, "edges")


def annotation_graph(spark, d):
    return _annotated(spark, d)[1].select(*KEYS, "s", "t", "kind", "w")


def annotation_graph_vertices(spark, d):
    return _annotated(spark, d)[0].select(*KEYS, "v", "l", "r", "w")


def compare_graphs(spark, d):
    """Junctions, starts and ends of the loci's graphs held against those of their reference transcripts."""
    known, found = (graphs.landmarks(*g, KEYS) for g in (_annotated(spark, d), _graph(spark, d)))
    return transcripts.compare(known, found, [*KEYS, "kind", "l", "r"], ["kind"])


def intron_consensus(spark, d):
    """Each order's alignments as a transcript, its introns between neighbours in units of 32 days; orders of a strand (the number modulo 3) agree by intron chain, those without introns by overlap, run by run (the last digit)."""
    a = alignments(spark, d).withColumn("nxt", F.lead("pos").over(Window.partitionBy("qid").orderBy("pos", "rpos", "ln")))
    unit = lambda c: F.floor(F.col(c) / 32).cast("int")
    gap = F.when(F.col("nxt") > F.col("rpos"), F.struct(unit("rpos").alias("l"), unit("nxt").alias("r")))
    rows = a.groupBy("qid").agg(F.array_sort(F.collect_list(gap)).alias("introns"), F.sum("hid").cast("double").alias("coverage"), F.min("pos").alias("start"), F.max("rpos").alias("end"))
    rows = written(rows.withColumns({"strand": F.col("qid") % 3, "run": F.col("qid") % 10}), "transcripts")
    out = transcripts.consensus(rows, ["strand"], least_multi=3, least_single=5)
    chain = F.array_join(F.transform("introns", lambda x: F.concat(x["l"].cast("string"), F.lit(":"), x["r"].cast("string"))), ",")
    return out.select("strand", chain.alias("chain"), "cnt", F.round("coverage", 4).alias("coverage"), "start", "end")


def phased_bridges(spark, d):
    """Orders as ascending lists of part numbers modulo 9: the even ones are reference paths, the first and last two of the odd ones mates."""
    o = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set((F.col("l_partkey") % 9).cast("int"))).alias("path")).withColumn("k", F.col("id") % 7)
    mates = o.where("id % 2 = 1 AND size(path) >= 4").select("k", F.slice("path", 1, 2).alias("v1"), F.slice("path", -2, 2).alias("v2")).distinct()
    out = bridging.phased(mates, o.where("id % 2 = 0").select("k", "path"), ["k"])
    return out.select("k", *[F.array_join(c, ">").alias(c) for c in ("v1", "v2", "way")], "cnt")


def chosen_paths(spark, d):
    """Pairs of an order's lines as candidates of one fragment; those of even orders count as linked reads."""
    c = mate_pairs(spark, d).withColumn("length", F.abs(F.col("mate_pos") - F.col("pos"))).withColumn("type", (F.col("qid") + 1) % 2)
    return bridging.chosen_paths(c, ["qid"], 20, 60, 90, ["ln", "mate_ln"]).select("qid", "ln", "mate_ln", "length", "kind")


def graph_layers(spark, d):
    """Fewest and most edges, number of paths and widest path from each locus's source to its vertices and sink."""
    v, e = _graph(spark, d)
    out = graphs.layers(v.select(*KEYS, F.lit(0).alias("v")), e, KEYS)
    return out.select(*KEYS, "v", "hops", "depth", "paths", F.round("widest", 6).alias("widest"))


def path_pairs(spark, d):
    """How many paths lead between each two vertices of each locus's graph, and the fewest and most edges of one."""
    return graphs.all_paths(_graph(spark, d)[1], KEYS).select(*KEYS, "s", "t", "hops", "depth", "paths", F.round("widest", 6).alias("widest"))


def unavoidable_vertices(spark, d):
    """The vertices that all paths from a locus's source to its sink pass."""
    v, e = _graph(spark, d)
    ends = v.groupBy(*KEYS).agg(F.lit(0).alias("s"), (F.max("v") + 1).alias("t"))
    return graphs.on_every_path(graphs.all_paths(e, KEYS), ends, KEYS).select(*KEYS, "v")


def _split(spark, d) -> DataFrame:
    v, e = _graph(spark, d)
    vertex = lambda c: F.struct(*KEYS, F.col(c).alias("v"))
    inner = e.where("kind IN ('junction', 'adjacent')")
    labels = components(inner.select(vertex("s").alias("a"), vertex("t").alias("b"))).select("node.*", F.col("label.v").alias("label"))
    return graphs.split_components(v, e, labels, KEYS)[1]


def split_graphs(spark, d):
    """The edges of each component of each locus, with vertices numbered anew."""
    return _split(spark, d).select(*KEYS, "label", "s", "t", F.round("w", 6).alias("w"), "kind")


ANNOTATED = f""", rf AS (SELECT a.*, ln % 3 AS id FROM bnd a JOIN bun b ON a.tid = b.tid AND a.bid = b.bid), rn AS (SELECT *, CASE WHEN pos > max(rpos) OVER (PARTITION BY tid, bid, id ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM rf), ri AS (SELECT *, sum(new) OVER (PARTITION BY tid, bid, id ORDER BY {ORD}) AS i FROM rn),
rx AS (SELECT tid, bid, id, min(pos) AS l, max(rpos) AS r FROM ri GROUP BY tid, bid, id, i), rc AS (SELECT tid, bid, id, greatest(CAST(floor(count(*) * 0.75) AS INT), 1) AS c FROM rf GROUP BY tid, bid, id),
rp AS (SELECT tid, bid, p, lead(p) OVER (PARTITION BY tid, bid ORDER BY p) AS q FROM (SELECT tid, bid, l AS p FROM rx UNION SELECT tid, bid, r FROM rx)),
av AS (SELECT *, CAST(row_number() OVER (PARTITION BY tid, bid ORDER BY l) AS INT) AS v FROM (SELECT tid, bid, p AS l, q AS r, CAST(sum(c) AS DOUBLE) AS w FROM rp JOIN rx USING (tid, bid) JOIN rc USING (tid, bid, id) WHERE p >= l AND q <= r GROUP BY tid, bid, p, q)),
ak AS (SELECT tid, bid, CAST(max(v) + 1 AS INT) AS sink FROM av GROUP BY tid, bid),
st AS (SELECT v.tid, v.bid, v.v, v.r, c, lag(v.v) OVER o AS pv, lead(v.v) OVER o AS nv, lead(v.l) OVER o AS nl FROM av v JOIN rx x ON v.tid = x.tid AND v.bid = x.bid AND v.l >= x.l AND v.r <= x.r JOIN rc ON rc.tid = x.tid AND rc.bid = x.bid AND rc.id = x.id WINDOW o AS (PARTITION BY v.tid, v.bid, x.id ORDER BY v.v)),
ae AS (SELECT tid, bid, s, t, kind, CAST(sum(c) AS DOUBLE) AS w FROM (SELECT tid, bid, 0 AS s, v AS t, 'start' AS kind, c FROM st WHERE pv IS NULL UNION ALL SELECT tid, bid, v, nv, CASE WHEN nl = r THEN 'adjacent' ELSE 'junction' END, c FROM st WHERE nv IS NOT NULL UNION ALL SELECT tid, bid, v, sink, 'end', c FROM st JOIN ak USING (tid, bid) WHERE nv IS NULL) GROUP BY tid, bid, s, t, kind)
"""
RECURSIVE = BASE.replace("WITH ", "WITH RECURSIVE ", 1)
MARKS = "SELECT DISTINCT e.tid, e.bid, kind, CASE WHEN kind <> 'start' THEN x.r ELSE -1 END AS l, CASE WHEN kind <> 'end' THEN y.l ELSE -1 END AS r FROM {e} e LEFT JOIN {v} x ON e.tid = x.tid AND e.bid = x.bid AND e.s = x.v LEFT JOIN {v} y ON e.tid = y.tid AND e.bid = y.bid AND e.t = y.v WHERE kind <> 'adjacent'"

SPLIT = (
    RECURSIVE + PEX + ", und AS (SELECT tid, bid, s AS a, t AS b FROM inn UNION SELECT tid, bid, t, s FROM inn), rea AS (SELECT tid, bid, a AS v, a AS root FROM und UNION SELECT u.tid, u.bid, u.b, x.root FROM rea x JOIN und u ON u.tid = x.tid AND u.bid = x.bid AND u.a = x.v), lab AS (SELECT tid, bid, v, min(root) AS label FROM rea GROUP BY tid, bid, v), "
    "mem AS (SELECT tid, bid, label, v, CAST(row_number() OVER (PARTITION BY tid, bid, label ORDER BY v) AS INT) AS n, CAST(count(*) OVER (PARTITION BY tid, bid, label) + 1 AS INT) AS sink FROM (SELECT p.tid, p.bid, p.v, coalesce(label, p.v) AS label FROM pex p LEFT JOIN lab ON lab.tid = p.tid AND lab.bid = p.bid AND lab.v = p.v)), "
    "sp AS (SELECT e.tid, e.bid, coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS s, coalesce(b.n, a.sink) AS t, e.w, kind FROM edges e LEFT JOIN mem a ON a.tid = e.tid AND a.bid = e.bid AND a.v = e.s LEFT JOIN mem b ON b.tid = e.tid AND b.bid = e.bid AND b.v = e.t) "
)

HIT = "least({a}.e, e) - greatest({a}.s, s) >= 0.9 * ({a}.e - {a}.s) OR least({a}.e, e) - greatest({a}.s, s) >= 0.9 * (e - s)"
SINGLES = (
    "one AS (SELECT strand, p AS s, q AS e, c, row_number() OVER (PARTITION BY strand ORDER BY qid % 10, p, q) AS k FROM t WHERE chain = ''), "
    "step AS (SELECT strand, k, [struct_pack(s := s, e := e, n := 1, c := c)] AS items FROM one WHERE k = 1 UNION ALL SELECT strand, k, CASE WHEN hit THEN list_transform(items, lambda x, i: CASE WHEN i = spot THEN struct_pack(s := least(x.s, s), e := greatest(x.e, e), n := x.n + 1, c := least(x.c, c)) ELSE x END) "
    "ELSE list_concat(list_concat(items[1:spot - 1], [struct_pack(s := s, e := e, n := 1, c := c)]), items[spot:]) END FROM (SELECT *, "
    f"coalesce(list_min(list_transform(list_filter(list_zip(items, range(1, len(items) + 1)), lambda z: {HIT.format(a='z[1]')} OR z[1].s > s OR (z[1].s = s AND z[1].e > e)), lambda z: z[2])), len(items) + 1) AS spot, "
    f"spot <= len(items) AND ({HIT.format(a='items[spot]')}) AS hit FROM (SELECT one.*, step.items FROM step JOIN one ON one.strand = step.strand AND one.k = step.k + 1)))"
)

QUERIES = {
    "false_boundaries": (false_boundaries, None),
    "annotation_graph": (annotation_graph, BASE + ANNOTATED + "SELECT tid, bid, s, t, kind, w FROM ae"),
    "annotation_graph_vertices": (annotation_graph_vertices, BASE + ANNOTATED + "SELECT tid, bid, v, l, r, w FROM av"),
    "compare_graphs": (
        compare_graphs,
        BASE + PEX + ANNOTATED + f", ka AS ({MARKS.format(e='ae', v='av')}), kb AS ({MARKS.format(e='edges', v='pex')}) SELECT kind, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS fn FROM (SELECT *, true AS a FROM ka) x FULL JOIN (SELECT *, true AS b FROM kb) y USING (tid, bid, kind, l, r) GROUP BY kind",
    ),
    "intron_consensus": (
        intron_consensus,
        f"WITH RECURSIVE {ALN_SQL}, n AS (SELECT *, lead(pos) OVER (PARTITION BY qid ORDER BY pos, rpos, ln) AS nx FROM aln), t AS (SELECT qid, qid % 3 AS strand, coalesce(string_agg(CASE WHEN nx > rpos THEN CAST(floor(rpos / 32.0) AS INT) || ':' || CAST(floor(nx / 32.0) AS INT) END, ',' ORDER BY pos, rpos, ln), '') AS chain, sum(hid) AS c, min(pos) AS p, max(rpos) AS q FROM n GROUP BY qid), "
        f"{SINGLES} SELECT strand, chain, count(*) AS cnt, round(sum(c) / 10.0, 4)::DOUBLE AS coverage, min(p) AS \"start\", max(q) AS \"end\" FROM t WHERE chain <> '' GROUP BY strand, chain HAVING count(*) >= 3 "
        "UNION ALL SELECT strand, '', CAST(x.n AS BIGINT), round(CAST(x.c AS DOUBLE), 4), x.s, x.e FROM (SELECT strand, unnest(items) AS x FROM step WHERE k = (SELECT max(k) FROM one WHERE one.strand = step.strand)) WHERE x.n >= 5",
    ),
    "phased_bridges": (
        phased_bridges,
        "WITH o AS (SELECT l_orderkey AS id, l_orderkey % 7 AS k, list_sort(list(DISTINCT l_partkey % 9)) AS p FROM lineitem GROUP BY l_orderkey), c AS (SELECT DISTINCT k, p[1:2] AS v1, p[len(p) - 1:] AS v2 FROM o WHERE id % 2 = 1 AND len(p) >= 4), x AS (SELECT c.k, v1, v2, p, list_position(p, v1[1]) AS i, list_position(p, v2[1]) AS j FROM c JOIN o ON o.k = c.k WHERE id % 2 = 0) "
        "SELECT k, array_to_string(v1, '>') AS v1, array_to_string(v2, '>') AS v2, array_to_string(p[i:j + 1], '>') AS way, count(*) AS cnt FROM x WHERE i > 0 AND j >= i + 2 AND p[i:i + 1] = x.v1 AND p[j:j + 1] = x.v2 GROUP BY ALL",
    ),
    "chosen_paths": (
        chosen_paths,
        f"WITH {ALN_SQL}, {PAIRS}, x AS (SELECT qid, ln, mate_ln, abs(mate_pos - pos) AS length FROM pr) SELECT qid, ln, mate_ln, length, CASE WHEN length BETWEEN 20 AND 90 THEN 1 ELSE 2 END AS kind FROM x WHERE qid % 2 = 1 OR length BETWEEN 16 AND 108 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY abs(length - 60), ln, mate_ln) = 1",
    ),
    "path_pairs": (
        path_pairs,
        RECURSIVE + PEX + ", wk AS (SELECT tid, bid, s, t, 1 AS k, w AS x FROM edges UNION ALL SELECT e.tid, e.bid, wk.s, e.t, k + 1, least(x, w) FROM wk JOIN edges e ON e.tid = wk.tid AND e.bid = wk.bid AND e.s = wk.t) SELECT tid, bid, s, t, min(k) AS hops, max(k) AS depth, count(*) AS paths, round(max(x), 6) AS widest FROM wk GROUP BY tid, bid, s, t",
    ),
    "unavoidable_vertices": (
        unavoidable_vertices,
        RECURSIVE + PEX + ", wk AS (SELECT tid, bid, 0 AS v, [0] AS p FROM (SELECT DISTINCT tid, bid FROM pex) UNION ALL SELECT e.tid, e.bid, e.t, list_append(p, e.t) FROM wk JOIN edges e ON e.tid = wk.tid AND e.bid = wk.bid AND e.s = wk.v), z AS (SELECT tid, bid, max(v) + 1 AS t FROM pex GROUP BY tid, bid), f AS (SELECT wk.tid, wk.bid, wk.p FROM wk JOIN z ON z.tid = wk.tid AND z.bid = wk.bid AND z.t = wk.v), "
        "n AS (SELECT tid, bid, count(*) AS n FROM f GROUP BY tid, bid), o AS (SELECT tid, bid, unnest(p[2:len(p) - 1]) AS v FROM f) SELECT o.tid, o.bid, v FROM o JOIN n ON n.tid = o.tid AND n.bid = o.bid GROUP BY o.tid, o.bid, v, n.n HAVING count(*) = n.n",
    ),
    "graph_layers": (
        graph_layers,
        RECURSIVE + PEX + ", wk AS (SELECT tid, bid, 0 AS v, 0 AS k, CAST(NULL AS DOUBLE) AS x FROM (SELECT DISTINCT tid, bid FROM pex) UNION ALL SELECT e.tid, e.bid, e.t, k + 1, least(coalesce(x, w), w) FROM wk JOIN edges e ON e.tid = wk.tid AND e.bid = wk.bid AND e.s = wk.v) SELECT tid, bid, v, min(k) AS hops, max(k) AS depth, count(*) AS paths, round(max(x), 6) AS widest FROM wk GROUP BY tid, bid, v",
    ),
    "split_graphs": (
        split_graphs,
        SPLIT + "SELECT tid, bid, label, s, t, round(w, 6) AS w, kind FROM sp",
    ),
}
