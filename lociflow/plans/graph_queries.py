"""Queries over graphs and phasing paths, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import alignments as A
from lociflow.operators import bridging, graphs, junctions, transcripts
from lociflow.operators.bins import within
from lociflow.operators.components import components
from lociflow.operators.running import following
from lociflow.plans.locus_queries import BASE, BIN, ORD, _assigned, _junctions, _regions, _segments
from lociflow.sources.shared import written
from lociflow.sources.tables import ORDER, read

LAYERS = 6


def _events(spark, d) -> DataFrame:
    return read(spark, d, "events")


def _edges(spark, d) -> DataFrame:
    return graphs.chain_edges(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type")


def _layered(spark, d) -> DataFrame:
    """Steps from one four-hour part of the day to the next, between event types: s, t, w."""
    e = _events(spark, d).withColumn("v", F.concat(F.floor(F.hour("ts") / 4).cast("string"), F.lit(":"), F.col("event_type")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.select(F.col("v").alias("s"), F.lead("v").over(w).alias("t")).where("t IS NOT NULL AND CAST(split(t, ':')[0] AS INT) = CAST(split(s, ':')[0] AS INT) + 1")
    return steps.groupBy("s", "t").agg(F.count(F.lit(1)).alias("w"))


def _starts(edges: DataFrame, value: int) -> DataFrame:
    return edges.where("s LIKE '0:%'").select(F.col("s").alias("v")).distinct().withColumn("value", F.lit(value).cast("long"))


def kmer_paths(spark, d):
    out = None
    for k in (2, 3):
        part = graphs.kmers(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", k).select(F.array_join("path", ">").alias("path"), "cnt")
        out = part if out is None else out.unionByName(part)
    return out


def phasing_counts(spark, d):
    days = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.array_distinct(F.collect_list("event_type"))).alias("types")).where(F.size("types") >= 2)
    return days.groupBy(F.array_join("types", ">").alias("path")).agg(F.count(F.lit(1)).alias("cnt"))


def phasing_edges_valid(spark, d):
    paths = graphs.kmers(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", 4).select("path")
    edges = _edges(spark, d).where("w >= 380")
    return graphs.path_edges_valid(paths, edges).select(F.array_join("path", ">").alias("path"), "valid")


def path_overlap(spark, d):
    paths = graphs.kmers(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", 3).select(F.array_join("path", ">").alias("id"), "path")
    return graphs.path_overlaps(paths)


def graph_degree(spark, d):
    return graphs.degrees(_edges(spark, d))


def graph_max_edge(spark, d):
    return graphs.heaviest_out_edge(_edges(spark, d))


def graph_components(spark, d):
    """Events linked to the user's next within six hours, as a graph: its components."""
    e = _events(spark, d).select("user_id", F.col("event_id").alias("a"), F.unix_timestamp("ts").alias("at"))
    w = Window.partitionBy("user_id").orderBy("at", "a")
    links = e.select("a", "at", F.lead("a").over(w).alias("b"), F.lead("at").over(w).alias("then")).where("then - at <= 21600")
    return components(links.select("a", "b")).select("node", "label")


def graph_path_count(spark, d):
    e = _layered(spark, d)
    return graphs.propagate(_starts(e, 1), e, LAYERS - 1, "count")


def graph_widest_path(spark, d):
    e = _layered(spark, d)
    return graphs.propagate(_starts(e, 1 << 40), e, LAYERS - 1, "widest").where("value < 1099511627776")


def graph_reachability(spark, d):
    e = _layered(spark, d).where("w >= 5")
    return graphs.propagate(_starts(e, 0), e, LAYERS - 1, "hops")


def _graph(spark, d):
    """Vertices and edges of all loci, as tables: each is used several times over."""
    regs, segs = written(_regions(spark, d), "regions"), _segments(spark, d)
    ex = junctions.partial_exons(regs, segs, bin_width=BIN).where("NOT empty").select("tid", "bid", "l", "r", (F.col("area") / F.col("length")).alias("w"))
    spans = regs.groupBy("tid", "bid").agg(F.min("l").alias("_l"), F.max("r").alias("_r"))
    jun = within(_junctions(spark, d), F.col("lpos") - 1, spans, ["tid"], "_l", "_r", BIN).where("rpos < _r").select("tid", "bid", "lpos", "rpos", "cnt")
    v, e = graphs.splice_graph(written(ex, "exons"), jun, ["tid", "bid"])
    return written(v, "vertices"), written(e, "edges")


def splice_graph_edges(spark, d):
    return _graph(spark, d)[1].select("tid", "bid", "s", "t", F.round("w", 6).alias("w"), "kind")


def splice_graph_vertices(spark, d):
    return _graph(spark, d)[0].select("tid", "bid", "v", "l", "r", F.round("w", 6).alias("w"))


def vertex_rules(spark, d):
    return graphs.vertex_rules(*_graph(spark, d), ["tid", "bid"])


def weak_junctions(spark, d):
    v, e = _graph(spark, d)
    return graphs.weak_junctions(e.withColumn("w", F.when(F.col("kind") == "adjacent", F.col("w") * 10).otherwise(F.col("w"))), ["tid", "bid"])


def extended_boundaries(spark, d):
    v, e = _graph(spark, d)
    x = graphs.extended_boundaries(v.withColumn("w", F.col("w") * 20), e, ["tid", "bid"])
    return x.select("tid", "bid", "s", "t", F.round("w", 6).alias("w"), "kind")


def _linked(spark, d, vertices: DataFrame) -> DataFrame:
    """The vertex lists that alignments and those a junction leads to show, with their counts."""
    rows = _assigned(spark, d).withColumn("_at", F.struct("pos", "rpos"))
    pairs = following(rows, ["tid", "xs"], F.floor(F.col("pos") / (8 * BIN)), ORDER, "_at", "next").where("next.pos > rpos")
    return junctions.linked_paths(pairs.select("tid", "bid", "pos", "rpos", F.col("next.pos").alias("next_pos"), F.col("next.rpos").alias("next_rpos")), vertices, bin_width=BIN)


def linked_paths(spark, d):
    return _linked(spark, d, _graph(spark, d)[0]).select("tid", "bid", F.array_join("path", ">").alias("path"), "cnt")


def decomposition(spark, d):
    """Each locus's graph as weighted paths, those that linked alignments show first."""
    v, e = _graph(spark, d)
    paths = graphs.decompose(e, ["tid", "bid"], _linked(spark, d, v))
    return paths.select("tid", "bid", "k", F.array_join("path", ">").alias("path"), F.round("abundance", 6).alias("abundance"))


def path_to_exons(spark, d):
    v, e = _graph(spark, d)
    out = transcripts.path_exons(graphs.decompose(e, ["tid", "bid"], _linked(spark, d, v)), v, ["tid", "bid"])
    return out.select("tid", "bid", "k", F.explode("exons").alias("e")).select("tid", "bid", "k", "e.l", "e.r")


def graph_closest_path(spark, d):
    e = _layered(spark, d)
    return graphs.propagate(_starts(e, 0), e, LAYERS - 1, "closest")


def thin_chains(spark, d):
    return graphs.thin_chains(_graph(spark, d)[0], ["tid", "bid"], most=3.0, least=2)


def locus_graph_components(spark, d):
    """The heaviest inner edge of each locus's components without source and sink."""
    v, e = _graph(spark, d)
    inner = e.where("kind IN ('junction', 'adjacent')")
    vertex = lambda c: F.struct("tid", "bid", F.col(c).alias("v"))
    own = components(inner.select(vertex("s").alias("a"), vertex("t").alias("b"))).select("node.*", F.col("label.v").alias("label"))
    return graphs.heaviest_edges(e, own, ["tid", "bid"], 1.5).select("tid", "bid", "label", "s", "t", F.round("w", 6).alias("w"))


def bridge_paths(spark, d):
    """The widest ways from each locus's first exon to its last."""
    v, e = _graph(spark, d)
    ends = v.groupBy("tid", "bid").agg(F.min("v").alias("s"), F.max("v").alias("t")).where("s < t")
    lengths = v.select("tid", "bid", "v", (F.col("r") - F.col("l")).alias("length"))
    out = bridging.widest_bridges(ends, e.where("kind IN ('junction', 'adjacent')"), lengths, None, ["tid", "bid"])
    return out.select("tid", "bid", "rank", F.array_join("path", ">").alias("path"), "length")


def run_length_codec(spark, d):
    u = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.array_distinct(F.collect_list((F.col("event_id") % 97).cast("int")))).alias("v"))
    runs = u.withColumn("runs", A.run_length_encode(F.col("v")))
    return runs.select("user_id", F.size("runs").alias("n_runs"), (A.run_length_decode(F.col("runs")) == F.col("v")).alias("same"))


LAY = "lay AS (SELECT s, t, count(*) AS w FROM (SELECT v AS s, lead(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM (SELECT *, CAST(hour(ts) // 4 AS VARCHAR) || ':' || event_type AS v FROM events)) WHERE t IS NOT NULL AND CAST(split_part(t, ':', 1) AS INT) = CAST(split_part(s, ':', 1) AS INT) + 1 GROUP BY s, t)"
EDG = "edg AS (SELECT s, t, count(*) AS w FROM (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL GROUP BY s, t)"
PEX = """, ins AS (SELECT g.tid, bid, l, r, p, q, cov FROM reg g JOIN seg s ON g.tid = s.tid AND p >= l AND q <= r), c AS (SELECT *, CASE WHEN p > coalesce(lag(q) OVER (PARTITION BY tid, bid, l ORDER BY p), l) + 3 THEN 1 ELSE 0 END AS new FROM ins), k AS (SELECT *, sum(new) OVER (PARTITION BY tid, bid, l ORDER BY p) AS k FROM c), g2 AS (SELECT tid, bid, l, r, k, min(p) AS a, max(q) AS b, CAST(sum((q - p) * cov) AS BIGINT) AS area FROM k GROUP BY tid, bid, l, r, k), g3 AS (SELECT tid, bid, l AS ol, r AS orr, CASE WHEN a - l <= 3 THEN l ELSE a END AS l, CASE WHEN r - b <= 3 THEN r ELSE b END AS r, area FROM g2),
pex AS (SELECT tid, bid, l, r, greatest(area / CAST(r - l AS DOUBLE), 0.01) AS w, CAST(row_number() OVER (PARTITION BY tid, bid ORDER BY l) AS INT) AS v, lead(l) OVER (PARTITION BY tid, bid ORDER BY l) AS nl, lead(greatest(area / CAST(r - l AS DOUBLE), 0.01)) OVER (PARTITION BY tid, bid ORDER BY l) AS nw FROM g3 WHERE NOT ((r - l < 15 OR area < 1.5 * (r - l) OR area < 3) AND NOT (l = ol AND r = orr))),
inn AS (SELECT a.tid, a.bid, a.v AS s, b.v AS t, CAST(cnt AS DOUBLE) AS w, 'junction' AS kind FROM jun j JOIN pex a ON j.tid = a.tid AND j.lpos = a.r JOIN pex b ON j.tid = b.tid AND a.bid = b.bid AND j.rpos = b.l UNION ALL SELECT tid, bid, v, v + 1, least(w, nw), 'adjacent' FROM pex WHERE nl = r),
snk AS (SELECT tid, bid, CAST(count(*) + 1 AS INT) AS sink FROM pex GROUP BY tid, bid),
edges AS (SELECT * FROM inn UNION ALL SELECT tid, bid, 0, v, w, 'start' FROM pex p WHERE NOT EXISTS (SELECT 1 FROM inn i WHERE i.tid = p.tid AND i.bid = p.bid AND i.t = p.v) UNION ALL SELECT p.tid, p.bid, v, sink, w, 'end' FROM pex p JOIN snk ON p.tid = snk.tid AND p.bid = snk.bid WHERE NOT EXISTS (SELECT 1 FROM inn i WHERE i.tid = p.tid AND i.bid = p.bid AND i.s = p.v)),
deg AS (SELECT tid, bid, v, sum(i) AS din, sum(o) AS dout, sum(wi) AS win, sum(wo) AS wout FROM (SELECT tid, bid, t AS v, 1 AS i, 0 AS o, w AS wi, 0.0 AS wo FROM edges UNION ALL SELECT tid, bid, s, 0, 1, 0.0, w FROM edges) GROUP BY tid, bid, v)
"""
KMER = "SELECT {p} AS path, count(*) AS cnt FROM (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(event_type, 3) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE {last} IS NOT NULL GROUP BY 1"

QUERIES = {
    "kmer_paths": (kmer_paths, KMER.format(p="a || '>' || b", last="b") + " UNION ALL " + KMER.format(p="a || '>' || b || '>' || c", last="c")),
    "phasing_counts": (phasing_counts, "SELECT path, count(*) AS cnt FROM (SELECT array_to_string(list_sort(list_distinct(list(event_type))), '>') AS path, count(DISTINCT event_type) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)) WHERE n >= 2 GROUP BY path"),
    "phasing_edges_valid": (
        phasing_edges_valid,
        f"WITH {EDG}, k AS (SELECT DISTINCT a, b, c, d FROM (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(event_type, 3) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE d IS NOT NULL), e AS (SELECT s, t FROM edg WHERE w >= 380) SELECT a || '>' || b || '>' || c || '>' || d AS path, EXISTS (SELECT 1 FROM e WHERE s = a AND t = b) AND EXISTS (SELECT 1 FROM e WHERE s = b AND t = c) AND EXISTS (SELECT 1 FROM e WHERE s = c AND t = d) AS valid FROM k",
    ),
    "path_overlap": (
        path_overlap,
        "WITH k AS (SELECT DISTINCT a, b, c FROM (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE c IS NOT NULL) SELECT x.a || '>' || x.b || '>' || x.c AS i, y.a || '>' || y.b || '>' || y.c AS j FROM k x JOIN k y ON x.b = y.a AND x.c = y.b WHERE (x.a, x.b, x.c) <> (y.a, y.b, y.c)",
    ),
    "graph_degree": (graph_degree, f"WITH {EDG} SELECT v, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(wi) AS BIGINT) AS in_weight, CAST(sum(wo) AS BIGINT) AS out_weight FROM (SELECT t AS v, 1 AS i, 0 AS o, w AS wi, 0 AS wo FROM edg UNION ALL SELECT s, 0, 1, 0, w FROM edg) GROUP BY v"),
    "graph_max_edge": (graph_max_edge, f"WITH {EDG} SELECT s, t, w FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w DESC, t DESC) AS k FROM edg) WHERE k = 1"),
    "graph_components": (
        graph_components,
        "WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), c AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM c) SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id, k) AS label FROM k QUALIFY count(*) OVER (PARTITION BY user_id, k) > 1",
    ),
    "graph_path_count": (graph_path_count, f"WITH RECURSIVE {LAY}, r AS (SELECT DISTINCT s AS v FROM lay WHERE s LIKE '0:%' UNION ALL SELECT t FROM r JOIN lay ON v = s) SELECT v, count(*) AS value FROM r GROUP BY v"),
    "graph_widest_path": (graph_widest_path, f"WITH RECURSIVE {LAY}, r AS (SELECT DISTINCT s AS v, CAST(1099511627776 AS BIGINT) AS x FROM lay WHERE s LIKE '0:%' UNION ALL SELECT t, least(x, w) FROM r JOIN lay ON v = s) SELECT v, max(x) AS value FROM r GROUP BY v HAVING max(x) < 1099511627776"),
    "graph_reachability": (graph_reachability, f"WITH RECURSIVE {LAY}, f AS (SELECT * FROM lay WHERE w >= 5), r AS (SELECT DISTINCT s AS v, CAST(0 AS BIGINT) AS x FROM f WHERE s LIKE '0:%' UNION SELECT t, x + 1 FROM r JOIN f ON v = s) SELECT v, min(x) AS value FROM r GROUP BY v"),
    "splice_graph_edges": (splice_graph_edges, BASE + PEX + "SELECT tid, bid, s, t, round(w, 6) AS w, kind FROM edges"),
    "splice_graph_vertices": (splice_graph_vertices, BASE + PEX + "SELECT tid, bid, v, l, r, round(w, 6) AS w FROM pex"),
    "vertex_rules": (
        vertex_rules,
        BASE + PEX + ", tch AS (SELECT tid, bid, s AS v FROM edges WHERE kind = 'adjacent' UNION SELECT tid, bid, t FROM edges WHERE kind = 'adjacent') SELECT p.tid, p.bid, p.v, 'small exon' AS rule FROM pex p WHERE r - l < 20 AND (tid, bid, v) NOT IN (SELECT (tid, bid, v) FROM tch) AND EXISTS (SELECT 1 FROM edges e WHERE e.tid = p.tid AND e.bid = p.bid AND ((kind = 'start' AND e.t = p.v) OR (kind = 'end' AND e.s = p.v))) "
        "UNION ALL SELECT p.tid, p.bid, p.v, 'intron contamination' FROM pex p JOIN deg ON deg.tid = p.tid AND deg.bid = p.bid AND deg.v = p.v AND din = 1 AND dout = 1 JOIN edges i ON i.tid = p.tid AND i.bid = p.bid AND i.t = p.v AND i.kind = 'adjacent' JOIN edges o ON o.tid = p.tid AND o.bid = p.bid AND o.s = p.v AND o.kind = 'adjacent' JOIN edges j ON j.tid = p.tid AND j.bid = p.bid AND j.s = i.s AND j.t = o.t AND j.kind = 'junction' WHERE p.w <= 2.0 AND p.w <= j.w",
    ),
    "weak_junctions": (weak_junctions, BASE + PEX + ", e10 AS (SELECT tid, bid, s, t, CASE WHEN kind = 'adjacent' THEN w * 10 ELSE w END AS w, kind FROM edges), bf AS (SELECT tid, bid, t AS v, max(w) AS x FROM e10 WHERE kind = 'adjacent' GROUP BY ALL), bh AS (SELECT tid, bid, s AS v, max(w) AS x FROM e10 WHERE kind = 'adjacent' GROUP BY ALL) SELECT e.tid, e.bid, s, t FROM e10 e JOIN bf ON e.tid = bf.tid AND e.bid = bf.bid AND e.s = bf.v JOIN bh ON e.tid = bh.tid AND e.bid = bh.bid AND e.t = bh.v WHERE kind = 'junction' AND bf.x >= 2 * w * w + 18 AND bh.x >= 2 * w * w + 18"),
    "extended_boundaries": (
        extended_boundaries,
        BASE + PEX + ", kv AS (SELECT p.tid, p.bid, p.v, p.w * 20 AS wv, win, wout, sink FROM pex p JOIN deg ON deg.tid = p.tid AND deg.bid = p.bid AND deg.v = p.v JOIN snk ON snk.tid = p.tid AND snk.bid = p.bid) SELECT tid, bid, 0 AS s, v AS t, round(wv - win, 6) AS w, 'start' AS kind FROM kv k WHERE wv >= 10 * win * win + 10 AND wv >= win AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.tid = k.tid AND e.bid = k.bid AND e.t = k.v AND kind = 'start') UNION ALL SELECT tid, bid, v, sink, round(wv - wout, 6), 'end' FROM kv k WHERE wv >= 10 * wout * wout + 10 AND wv >= wout AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.tid = k.tid AND e.bid = k.bid AND e.s = k.v AND kind = 'end')",
    ),
    "graph_closest_path": (graph_closest_path, f"WITH RECURSIVE {LAY}, r AS (SELECT DISTINCT s AS v, CAST(0 AS BIGINT) AS x FROM lay WHERE s LIKE '0:%' UNION ALL SELECT t, x + w FROM r JOIN lay ON v = s) SELECT v, min(x) AS value FROM r GROUP BY v"),
    "thin_chains": (thin_chains, BASE + PEX + ", tc AS (SELECT *, CASE WHEN l - lag(r) OVER (PARTITION BY tid, bid ORDER BY l) <= 2000 THEN 0 ELSE 1 END AS new FROM pex WHERE w <= 3.0), tk AS (SELECT *, sum(new) OVER (PARTITION BY tid, bid ORDER BY l) AS kk FROM tc) SELECT tid, bid, min(l) AS l, max(r) AS r, count(*) AS n FROM tk GROUP BY tid, bid, kk HAVING count(*) >= 2"),
    "locus_graph_components": (
        locus_graph_components,
        BASE.replace("WITH ", "WITH RECURSIVE ", 1) + PEX + ", und AS (SELECT tid, bid, s AS a, t AS b FROM inn UNION SELECT tid, bid, t, s FROM inn), rea AS (SELECT tid, bid, a AS v, a AS root FROM und UNION SELECT u.tid, u.bid, u.b, x.root FROM rea x JOIN und u ON u.tid = x.tid AND u.bid = x.bid AND u.a = x.v), lab AS (SELECT tid, bid, v, min(root) AS label FROM rea GROUP BY tid, bid, v) SELECT tid, bid, label, s, t, round(w, 6) AS w FROM (SELECT i.tid, i.bid, label, s, t, w, row_number() OVER (PARTITION BY i.tid, i.bid, label ORDER BY w DESC, s DESC, t DESC) AS kk FROM inn i JOIN lab ON lab.tid = i.tid AND lab.bid = i.bid AND lab.v = i.s) WHERE kk = 1 AND w >= 1.5",
    ),
    "linked_paths": (
        linked_paths,
        BASE + PEX + f", prs AS (SELECT tid, bid, pos, rpos, np, nr, count(*) AS n FROM (SELECT *, lead(pos) OVER w AS np, lead(rpos) OVER w AS nr FROM bnd WINDOW w AS (PARTITION BY tid, xs ORDER BY {ORD})) WHERE np > rpos GROUP BY ALL), "
        "loc AS (SELECT p.tid, p.bid, n, sink - 1 AS m, a.v + CASE WHEN pos - a.l > 3 AND a.r - pos < 3 THEN 1 ELSE 0 END AS f1, b.v - CASE WHEN b.r - rpos > 3 AND rpos - b.l <= 3 THEN 1 ELSE 0 END AS l1, c.v + CASE WHEN np - c.l > 3 AND c.r - np < 3 THEN 1 ELSE 0 END AS f2, e.v - CASE WHEN e.r - nr > 3 AND nr - e.l <= 3 THEN 1 ELSE 0 END AS l2 "
        "FROM prs p JOIN snk ON snk.tid = p.tid AND snk.bid = p.bid JOIN pex a ON a.tid = p.tid AND a.bid = p.bid AND pos >= a.l AND pos < a.r JOIN pex b ON b.tid = p.tid AND b.bid = p.bid AND rpos - 1 >= b.l AND rpos - 1 < b.r JOIN pex c ON c.tid = p.tid AND c.bid = p.bid AND np >= c.l AND np < c.r JOIN pex e ON e.tid = p.tid AND e.bid = p.bid AND nr - 1 >= e.l AND nr - 1 < e.r) "
        "SELECT tid, bid, path, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT tid, bid, n, list_concat(range(f1, l1 + 1), range(f2, l2 + 1)) AS way, array_to_string(way, '>') AS path FROM loc WHERE f1 <= m AND l1 >= 1 AND f2 <= m AND l2 >= 1 AND f1 <= l1 AND l1 < f2 AND f2 <= l2) WHERE len(way) >= 3 GROUP BY tid, bid, path",
    ),
    "bridge_paths": (bridge_paths, None),
    "decomposition": (decomposition, None),
    "path_to_exons": (path_to_exons, None),
    "run_length_codec": (run_length_codec, "WITH v AS (SELECT DISTINCT user_id, event_id % 97 AS x FROM events), g AS (SELECT user_id, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS k FROM v) SELECT user_id, CAST(count(DISTINCT k) AS INT) AS n_runs, true AS same FROM g GROUP BY user_id"),
}
