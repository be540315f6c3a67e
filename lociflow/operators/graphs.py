"""Weighted graphs as edge tables (s, t, w, and keys where there are many): degrees, paths, splice graphs and their cleaning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators.bins import WIDTH, within
from lociflow.operators.coverage import segments
from lociflow.sources.shared import drop_written, written

#: How many paths to a vertex are told apart (a fixed value).
MOST_PATHS = 9_999_999_999


def degrees(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, v, in_degree, out_degree, in_weight, out_weight of each vertex with an edge."""
    ends = edges.select(*keys, F.col("t").alias("v"), F.lit(1).alias("i"), F.col("w").alias("wi"), F.lit(0).alias("o"), (F.col("w") * 0).alias("wo")).unionByName(edges.select(*keys, F.col("s").alias("v"), F.lit(0).alias("i"), (F.col("w") * 0).alias("wi"), F.lit(1).alias("o"), F.col("w").alias("wo")))
    return ends.groupBy(*keys, "v").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("wi").alias("in_weight"), F.sum("wo").alias("out_weight"))


def heaviest_out_edge(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, s, t, w: each vertex's heaviest out-edge, the one with the highest target on ties."""
    return edges.groupBy(*keys, "s").agg(F.max(F.struct("w", "t")).alias("_m")).select(*keys, "s", "_m.t", "_m.w")


def chain_edges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """s, t, w: how often a label follows another within keys."""
    return rows.select(F.col(label).alias("s"), F.lead(label).over(Window.partitionBy(*keys).orderBy(*order)).alias("t")).where("t IS NOT NULL").groupBy("s", "t").agg(F.count(F.lit(1)).alias("w"))


def kmers(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, k: int) -> DataFrame:
    """path (array of k labels in a row), cnt."""
    w = Window.partitionBy(*keys).orderBy(*order)
    parts = [F.lead(label, i).over(w) for i in range(k)]
    whole = rows.select(F.array(*parts).alias("path"), parts[-1].alias("_last")).where("_last IS NOT NULL")
    return whole.groupBy("path").agg(F.count(F.lit(1)).alias("cnt"))


def propagate(sources: DataFrame, edges: DataFrame, rounds: int, how: str) -> DataFrame:
    """v, value over the vertices that sources (v, value) reach in `rounds` steps of layered edges (s, t, w; each leads one layer on).

    count: how many paths lead there; widest: the largest smallest weight of a path; hops: the fewest steps; closest: the least sum of weights. Each step is one join and one aggregate by vertex,
    never a row for each path.
    """
    step = {"count": lambda: F.sum("value"), "widest": lambda: F.max(F.least("value", "w")), "hops": lambda: F.min(F.col("value") + 1), "closest": lambda: F.min(F.col("value") + F.col("w"))}[how]
    reached = front = sources.select("v", "value")
    for _ in range(rounds):
        front = front.join(edges, F.col("v") == F.col("s")).groupBy(F.col("t").alias("v")).agg(step().alias("value"))
        reached = reached.unionByName(front)
    merge = {"count": F.sum, "widest": F.max, "hops": F.min, "closest": F.min}[how]
    return reached.groupBy("v").agg(merge("value").alias("value"))


def all_paths(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, s, t, hops, depth, paths, widest of each two vertices between which edges (keys, s, t, w; without cycles) lead: the fewest and most edges of a path, how many paths there are (MOST_PATHS at
    most), and the largest smallest weight of one.

    Path lengths double: a round joins the paths of exactly n edges with those of up to n, so a locus whose longest path has d edges takes log2(d) rounds, all loci at once. Rows are pairs of
    vertices, never paths; each round's two tables are in the shared folder, those of the round before go.
    """
    keys, cap = list(keys), F.lit(MOST_PATHS).cast("decimal(38,0)")
    number = lambda x: F.least(F.sum(x.cast("decimal(38,0)")), cap).cast("long").alias("paths")
    ends = [*keys, "s", "t"]
    ways = edges.groupBy(*ends).agg(F.count(F.lit(1)).alias("paths"), F.max(F.col("w").cast("double")).alias("widest"))
    exact, upto, n = written(ways, "exact"), written(ways.select(*ends, F.lit(1).alias("hops"), F.lit(1).alias("depth"), "paths", "widest"), "paths"), 1
    while True:
        ahead = exact.select(*keys, "s", F.col("t").alias("_m"), F.col("paths").alias("_n"), F.col("widest").alias("_w"))
        times = F.col("_n").cast("decimal(19,0)") * F.col("paths").cast("decimal(19,0)")
        joined = lambda df: ahead.join(df.withColumnRenamed("s", "_m"), [*keys, "_m"])  # noqa: E731, B023
        longer = written(joined(upto).groupBy(*ends).agg((F.min("hops") + n).alias("hops"), (F.max("depth") + n).alias("depth"), number(times), F.max(F.least("_w", "widest")).alias("widest")), "longer")
        if longer.isEmpty():
            drop_written(exact, longer)
            return upto
        both = upto.unionByName(longer).groupBy(*ends).agg(F.min("hops").alias("hops"), F.max("depth").alias("depth"), number(F.col("paths")), F.max("widest").alias("widest"))
        before = exact, upto, longer
        upto, exact, n = written(both, "paths"), written(joined(exact).groupBy(*ends).agg(number(times), F.max(F.least("_w", "widest")).alias("widest")), "exact"), 2 * n
        drop_written(*before)


def layers(starts: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, v, hops, depth, paths, widest of each vertex that the starts (keys, v) reach over edges (keys, s, t, w; without cycles): as all_paths() gives them, over all starts; of the starts
    themselves also the path of no edge, with widest null.

    Depths order a locus's vertices so that each edge leads upward.
    """
    own, cap = starts.select(*keys, "v").distinct(), F.lit(MOST_PATHS).cast("decimal(38,0)")
    reached = all_paths(edges, keys).join(own.withColumnRenamed("v", "s"), [*keys, "s"], "left_semi").withColumnRenamed("t", "v").drop("s")
    here = own.select(*keys, "v", F.lit(0).alias("hops"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("paths"), F.lit(None).cast("double").alias("widest"))
    return reached.unionByName(here).groupBy(*keys, "v").agg(F.min("hops").alias("hops"), F.max("depth").alias("depth"), F.least(F.sum(F.col("paths").cast("decimal(38,0)")), cap).cast("long").alias("paths"), F.max("widest").alias("widest"))


def on_every_path(pairs: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, s, t, v: the vertices that all paths from s to t (ends: keys, s, t) pass, by the numbers of paths (pairs: all_paths()) before and behind them; s and t themselves are left out.

    A pair of ends with MOST_PATHS or more paths is left out, as its number isn't known.
    """
    whole = ends.select(*keys, "s", "t").join(pairs.select(*keys, "s", "t", F.col("paths").alias("_all")), [*keys, "s", "t"]).where(F.col("_all") < MOST_PATHS)
    before = whole.join(pairs.select(*keys, "s", F.col("t").alias("v"), F.col("paths").alias("_n")), [*keys, "s"])
    both = before.join(pairs.select(*keys, F.col("s").alias("v"), "t", F.col("paths").alias("_m")), [*keys, "v", "t"])
    return both.where(F.col("_n").cast("decimal(19,0)") * F.col("_m").cast("decimal(19,0)") == F.col("_all")).select(*keys, "s", "t", "v")


def split_components(vertices: DataFrame, edges: DataFrame, labels: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Each component of the graphs without source and sink as a graph of its own: vertices (keys, label, v, n: its new number, from 1, l, r, w) and edges (keys, label, s, t, w, kind) between new numbers.

    labels (keys, v, label) hold the vertices with an inner edge; one without is a component itself. 0 is each component's source, one more than its vertices' number its sink.
    """
    keys = list(keys)
    own = vertices.join(labels.select(*keys, "v", "label"), [*keys, "v"], "left").withColumn("label", F.coalesce("label", "v"))
    member = Window.partitionBy(*keys, "label")
    own = written(own.withColumns({"n": F.row_number().over(member.orderBy("v")), "_size": F.count(F.lit(1)).over(member).cast("int")}), "members")
    end = lambda c: own.select(*keys, F.col("v").alias(c), F.col("n").alias(f"_{c}"), F.col("label").alias(f"_{c}l"), F.col("_size").alias(f"_{c}n"))
    both = edges.join(end("s"), [*keys, "s"], "left").join(end("t"), [*keys, "t"], "left").where("_s IS NOT NULL OR _t IS NOT NULL")
    copied = both.select(*keys, F.coalesce("_sl", "_tl").alias("label"), F.coalesce("_s", F.lit(0)).alias("s"), F.coalesce("_t", F.col("_sn") + 1).alias("t"), "w", "kind")
    return own.select(*keys, "label", "v", "n", "l", "r", "w"), copied


def path_edges_valid(paths: DataFrame, edges: DataFrame, path: str = "path") -> DataFrame:
    """paths with valid: whether it has two edges at least and each step is an edge."""
    steps = paths.select(path, F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(F.col(path), i).alias("s"), F.try_element_at(F.col(path), i + 1).alias("t")))).alias("_i", "_e"))
    known = steps.join(edges.select("s", "t"), (F.col("_e.s") == F.col("s")) & (F.col("_e.t") == F.col("t"))).groupBy(path).agg(F.count(F.lit(1)).alias("_n"))
    return paths.join(known, path, "left").withColumn("valid", (F.size(path) > 2) & (F.coalesce("_n", F.lit(0)) == F.size(path) - 1)).drop("_n")


def path_overlaps(paths: DataFrame) -> DataFrame:
    """i, j: pairs of paths (id, path) where i's tail of all but its first vertex is j's head."""
    tail, head = F.slice("path", 2, F.size("path")), F.slice("path", 1, F.size("path") - 1)
    return paths.select(F.col("id").alias("i"), tail.alias("m")).join(paths.select(F.col("id").alias("j"), head.alias("m")), "m").where("i <> j").select("i", "j")


def splice_graph(exons: DataFrame, junctions: DataFrame, keys: Sequence[str], floor: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Vertices (keys, v, l, r, w) and edges (keys, s, t, w, kind) of each locus, from exons (keys, l, r, w) and junctions (keys, lpos, rpos, cnt).

    Vertex 0 is the source, one more than the exons' number the sink. A junction joins the exon that ends at it with the one that begins there. An exon
    that touches no other on a side, and no junction there, starts or ends transcripts; touching exons are adjacent with the smaller of their weights.
    """
    w = Window.partitionBy(*keys).orderBy("l")
    v = exons.withColumns({"w": F.greatest(F.col("w").cast("double"), F.lit(floor)), "v": F.row_number().over(w), "_before": F.lag("r").over(w), "_after": F.lead("l").over(w), "_next_w": F.lead("w").over(w)})
    n = exons.groupBy(*keys).agg((F.count(F.lit(1)) + 1).cast("int").alias("sink"))
    spliced = junctions.select(*keys, F.col("lpos").alias("r"), F.col("rpos").alias("_to"), F.col("cnt").cast("double").alias("_cnt")).join(v.select(*keys, "r", F.col("v").alias("s")), [*keys, "r"])
    spliced = spliced.join(v.select(*keys, F.col("l").alias("_to"), F.col("v").alias("t")), [*keys, "_to"]).select(*keys, "s", "t", F.col("_cnt").alias("w"), F.lit("junction").alias("kind"))
    adjacent = v.where("_after = r").select(*keys, F.col("v").alias("s"), (F.col("v") + 1).alias("t"), F.least("w", F.greatest(F.col("_next_w").cast("double"), F.lit(floor))).alias("w"), F.lit("adjacent").alias("kind"))
    inner = spliced.unionByName(adjacent)
    starts = v.join(inner.select(*keys, F.col("t").alias("v")).distinct(), [*keys, "v"], "left_anti").select(*keys, F.lit(0).alias("s"), F.col("v").alias("t"), "w", F.lit("start").alias("kind"))
    ends = v.join(inner.select(*keys, F.col("s").alias("v")).distinct(), [*keys, "v"], "left_anti").join(n, list(keys)).select(*keys, F.col("v").alias("s"), F.col("sink").alias("t"), "w", F.lit("end").alias("kind"))
    return v.select(*keys, "v", "l", "r", "w"), inner.unionByName(starts).unionByName(ends)


def annotation_graph(exons: DataFrame, keys: Sequence[str], bin_width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Vertices (keys, v, l, r, w) and edges (keys, s, t, w, kind) of each gene, from the exons (keys, id, l, r, coverage) of reference transcripts.

    Exons are cut at each other's ends; a vertex weighs the whole parts of the coverages of the transcripts over it, each 1 at least. Each transcript goes from the source (0) over its
    vertices to the sink, one more than the vertices' number, and adds its weight to each edge.
    """
    rows = exons.select(*keys, "id", F.col("l").alias("_l"), F.col("r").alias("_r"), F.greatest(F.floor("coverage"), F.lit(1)).cast("int").alias("_c"))
    parts = segments(rows, keys, "_l", "_r", bin_width, F.col("_c"))
    v = written(parts.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("p")).alias("v"), F.col("p").alias("l"), F.col("q").alias("r"), F.col("cov").cast("double").alias("w")), "annotated")
    sink = v.groupBy(*keys).agg((F.max("v") + 1).alias("_sink"))
    own = Window.partitionBy(*keys, "id").orderBy("v")
    steps = within(v, F.col("l"), rows, keys, "_l", "_r", bin_width).withColumns({"_to": F.lead("v").over(own), "_at": F.lead("l").over(own), "_from": F.lag("v").over(own)})
    first = steps.where("_from IS NULL").select(*keys, F.lit(0).alias("s"), F.col("v").alias("t"), "_c", F.lit("start").alias("kind"))
    inner = steps.where("_to IS NOT NULL").select(*keys, F.col("v").alias("s"), F.col("_to").alias("t"), "_c", F.when(F.col("_at") == F.col("r"), "adjacent").otherwise("junction").alias("kind"))
    last = steps.where("_to IS NULL").join(sink, list(keys)).select(*keys, F.col("v").alias("s"), F.col("_sink").alias("t"), "_c", F.lit("end").alias("kind"))
    return v, first.unionByName(inner).unionByName(last).groupBy(*keys, "s", "t", "kind").agg(F.sum("_c").cast("double").alias("w"))


def landmarks(vertices: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind, l, r: a graph's junctions (from l to r), the places where it starts (r) and where it ends (l); -1 for the other side."""
    at = edges.where("kind <> 'adjacent'").join(vertices.select(*keys, F.col("v").alias("s"), F.col("r").alias("_r")), [*keys, "s"], "left").join(vertices.select(*keys, F.col("v").alias("t"), F.col("l").alias("_l")), [*keys, "t"], "left")
    return at.select(*keys, "kind", F.coalesce(F.when(F.col("kind") != "start", F.col("_r")), F.lit(-1)).alias("l"), F.coalesce(F.when(F.col("kind") != "end", F.col("_l")), F.lit(-1)).alias("r"))


def graph_stats(vertices: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, vertices, edges, junctions (how many), needed (how many paths make up any flow on the graph with its source and sink: edges less vertices, plus two), vertex_weight, edge_weight (means), s, t, w (the heaviest edge, the last on ties) of each locus.

    `vertices` holds neither source nor sink.
    """
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "junction").alias("junctions"), F.avg("w").alias("edge_weight"), F.max(F.struct("w", "s", "t")).alias("_m"))
    v = vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("vertices"), F.avg("w").alias("vertex_weight"))
    return v.join(e, list(keys)).select(*keys, "vertices", "edges", "junctions", (F.col("edges") - (F.col("vertices") + 2) + 2).alias("needed"), "vertex_weight", "edge_weight", "_m.s", "_m.t", "_m.w")


def worth_solving(vertices: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys of the loci with an edge and with a vertex (regional: boolean) that isn't regional."""
    return vertices.groupBy(*keys).agg(F.bool_and("regional").alias("_r")).where("NOT _r").select(*keys).join(edges.select(*keys).distinct(), list(keys), "left_semi")


def contained_paths(paths: DataFrame, members: DataFrame) -> DataFrame:
    """Paths (path, cnt) all of whose vertices are members (v, n: their new numbers), with numbers for vertices: path, cnt."""
    steps = paths.select("path", "cnt", F.posexplode("path").alias("_i", "v")).join(members.select("v", "n"), "v", "left")
    whole = steps.groupBy("path", "cnt").agg(F.array_sort(F.collect_list(F.struct("_i", "n"))).alias("_e"), F.bool_and(F.col("n").isNotNull()).alias("_ok")).where("_ok")
    return whole.select(F.transform("_e", lambda x: x["n"]).alias("path"), "cnt")


def graph_lines(vertices: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, line_no, value: each graph as text. The number of vertices with source and sink, then "name weight length" of each, then "source target weight length" of each edge, by number."""
    number = lambda w: F.format_string("%.4f", w.cast("double"))
    n = vertices.groupBy(*keys).agg((F.count(F.lit(1)) + 2).cast("int").alias("_n"))
    ends = n.select(*keys, F.explode(F.array(F.lit(0), F.col("_n") - 1)).alias("v"), F.lit(0.0).alias("w"), F.lit(0).alias("size"))
    named = vertices.select(*keys, "v", F.col("w").cast("double").alias("w"), (F.col("r") - F.col("l")).alias("size")).unionByName(ends)
    head = n.select(*keys, F.lit(0).alias("line_no"), F.col("_n").cast("string").alias("value"))
    body = named.select(*keys, (F.col("v") + 1).alias("line_no"), F.concat_ws(" ", F.concat(F.lit("v"), "v"), number(F.col("w")), F.col("size").cast("string")).alias("value"))
    lines = edges.join(n, list(keys)).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("s", "t", "kind")))
    rows = lines.select(*keys, (F.col("_n") + F.col("_k")).alias("line_no"), F.concat_ws(" ", F.col("s").cast("string"), F.col("t").cast("string"), number(F.col("w")), F.lit("1")).alias("value"))
    return head.unionByName(body).unionByName(rows)


def parse_graph(lines: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices (keys, v, name, w, length) and edges (keys, s, t, w, length) of graphs written by graph_lines()."""
    f = F.split("value", " ")
    n = lines.where("line_no = 0").select(*keys, F.col("value").cast("int").alias("_n"))
    rows = lines.where("line_no > 0").join(n, list(keys))
    v = rows.where("line_no <= _n").select(*keys, (F.col("line_no") - 1).alias("v"), f[0].alias("name"), f[1].cast("double").alias("w"), f[2].cast("int").alias("length"))
    e = rows.where("line_no > _n").select(*keys, f[0].cast("int").alias("s"), f[1].cast("int").alias("t"), f[2].cast("double").alias("w"), f[3].cast("int").alias("length"))
    return v, e


def vertex_rules(vertices: DataFrame, edges: DataFrame, keys: Sequence[str], short: int = 20, thin: float = 2.0) -> DataFrame:
    """keys, v, rule of the vertices that one round of cleaning marks: 'small exon' and 'intron contamination'.

    A small exon touches no other and starts or ends transcripts; a contaminated intron is a thin vertex between two that it touches and that a heavier junction joins.
    """
    adjacent = edges.where("kind = 'adjacent'")
    touching = adjacent.select(*keys, F.col("s").alias("v")).unionByName(adjacent.select(*keys, F.col("t").alias("v"))).distinct()
    ends = edges.where("kind IN ('start', 'end')").select(*keys, F.when(F.col("kind") == "start", F.col("t")).otherwise(F.col("s")).alias("v")).distinct()
    small = vertices.where(F.col("r") - F.col("l") < short).join(touching, [*keys, "v"], "left_anti").join(ends, [*keys, "v"], "left_semi").select(*keys, "v", F.lit("small exon").alias("rule"))
    single = degrees(edges, keys).where("in_degree = 1 AND out_degree = 1").select(*keys, "v")
    into, out = adjacent.select(*keys, F.col("s").alias("a"), F.col("t").alias("v")), adjacent.select(*keys, F.col("s").alias("v"), F.col("t").alias("b"))
    over = edges.where("kind = 'junction'").select(*keys, F.col("s").alias("a"), F.col("t").alias("b"), F.col("w").alias("we"))
    inside = vertices.where(F.col("w") <= thin).join(single, [*keys, "v"]).join(into, [*keys, "v"]).join(out, [*keys, "v"]).join(over, [*keys, "a", "b"]).where("w <= we")
    return small.unionByName(inside.select(*keys, "v", F.lit("intron contamination").alias("rule")))


def weak_junctions(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, s, t of the junctions far lighter than what is adjacent before the exon they leave and behind the one they enter (at least 2 w**2 + 18)."""
    adjacent = edges.where("kind = 'adjacent'")
    into = adjacent.groupBy(*keys, F.col("t").alias("s")).agg(F.max("w").alias("before"))
    out = adjacent.groupBy(*keys, F.col("s").alias("t")).agg(F.max("w").alias("behind"))
    limit = 2 * F.col("w") * F.col("w") + 18
    return edges.where("kind = 'junction'").join(into, [*keys, "s"]).join(out, [*keys, "t"]).where((F.col("before") >= limit) & (F.col("behind") >= limit)).select(*keys, "s", "t")


def extended_boundaries(vertices: DataFrame, edges: DataFrame, keys: Sequence[str], sinks: DataFrame | None = None) -> DataFrame:
    """New start and end edges (keys, s, t, w, kind) of vertices far heavier than all that enters or leaves them (at least 10 e**2 + 10)."""
    sink = vertices.groupBy(*keys).agg((F.max("v") + 1).alias("sink")) if sinks is None else sinks
    known = vertices.select(*keys, "v", F.col("w").alias("wv")).join(degrees(edges, keys), [*keys, "v"]).join(sink, list(keys))
    enough = lambda e: (F.col("wv") >= 10 * F.col(e) * F.col(e) + 10) & (F.col("wv") >= F.col(e))
    started = edges.where("kind = 'start'").select(*keys, F.col("t").alias("v"))
    ended = edges.where("kind = 'end'").select(*keys, F.col("s").alias("v"))
    starts = known.where(enough("in_weight")).join(started, [*keys, "v"], "left_anti").select(*keys, F.lit(0).alias("s"), F.col("v").alias("t"), (F.col("wv") - F.col("in_weight")).alias("w"), F.lit("start").alias("kind"))
    ends = known.where(enough("out_weight")).join(ended, [*keys, "v"], "left_anti").select(*keys, F.col("v").alias("s"), F.col("sink").alias("t"), (F.col("wv") - F.col("out_weight")).alias("w"), F.lit("end").alias("kind"))
    return starts.unionByName(ends)


def heaviest_edges(edges: DataFrame, labels: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """keys, label, s, t, w: the heaviest inner edge of each component (labels: keys, v, label), if it weighs `least`."""
    of = edges.where("kind IN ('junction', 'adjacent')").join(labels.withColumnRenamed("v", "s"), [*keys, "s"])
    return of.groupBy(*keys, "label").agg(F.max(F.struct("w", "s", "t")).alias("_m")).where(F.col("_m.w") >= least).select(*keys, "label", "_m.s", "_m.t", "_m.w")


def thin_chains(vertices: DataFrame, keys: Sequence[str], most: float = 2.0, reach: int = 2000, least: int = 5) -> DataFrame:
    """keys, l, r, n: runs of at least `least` vertices no heavier than `most`, each within `reach` of the one before."""
    w = Window.partitionBy(*keys).orderBy("l")
    cut = vertices.where(F.col("w") <= most).withColumn("_new", F.when(F.col("l") - F.lag("r").over(w) <= reach, 0).otherwise(1))
    return cut.withColumn("_k", F.sum("_new").over(w)).groupBy(*keys, "_k").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_k")


def disconnected(edges: DataFrame, vertices: DataFrame, rounds: int, source: object, sink: object) -> DataFrame:
    """v: vertices that the source doesn't reach, or that don't reach the sink, within `rounds` steps."""
    spark_one = lambda v: vertices.where(F.col("v") == F.lit(v)).select("v", F.lit(0).cast("long").alias("value"))
    there = propagate(spark_one(source), edges, rounds, "hops").select("v")
    back = propagate(spark_one(sink), edges.select(F.col("t").alias("s"), F.col("s").alias("t"), "w"), rounds, "hops").select("v")
    return vertices.select("v").join(there.intersect(back), "v", "left_anti")


def random_dag(spark, n: int, m: int, seed: int, most: int = 20) -> DataFrame:
    """s, t, w: m random upward edges at most among n vertices, equal for equal seeds."""
    a, b = F.floor(F.rand(seed) * n).cast("int"), F.floor(F.rand(seed + 1) * n).cast("int")
    drawn = spark.range(m).select(a.alias("a"), b.alias("b"), (F.floor(F.rand(seed + 2) * most) + 1).cast("double").alias("w")).where("a <> b")
    return drawn.groupBy(F.least("a", "b").alias("s"), F.greatest("a", "b").alias("t")).agg(F.max("w").alias("w"))


def _widest(edges: dict[tuple[int, int], float], through: list[int], sink: int) -> tuple[list[int], float]:
    """The path from 0 to sink over the vertices `through`, in order, whose lightest edge is heaviest."""
    into: dict[int, list[int]] = {}
    for s, t in sorted(edges):
        into.setdefault(t, []).append(s)
    best: dict[int, tuple[float, int]] = {0: (np.inf, -1)}
    for v in sorted(into):
        if gate := [x for x in through if x < v]:
            ways = [s for s in into[v] if s >= gate[-1]]
        else:
            ways = into[v]
        found = [(min(best[s][0], edges[s, v]), s) for s in ways if s in best]
        if found:
            best[v] = max(found)
    if sink not in best:
        return [], 0.0
    path = [sink]
    while path[-1]:
        path.append(best[path[-1]][1])
    path.reverse()
    return (path, best[sink][0]) if set(through) <= set(path) else ([], 0.0)


def peel(edges: dict[tuple[int, int], float], phased: list[list[int]], sink: int, least: float) -> list[tuple[list[int], float]]:
    """Paths from 0 to sink: first the widest through each phased list, then the widest of all, each taken off the edges, down to a width of `least`."""
    out = []
    for through in [*phased, *([] for _ in range(len(edges)))]:
        path, width = _widest(edges, through, sink)
        if not path or width < least:
            if not through:
                break
            continue
        out.append((path, width))
        for step in zip(path, path[1:]):
            edges[step] -= width
            if edges[step] <= 1e-9:
                del edges[step]
    return out


def decompose(edges: DataFrame, keys: Sequence[str], phasing: DataFrame | None = None, least: float = 1.5) -> DataFrame:
    """keys, k, path, abundance: each locus's graph as weighted paths from its source to its sink, those that phasing (keys, path, cnt) shows first.

    The locus is the unit of work; hits have become counts by then, so a group's size is that of its graph. Paths come in one order whatever the input's.
    """
    own = [F.col(k) for k in keys]
    graphs = edges.groupBy(*own).agg(F.collect_list(F.struct("s", "t", F.col("w").cast("double").alias("w"))).alias("edges"))
    phases = phasing.groupBy(*own).agg(F.collect_list(F.struct("cnt", "path")).alias("phased")) if phasing is not None else None
    packed = graphs.join(phases, list(keys), "left") if phases is not None else graphs.withColumn("phased", F.lit(None).cast("array<struct<cnt:bigint,path:array<int>>>"))

    def run(batches):
        for pdf in batches:
            rows = []
            for at, row in zip(pdf[list(keys)].itertuples(index=False), pdf.itertuples()):
                graph = {(e["s"], e["t"]): e["w"] for e in row.edges}
                phased = [list(p["path"]) for p in sorted(row.phased, key=lambda p: (-p["cnt"], list(p["path"])))] if row.phased is not None else []
                rows += [(*at, k, path, float(w)) for k, (path, w) in enumerate(peel(graph, phased, max(t for _, t in graph), least))]
            yield pd.DataFrame(rows, columns=[*keys, "k", "path", "abundance"])

    kinds = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)
    return packed.select(*keys, "edges", "phased").mapInPandas(run, f"{kinds}, k int, path array<int>, abundance double")
